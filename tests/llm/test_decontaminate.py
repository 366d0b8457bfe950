import hashlib
import re

import pytest

from corpusrules.llm import decontaminate as op

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(texts, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item) if item is not None else None)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for run, ids in windows.items():
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    found |= ids
        found = sorted(x for x in found if x is not None)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


TEN = "One two, three four five six seven eight nine ten"
ITEMS = [(7, TEN + " eleven"), (10, "Ähnlich wie"), (2, None), (3, ""), (4, "!!"), (None, "null item words"), (7, TEN + " eleven"), (21, "twice twice")]
TEXTS = [
    None, "", "...", TEN, "x " + TEN.upper() + " ELEVEN twelve", "one two three four five six seven eight nine", "ähnlich-WIE Ähnlich wie", "Ä hnlich wie", "null item words",
    "twice twice twice", TEN + " " + TEN, "a\x00one two", "Ω " * 3000 + "twice twice", "xtwice twicex",
]


@pytest.mark.parametrize("most", [op.MAX_AUTOMATON_BYTES, 40])
def test_against_brute_force(docs, rows, most):
    items = rows("item_id long, text string, doc_id int", *((*i, 0) for i in ITEMS))
    table = docs(*TEXTS)
    got = {r["doc_id"]: tuple(r)[1:] for r in op.digest(op.decontaminate(table, items, most=most)).collect()}
    expected = brute(TEXTS, ITEMS)
    assert [got[k] for k in range(len(TEXTS))] == expected
    clean = op.without_contaminated(table, items, most=most)
    assert sorted(r["doc_id"] for r in clean.collect()) == [k for k, e in enumerate(expected) if not e[-1]]


def test_long_text_full_of_hits(docs, rows):
    """Ten million characters of one benchmark passage, repeated."""
    items = rows("item_id long, text string", (1, TEN))
    (row,) = op.digest(op.decontaminate(docs((TEN + " ") * 200_000), items)).collect()
    assert row["n_words"] == row["n_hit"] == 2_000_000 and row["contaminated"]


def test_spans_point_into_the_original(docs, rows):
    items = rows("item_id long, text string", *ITEMS)
    text = "Über: ONE two, three four five six seven eight nine ten -- end"
    (row,) = op.decontaminate(docs(text), items).collect()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["ONE two, three four five six seven eight nine ten"]
    assert row["items"] == ["7"]


def test_filter_keeps_rows_and_columns(docs, rows):
    items = rows("item_id long, text string", *ITEMS)
    table = docs(*TEXTS)
    kept = op.without_contaminated(table, items)
    assert kept.columns == table.columns
    clean = [k for k, e in enumerate(brute(TEXTS, ITEMS)) if not e[-1]]
    assert sorted(r["doc_id"] for r in kept.collect()) == clean


def test_empty_tables(docs, rows):
    items = rows("item_id long, text string", *ITEMS)
    assert op.decontaminate(docs(), items).collect() == []
    none = rows("item_id long, text string")
    assert [r["n_hit"] for r in op.decontaminate(docs(TEN, None), none).collect()] == [0, 0]
