import random
import re
from collections import Counter
from pathlib import Path

import pytest

from corpusrules.llm import packing, tokens
from corpusrules.llm.catalog import QUERIES

pytestmark = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="vocabulary files not present")

TEXTS = [None, "", "a", "Hello, world!", "Hello, world!", "ñandú  x\n\n y<|endoftext|>", "the cat " * 3000, " ", "\x00", "漢字かな" * 50]


@pytest.fixture(scope="module")
def encode():
    enc = tokens.encoding(Path(tokens.VOCABULARY).read_bytes())
    return lambda text: enc.encode_ordinary(text or "")


def test_encoding_round_trip(encode):
    enc = tokens.encoding(Path(tokens.VOCABULARY).read_bytes())
    assert all(enc.decode(encode(t)) == t for t in TEXTS if t is not None)


BLANK_RUNS = [" " * 2_000_000, "\n" * 2_000_000, " " * 2_000_000 + "word", "a" + "\u3000" * 500_000 + "\tb" + " " * 1_500_000]


def test_long_runs_are_cut_as_the_pattern_cuts_them():
    """The same ids with runs of two and more cut out as with none, whatever stands around them; and where the pattern alone would fail."""
    enc = tokens.encoding(Path(tokens.VOCABULARY).read_bytes())
    short = re.compile(tokens.BLANKS.pattern.replace("100000", "2"))
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\r\n", "\t", "\xa0", "\u2003", "\x85", "\x1c", "a", "Zoë", "7", "'s", "'", "!!", "漢", "…", "\u200b"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        assert tokens.encoded(enc, text, short) == enc.encode_ordinary(text), repr(text)
    run = " " * 60_000
    assert tokens.encoded(enc, f"a{run}b{run}", short) == enc.encode_ordinary(f"a{run}b{run}")
    for text in BLANK_RUNS:
        assert enc.decode(tokens.encoded(enc, text)) == text


def test_long_runs_through_the_queries(spark, docs, tmp_path):
    enc = tokens.encoding(Path(tokens.VOCABULARY).read_bytes())
    docs(*BLANK_RUNS).write.parquet(f"{tmp_path}/documents.parquet")
    lengths = [len(tokens.encoded(enc, t)) for t in BLANK_RUNS]
    rows = QUERIES["op2_token_counts"](spark, str(tmp_path)).collect()
    assert {r["length"]: r["n_docs"] for r in rows} == dict(Counter(lengths))
    ends = QUERIES["op7_token_ids"](spark, str(tmp_path)).selectExpr("sum(cu_seqlens[size(cu_seqlens) - 1])").first()[0]
    assert ends == sum(lengths) + len(lengths)


@pytest.mark.parametrize("stripe", [2, 4096])
def test_histogram_and_sums(docs, encode, monkeypatch, stripe):
    monkeypatch.setattr(tokens, "STRIPE", stripe)
    lengths = [len(encode(t)) for t in TEXTS]
    sums = tokens.token_counts(docs(*TEXTS))
    got = {r["length"]: r for r in sums.collect()}
    assert {n: r["n_docs"] for n, r in got.items()} == dict(Counter(lengths))
    for n, r in got.items():
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["tokens_cut"] == sum(min(x, n) for x in lengths)
        assert r["share_up_to"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits = {r["context"]: r for r in tokens.at_limits(sums, [1, 5, 10**6]).collect()}
    for c, r in limits.items():
        assert (r["docs_within"], r["tokens"], r["tokens_kept"]) == (sum(x <= c for x in lengths), sum(lengths), sum(min(x, c) for x in lengths))
        assert r["tokens_lost"] == r["tokens"] - r["tokens_kept"]
    ranked = sorted(lengths)
    found = {r["share"]: r["length"] for r in tokens.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert found == {0.1: ranked[0], 0.5: ranked[4], 1.0: ranked[-1]}


def test_groups_and_empty(docs, encode):
    got = tokens.token_counts(docs("a", "a b", None, "a", source=["x", None, None, "x"]), by=["source"]).collect()
    assert sorted((str(r["source"]), r["length"], r["n_docs"], r["docs_at_least"]) for r in got) == [("None", 0, 1, 2), ("None", 2, 1, 1), ("x", 1, 2, 2)]
    assert tokens.token_counts(docs()).collect() == []


def test_registered_result_answers_limits_and_quantiles(spark, docs, encode, tmp_path):
    docs(*TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    lengths = sorted(len(encode(t)) for t in TEXTS)
    rows = QUERIES["op2_token_counts"](spark, str(tmp_path)).collect()
    assert {r["length"]: r["n_docs"] for r in rows} == dict(Counter(lengths)) and len(rows) == len(set(lengths))
    contexts = {c["context"]: c for r in rows for c in r["contexts"] or ()}
    assert sorted(contexts) == list(tokens.CONTEXTS) and sum(len(r["contexts"] or ()) for r in rows) == len(contexts)
    for c, r in contexts.items():
        kept = sum(min(x, c) for x in lengths)
        assert tuple(r)[1:] == (sum(x <= c for x in lengths), sum(lengths), kept, sum(lengths) - kept)
    assert {s: r["length"] for r in rows for s in r["quantiles"] or ()} == {s: next(x for k, x in enumerate(lengths, 1) if k / len(lengths) >= s) for s in tokens.SHARES}


def test_limits_come_from_suffix_sums(rows, docs, encode):
    """Sums that a recount of the histogram would contradict, limits twice, groups, limits below every length, no rows."""
    sums = rows("length long, n_docs long, docs_at_least long, tokens_at_least long", (4, None, 10, 100), (9, None, 3, 40))
    got = {r["context"]: tuple(r)[1:] for r in tokens.at_limits(sums, [3, 5, 5, 9]).collect()}
    assert got == {3: (0, 100, 30, 70, None), 5: (7, 100, 75, 25, 4), 9: (10, 100, 100, 0, 9)}
    by = tokens.token_counts(docs("a", "a b c d", "a b", "a", source=["x", None, None, "x"]), by=["source"])
    rows = tokens.answered(by, limits=[1, 3], shares=[0.5], by=["source"]).collect()
    assert {(r["source"], c["context"]): tuple(c)[1:] for r in rows for c in r["contexts"] or ()} == {("x", 1): (2, 2, 2, 0), ("x", 3): (2, 2, 2, 0), (None, 1): (0, 6, 2, 4), (None, 3): (1, 6, 5, 1)}
    assert {r["source"]: r["length"] for r in rows if r["quantiles"]} == {"x": 1, None: 2}
    empty = tokens.token_counts(docs())
    assert tokens.at_limits(empty, [1]).collect() == tokens.quantiles(empty, [0.5]).collect() == tokens.answered(empty).collect() == []


@pytest.mark.parametrize("length,group", [(16, 40), (64, 10**6), (1, 3)])
def test_packing_round_trip(docs, rows, encode, length, group):
    import numpy as np

    texts = TEXTS if length > 1 else TEXTS[:5]
    packed = packing.packed_rows(docs(*texts), length=length, group_tokens=group)
    for r in packed.collect():
        ids, positions = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        ends = r["cu_seqlens"]
        assert len(ids) == len(positions) == length and ends[0] == 0 and ends[-1] <= length
        assert all(a < b for a, b in zip(ends, ends[1:], strict=False)) and len(r["doc_ids"]) == len(r["starts"]) == len(ends) - 1
        for a, b in zip(ends, ends[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
        assert (ids[ends[-1] :] == packing.PAD).all() and positions[ends[-1] :].tolist() == list(range(length - ends[-1]))
    back = {r["id"]: r["tokens"] for r in packing.unpacked(packed).collect()}
    assert back == {k: [*encode(t), packing.END] for k, t in enumerate(texts)}


def test_packing_fills_rows(docs):
    packed = packing.packed_rows(docs(*["word " * (k % 50) for k in range(400)]).coalesce(1), length=128)
    used = sum(r["cu_seqlens"][-1] for r in packed.collect())
    assert used / (packed.count() * 128) > 0.99


def test_best_fit_decreasing_against_a_scan():
    import random

    rng = random.Random(0)
    for _ in range(200):
        capacity = rng.choice([1, 2, 7, 8, 16, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        space, loads = [], []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, s in enumerate(space) if s >= n]
            if fits:
                k = min(fits, key=lambda k: space[k])
                space[k] -= n
                loads[k] += n
            else:
                space.append(capacity - n)
                loads.append(n)
        got = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(k for row in got for k in row) == list(range(len(lengths)))
        assert sorted(sum(lengths[k] for k in row) for row in got) == sorted(loads)


def test_packing_edges(docs, rows):
    assert packing.packed_rows(docs()).collect() == []
    twins = rows("doc_id string, text string, line int", (None, "a", 1), ("x", "b", 1), ("x", "b", 1))
    got = packing.packed_rows(twins.coalesce(1), length=32).collect()
    assert len(got) == 1 and sorted(map(str, got[0]["doc_ids"])) == ["None", "x", "x"]
    with pytest.raises(ValueError):
        packing.packed_rows(docs("a"), length=0)
