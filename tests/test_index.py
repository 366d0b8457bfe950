"""Trigram conditions, search over an index, and gates for many searches: the same rows as searching everything."""

import re
import tracemalloc
import warnings

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusrules.functions import trigrams as G
from corpusrules.operators.search import search_content
from corpusrules.operators.search_table import gate, search_many
from corpusrules.rulepack import Search
from corpusrules.sources import index as X

ROWS = [
    (1, "a.txt", "The License\nis here\nno"),
    (1, "b.py", "token = 'abc'\nKelvin Kelvin\nſtrasse LICENCE"),
    (1, "c.txt", None),
    (2, "d.txt", ""),
    (2, "e.txt", "Straße und Ärger\närger\r\nkelvin"),
    (2, "f.md", "a.b(c)\nlicensed to x.\nabcabc"),
    (3, "g.txt", "İstanbul istanbul\nfoo1 bar22 foofoo"),
    (3, "h.txt", "x" * 5000 + "license" + "y" * 5000),
]
SEARCHES = [
    Search("license", name="literal"),
    Search("License", name="case", case_sensitive=True),
    Search("kelvin", name="folded"),
    Search("ÄRGER", name="umlaut"),
    Search("istanbul", name="dotted"),
    Search("ab", name="short"),
    Search(r"licen[sc]e", name="class", is_regex=True),
    Search(r"foo\d bar\d+|abc{1,2}abc", name="choice", is_regex=True),
    Search(r"(to|from) x", name="group", is_regex=True, case_sensitive=True),
    Search(r"[a-z]+\d", name="nothing known", is_regex=True),
    Search("token", name="by file", file_patterns=("*.py",)),
    Search("e", name="capped", max_matches=2),
    Search("absent words", name="none"),
]


def _rows(df):
    columns = ["search_name", "project_id", "file_path", "line_number", "line_content", "matched_text"]
    return sorted(map(str, df.select(columns).collect()))


def test_indexed_search(spark, make_files, tmp_path):
    files = make_files(*ROWS)
    X.write_index(files.repartition(3), f"{tmp_path}/index")
    expected = [row for s in SEARCHES for row in _rows(search_content(files, s))]
    assert _rows(X.indexed_search(spark, f"{tmp_path}/index", SEARCHES)) == sorted(expected) and len(expected) > 15
    read = {r["search_name"]: r["files_read"] for r in X.index_report(spark, f"{tmp_path}/index", SEARCHES).collect()}
    assert read["literal"] == 3 and read["none"] == 0 and read["short"] == len(ROWS) and read["umlaut"] == 1
    with pytest.raises(ValueError):
        X.indexed_search(spark, f"{tmp_path}/index", [])


def test_many_candidates_and_blocks(spark, make_files, tmp_path, monkeypatch):
    files = make_files(*[(k % 3, f"{k}.txt", f"number {k}\nfoo {k % 7}") for k in range(300)])
    monkeypatch.setattr(X, "MOST_CANDIDATES", 10)
    X.write_index(files.coalesce(2), f"{tmp_path}/index")
    for search in (Search("foo 3"), Search("number 12")):
        assert _rows(X.indexed_search(spark, f"{tmp_path}/index", search)) == _rows(search_content(files, search))


def test_a_task_of_the_index_holds_little():
    """Memory goes by what is gathered, and lists are whole."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 20_000, np.uint8).tobytes() for _ in range(300)] + [None, b"", b"ab"]
    batches = [pa.record_batch({"file_no": pa.array([k], pa.int64()), "content": pa.array([t], pa.binary())}) for k, t in enumerate(texts)]
    expected: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        for code in G.codes(t or b"").tolist():
            expected.setdefault(code, []).append(k)
    got: dict[int, list[int]] = {}
    tracemalloc.start()
    try:
        for batch in X._poster()(iter(batches)):
            for row in range(batch.num_rows):
                got.setdefault(batch["trigram"][row].as_py(), []).append(batch["files"][row].as_py())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {code: np.frombuffer(b"".join(own), np.uint32).tolist() for code, own in got.items()} == expected
    assert peak < 75 << 20


def test_many_searches(spark, make_files):
    files = make_files(*ROWS)
    expected = sorted(row for s in SEARCHES for row in _rows(search_content(files, s)))
    assert _rows(search_many(files, SEARCHES)) == expected
    plan = search_many(files, SEARCHES + [Search(f"word{k}") for k in range(1000)])
    assert len(plan._jdf.queryExecution().analyzed().toString()) < 20_000
    assert _rows(plan) == expected
    with pytest.raises(ValueError):
        search_many(files, [Search("a", context_lines=1)])
    with pytest.raises(ValueError):
        search_many(files, [])


def test_sizes_and_malformed_globs(spark, make_files):
    files = make_files(*ROWS)
    searches = [Search("license", name="small", max_file_size=100), Search("license", name="malformed", file_patterns=("[",)), Search("license", name="two", file_patterns=("*.md", "a.*"))]
    assert _rows(search_many(files, searches)) == sorted(row for s in searches for row in _rows(search_content(files, s)))


def test_only_lines_that_may_match_leave_the_gate(spark, make_files):
    """A file meets its searches line by line: many searches do not carry its whole text each."""
    words = [f"word{k:03d}x" for k in range(200)]
    text = "\n".join(["Kelvin ſtraße", *words, "", "word001x word002x\r", "word003", "x", words[1].upper()])
    searches = [*(Search(w, name=w) for w in words), Search("(straße|word1)\\w* *", name="folded", is_regex=True), Search("word003\nx", name="break"), Search("z", name="short")]
    files = make_files((1, "a.txt", text), (1, "b.txt", None), (2, "c.txt", ""), (2, "d.txt", "nothing\n" * 50))
    expected = sorted(row for s in searches[:6] + searches[-3:] for row in _rows(search_content(files, s)))
    assert _rows(search_many(files, searches[:6] + searches[-3:])) == expected and len(expected) == 9 + 101
    parts = files.select("file_path", F.explode(gate(searches[:-1], F.col("content"))).alias("p")).select("file_path", "p.*").collect()
    assert {r["file_path"] for r in parts} == {"a.txt"}
    met = {r["first"]: (bytes(r["part"]).decode(), list(r["searches"])) for r in parts}
    assert met.pop(0) == ("Kelvin ſtraße", [200])
    assert met.pop(202) == ("word001x word002x\r", [1, 2]) and met.pop(205) == ("WORD001X", [1])
    assert met == {k + 1: (w, [k, 200] if w[4] == "1" else [k]) for k, w in enumerate(words)}
    plan = search_many(files, searches)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize(
    "pattern,condition",
    [
        ("license", "license"),
        ("lic.nse", ("and", ("lic", "nse"))),
        ("licen[sc]e", ("or", ("licence", "license"))),
        ("(abc|def)+x", ("or", ("abc", "def"))),
        ("ab?c", True),
        ("abc*", True),
        ("(?i)Foo", "foo"),
        ("a{3}bcd", "bcd"),
        (r"\bword\b", "word"),
        ("[[:alpha:]]xyz", "xyz"),
        (r"x\Qa.b\Eyz", "xa.byz"),
        ("abc|de", True),
    ],
)
def test_conditions(pattern, condition):
    assert G.of_pattern(pattern) == condition


PARTS = st.sampled_from(["a", "b", "c", "k", "s", "K", "S", "ab", "[ab]", "[^a]", ".", "a?", "(?:ab|c)", "(a|bc)", "(?:abc)+", "b{2}", "(?:ab){1,2}", "c*", "^", "$", r"\w", r"\.", "(?i:Sk)", "é"])


@given(st.lists(PARTS, min_size=1, max_size=7).map("".join), st.booleans(), st.lists(st.sampled_from(list("abckKsSé.Kſ ")), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_no_match_is_lost(pattern, ignore_case, line):
    """A line that matches holds what the condition asks for."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        condition = G.of_pattern(pattern, ignore_case)
    if re.search(pattern, line, re.IGNORECASE if ignore_case else 0):
        assert G.met(condition, G.codes(line.encode()))


def test_codes():
    assert G.codes(b"").tolist() == G.codes(b"ab").tolist() == []
    assert G.codes(b"ABC").tolist() == G.codes(b"abc").tolist() == [0x616263]
    assert G.codes("Kab".encode()).tolist() == G.codes(b"kab").tolist()
    assert len(G.codes(b"aaaaaa")) == 1
