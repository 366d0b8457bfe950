"""Content search and the bounded grouping behind it."""

import pytest
from pyspark.sql import functions as F

from corpusrules.operators.search import (
    cap_per_file,
    cap_per_project,
    nest_by_file,
    project_matches,
    projects_with_matches,
    projects_without_matches,
    search_content,
    search_files,
    search_lines,
    skipped_counts,
    snippet_matches,
)
from corpusrules.operators.skew import top_n, with_position
from corpusrules.operators.stats import matches_by_file, search_statistics
from corpusrules.plans.reports import content_search, version_scan
from corpusrules.rulepack import Search
from corpusrules.sources.snippets import search_snippets

TEXT = "line one\n# TODO: fix\r\nnothing\n  todo later ToDo\nlast"


@pytest.fixture(scope="module")
def files(make_files):
    return make_files(
        (1, "src/a.py", TEXT),
        (1, "src/b.yml", 'x: 1\npassword = "secret123"\n'),
        (2, "a.py", "no hits here"),
        (2, "big.py", "TODO " + "x" * 100),
    )


def found(df):
    return sorted((r.file_path, r.line_number, r.line_content, r.matched_text) for r in df.collect())


def test_literal_search(files):
    assert found(search_lines(files.where("project_id = 1"), Search("todo"))) == [
        ("src/a.py", 2, "# TODO: fix", "TODO"),
        ("src/a.py", 4, "  todo later ToDo", "todo"),
    ]
    assert found(search_lines(files, Search("TODO", case_sensitive=True))) == [
        ("big.py", 1, "TODO " + "x" * 100, "TODO"),
        ("src/a.py", 2, "# TODO: fix", "TODO"),
    ]
    assert found(search_lines(files, Search("absent"))) == []


def test_regex_search(files):
    assert found(search_lines(files, Search(r'password\s*=\s*"[^"]+"', is_regex=True))) == [
        ("src/b.yml", 2, 'password = "secret123"', 'password = "secret123"')
    ]
    assert [r[1] for r in found(search_lines(files, Search(r"^L.*e$", is_regex=True)))] == [1]
    assert found(search_lines(files, Search(r"^L.*e$", is_regex=True, case_sensitive=True))) == []
    assert len(found(search_lines(files.where("project_id = 1"), Search(r"x*", is_regex=True)))) == 8


def test_carriage_return_is_matched_but_not_shown(files):
    assert found(search_lines(files, Search(r"fix\s$", is_regex=True))) == [("src/a.py", 2, "# TODO: fix", "fix\r")]


def test_names_and_sizes(files):
    assert {r[0] for r in found(search_lines(files, Search("todo", file_patterns=("*.yml", "a.*"))))} == {"src/a.py"}
    assert found(search_lines(files, Search("todo", file_patterns=("[bad",)))) == []
    assert {r[0] for r in found(search_lines(files, Search("todo", is_regex=True, max_file_size=60)))} == {"src/a.py"}


def test_no_limit_unless_asked_for(make_files):
    files = make_files((1, "big.txt", "x" * (1 << 20) + "\nneedle 1"), (1, "small.txt", "needle 2"), (2, "b.md", "y" * 99))
    for search in (Search(r"needle \d", is_regex=True), Search("needle"), Search("needle", max_file_size=0), Search.from_record({"name": "n", "search_term": "needle", "max_file_size": 0})):
        assert len(found(search_lines(files, search))) == 2
    limited = Search.from_record({"name": "n", "search_term": "needle", "file_patterns": ["*.txt"], "max_file_size": 50})
    assert [r[0] for r in found(search_lines(files, limited))] == ["small.txt"]
    assert [tuple(r) for r in skipped_counts(files, [limited, Search("needle")]).collect()] == [("n", 1, 1)]


def test_no_searches(files):
    with pytest.raises(ValueError, match="no search"):
        search_content(files, [])


def test_pack_scans_once(spark, make_files, tmp_path):
    make_files((1, "a", "x\ny"), (1, "b", "x")).write.parquet(str(tmp_path / "f"))
    table = spark.read.parquet(str(tmp_path / "f"))
    capped = search_content(table, [Search("x", max_matches=1), Search("y"), Search("z", max_matches=500)])
    assert capped._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((r.search_name, r.file_path) for r in capped.collect()) == [("x", "a"), ("y", "a")]


def test_case_folding_keeps_positions(make_files):
    files = make_files((1, "t", "İİİ Straße ÉTÉ ok"))
    assert found(search_lines(files, Search("été")))[0][3] == "ÉTÉ"
    assert found(search_lines(files, Search("OK")))[0][3] == "ok"


def test_binary_content(spark):
    files = spark.createDataFrame([(1, "f", bytearray(b"ok \xff\xfe\nTODO \xff"))], "project_id long, file_path string, content binary")
    assert [r[1] for r in found(search_lines(files, Search("todo")))] == [2]


def test_context(files):
    rows = search_lines(files.where("project_id = 1"), Search("todo", context_lines=2)).orderBy("line_number").collect()
    assert rows[0].before == ["line one"] and rows[0].after == ["nothing", "  todo later ToDo"]
    assert rows[1].before == ["# TODO: fix", "nothing"] and rows[1].after == ["last"]


def test_pack_in_one_pass(files):
    searches = [
        Search("todo", "t"),
        Search("x", "x", max_matches=1, case_sensitive=True),
        Search(r"\d+", "n", is_regex=True, file_patterns=("*.yml",)),
        Search("line", "l", max_matches=5),
    ]
    got = {}
    for r in search_content(files, searches).collect():
        got.setdefault(r.search_name, []).append((r.project_id, r.file_path, r.line_number))
    assert sorted(got["t"]) == [(1, "src/a.py", 2), (1, "src/a.py", 4), (2, "big.py", 1)]
    assert sorted(got["x"]) == [(1, "src/a.py", 2), (2, "big.py", 1)]
    assert sorted(got["n"]) == [(1, "src/b.yml", 1), (1, "src/b.yml", 2)]
    assert got["l"] == [(1, "src/a.py", 1)]
    context = search_content(files, [Search("todo", "t", context_lines=1), Search("x", "x", max_matches=1)])
    rows = {(r.search_name, r.file_path, r.line_number): (r.before, r.after) for r in context.collect()}
    assert rows[("t", "src/a.py", 2)] == (["line one"], ["nothing"])
    assert rows[("x", "src/a.py", 2)] == ([], [])


def test_caps(files):
    hits = search_lines(files, Search("o", case_sensitive=False))
    assert [(r[0], r[1]) for r in found(cap_per_project(hits, 2))] == [("a.py", 1), ("big.py", 1), ("src/a.py", 1), ("src/a.py", 2)]
    assert [(r[0], r[1]) for r in found(cap_per_file(hits, 1))] == [("a.py", 1), ("big.py", 1), ("src/a.py", 1), ("src/b.yml", 2)]


def test_snippets(files):
    snippets = search_snippets(files.where("project_id = 1"), "TODO")
    assert [(r.startline, r.data) for r in snippets.orderBy("startline").collect()] == [
        (1, "line one\n# TODO: fix\r\nnothing"),
        (4, "  todo later ToDo\nlast"),
    ]
    direct = found(search_lines(files.where("project_id = 1"), Search("todo")))
    assert found(snippet_matches(snippets, Search("todo"))) == direct
    assert found(snippet_matches(snippets, Search("todo", file_patterns=("*.yml",)))) == []
    with pytest.raises(ValueError):
        search_snippets(files, "")


@pytest.fixture(scope="module")
def projects(spark):
    rows = [(1, "one", "g/one"), (2, "two", "g/two"), (3, "three", "g/three")]
    return spark.createDataFrame(rows, "id long, name string, path_with_namespace string")


def test_projects(files, projects):
    hits = search_lines(files, Search("password"))
    rows = {r.id: (r.match_count, r.files_with_matches) for r in project_matches(projects, hits).collect()}
    assert rows == {1: (1, 1), 2: (0, 0), 3: (0, 0)}
    nested = search_files(files, Search("password")).collect()
    assert [(r.file_path, r.match_count, r.matches[0].matched_text) for r in nested] == [("src/b.yml", 1, "password")]
    assert [tuple(r) for r in nest_by_file(hits).collect()] == [tuple(r) for r in nested]
    assert [r.id for r in projects_with_matches(projects, hits).collect()] == [1]
    assert sorted(r.id for r in projects_without_matches(projects, hits).collect()) == [2, 3]


def test_statistics(spark):
    counts = spark.createDataFrame(
        [(1, 2, None), (2, None, None), (3, None, "boom")], "id long, match_count long, error string"
    )
    r = search_statistics(counts).first()
    assert (r.total_projects, r.projects_with_hits, r.projects_no_hits, r.total_matches, r.error_count) == (3, 1, 1, 2, 1)


def test_same_path_in_two_projects_is_one(make_files):
    files = make_files((1, "a", "x\nx"), (2, "a", "x"))
    assert [tuple(r) for r in matches_by_file(search_lines(files, Search("x"))).collect()] == [("a", 3)]


# -- bounded grouping ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows of which one key holds half; the other keys hold 100 each."""
    key = F.when(F.col("id") < 10_000, F.lit(0)).otherwise(1 + F.col("id") % 100)
    return spark.range(20_000).select(key.alias("k"), F.col("id").alias("v"))


@pytest.mark.parametrize("n", [1, 7, 1500])
def test_top_n(skewed, n):
    got = sorted(tuple(r) for r in top_n(skewed, ["k"], ["v"], n).collect())
    want, seen = [], {}
    for k, v in sorted(tuple(r) for r in skewed.collect()):
        seen[k] = seen.get(k, 0) + 1
        if seen[k] <= n:
            want.append((k, v))
    assert got == want


def test_top_n_drops_rows_before_the_shuffle(skewed):
    plan = top_n(skewed, ["k"], ["v"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_large_caps_have_no_task_with_the_hot_key(spark):
    hot = spark.range(40_000).select(F.lit(0).alias("k"), F.col("id").alias("v")).repartition(8)
    df = top_n(hot, ["k"], ["v"], 5000, rank="r")
    assert sorted(r.v for r in df.collect()) == list(range(5000))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Only the ranges' sizes are windowed; rows were ranked where their range lies.
    assert "row_number" not in plan
    # Rows as few as these would be put together again, or broadcast.
    as_at_scale = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for key, value in as_at_scale.items():
            spark.conf.set(key, value)
        ranked = top_n(hot, ["k"], ["v"], 39_000, rank="r")
        assert ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 39_000
    finally:
        for key in as_at_scale:
            spark.conf.unset(key)


def test_positions(spark):
    df = spark.range(1000).select(F.format_string("%05d", 999 - F.col("id")).alias("p")).repartition(7)
    rows = with_position(df, ["p"], "i", "n").collect()
    assert sorted((r.p, r.i) for r in rows) == [(f"{i:05d}", i + 1) for i in range(1000)]
    assert {r.n for r in rows} == {1000}
    assert with_position(df.limit(0), ["p"]).count() == 0


# -- reports -----------------------------------------------------------------------------------------------------------------


def test_search_report(files, projects):
    searches = [Search("todo", "t"), Search("absent", "n")]
    report = content_search(projects, files, searches)
    first, second = (report.of(s) for s in searches)
    s = first.statistics.first()
    assert (s.total_projects, s.projects_with_hits, s.total_matches) == (3, 2, 3)
    assert second.statistics.first().projects_with_hits == 0
    rows = sorted((r["index"], r.total_projects, r.project_name, r.match_count) for r in first.results.collect())
    assert rows == [(1, 3, "one", 2), (2, 3, "three", 0), (3, 3, "two", 1)]
    assert {r.file_path: r.matches for r in first.by_file.collect()} == {"src/a.py": 2, "big.py": 1}


def test_search_report_leaves_out_other_projects(files, projects):
    report = content_search(projects.where("id = 2"), files, [Search("todo")])
    assert report.statistics.first().total_matches == 1


def test_scan_report(projects, make_files):
    files = make_files((1, ".python-version", "3.11"), (3, "Dockerfile", "FROM python:3.9"))
    report = version_scan(projects, files)
    assert tuple(report.statistics.first()) == (3, 2, 1, 0)
    assert {r.python_version: r.projects for r in report.distribution.collect()} == {"3.11": 1, "3.9": 1}


def test_caps_too_large_for_the_group_limit(spark, make_files):
    """Ranked by range: a hot project's hits are spread, and searches without a cap keep all."""
    rows = make_files(*[(k % 2, f"f{k:04d}.txt", "hit\nhit other\nno") for k in range(700)])
    searches = [Search("hit", name="large", max_matches=1001), Search("other", name="free"), Search("hit", name="small", max_matches=3)]
    got = search_content(rows, searches)
    counts = {(r["search_name"], r["project_id"]): r["count"] for r in got.groupBy("search_name", "project_id").count().collect()}
    assert counts == {("large", 0): 700, ("large", 1): 700, ("free", 0): 350, ("free", 1): 350, ("small", 0): 3, ("small", 1): 3}
    more = [Search("hit", name="large", max_matches=1000)]
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "600")
    try:
        by_range = found(search_content(rows.where("project_id = 0"), [Search("hit", name="x", max_matches=650)]))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert by_range == found(search_content(rows.where("project_id = 0"), more))[:650]
