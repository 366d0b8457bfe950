"""Sources, sinks and streams."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from corpusrules.operators.search import project_matches, search_files, search_lines
from corpusrules.operators.skew import with_position
from corpusrules.operators.stats import scan_statistics, search_statistics, version_distribution
from corpusrules.rulepack import Search, builtin_pack
from corpusrules.schemas import PROJECTS
from corpusrules.session import collect_small, run_folder, scratch_path, shared_dir
from corpusrules.sinks import logs as K
from corpusrules.sources.files import (
    fetch_content,
    file_contents,
    file_metadata,
    inventory,
    land_files,
)
from corpusrules.sources.logs import (
    broken_lines,
    read_scan_log,
    read_search_log,
    scan_log_headers,
    scan_log_results,
    scan_log_summaries,
    scan_log_versions,
    search_log_matches,
    search_log_projects,
)
from corpusrules.sources.packs import load_rules, load_searches, pack_as_table, read_pack, rules_table, searches_table
from corpusrules.sources.projects import list_active_projects, list_projects, read_projects
from corpusrules.sources.snippets import search_group_snippets
from corpusrules.sources.tree import list_tree, read_listed, read_tree
from corpusrules.sources.urls import split_source_url
from corpusrules.streaming.publish import read_published
from corpusrules.streaming.scan import append_detections, append_matches, publish_running, running_statistics, stream_table

# -- projects ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def projects(spark):
    rows = [(1, "org/a", False), (2, "org/sub/b", False), (3, "org/old", True), (4, "organic/c", False), (5, "org/sub/x/d", True)]
    df = spark.createDataFrame(rows, "id long, path_with_namespace string, archived boolean")
    return df.withColumn("name", F.substring_index("path_with_namespace", "/", -1))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_project_listing(projects):
    assert ids(list_projects(projects)) == [1, 2, 3, 4, 5]
    assert ids(list_projects(projects, archived=True)) == [3, 5]
    assert ids(list_projects(projects, group="/org/")) == [1, 2, 3, 5]
    assert ids(list_projects(projects, group="org", include_subgroups=False)) == [1, 3]
    assert ids(list_projects(projects, group="org/sub", include_subgroups=False)) == [2]
    assert ids(list_active_projects(projects, "org")) == [1, 2]


def test_project_snapshot(spark, projects):
    path = scratch_path(spark, "projects")
    projects.write.json(path)
    df = read_projects(spark, path, "json")
    assert df.schema == PROJECTS and df.where("archived").count() == 2


# -- files ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in {
        "1/.python-version": "3.11\n",
        "1/src/app.py": "print('TODO')\n",
        "2/Dockerfile": "FROM python:3.9\n",
        "2/docs/a/readme.md": "x" * 100,
        "team-x/.gitlab-ci.yml": "image: python:3.8\n",
        "beside.txt": "of no project",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def test_tree_source(spark, tree):
    listing = list_tree(spark, tree)
    rows = {(r.project, r.project_id, r.file_path): (r.file_name, r.size) for r in listing.collect()}
    assert rows == {
        ("1", 1, ".python-version"): (".python-version", 5),
        ("1", 1, "src/app.py"): ("app.py", 14),
        ("2", 2, "Dockerfile"): ("Dockerfile", 16),
        ("2", 2, "docs/a/readme.md"): ("readme.md", 100),
        ("team-x", None, ".gitlab-ci.yml"): (".gitlab-ci.yml", 18),
    }
    small = read_listed(listing.where("size < 10"), tree).collect()
    assert [(r.file_path, bytes(r.content)) for r in small] == [(".python-version", b"3.11\n")]
    assert inventory(listing).columns == ["project_id", "file_name", "file_path"]


def test_listed_file_that_is_gone_gives_no_row(spark, tmp_path):
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "a").write_text("x")
    (tmp_path / "7" / "b").write_text("y")
    rows = list_tree(spark, str(tmp_path)).collect()
    listing = spark.createDataFrame(rows, list_tree(spark, str(tmp_path)).schema)
    (tmp_path / "7" / "a").unlink()
    assert [r.file_path for r in read_listed(listing, str(tmp_path)).collect()] == ["b"]


def test_stored_inventory_reads_no_content(spark, tree):
    path = scratch_path(spark, "files")
    land_files(read_tree(spark, tree), path)
    plan = inventory(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_inventory_options(spark):
    rows = [(1, "blob", "a.py", "main"), (1, "tree", "d", "main"), (1, "blob", "d/b.py", "main"), (1, "blob", "d/e/c.py", "dev"), (2, "blob", "z", "main")]
    df = spark.createDataFrame(rows, "project_id long, type string, file_path string, ref string")

    def paths(**kw):
        return sorted(r.file_path for r in inventory(df, **kw).collect())

    assert paths() == ["a.py", "d/b.py", "d/e/c.py", "z"]
    assert paths(project_id=1, recursive=False) == ["a.py"]
    assert paths(path="d/", recursive=False) == ["d/b.py"]
    assert paths(path="d") == ["d/b.py", "d/e/c.py"]
    assert paths(ref="dev") == ["d/e/c.py"]


def test_landing(spark, tree):
    path = scratch_path(spark, "files")
    land_files(read_tree(spark, tree), path)
    assert spark.read.parquet(path).count() == 5


def test_fetch(spark, tree):
    wanted = spark.createDataFrame([(1, ".python-version"), (1, ".python-version"), (9, "x")], "project_id long, file_path string")
    rows = fetch_content(read_tree(spark, tree), wanted).collect()
    assert [bytes(r.content) for r in rows] == [b"3.11\n"]


def test_contents_and_metadata(spark):
    rows = [
        (1, "d/a", "base64", base64.b64encode(b"hi \xff").decode(), "", "c1", ""),
        (1, "b", "text", "plain", "given", "c2", "l2"),
    ]
    df = spark.createDataFrame(
        rows, "project_id long, file_path string, encoding string, content string, content_sha256 string, commit_id string, last_commit_id string"
    )
    got = {r.file_path: r for r in file_contents(df).collect()}
    assert bytes(got["d/a"].content) == b"hi \xff" and got["d/a"].file_name == "a"
    assert got["d/a"].last_commit_id == "c1" and got["b"].last_commit_id == "l2"
    assert got["b"].content_sha256 == "given" and len(got["d/a"].content_sha256) == 64
    assert "content" not in file_metadata(df).columns


@pytest.mark.parametrize(
    "url,base,namespace",
    [
        ("code.example.org/tools/build", "https://code.example.org", "tools/build"),
        ("forge.example.net/atlas/", "https://forge.example.net", "atlas"),
        ("http://10.1.2.3/lab", "http://10.1.2.3", "lab"),
        ("code.example.org", "https://code.example.org", ""),
        ("https://host:8443//a/b//?x=1#y", "https://host:8443", "a/b"),
    ],
)
def test_source_urls(spark, url, base, namespace):
    r = spark.range(1).select(split_source_url(F.lit(url)).alias("u")).first().u
    assert (r.base_url, r.namespace) == (base, namespace)


def test_group_snippets(make_files, projects):
    files = make_files((1, "a", "TODO"), (4, "b", "todo"))
    assert [r.project_id for r in search_group_snippets(files, projects, "org", "todo").collect()] == [1]


# -- packs ---------------------------------------------------------------------------------------------------------------

PACK_JSON = {
    "settings": {"default_priority": 33},
    "rules": [
        {"name": "v", "match": {"file_pattern": "v.txt", "max_file_size": 10}, "parser": {"type": "simple_version", "config": {"confidence": 1, "trim_whitespace": False}}},
        {"name": "off", "priority": 0, "enabled": False, "tags": ["t"], "match": {"path_pattern": "^x/"}, "parser": {"type": "regex", "config": {"pattern": "a"}}},
    ],
    "searches": [
        {"name": "todo", "search_term": "TODO", "case_sensitive": True, "max_matches": 3},
        {"name": "re", "search_term": "a+", "is_regex": True, "file_patterns": ["*.py"], "context_lines": 1},
        {"name": "gone", "search_term": "x", "enabled": False},
    ],
}
PACK_YAML = """
settings: {default_priority: 33}
rules:
  - name: v
    match: {file_pattern: v.txt, max_file_size: 10}
    parser: {type: simple_version, config: {confidence: 1, trim_whitespace: false}}
  - name: "off"
    priority: 0
    enabled: false
    tags: [t]
    match: {path_pattern: "^x/"}
    parser: {type: regex, config: {pattern: a}}
searches:
  - {name: todo, search_term: TODO, case_sensitive: true, max_matches: 3}
  - {name: re, search_term: a+, is_regex: true, file_patterns: ["*.py"], context_lines: 1}
  - {name: gone, search_term: x, enabled: false}
"""


@pytest.mark.parametrize("kind", ["json", "yaml"])
def test_pack_documents(spark, tmp_path, kind):
    if kind == "yaml":
        pytest.importorskip("yaml")
    path = tmp_path / f"pack.{kind}"
    path.write_text(json.dumps(PACK_JSON, indent=1) if kind == "json" else PACK_YAML)
    document = read_pack(spark, str(path))
    pack = load_rules(rules_table(document))
    off, v = pack.rules
    assert (off.name, off.priority, off.enabled, off.tags) == ("off", 0, False, ("t",))
    assert (v.priority, v.enabled, v.max_file_size) == (33, True, 10)
    assert dict(v.parser_config) == {"confidence": "1", "trim_whitespace": "false"}
    assert len(pack.enabled()) == 1
    searches = load_searches(searches_table(document))
    assert [(s.name, s.max_matches, s.context_lines) for s in searches] == [("todo", 3, 0), ("re", 0, 1)]


def test_pack_table_round_trip(spark):
    pack = builtin_pack()
    again = load_rules(pack_as_table(spark, pack))
    assert [r.to_record() for r in again] == [r.to_record() for r in pack]


def test_small_tables_are_checked(spark):
    with pytest.raises(ValueError, match="more than 3"):
        collect_small(spark.range(4), 3, "rows")


# -- logs ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        ("backend", "g/backend", "3.11.5", ".python-version", None, 1, 3),
        ("frontend", "g/frontend", "", None, None, 2, 3),
        ("broken", "g/broken", None, None, "timeout", 3, 3),
    ]
    columns = "project_name string, project_path string, python_version string, detection_source string, error string, index long, total_projects long"
    return spark.createDataFrame(rows, columns)


def lines(df):
    return [r.value for r in df.collect()]


def test_scan_rendering(results):
    assert sorted(lines(K.render_scan_results(results))) == [
        "[1/3] backend: Python 3.11.5 (from .python-version)",
        "[2/3] frontend: Python not detected",
        "[3/3] broken: Error - timeout",
    ]
    stamped = results.withColumn("timestamp", F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    assert lines(K.render_scan_results(stamped.limit(1), timestamps=True)) == [
        "[2024-05-06T07:08:09Z] [1/3] backend: Python 3.11.5 (from .python-version)"
    ]


def test_scan_statistics_and_text_blocks(results, spark):
    versions = ["3.11.5", "3.10.0", "3.11.5", "2.7.18", ""]
    df = spark.createDataFrame([(v, None) for v in versions], "python_version string, error string")
    stats, dist = scan_statistics(df), version_distribution(df)
    assert tuple(stats.first()) == (5, 4, 1, 0)
    assert {r.python_version: r.projects for r in dist.collect()}["3.11.5"] == 2
    assert lines(K.render_scan_summary(scan_statistics(results))) == [
        "Scan complete: 3 projects, 1 Python projects, 1 non-Python",
        "Errors encountered: 1",
    ]
    block = lines(K.render_scan_summary(stats, dist))
    assert block[0] == "=== Scan Summary ===" and "  3.11.5: 2" in block and block[-1] == "===================="
    assert "Errors: 0" not in block
    assert lines(K.render_scan_header(stats, "u")) == ["Found 5 projects in organization"]
    assert "Source URL: u" in lines(K.render_scan_header(stats, "u", log=True))


def test_scan_log(spark, results):
    path = scratch_path(spark, "scan-log")
    K.write_full_scan_log(results, path, "https://host/org")
    raw = [json.loads(r.value) for r in spark.read.text(path).collect()]
    frontend = next(r for r in raw if r.get("project_name") == "frontend")
    assert set(frontend) == {"timestamp", "project_name", "project_path", "index", "total_projects"}
    done = next(r for r in raw if r.get("type") == "scan_completed")
    assert done["error_count"] == 1 and "version_counts" not in done
    log = read_scan_log(spark, path)
    assert scan_log_results(log).count() == 3
    assert [tuple(r) for r in scan_log_versions(log).collect()] == [("3.11.5", 1)]
    assert scan_log_headers(log).first().gitlab_url == "https://host/org"
    summary = scan_log_summaries(log).first()
    assert (summary.total_projects, summary.python_projects, summary.non_python_projects) == (3, 1, 1)


def test_many_versions_are_one_summary(spark):
    rows = spark.range(20_000).select(
        F.concat(F.lit("p"), "id").alias("project_name"),
        F.concat(F.lit("3."), "id").alias("python_version"),
        F.lit("f").alias("detection_source"),
        F.lit(None).cast("string").alias("error"),
        F.col("id").alias("index"),
        F.lit(20_000).cast("long").alias("total_projects"),
    )
    path = scratch_path(spark, "scan-log")
    K.write_full_scan_log(rows, path, "u")
    log = read_scan_log(spark, path)
    assert [r.python_projects for r in scan_log_summaries(log).collect()] == [20_000]
    assert scan_log_versions(log).agg(F.count("*"), F.sum("projects")).first() == (20_000, 20_000)
    assert scan_log_results(log).count() == 20_000


def test_older_logs_are_read_too(spark, tmp_path):
    old = {"type": "scan_completed", "total_projects": 2, "python_projects": 2, "version_counts": {"3.9": 2}}
    (tmp_path / "old.json").write_text(json.dumps(old))
    log = read_scan_log(spark, str(tmp_path))
    assert [tuple(r) for r in scan_log_versions(log).collect()] == [("3.9", 2)]
    assert scan_log_summaries(log).first().total_projects == 2


def test_full_text_log(spark, results):
    path = scratch_path(spark, "text-log")
    K.write_full_text_log(results, path, "https://host/org")
    found = lines(spark.read.text(path))
    assert len(found) == 5 + 3 + 9 and found.count("=== Scan Summary ===") == 1 and "Errors: 1" in found


def test_append_and_overwrite(spark, results):
    path = scratch_path(spark, "log")
    K.write_scan_log(results, path)
    K.write_scan_log(results, path, mode="append")
    assert read_scan_log(spark, path).count() == 6
    K.write_scan_log(results, path, fmt="text")
    assert spark.read.text(path).count() == 3
    with pytest.raises(ValueError, match="unknown log format"):
        K.write_scan_log(results, path, fmt="xml")


def test_search_logs(spark, make_files):
    files = make_files((1, "a.py", "x TODO\ny\nTODO z"), (2, "b.py", "none"))
    projects = spark.createDataFrame([(1, "one"), (2, "two")], "id long, project_name string")
    numbered = with_position(projects, ["project_name"], "index", "total_projects")
    matches = search_lines(files, Search("todo"))
    results = project_matches(numbered, matches)
    rendered = K.render_search_results(results, matches).orderBy("index", "file_path", "line_number").collect()
    assert [r.value for r in rendered] == [
        "[1/2] one: 2 match(es) found",
        "  a.py:1: x TODO",
        "  a.py:3: TODO z",
        "[2/2] two: no matches",
    ]
    failed = results.where("index = 2").withColumn("error", F.lit("boom"))
    assert [r.value for r in K.render_search_results(failed, matches).collect()] == ["[2/2] two: Error - boom"]
    path = scratch_path(spark, "search-log")
    K.write_search_log(results, matches, path, "todo")
    log = read_search_log(spark, path)
    counted = {r.project_name: (r.match_count, r.files_with_matches) for r in search_log_projects(log).collect()}
    assert counted == {"one": (2, 1), "two": (0, 0)}
    assert sorted((r.project_name, r.file_path, r.line_number) for r in search_log_matches(log).collect()) == [("one", "a.py", 1), ("one", "a.py", 3)]
    text = scratch_path(spark, "search-text")
    K.write_search_log(results, matches, text, "todo", fmt="text")
    assert [r.value.split("] ")[-1] for r in spark.read.text(text).collect()] == ["one: 2 match(es)", "  a.py:1: x TODO", "  a.py:3: TODO z", "two: no matches"]
    stats = search_statistics(results)
    assert lines(K.render_search_header(stats, 'a"b')) == ['Searching 2 projects for "a\\"b"']
    assert lines(K.render_search_summary(stats)) == ["Search complete: 2 projects scanned, 1 with matches (2 total matches)"]


def test_hundreds_of_hits_in_one_file_are_one_result(spark, make_files):
    files = make_files((1, "a.py", "\n".join(["hit"] * 300)), (1, "b.py", "hit"), (2, "c.py", "none"))
    projects = spark.createDataFrame([(1, "one"), (2, "two")], "id long, project_name string")
    numbered = with_position(projects, ["project_name"], "index", "total_projects")
    matches = search_lines(files, Search("hit"))
    results = project_matches(numbered, matches)
    headings = [r.value for r in K.render_search_results(results, matches).where("file_path is null").collect()]
    assert sorted(headings) == ["[1/2] one: 301 match(es) found", "[2/2] two: no matches"]
    path = scratch_path(spark, "search-log")
    K.write_search_log(results, matches, path, "hit")
    raw = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sorted((r.get("type", ""), r["project_name"], r["match_count"]) for r in raw) == [("", "one", 301), ("", "two", 0), ("file_matches", "one", 1), ("file_matches", "one", 300)]
    nested = {r.file_path: r.match_count for r in search_files(files, Search("hit")).collect()}
    assert nested == {"a.py": 300, "b.py": 1}


def test_torn_lines_are_left_out_and_counted(spark, tmp_path):
    path = str(tmp_path / "log")
    results = spark.createDataFrame([(f"p{k}", "3.9", k, 3) for k in range(1, 4)], "project_name string, python_version string, index long, total_projects long")
    K.write_scan_log(results, path)
    with open(tmp_path / "log" / "zz.json", "w") as file:
        file.write('{"timestamp":"2024-01-01T00:00:00Z","project_name":"x","index":4}\nnot json\n{"project_name":"to')
    log = read_scan_log(spark, path)
    assert sorted(r["project_name"] for r in scan_log_results(log).collect()) == ["p1", "p2", "p3", "x"]
    assert tuple(broken_lines(spark, path).first()) == (4, 2)


def test_a_run_replaces_its_own_records(spark, tmp_path):
    path = str(tmp_path / "log")

    def results(version):
        return spark.createDataFrame([("p", version, None, "x", 1, 1)], "project_name string, python_version string, error string, detection_source string, index long, total_projects long")

    for run, version in (("a", "3.8"), ("b", "3.9"), ("a", "3.10")):
        K.write_scan_run(results(version), path, run, "https://example.com")
    log = read_scan_log(spark, path)
    assert sorted((r["run"], r["python_version"]) for r in scan_log_results(log, "run").collect()) == [("a", "3.10"), ("b", "3.9")]
    assert log.where("type = 'scan_completed'").count() == 2
    with pytest.raises(ValueError):
        K.write_scan_run(results("3.8"), path, "a/b", "")


# -- streams ---------------------------------------------------------------------------------------------------------------


def test_incremental_scan(spark, tmp_path, make_files):
    landed, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        files = stream_table(spark, spark.read.parquet(landed).schema, landed)
        append_detections(files, builtin_pack(), out, state).awaitTermination()
        return sorted((r.project_id, r.version) for r in spark.read.json(out).collect())

    land_files(make_files((1, ".python-version", "3.11"), (1, "readme.md", "x")), landed)
    assert run() == [(1, "3.11")]
    land_files(make_files((2, "Dockerfile", "FROM python:3.9")), landed, mode="append")
    assert run() == [(1, "3.11"), (2, "3.9")]
    assert run() == [(1, "3.11"), (2, "3.9")]


def test_stream_search(spark, tmp_path, tree):
    out = str(tmp_path / "out")
    landed = str(tmp_path / "landed")
    land_files(read_tree(spark, tree), landed)
    files = stream_table(spark, spark.read.parquet(landed).schema, landed)
    append_matches(files, Search("python"), out, str(tmp_path / "state")).awaitTermination()
    # Hidden files arrive like any other.
    assert sorted(r.file_path for r in spark.read.json(out).collect()) == [".gitlab-ci.yml", "Dockerfile"]
    with pytest.raises(ValueError):
        append_matches(files, Search("todo", max_matches=1), out, str(tmp_path / "s2"))


def test_running_statistics(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "python_version string, error string"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        publish_running(running_statistics(stream), out, state).awaitTermination()
        return tuple(read_published(spark, out, running_statistics(stream).schema).first())

    assert run(("3.11", None), (None, None)) == (2, 1, 1, 0)
    assert run((None, "boom"), ("3.9", None)) == (4, 2, 1, 1)


def test_a_run_has_a_folder_of_its_own(spark):
    outside = scratch_path(spark, "x")
    with run_folder(spark, "nightly") as folder:
        assert scratch_path(spark, "x").startswith(f"{folder}/x-") and folder.startswith(f"{shared_dir(spark)}/nightly-")
        with run_folder(spark) as inner:
            assert scratch_path(spark, "x").startswith(inner)
        assert scratch_path(spark, "x").startswith(folder)
    assert scratch_path(spark, "x").rsplit("/", 1)[0] == outside.rsplit("/", 1)[0] == shared_dir(spark)


def test_shared_dir_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
