"""Rule execution: options, ranking, errors, tables and custom extractors."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusrules.functions.extractors import register_extractor
from corpusrules.operators.projects import number_results, project_versions
from corpusrules.operators.rules import (
    best_match,
    execute_rules,
    first_match,
    join_rules,
    matching_rules,
    rule_outcomes,
    rule_results,
)
from corpusrules.operators.stats import average_confidence, coverage_by_priority, coverage_by_tag, pack_statistics, rule_coverage
from corpusrules.rulepack import Rule, RulePack, Search, builtin_pack, enabled_searches


def rx(name, pattern, priority, confidence=0.5, **kw):
    kw.setdefault("file_pattern", "*.py")
    return Rule(name, parser_config={"pattern": pattern, "confidence": confidence}, priority=priority, **kw)


PACK = RulePack(
    (
        rx("c", r"c=(\S+)", 30, 0.7, tags=("text",)),
        rx("a", r"a=(\S+)", 10, 0.7, tags=("explicit", "config")),
        rx("b", r"b=(\S+)", 20, 0.9, tags=("config",)),
        rx("off", r"a=(\S+)", 1, 1.0, enabled=False, tags=("explicit",)),
    )
)


@pytest.fixture(scope="module")
def files(make_files):
    return make_files((1, "x.py", "a=1 b=2 c=3"), (1, "y.py", "c=9"), (2, "d/z.py", "none"), (2, "z.txt", "a=1"))


def by_path(df, *columns):
    return {r.file_path: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def versions(executed):
    return by_path(executed.select("file_path", F.transform("results", lambda r: r["version"]).alias("v")), "v")


def test_all_matches_in_priority_order(files):
    out = execute_rules(files, PACK)
    assert versions(out) == {"x.py": ["1", "2", "3"], "y.py": ["9"], "d/z.py": []}
    assert by_path(out, "rules_applied") == {"x.py": 3, "y.py": 3, "d/z.py": 3}
    assert out.where("file_path = 'x.py'").first().best_result.version == "2"
    assert execute_rules(files, PACK, all_files=True).where("file_path = 'z.txt'").first().rules_applied == 0


def test_limits_confidence_and_tags(files):
    assert versions(execute_rules(files, PACK, max_results=2))["x.py"] == ["1", "2"]
    stopped = execute_rules(files, PACK, stop_on_first_match=True)
    assert versions(stopped)["x.py"] == ["1"]
    assert by_path(stopped, "rules_applied") == {"x.py": 1, "y.py": 3, "d/z.py": 3}
    assert versions(execute_rules(files, PACK, min_confidence=0.8))["x.py"] == ["2"]
    assert versions(execute_rules(files, PACK, tags=["explicit", "text"]))["x.py"] == ["1", "3"]
    capped = execute_rules(files, PACK, max_results=1, min_confidence=0.8)
    assert by_path(capped, "rules_applied")["x.py"] == 2
    assert versions(execute_rules(files, PACK, tags=["unknown"], all_files=True))["x.py"] == []


def test_first_and_best(files):
    assert by_path(first_match(files, PACK), "rule_name", "version") == {"x.py": ("a", "1"), "y.py": ("c", "9")}
    assert by_path(best_match(files, PACK), "rule_name", "version") == {"x.py": ("b", "2"), "y.py": ("c", "9")}
    tie = RulePack((rx("late", r"a=(\S+)", 20, 0.7), rx("early", r"b=(\S+)", 10, 0.7)))
    assert by_path(best_match(files, tie), "rule_name")["x.py"] == "early"


def test_size_errors(make_files):
    files = make_files((1, "big.py", "a=1 b=2 " + "x" * 40), (1, "small.py", "a=1"))
    pack = RulePack((rx("a", r"a=(\S+)", 10, max_file_size=10), rx("b", r"b=(\S+)", 20)))
    message = "rule a: file size 48 exceeds maximum 10 bytes"
    out = execute_rules(files, pack)
    assert by_path(out, "errors") == {"big.py": [message], "small.py": []}
    assert by_path(first_match(files, pack), "rule_name", "error") == {"big.py": ("b", message), "small.py": ("a", None)}
    strict = by_path(first_match(files, pack, strict=True), "rule_name", "found", "error")
    assert strict == {"big.py": (None, False, message), "small.py": ("a", True, None)}
    assert by_path(best_match(files, pack, strict=True), "version") == {"big.py": None, "small.py": "1"}
    late = RulePack((rx("b", r"b=(\S+)", 5), rx("a", r"a=(\S+)", 10, max_file_size=10)))
    assert by_path(first_match(files, late), "error")["big.py"] is None
    assert by_path(execute_rules(files, late, stop_on_first_match=True), "errors")["big.py"] == []


def test_errors_survive_without_a_hit(make_files):
    files = make_files((1, "big.py", "none " + "x" * 40), (1, "small.py", "none"))
    pack = RulePack((rx("a", r"a=(\S+)", 10, max_file_size=10), rx("b", r"b=(\S+)", 20)))
    message = "rule a: file size 45 exceeds maximum 10 bytes"
    for match in (first_match, best_match):
        for strict in (False, True):
            assert by_path(match(files, pack, strict=strict), "rule_name", "found", "version", "error") == {"big.py": (None, False, None, message)}


def test_size_is_in_bytes(make_files):
    files = make_files((1, "u.py", "é=1"))
    pack = RulePack((rx("r", r"=(\d)", 1, max_file_size=3),))
    assert rule_outcomes(files, pack).first().error.startswith("rule r: file size 4")


def test_required_content_skips_quietly(files):
    pack = RulePack((rx("a", r"a=(\S+)", 1, required_content=r"c=\d"), rx("n", r"c=(\S+)", 2, required_content="zzz")))
    out = {(r.file_path, r.rule_name): (r.found, r.error) for r in rule_outcomes(files, pack).collect()}
    assert out[("x.py", "a")] == (True, None)
    assert out[("y.py", "a")] == (False, None)
    assert out[("x.py", "n")] == (False, None)


def test_path_patterns_and_rule_tables(spark, make_files):
    files = make_files((1, "harbour/images/Dockerfile", ""), (1, "harbour/probe/Dockerfile", ""), (1, "a/b.toml", ""))
    pack = RulePack(
        (
            rx("dock", "x", 1, file_pattern="Dockerfile", path_pattern="/probe/"),
            rx("any", "x", 2, file_pattern=None, path_pattern=r"b\.toml$"),
            rx("glob", "x", 3, file_pattern="*.t?ml"),
            rx("off", "x", 4, file_pattern="*", enabled=False),
        )
    )
    want = {("harbour/probe/Dockerfile", "dock"), ("a/b.toml", "any"), ("a/b.toml", "glob")}
    assert {(r.file_path, r.rule_name) for r in matching_rules(files, pack).collect()} == want
    assert {(r.file_path, r.rule_name) for r in join_rules(files, pack).collect()} == want


def test_joined_rules_agree_with_unrolled_ones(make_files):
    names = ["a.py", "a.tar.gz", ".gz", "gz", "x.GZ", "a.b\nc.gz", "Dockerfile", "Dockerfile.dev", "*.gz", "d/e.gz", ""]
    files = make_files(*[(1, n, "") for n in names])
    patterns = ["*.gz", "*.tar.gz", "*.py", "Dockerfile", "Dockerfile*", "?.py", "*", "a.*", "*.g?", ".gz"]
    pack = RulePack(tuple(rx(f"r{i}", "x", i, file_pattern=p) for i, p in enumerate(patterns)))
    columns = ("file_path", "rule_name", "priority")
    joined = sorted(tuple(r[c] for c in columns) for r in join_rules(files, pack).collect())
    assert joined == sorted(tuple(r[c] for c in columns) for r in matching_rules(files, pack).collect())
    assert len(joined) > 20


def test_empty_pack(files):
    none = RulePack(())
    assert first_match(files, none).count() == 0
    assert rule_outcomes(files, none).count() == 0
    assert join_rules(files, none).count() == 0
    assert execute_rules(files, none, all_files=True).where("rules_applied = 0").count() == 4


def test_source_defaults_to_the_file_name(make_files):
    files = make_files((1, "d/x.py", "a=1"))
    assert first_match(files, RulePack((rx("a", r"a=(\d)", 1),))).first().source == "x.py"


def test_results_as_rows(files):
    rows = rule_results(execute_rules(files, PACK)).where("file_path = 'x.py'").orderBy("position").collect()
    assert [(r.position, r.rule_name, r.priority) for r in rows] == [(1, "a", 10), (2, "b", 20), (3, "c", 30)]


# -- user extractors -----------------------------------------------------------------------------------------------------


def _pandas_factory(config):
    schema = "version string, source string, confidence double, raw_value string, metadata map<string,string>, error string"

    @F.pandas_udf(schema)
    def shout(content: pd.Series) -> pd.DataFrame:
        bad = content.str.contains("!").fillna(False).astype(bool)
        empty = content.isna() | bad
        n = len(content)
        return pd.DataFrame(
            {
                "version": content.str.upper().mask(empty, None),
                "source": [""] * n,
                "confidence": [0.3] * n,
                "raw_value": content,
                "metadata": [{} for _ in range(n)],
                "error": pd.Series([None] * n, dtype=object).mask(bad, "cannot shout"),
            }
        )

    return lambda content, name: shout(content)


def test_pandas_extractor_with_errors(make_files):
    register_extractor("shout", _pandas_factory, can_fail=True)
    files = make_files((1, "a.py", "abc"), (1, "b.py", "abc!"), (1, "c.txt", "abc"))
    pack = RulePack((Rule("s", "*.py", "shout", priority=1), rx("t", r"(b)", 2, 0.2)))
    out = {(r.file_path, r.rule_name): (r.found, r.version, r.error) for r in rule_outcomes(files, pack).collect()}
    assert out[("a.py", "s")] == (True, "ABC", None)
    assert out[("b.py", "s")] == (False, None, "rule s: parser error in rule s: cannot shout")
    assert {k[0] for k in out} == {"a.py", "b.py"}
    assert by_path(first_match(files, pack), "rule_name", "source") == {"a.py": ("s", "a.py"), "b.py": ("t", "b.py")}
    assert by_path(first_match(files, pack), "error")["b.py"].endswith("cannot shout")


# -- packs ---------------------------------------------------------------------------------------------------------------


def test_builtin_packs():
    names = [r.name for r in builtin_pack()]
    assert names == [
        "python-version-file",
        "runtime-txt",
        "setup-py",
        "pipfile",
        "pyproject-toml",
        "dockerfile",
        "gitlab-ci",
        "tox-ini",
        "requirements-txt-dependencies",
    ]
    assert [r.priority for r in builtin_pack()] == [1, 2, 8, 9, 10, 11, 12, 13, 15]
    assert len(builtin_pack("default+comments")) == 10


def test_pack_checks():
    with pytest.raises(ValueError, match="duplicate"):
        RulePack((rx("a", "x", 1), rx("a", "y", 2)))
    with pytest.raises(ValueError, match="required"):
        Rule("r", None, "simple_version")
    with pytest.raises(ValueError):
        rx("r", "x", 1, required_content="[invalid")
    with pytest.raises(ValueError, match="unknown parser"):
        Rule("r", "x", "nope")
    with pytest.raises(ValueError, match="empty"):
        Rule("", "x", "simple_version")


def test_record_defaults():
    record = {"name": "r", "match": {"file_pattern": "x"}, "parser": {"type": "simple_version"}}
    assert Rule.from_record(record).priority == 50
    assert Rule.from_record(record, {"default_priority": 7, "default_enabled": False}).enabled is False
    assert Rule.from_record({**record, "priority": 0, "enabled": False}, {"default_priority": 7}).priority == 0


def test_searches():
    with pytest.raises(ValueError, match="empty"):
        Search("")
    with pytest.raises(ValueError):
        Search("[invalid", is_regex=True)
    with pytest.raises(ValueError, match="no search"):
        enabled_searches([])
    with pytest.raises(ValueError, match="no enabled"):
        enabled_searches([Search("x", enabled=False)])
    with pytest.raises(ValueError, match="duplicate"):
        enabled_searches([Search("x"), Search("x")])


def test_pack_statistics():
    pack = RulePack(
        (
            rx("a", "x", 10, tags=("explicit", "config")),
            rx("b", "x", 10, tags=("config",)),
            rx("c", "x", 20, enabled=False),
        )
    )
    stats = pack_statistics(pack)
    assert (stats["total_rules"], stats["enabled_rules"], stats["disabled_rules"]) == (3, 2, 1)
    assert stats["rules_by_priority"] == {10: 2, 20: 1}
    assert stats["rules_by_tag"] == {"explicit": 1, "config": 2}


def test_coverage(files):
    outcomes = rule_outcomes(files, PACK)
    cover = {r.rule_name: (r.files_tried, r.detections, r.errors) for r in rule_coverage(outcomes).collect()}
    assert cover == {"a": (3, 1, 0), "b": (3, 1, 0), "c": (3, 2, 0)}
    tags = {r.tag: (r.rules, r.detections) for r in coverage_by_tag(outcomes, PACK).collect()}
    assert tags == {"explicit": (2, 1), "config": (2, 2), "text": (1, 2)}
    priorities = {r.priority: r.files_tried for r in coverage_by_priority(outcomes, PACK).collect()}
    assert priorities == {1: 0, 10: 3, 20: 3, 30: 3}
    assert average_confidence(outcomes).first().avg_confidence == pytest.approx(0.75)


# -- projects ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def projects(spark):
    rows = [(i, f"p{i}", f"g/p{i}") for i in (1, 2, 3, 4, 5)]
    return spark.createDataFrame(rows, "id long, name string, path_with_namespace string")


@pytest.fixture(scope="module")
def repositories(make_files):
    return make_files(
        (1, "tox.ini", "[tox]\nenvlist = py38"),
        (1, "Dockerfile.dev", "FROM python:3.10"),
        (1, "sub/.python-version", "3.12"),
        (2, "requirements.txt", "flask==1.0"),
        (3, ".python-version", "nonsense"),
        (3, "runtime.txt", "python-3.9.1"),
        (4, "Dockerfile", "FROM python:3.7"),
        (4, "Dockerfile.old", "FROM python:2.7"),
    )


def scan(projects, files, **options):
    rows = project_versions(projects, files, builtin_pack(), **options).collect()
    return {r.id: (r.python_version, r.detection_source) for r in rows}


def test_first_accepted_rule_per_project(projects, repositories):
    assert scan(projects, repositories) == {
        1: ("3.10", "Dockerfile.dev"),
        2: (None, None),
        3: ("3.9.1", "runtime.txt"),
        4: ("3.7", "Dockerfile"),
        5: (None, None),
    }


def test_depth_and_literal_modes(projects, repositories):
    assert scan(projects, repositories, depth="any")[1] == ("3.12", ".python-version")
    literal = scan(projects, repositories, pattern_mode="literal")
    assert literal[1] == ("3.8", "tox.ini") and literal[4] == (None, None)


def test_errors_of_projects(projects, make_files):
    files = make_files((1, ".python-version", "3.11"), (2, ".python-version", "3.11" + " " * 2000), (3, ".python-version", "x" * 2000), (3, "runtime.txt", "python-3.9"))
    rows = {r.id: (r.python_version, r.error) for r in project_versions(projects, files, builtin_pack()).collect()}
    assert rows[1] == ("3.11", None) and rows[3] == ("3.9", None) and rows[4] == (None, None)
    assert rows[2][0] is None and "exceeds maximum" in rows[2][1]
    none = project_versions(projects, files, RulePack((rx("off", "x", 1, enabled=False),)))
    assert {r.error for r in none.collect()} == {"no enabled rules found"} and none.count() == 5


def test_manifest_corpus_with_keys_from_one(spark, tmp_path):
    from corpusrules.sources.corpus import manifest_files, manifest_projects

    rows = [(k, f"n{k}", "b", "t", k % 50) for k in range(1, 40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    ids = {r.id for r in manifest_projects(spark, str(tmp_path)).collect()}
    assert {r.project_id for r in manifest_files(spark, str(tmp_path)).collect()} <= ids and 0 in ids


def test_equal_priorities_fall_back_to_names(projects, make_files):
    files = make_files((1, "b.py", "v=2"), (1, "a.py", "v=1"))
    pack = RulePack((rx("z", r"v=(\d)", 5), rx("y", r"v=(\d)", 5)))
    row = project_versions(projects, files, pack).where("id = 1").first()
    assert (row.rule_name, row.python_version, row.file_path) == ("y", "1", "a.py")


def test_numbering(projects):
    rows = number_results(projects, ("path_with_namespace",)).collect()
    assert sorted((r["index"], r.total_projects, r.id) for r in rows) == [(i, 5, i) for i in (1, 2, 3, 4, 5)]
