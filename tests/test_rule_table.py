"""Packs as data: the same results as the unrolled form."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusrules.functions.extractors import register_extractor
from corpusrules.operators import rule_table as RT
from corpusrules.operators import rules as R
from corpusrules.rulepack import Rule, RulePack
from corpusrules.sources.packs import pack_as_table

PACK = RulePack(
    (
        Rule("plain", "setup.py", "setup_py", priority=3),
        Rule("extension", "*.txt", parser_config={"pattern": r"(?i)ver\w*\s+(?P<version>\d+\.\d+)", "confidence": 0.7}),
        Rule("extension-of-two", "*.tar.gz", "simple_version", priority=1),
        Rule("head", "req*", "requirements_dependencies", priority=9),
        Rule("tail", "*-dev.txt", "requirements_comment", priority=2),
        Rule("inside", "*a?b*", "simple_version", {"trim_whitespace": False, "confidence": 0.25}),
        Rule("all", "*", "string_search", {"search_term": "python", "max_matches": 1}, priority=60),
        Rule("regex-lines", "?*", "string_search", {"search_term": r"^v\d", "is_regex": True}, priority=61),
        Rule("path-only", None, "simple_version", path_pattern="^src/.*[.]md$", priority=5),
        Rule("both", "*.md", "simple_version", path_pattern="^docs/", priority=5),
        Rule("needs", "*.txt", parser_config={"pattern": "ver"}, required_content=r"\bmust\b"),
        Rule("small", "*.txt", "simple_version", max_file_size=12),
        Rule("off", "*", "simple_version", enabled=False),
        Rule("docker", "Dockerfile*", "dockerfile"),
        Rule("toml", "pyproject.toml", "pyproject_toml"),
        Rule("term", "*.md", "string_search", {"search_term": "a.b(c)[d]\\", "case_sensitive": True}),
    )
)
FILES = [
    (1, "setup.py", "setup(python_requires = '>=3.8')"),
    (1, "a.txt", "Version 1.25\nmust be python, Python"),
    (1, "b.tar.gz", " 7 "),
    (1, "requirements-dev.txt", "# Python 3.9\nflask>=2\nv8"),
    (2, "req", "flask"),
    (2, "xaxbx", "  keep  "),
    (2, "src/x.md", "text a.b(c)[d]\\ python"),
    (2, "docs/x.md", "v1\nv2"),
    (2, "docs/.txt", "ver"),
    (2, "Dockerfile.dev", "FROM python:3.11-slim"),
    (2, "pyproject.toml", "[project]\nrequires-python = '>=3.10'\n"),
    (3, "empty.txt", ""),
    (3, "null.txt", None),
    (3, "odd\nname.txt", "ver must"),
    (3, "ünï.txt", "Ver 2.0 must python"),
]


def _rows(df):
    return sorted(str(sorted(r.asDict(recursive=True).items())) for r in df.collect())


def test_outcomes_are_those_of_the_unrolled_form(spark, make_files):
    files = make_files(*FILES)
    table = RT.prepare_rules(pack_as_table(spark, PACK))
    assert table.count == len(PACK.enabled())
    assert _rows(RT.table_outcomes(files, table)) == _rows(R.rule_outcomes(files, PACK))


def test_choices_are_those_of_the_unrolled_form(spark, make_files):
    files = make_files(*FILES)
    table = RT.prepare_rules(pack_as_table(spark, PACK))
    for ours, theirs in ((RT.table_first_match, R.first_match), (RT.table_best_match, R.best_match)):
        expected = theirs(files, PACK).where("found").drop("found", "error")
        assert _rows(ours(files, table)) == _rows(expected.select(ours(files, table).columns))
    executed = R.execute_rules(files, PACK).select("project_id", "file_path", "file_name", "results", "rules_applied", "result_count")
    assert _rows(RT.table_results(files, table)) == _rows(executed)


def test_many_rules_meet_names_first(spark, make_files, monkeypatch):
    files = make_files(*FILES)
    table = RT.prepare_rules(pack_as_table(spark, PACK))
    expected = _rows(RT.table_outcomes(files, table))
    monkeypatch.setattr(RT, "BROADCAST_RULES", 3)
    assert _rows(RT.table_outcomes(files, table)) == expected


def test_users_kinds_have_stages_of_their_own(spark, make_files):
    def build(config):
        word = str(config.get("word", "x"))
        fields = {"version": "version", "source": "source", "confidence": "confidence", "raw_value": "raw_value", "metadata": "metadata", "error": "error"}

        def make(content, name):
            values = {
                "version": F.when(content.contains(word), F.lit(word)),
                "source": F.lit(""),
                "confidence": F.lit(0.3),
                "raw_value": content,
                "metadata": F.create_map().cast("map<string,string>"),
                "error": F.when(content.contains("bad"), F.lit("bad content")),
            }
            return F.struct(*[values[f].alias(f) for f in fields])

        return make

    register_extractor("word_kind", build, can_fail=True)
    pack = RulePack((Rule("one", "*.txt", "word_kind", {"word": "ver"}), Rule("two", "a*", "word_kind", {"word": "must"}), Rule("three", "*", "simple_version")))
    files = make_files(*FILES, (4, "c.txt", "bad ver"))
    assert _rows(RT.table_outcomes(files, RT.prepare_rules(pack_as_table(spark, pack)))) == _rows(R.rule_outcomes(files, pack))


@pytest.mark.parametrize("pattern,key,whole", [("a.txt", "=a.txt", True), ("*.tar.gz", "*.tar.gz", True), ("ab*c", "^ab", False), ("a*.txt", "$.txt", False), ("*", "", False), ("?.py", "$.py", False), (None, "", True), ("*.*", "", False)])
def test_keys(pattern, key, whole):
    assert RT.rule_key(pattern) == (key, whole)


def test_bad_rules_are_refused(spark):
    twice = pack_as_table(spark, RulePack((Rule("a", "*", "simple_version"),)))
    with pytest.raises(ValueError, match="duplicate rule name: a"):
        RT.prepare_rules(twice.union(twice))
    broken = twice.withColumn("parser", F.struct(F.lit("regex").alias("type"), F.create_map(F.lit("pattern"), F.lit("(")).alias("config")))
    with pytest.raises(Exception, match="invalid regex pattern"):
        RT.prepare_rules(broken)


def test_thousands_of_rules_build_in_seconds(spark, make_files):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(5000)]
    pack = RulePack(tuple(Rule(f"r{k}", ("f%d.txt" % (k % 50), "*.txt", f"f{k % 10}*")[k % 3], parser_config={"pattern": rf"{w}=(\d+)"}, priority=k % 90) for k, w in enumerate(words)))
    files = make_files(*[(k, f"f{k}.txt", " ".join(f"{w}={k}" for w in words[k * 90 : k * 90 + 40])) for k in range(50)])
    start = time.perf_counter()
    table = RT.prepare_rules(pack_as_table(spark, pack))
    found = RT.table_outcomes(files, table).where("found")
    assert time.perf_counter() - start < 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    got = {(r["file_path"], r["rule_name"]) for r in found.collect()}
    text = {r["file_path"]: r["content"] for r in files.collect()}
    expected = {(path, r.name) for r in pack for path, content in text.items() if f"{words[int(r.name[1:])]}=" in content and (r.file_pattern in (path, "*.txt") or r.file_pattern.endswith("*") and path.startswith(r.file_pattern[:-1]))}
    assert got == expected and len(got) > 500


@pytest.mark.parametrize(
    "pattern,key,shape",
    [("12?.txt", "2,4,7:12.txt", (2, 4, 7)), ("?2.txt", "0,5,6:2.txt", (0, 5, 6)), ("ab*c", "2,1,-1:abc", (2, 1, -1)), ("??", "0,0,2:", (0, 0, 2)), ("*a*", "", None), ("*", "", None), ("*.txt", "*.txt", None), ("a", "=a", None)],
)
def test_meeting_keys(pattern, key, shape):
    assert RT.meeting_key(pattern)[:2] == (key, shape)


@pytest.mark.parametrize("broadcast", [RT.BROADCAST_RULES, 3])
def test_patterns_meet_few_names_by_key(spark, make_files, monkeypatch, broadcast):
    """Rules that share an extension with every file meet the files that they are for, not all."""
    monkeypatch.setattr(RT, "BROADCAST_RULES", broadcast)
    numbers = range(100, 400)
    pack = RulePack(tuple(Rule(f"r{n}", f"{str(n)[:2]}?.txt", "simple_version") for n in numbers) + (Rule("any", "??", "simple_version"), Rule("open", "3*9.txt", "simple_version")))
    files = make_files(*[(1, f"{n}.txt", f"v{n}") for n in numbers], (1, "ab", "x"), (1, "ü?", "y"))
    table = RT.prepare_rules(pack_as_table(spark, pack))
    keyed = files.select(F.explode(RT._file_keys(F.col("file_path"), table)).alias("key"))
    assert keyed.join(table.rules, "key").count() == 300 * 10 + 2 + 10
    got = {(r["file_path"], r["rule_name"]) for r in RT.table_outcomes(files, table).where("found").collect()}
    expected = {(f"{n}.txt", f"r{m}") for n in numbers for m in numbers if n // 10 == m // 10}
    assert got == expected | {("ab", "any"), ("ü?", "any")} | {(f"3{k}9.txt", "open") for k in range(10)}


def test_many_rules_keep_files_that_share_keys_or_have_none(spark, make_files, monkeypatch):
    files = make_files(*FILES, (None, "a.txt", "Version 3.5"), (7, "b.tar.gz", "1"), (7, "b.tar.gz", "2"), (7, "b.tar.gz", "2"), (8, None, "x"))
    table = RT.prepare_rules(pack_as_table(spark, PACK))
    expected = _rows(RT.table_outcomes(files, table))
    monkeypatch.setattr(RT, "BROADCAST_RULES", 3)
    assert _rows(RT.table_outcomes(files, table)) == expected
