"""Extraction jobs on the golden cases."""

import pytest
from pyspark.sql import functions as F

from corpusrules.functions.extractors import extractor_kinds, get_extractor
from corpusrules.functions.text import constraint_version, leading_version, tox_env_version
from corpusrules.operators.requirements import dependency_counts, requirement_rows

CASES = [
    ("python_version_file", "3.11", "3.11", 1.0),
    ("python_version_file", "  3.11.5  \n", "3.11.5", 1.0),
    ("python_version_file", "python-3.11.5", "3.11.5", 1.0),
    ("python_version_file", "Python-3.11", "3.11", 1.0),
    ("python_version_file", "py3.11", "3.11", 1.0),
    ("python_version_file", " 3.9 ", "3.9", 1.0),
    ("python_version_file", "not a version", None, None),
    ("python_version_file", "", None, None),
    ("runtime_txt", "python-3.11.5", "3.11.5", 0.95),
    ("runtime_txt", "  python-3.11  \n", "3.11", 0.95),
    ("runtime_txt", "ruby-2.7", None, None),
    ("runtime_txt", "py3.11", None, None),
    ("setup_py", "setup(python_requires='>=3.11')", "3.11", 0.9),
    ("setup_py", 'setup(\n python_requires=">=3.10,<4.0",\n)', "3.10", 0.9),
    ("setup_py", 'python_requires = "==3.11.5"', "3.11.5", 0.9),
    ("setup_py", "setup(name='x')", None, None),
    ("pipfile", '[requires]\npython_version = "3.11"\n', "3.11", 0.9),
    ("pipfile", '[requires]\npython_version = "3.10"\npython_full_version = "3.11.5"\n', "3.11.5", 0.9),
    ("pipfile", '[requires]\npython_version = ">=3.11"\n', None, None),
    ("pipfile", '[packages]\npython_version = "3.11"\n', None, None),
    ("pyproject_toml", '[project]\nrequires-python = ">=3.12"\n\n[tool.poetry.dependencies]\npython = "^3.11"\n', "3.12", 0.9),
    ("pyproject_toml", '[project]\nrequires-python = "any"\n[tool.poetry.dependencies]\npython = "^3.11"\n', "3.11", 0.9),
    ("pyproject_toml", '[tool.poetry.dependencies]\npython = {version = "^3.9", optional = false}\n', "3.9", 0.9),
    ("pyproject_toml", "[project]\r\nrequires-python = '>=3.10'\r\n", "3.10", 0.9),
    ("pyproject_toml", '[tool.mypy]\npython_version = "3.11"\n', None, None),
    ("pyproject_toml", '[project]\nrequires-python = ""\n', None, None),
    ("pyproject_toml", '[project]\nrequires-python = ">=3.12"\n[broken\nname = "x"\n', None, None),
    ("pyproject_toml", '[project]\nrequires-python = ">=3.12"\nname =\n', None, None),
    ("pyproject_toml", '[project]\nrequires-python = ">=3.12"\n[tool.tox]\nlegacy_tox_ini = """\n[tox]\nenvlist =\n  py312\n"""\n', "3.12", 0.9),
    ("pyproject_toml", '[project]\nrequires-python = ">=3.12"\nx = [\n  [\n    1,\n  ],\n]\n', "3.12", 0.9),
    ("dockerfile", "FROM python:3.13-bullseye AS base", "3.13", 0.8),
    ("dockerfile", "# x\nARG A\n  FROM python:3.9.1\nFROM python:3.12\n", "3.9.1", 0.8),
    ("dockerfile", "FROM scratch\nCOPY --from=x python:3.4 /y", None, None),
    ("dockerfile", "from python:3.4", None, None),
    ("dockerfile", "FROM\npython:3.4", None, None),
    ("gitlab_ci", "build:\n  image: python:3.13-bookworm", "3.13", 0.75),
    ("gitlab_ci", "image:\tpython:3.10.14-own-suffix", "3.10.14", 0.75),
    ("gitlab_ci", 'image: "python:3.11"', None, None),
    ("gitlab_ci", "image: ubuntu:latest", None, None),
    ("tox_ini", "[tox]\nenvlist = py311,py312", "3.11", 0.7),
    ("tox_ini", "[tox]\nenvlist = py39,py310", "3.9", 0.7),
    ("tox_ini", '[tox]\nenvlist = "py311,py312"', "3.11", 0.7),
    ("tox_ini", "[tox]\nenvlist =\n    py310\n", "3.10", 0.7),
    ("tox_ini", "[tox]\nskipsdist = True", None, None),
    ("requirements_comment", "# Python 3.11\nx", "3.11", 0.6),
    ("requirements_comment", "# Requires Python >= 3.11", "3.11", 0.6),
    ("requirements_comment", "a\n# py >= 3.10\n# Python 3.12", "3.10", 0.6),
    ("requirements_comment", "# py >= 3.9 # Python 3.11.5", "3.11.5", 0.6),
    ("requirements_comment", "requests", None, None),
    ("requirements_dependencies", "# Requires Python >= 3.11\nflask==2.0\n", "3.11", 0.6),
    ("requirements_dependencies", "flask==2.0\n", "", 0.5),
    ("requirements_dependencies", "-r base.txt\n# note\n--no-index\n", None, None),
]


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(i, kind, content) for i, (kind, content, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, kind string, content string")
    out = {}
    for kind in {c[0] for c in CASES}:
        made = get_extractor(kind).build(F.col("content"), F.lit("name.x"))
        for r in df.where(F.col("kind") == kind).select("i", made.alias("r")).collect():
            out[r.i] = r.r
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_golden_cases(extracted, i):
    _, _, version, confidence = CASES[i]
    result = extracted[i]
    if confidence is None:
        assert result is None
    else:
        assert (result.version, result.confidence, result.source) == (version, confidence, "name.x")


def _one(spark, kind, content, config=None):
    made = get_extractor(kind, config).build(F.lit(content), F.lit("f"))
    return spark.range(1).select(made.alias("r")).first().r


def test_raw_values_and_metadata(spark):
    assert _one(spark, "runtime_txt", "  python-3.11  \n").raw_value == "  python-3.11  \n"
    assert _one(spark, "python_version_file", "python-3.11.5\n").raw_value == "3.11.5"
    r = _one(spark, "dockerfile", "\tFROM  python:3.11-slim \r\n")
    assert r.raw_value == "FROM  python:3.11-slim" and r.metadata == {
        "source_type": "dockerfile",
        "from_image": "FROM  python:3.11-slim",
    }
    assert _one(spark, "gitlab_ci", "image:\n  python:3.11.5-x").metadata["image"] == "image:\n  python:3.11.5"
    r = _one(spark, "pyproject_toml", "[project]\nname = 'x'\nrequires-python = '>=3.8'\ndependencies = []\n")
    assert r.metadata == {"format": "PEP621", "constraint": ">=3.8"}
    text = "[project]\nrequires-python = '>=3.8'\ndependencies = [\n 'a[x]>1', # it's\n \"b\",\n]\n[x]\n"
    assert _one(spark, "pyproject_toml", text.replace(" # it's", "")).metadata["dependency_count"] == "2"
    text = '[tool.poetry.dependencies]\npython = "^3.11"\na = "1"\nb = {version = "2"}\n\n[build]\nc = 1\n'
    assert _one(spark, "pyproject_toml", text).metadata == {
        "format": "Poetry",
        "constraint": "^3.11",
        "dependency_count": "2",
    }
    assert _one(spark, "requirements_comment", "x\n # Python 3.8 \r\ny").raw_value == " # Python 3.8 "


def test_long_list_does_not_recurse(spark):
    items = "".join(f'  "pkg{i}>=1",\n' for i in range(20_000))
    text = f'[project]\nrequires-python = ">=3.8"\ndependencies = [\n{items}]\n'
    assert _one(spark, "pyproject_toml", text).metadata["dependency_count"] == "20000"


@pytest.mark.parametrize(
    "text,version",
    [("^3.11", "3.11"), (">=3.10", "3.10"), ("==3.11.5", "3.11.5"), ("~=3.11.0", "3.11.0"), (">=3.10,<3.12", "3.10"), ("3.11.*", "3.11"), ("python", "")],
)
def test_constraints(spark, text, version):
    assert spark.range(1).select(constraint_version(F.lit(text))).first()[0] == version


def test_version_helpers(spark):
    row = spark.range(1).select(
        leading_version(F.lit(" 3.9.1rc1 ")),
        leading_version(F.lit("v3.9")),
        tox_env_version(F.lit("flake8,py311")),
        tox_env_version(F.lit("invalid")),
    ).first()
    assert tuple(row) == ("3.9.1", "", "3.11", "")


def test_regex_extractor(spark):
    r = _one(spark, "regex", "FROM python-3.11.5\n", {"pattern": r"python-(?P<version>\d+\.\d+\.\d+)"})
    assert (r.version, r.confidence) == ("3.11.5", 0.5)
    r = _one(spark, "regex", "python 3.11.5", {"pattern": r"python (\d+)\.(\d+)\.(\d+)", "version_group": "0"})
    assert r.version == "3"
    r = _one(spark, "regex", "abc  x", {"pattern": r"c\s+", "confidence": 1})
    assert (r.version, r.raw_value, r.confidence) == ("c", "c  ", 1.0)
    assert _one(spark, "regex", "abc", {"pattern": r"a(x?)"}) is None
    r = _one(spark, "regex", "a=1 b=2", {"pattern": r"a=(?P<a_1>\d) b=(?P<b_2>\d)", "version_group": "b_2"})
    assert r.version == "2"
    with pytest.raises(ValueError):
        get_extractor("regex", {})
    with pytest.raises(ValueError):
        get_extractor("regex", {"pattern": "[invalid"})


def test_whole_file(spark):
    assert _one(spark, "simple_version", "  3.11.5  \n").version == "3.11.5"
    r = _one(spark, "simple_version", "  3.11.5  \n", {"trim_whitespace": False})
    assert (r.version, r.confidence) == ("  3.11.5  \n", 1.0)
    assert _one(spark, "simple_version", " \n ") is None
    assert _one(spark, "simple_version", "x", {"confidence": "0.25", "trim_whitespace": "false"}).confidence == 0.25


def test_search_as_rule(spark):
    r = _one(spark, "string_search", "x\nfoo TODO a\r\ntodo b\n", {"search_term": "todo"})
    assert (r.version, r.raw_value, r.confidence) == ("TODO", "foo TODO a", 0.0)
    assert r.metadata == {"match_count": "2", "line_number": "2"}
    r = _one(spark, "string_search", "a1\na2\na3", {"search_term": r"a\d", "is_regex": "true", "max_matches": 2.0})
    assert r.metadata["match_count"] == "2"
    assert _one(spark, "string_search", "TODO", {"search_term": "todo", "case_sensitive": True}) is None
    with pytest.raises(ValueError):
        get_extractor("string_search", {"search_term": ""})


def test_unknown_kind():
    with pytest.raises(ValueError, match="unknown parser type"):
        get_extractor("nope")
    assert {"regex", "simple_version", "string_search", "pyproject_toml"} <= set(extractor_kinds())


REQUIREMENTS = """# Requires Python >= 3.11
harbour[gates, locks]>=4.1; os_name=='posix'  # tides
-e hg+https://code.example.net/team/lighthouse@v2#egg=lighthouse
--editable ./local#frag
zope.interface==5

-r base.txt
--requirement more.txt
--index-url https://x
locked==1.0 --hash=sha256:abc --hash=sha256:def
under_score-x~=1.0 , <2
spaced --hash sha256:zzz
odd]name[x
[only]
plain\r
"""


def test_requirement_rows(make_files):
    files = make_files((1, "requirements.txt", REQUIREMENTS))
    rows = {r.line_no: r for r in requirement_rows(files).collect()}
    assert sorted(rows) == [2, 3, 4, 5, 10, 11, 12, 13, 15]
    r = rows[2]
    assert (r.name, r.specifier, r.extras, r.markers, r.comment) == (
        "harbour",
        ">=4.1",
        ["gates", "locks"],
        "os_name=='posix'",
        "tides",
    )
    assert rows[3].is_editable and rows[3].name == "hg+https://code.example.net/team/lighthouse@v2#egg=lighthouse"
    assert rows[4].name == "./local#frag"
    assert (rows[5].name, rows[5].specifier) == ("zope", ".interface==5")
    assert rows[10].hashes == ["sha256:abc", "sha256:def"] and rows[10].specifier == "==1.0"
    assert (rows[11].name, rows[11].specifier) == ("under_score-x", "~=1.0 , <2")
    assert rows[12].hashes == [] and rows[12].specifier == ""
    assert (rows[13].name, rows[13].specifier) == ("odd", "]name[x")
    assert rows[15].name == "plain"
    kept = requirement_rows(files, keep_requirement_files=True).where("is_requirement_file").count()
    assert kept == 2
    assert dependency_counts(files).first().dependency_count == 9


def test_requirement_labels_agree_with_rows(make_files, spark):
    made = get_extractor("requirements_dependencies").build(F.lit(REQUIREMENTS), F.lit("f"))
    r = spark.range(1).select(made.alias("r")).first().r
    assert r.metadata["dependency_count"] == "9"
    rows = requirement_rows(make_files((1, "f", REQUIREMENTS))).orderBy("line_no").limit(5).collect()
    assert [r.metadata[f"dependency_{i}"] for i in range(1, 6)] == [x.name + x.specifier for x in rows]
    assert r.metadata["python_version_source"] == "comment" and r.metadata["source_type"] == "requirements_txt"
