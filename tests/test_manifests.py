"""Manifests line by line: sections, dotted keys, values of several lines, and what makes a file broken."""

import pytest
from pyspark.sql import functions as F

from corpusrules.functions import manifests as ML
from corpusrules.functions.extractors import get_extractor


@pytest.fixture(scope="module")
def read(spark):
    def run(content, ini=False):
        (row,) = spark.createDataFrame([(content,)], "c string").select(ML.read_manifest(F.col("c"), ini).alias("m")).collect()
        return row["m"] and ([(e["line"], e["path"], e["value"], e["quoted"]) for e in row["m"]["entries"]], row["m"]["broken"])

    return run


def test_sections_keys_and_comments(read):
    content = "top = 1\r\n# note\n\n[project] # here\nname = \"x # y\"  # z\n[ tool . 'poetry' ]\nversion = '1'\ndependencies.python = \"^3.9\"\n[[tool.list]]\na=true\n"
    assert read(content) == (
        [(1, "top", "1", False), (5, "project.name", "x # y", True), (7, "tool.poetry.version", "1", True), (8, "tool.poetry.dependencies.python", "^3.9", True), (10, "tool.list.a", "true", False)],
        False,
    )


def test_values_of_several_lines(read):
    content = '[a]\nlist = [\n  "x", # one ]\n  "y]",\n]\ntext = """\n[project]\nrequires-python = "no"\n"""\nsingle = \'\'\'one line\'\'\'\ntable = {x = "1",\n y = [2]}\nlast = "z"'
    entries, broken = read(content)
    assert not broken
    assert [(line, path) for line, path, _, _ in entries] == [(2, "a.list"), (6, "a.text"), (10, "a.single"), (11, "a.table"), (13, "a.last")]
    values = {path: value for _, path, value, _ in entries}
    assert values["a.list"].split() == ["[", '"x",', '"y]",', "]"] and values["a.single"] == "one line" and "requires-python" in values["a.text"]


@pytest.mark.parametrize(
    "content",
    ["key =", "key = # nothing", "[open", "= 1", "just words", 'a = "no end', "a = [1,\n2", 'a = """\nnever closed', "[a]\nb = 'x' y", "a = {b = 1", "[]"],
)
def test_broken(read, content):
    assert read(content)[1]
    assert read("x = 1\n" + content + "\n")[1]


def test_nulls_and_empty(read):
    assert read(None) is None and read("") == ([], False) and read("\n\n") == ([], False)


def test_ini(read):
    content = "[tox]\nenvlist =\n    py311\n\n  py310\nskip: true\n; note\n[testenv:py39]\ndeps = \"a\"\nfree words\n"
    assert read(content, True) == ([(2, "tox.envlist", "\npy311\npy310", False), (6, "tox.skip", "true", False), (9, "testenv:py39.deps", "a", True)], False)


def test_long_texts_need_no_stack(read):
    item = '"' + "x" * 200_000 + '"'
    entries, broken = read("a = [" + ",".join(["'y'"] * 20_000) + "]\nb = " + item)
    assert not broken and entries[1][2] == "x" * 200_000


@pytest.fixture(scope="module")
def pyproject(spark):
    def run(content):
        made = get_extractor("pyproject_toml").build(F.col("c"), F.lit("pyproject.toml"))
        return spark.createDataFrame([(content,)], "c string").select(made.alias("r")).first()["r"]

    return run


@pytest.mark.parametrize(
    "content,version,count",
    [
        ('project.requires-python = ">=3.8"\n', "3.8", None),
        ('[project]\n"requires-python" = ">=3.9"\ndependencies = ["a", "b>=1",\n "c"]\n', "3.9", "3"),
        ('[tool.poetry]\ndependencies.python = "^3.7"\ndependencies.flask = "*"\n', "3.7", "1"),
        ('[tool.poetry.dependencies]\npython = {extras = ["x"], version = "~3.6"}\n[tool.poetry.dependencies.local]\npath = "../x"\n', "3.6", "1"),
        ('[tool.poetry.dependencies.python]\nversion = "3.5.2"\n', "3.5.2", None),
        ('[tool.x]\ndoc = """\n[project]\nrequires-python = ">=3.1"\n"""\n', None, None),
        ('[project]\nrequires-python = ">=3.8"\nbroken\n', None, None),
        ('[project]\nrequires-python = ">=3.8"\ntext = """\nopen', None, None),
        ("[project]\nrequires-python = 3.8\n", None, None),
    ],
)
def test_pyproject(pyproject, content, version, count):
    found = pyproject(content)
    assert (found and found["version"], found and found["metadata"].get("dependency_count")) == (version, count)


def test_relation(spark, make_files):
    files = make_files((1, "pyproject.toml", "[a]\nb = 1\nc = 2"), (2, "x/pyproject.toml", "[a]\nb ="), (3, "none.toml", None))
    got = sorted(tuple(r) for r in ML.manifest_lines(files).select("project_id", "file_path", "line", "path", "value", "broken").collect())
    assert got == [(1, "pyproject.toml", 2, "a.b", "1", False), (1, "pyproject.toml", 3, "a.c", "2", False)]
