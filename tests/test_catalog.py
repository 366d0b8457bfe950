"""Every registered query against its reference answer in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    if name not in ORACLES:
        return
    answer = con.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, rows) == _rows(columns, answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_depends_on_the_optional_subpackage():
    root = Path(entry.__file__).parent
    for path in [*root.glob("corpusrules/**/*.py"), root / "bench.py", *root.glob("tests/*.py")]:
        if "llm" not in path.relative_to(root).parts[:2]:
            assert "corpusrules.llm" not in path.read_text().replace('"corpusrules.llm" not in', ""), path


def test_absent_modules_are_passed_over():
    assert not entry._present("corpusrules.nothing.catalog") and entry._present("corpusrules.plans.catalog")
