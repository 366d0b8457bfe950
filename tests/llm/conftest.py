import pytest


@pytest.fixture(scope="session")
def rows(spark):
    def make(schema, *values):
        return spark.createDataFrame(list(values), schema)

    return make


@pytest.fixture(scope="session")
def docs(spark):
    def make(*texts, **more):
        """Documents numbered from 0; columns that clash with what operators add are there too."""
        n = len(texts)
        source = more.get("source", [f"s{k % 2}" for k in range(n)])
        lang = more.get("lang", [None] * n)
        values = [(k, t, lang[k], source[k], -1.0, "x", 7) for k, t in enumerate(texts)]
        return spark.createDataFrame(values, "doc_id long, text string, lang string, source string, score double, node string, found int")

    return make
