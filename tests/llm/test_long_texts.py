"""One very long text among short ones, through every operator that reads texts."""

import random

import pytest

from corpusrules.llm import hmm, jaccard, langid, merkle, quality, repeats, sharding

WORDS = 1_500_000


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choices(words, k=WORDS))
    rows = [(k, " ".join(rng.choices(words, k=30)), "en" if k % 2 else "de", "s", 1) for k in range(1, 40)]
    return spark.createDataFrame([(0, long, "en", "s", 1), *rows], "doc_id long, text string, lang string, source string, n_chars int").cache()


def test_shingles(table):
    found = {r[0]: (r[1], r[2]) for r in jaccard.digest(jaccard.similar_documents(table)).collect()}
    assert found[0][1] == 0 and 0.9 * WORDS < found[0][0] <= WORDS - 4 and len(found) == 40


def test_scores_and_languages(spark, table):
    scored = {r["id"]: r for r in hmm.scores(table, rounds=1).collect()}
    assert scored[0]["n_tokens"] == WORDS + 1 and scored[0]["score"] < scored[0]["n_tokens"] * -2
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    assert {r["doc_id"] for r in quality.quality(table, labels).collect()} == set(range(40))
    assert {r["lang_pred"] for r in langid.languages(table).collect()} <= {"en", "de"}


def test_bytes(table):
    size = len(table.where("doc_id = 0").first()["text"])
    cut = {r["doc_id"]: r for r in repeats.digest(repeats.without_repeats(table)).collect()}
    assert (cut[0]["n_bytes"], cut[0]["n_removed"]) == (size, 0)
    assert {r["size"] for r in sharding.digest(sharding.sharded(table)).where("doc_id = 0").collect()} == {size + 16}
    assert merkle.digest(table).count() == 40
