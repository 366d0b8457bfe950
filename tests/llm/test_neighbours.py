import math
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusrules.llm import neighbours as op
from corpusrules.llm.catalog import QUERIES


def brute(vectors, k=5, every=50):
    """vectors: (id, list) pairs; answers of every query id."""
    ok = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % every:
            continue
        found = {}
        for i, b in ok:
            if i != q and len(a) == len(b):
                found[i] = max(found.get(i, -2), float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))))
        out[q] = sorted(((-s, i) for i, s in found.items()))[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 24))
    return [(k, (centres[k % 8] + rng.normal(size=24) * 0.6).astype(np.float32).tolist()) for k in range(1500)]


@pytest.mark.parametrize("points", [8192, 300])
def test_recall(rows, clustered, points):
    table = rows("vec_id long, embedding array<float>, score double", *((i, v, 0.0) for i, v in clustered))
    index = op.build_index(table, shard_points=points)
    assert index.count() == -(-1500 // points) or points == 8192
    got = answers(op.search(index, table.where("vec_id % 50 = 0")))
    expected = brute([(i, np.float32(v).astype(float).tolist()) for i, v in clustered])
    assert set(got) == set(expected)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in expected[q]}) for q in expected)
    assert hits / (5 * len(expected)) >= 0.97
    for q, found in got.items():
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        scores = {i: -s for s, i in brute([(q, dict(clustered)[q]), *[(i, dict(clustered)[i]) for _, i, _ in found]])[q]}
        assert all(s == pytest.approx(scores[i], abs=1e-12) for _, i, s in found)


GIVEN = "/root/testdata/check_s"


@pytest.mark.skipif(not Path(GIVEN).exists(), reason="given tables not present")
def test_recall_of_the_registered_query(spark):
    """Against brute force, block by block, on the given embeddings: two shards of production size."""
    got = answers(QUERIES["op6_neighbours"](spark, GIVEN))
    table = pq.read_table(f"{GIVEN}/embeddings.parquet")
    ids = table["vec_id"].to_numpy()
    vectors = np.stack(table["embedding"].to_numpy()).astype(float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 50 == 0)
    assert len(ids) > op.SHARD_POINTS and set(got) == set(ids[asked].tolist())
    hits = 0
    for block in np.array_split(asked, -(-len(asked) // 256)):
        scores = vectors[block] @ vectors.T
        scores[np.arange(len(block)), block] = -2
        nearest = np.argpartition(-scores, 5, axis=1)[:, :5]
        hits += sum(len({i for _, i, _ in got[q]} & set(ids[near].tolist())) for q, near in zip(ids[block].tolist(), nearest, strict=True))
    assert hits / (5 * len(asked)) >= 0.9


def test_small_and_odd_rows(rows):
    values = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, []),
        (50, [0.0, 1.0]), (100, [1.0, 0.0, 0.0]), (150, None), (200, [1e200, 1e200]), (250, [1e-200, 0.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.5]),
    ]
    got = answers(op.neighbours(rows("vec_id long, embedding array<double>", *values)))
    assert [i for _, i, _ in got[0]] == [1, 2, 250, 200, 50]
    assert 100 not in got and 150 not in got
    assert [r for r, _, _ in got[50]] == [1, 2, 3, 4, 5]


def test_very_common_vector(rows):
    """Thousands of equal vectors are one point: ties go to the smallest ids, and nothing else is lost."""
    rng = np.random.default_rng(1)
    common = [1.0] + [0.0] * 7
    values = [(k, common) for k in range(0, 4000, 2)] + [(k, rng.normal(size=8).tolist()) for k in range(1, 601, 2)]
    got = answers(op.neighbours(rows("vec_id long, embedding array<double>", *values)))
    assert [i for _, i, _ in got[0]] == [2, 4, 6, 8, 10]
    assert [i for _, i, _ in got[2000]] == [0, 2, 4, 6, 8]


def test_fewer_candidates_repeats_and_empty(rows):
    schema = "vec_id long, embedding array<float>"
    assert answers(op.neighbours(rows(schema, (0, [1.0]), (1, [2.0]), (1, [2.0]), (0, [1.0])))) == {0: [(1, 1, 1.0)]}
    assert op.neighbours(rows(schema)).collect() == []
    assert op.neighbours(rows(schema, (0, [1.0, 2.0]))).collect() == []
    assert op.neighbours(rows(schema, (1, [1.0, 2.0]))).collect() == []


def test_graph_arrays_are_flat_and_sound():
    rng = np.random.default_rng(2)
    vectors = op.unit(rng.normal(size=(400, 10)))
    levels = np.floor(-np.log(1 - rng.random(400)) / np.log(op.LINKS)).astype(np.int32)
    graph = op.Graph(vectors, levels).build()
    assert graph.ground.shape == (400, 2 * op.LINKS) and graph.upper.shape == (levels.sum(), op.LINKS)
    for k in range(400):
        row = graph.ground[k][graph.ground[k] >= 0]
        assert len(set(row.tolist())) == len(row) and k not in row
    for level in range(1, levels.max() + 1):
        for k in np.flatnonzero(levels >= level):
            row = graph.row(int(k), level)
            assert (levels[row[row >= 0]] >= level).all()
