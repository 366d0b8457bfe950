import math
import re

import pytest
from pyspark.sql import functions as F

from corpusrules.llm import mixing as op


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """The rule as it is told: hand out by weight, cut at the caps, hand the excess out again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, active = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and active:
        total, spent = sum(weight[s] for s in active), 0.0
        for s in list(active):
            add = min(left * weight[s] / total, most * sizes[s] - target[s])
            target[s] += add
            spent += add
        left -= spent
        active = {s for s in active if target[s] < most * sizes[s] - 1e-9}
        if spent < 1e-9:
            break
    return target


SOURCES = ["b", None, "a", "Z", "é", "b", "b", "tiny", "empty"]


def table(docs, n=400):
    texts = [None if k % 41 == 0 else "" if k % 43 == 0 else " ".join(["w"] * (1 + k * 7919 % 60)) for k in range(n)]
    sources = [SOURCES[k % 7] for k in range(n)]
    sources[5], sources[6] = "tiny", "empty"
    texts[5], texts[6] = "one two three", ""
    return texts, sources, docs(*texts, source=sources)


def test_targets_and_taken(docs):
    texts, sources, df = table(docs)
    got = {r["doc_id"]: r for r in op.digest(op.mixed_rows(df)).collect()}
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + size(t)
    wanted = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for k, (t, s) in enumerate(zip(texts, sources, strict=True)):
        row = got[k]
        assert (row["size"], row["source_size"]) == (size(t), sizes[s])
        assert math.isclose(row["target"], wanted[s], abs_tol=1e-6)
        assert 0 <= row["taken"] <= 2 * row["size"]
        taken[s] += row["taken"]
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 30, s


def test_shards_are_exact_and_reruns_agree(docs):
    _, _, df = table(docs)
    one = {r["id"]: r["shards"] for r in op.mixed_rows(df, shards=8).collect()}
    two = {r["id"]: r["shards"] for r in op.mixed_rows(df.repartition(5), shards=8).collect()}
    assert one == two
    used = [s for shards in one.values() for s in shards]
    counts = [used.count(k) for k in range(8)]
    assert max(counts) - min(counts) <= 1 and min(counts) > 0
    mixed = op.mixed_documents(df, shards=8)
    assert mixed.columns == df.columns
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {k: len(v) for k, v in one.items() if v}


def test_split_is_hypergeometric(spark):
    """Draws of one tree node over many seeds have the mean, the variance and the range of the distribution."""
    draw = op.hypergeometric("50", "20", "15", "u")
    xs = [r[0] for r in spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u")).select(F.expr(draw)).collect()]
    mean, var = 15 * 20 / 50, 15 * 0.4 * 0.6 * 35 / 49
    assert min(xs) >= 0 and max(xs) <= 15
    assert abs(sum(xs) / 4000 - mean) < 0.01
    assert abs(sum((x - mean) ** 2 for x in xs) / 4000 - var) < 0.05
    exact = [math.comb(20, k) * math.comb(30, 15 - k) / math.comb(50, 15) for k in range(16)]
    assert all(abs(xs.count(k) / 4000 - exact[k]) < 0.001 for k in range(16))


@pytest.mark.parametrize("total,marked,drawn", [(0, 0, 0), (1, 1, 0), (1, 1, 1), (10, 0, 5), (10, 10, 4), (7, 3, 7), (10**9, 3 * 10**8, 5 * 10**8)])
def test_edges_of_the_draw(spark, total, marked, drawn):
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    xs = [r[0] for r in spark.range(8).select(((F.col("id") + 0.5) / 8).alias("u")).select(F.expr(op.hypergeometric(str(total), str(marked), str(drawn), "u"))).collect()]
    assert all(low <= x <= high for x in xs)
    if total:
        sd = math.sqrt(drawn * marked / total * (1 - marked / total) * (total - drawn) / max(1, total - 1))
        assert abs(sum(xs) / 8 - drawn * marked / total) <= max(1, sd)


def test_quotas_add_up(rows):
    blocks = {0: 17, 1: 0, 2: 1000, 3: 5}
    quotas = rows("number long, blocks long", *blocks.items())
    got = op.split_quotas(quotas, 16).collect()
    assert {n: sum(r["quota"] for r in got if r["number"] == n) for n in blocks} == blocks
    shards = [sum(r["quota"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(shards) - min(shards) <= 1
    assert [r["quota"] for r in op.split_quotas(quotas, 1).orderBy("number").collect()] == list(blocks.values())


def test_edges(docs, rows):
    assert op.mixed_rows(docs()).collect() == []
    assert op.mixed_documents(docs()).collect() == []
    silent = op.digest(op.mixed_rows(docs(None, "", " "))).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in silent] == [(0, 0.0, 0)] * 3
    twins = rows("doc_id long, text string, source string, mix int", *[(None, "a b", "s", 1)] * 3, *[(4, "c", None, 1)] * 4)
    assert op.mixed_rows(twins).count() == 7
    assert op.mixed_documents(twins).columns == twins.columns


def test_no_python_on_the_path(docs):
    plan = op.mixed_documents(table(docs)[2])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
