import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusrules.llm import sharding


@given(st.integers(1, 3000), st.integers(0, 1 << 30))
def test_network_is_a_bijection_with_an_inverse(count, seed):
    numbers = np.arange(count)
    places = sharding.permuted(numbers, count, seed)
    assert np.array_equal(np.sort(places), numbers)
    assert np.array_equal(sharding.permuted(places, count, seed, back=True), numbers)


@given(st.integers(1 << 40, (1 << 62) - 1), st.data())
def test_large_ranges(count, data):
    number = data.draw(st.integers(0, count - 1))
    shard, slot = sharding.slot_of(number, count, 1000)
    assert 0 <= shard < 1000 and slot * 1000 + shard < count
    assert sharding.row_at(shard, slot, count, 1000) == number


def test_places_look_random():
    """Neighbours part, and places are even over shards whatever block of rows one takes."""
    count = 100_000
    places = sharding.permuted(np.arange(count), count)
    assert abs(np.corrcoef(np.arange(count), places)[0, 1]) < 0.02
    block = np.bincount(places[:20_000] % 40, minlength=40)
    assert abs(block - 500).max() < 120
    assert np.mean(np.abs(np.diff(places)) < 100) < 0.01
    assert not np.array_equal(places, sharding.permuted(np.arange(count), count, seed=1))


def test_no_such_slot():
    assert sharding.row_at(0, 0, 1, 4) == 0
    with pytest.raises(IndexError):
        sharding.row_at(1, 0, 1, 4)


def test_rows(spark, docs):
    texts = ["b", None, "", "a" * 100_000, "Zoë", "same", "same"]
    rows = docs(*texts)
    extra = rows.where("doc_id = 5").selectExpr("cast(null as long) doc_id", *[c for c in rows.columns if c != "doc_id"])
    rows = rows.union(rows.where("doc_id = 3")).union(extra).union(extra)
    found = sharding.sharded(rows, shards=3).collect()
    want = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "same"), (None, "same")]
    facts = [(k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in want]
    assert Counter((r["id"], r["size"], r["crc"]) for r in found) == Counter(facts)
    order = sorted(facts, key=lambda f: (f[0] is None, f))
    for r in found:
        assert order[r["number"]] == (r["id"], r["size"], r["crc"])
        assert (r["shard"], r["slot"]) == sharding.slot_of(r["number"], len(want), 3)
    counts = Counter(r["shard"] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n)) for s, n in counts.items())


def test_layout_does_not_matter(docs):
    rows = docs(*[f"text {k % 7}" for k in range(60)])
    one, two = (sharding.digest(sharding.sharded(r)) for r in (rows.repartition(5), rows.coalesce(1)))
    assert Counter(one.collect()) == Counter(two.collect())


def test_empty_table(docs):
    assert sharding.digest(sharding.sharded(docs("x").limit(0))).collect() == []


def test_written_shards(spark, docs, tmp_path):
    rows = docs(*[f"text {k}" for k in range(50)]).withColumnRenamed("found", "slot")
    sharding.write_shards(rows, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert set(back.columns) == {*rows.columns, "slot_", "shard"}
    assert Counter(back.select(rows.columns).collect()) == Counter(rows.collect())
    whole = {(r["id"], r["shard"], r["slot"]) for r in sharding.sharded(rows, shards=4).collect()}
    assert {(r["doc_id"], r["shard"], r["slot_"]) for r in back.collect()} == whole
    for file in sorted((tmp_path / "out" / "shard=2").glob("*.parquet")):
        slots = [r["slot_"] for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
