import random
import re
from itertools import combinations

import numpy as np
import pytest

from corpusrules.llm import jaccard as op
from corpusrules.llm.components import components
from corpusrules.llm.lookup import looked_up


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts, ids):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k in range(len(texts)):
        if ids[k] is not None:
            least[find(k)] = min(ids[k], least.get(find(k), ids[k]))
    return sorted((str(ids[k]), len(sets[k]), str(least.get(find(k)))) for k in range(len(texts)))


def corpus(seed, sizes, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = []
    for n in sizes:
        base = rng.choices(vocabulary, k=n)
        texts.append(" ".join(base))
        for _ in range(edits):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, n // 25))):
                copy[rng.randrange(n)] = rng.choice(vocabulary)
            if rng.random() < 0.5:
                copy = copy[: n - rng.randint(0, max(1, n // 12))]
            texts.append(" ".join(copy))
    return texts


FIXED = [None, "", " \t\n", "a", "A", "a b c", "a  b\tC", "a b c d e", "a b c d e", "É x y z q", "é x y z q", "long " * 5000, "long " * 4000]


@pytest.mark.parametrize("small", [0, op.SMALL_MOST])
def test_against_brute_force(docs, monkeypatch, small):
    texts = FIXED + corpus(1, [8, 9, 10, 11, 12, 14, 16, 30, 80, 200], 6)
    if small:  # every set that may be small is
        monkeypatch.setattr(op, "boundary", lambda candidates: op.SMALL_MOST)
    else:
        monkeypatch.setattr(op, "boundary", lambda candidates: 0)
    monkeypatch.setattr(op, "SMALL_MOST", 14)
    got = op.digest(op.similar_documents(docs(*texts))).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(texts, list(range(len(texts))))


def test_hot_passage_and_copies(docs):
    """A passage in most documents, and a large group of near copies: heavy shingles, one star, all links kept."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [passage + " " + " ".join(f"u{k}_{j}" for j in range(rng.randint(20, 200))) for k in range(150)]
    base = [f"b{k}" for k in range(120)]
    for _ in range(80):
        copy = base[:]
        copy[rng.randrange(120)] = f"e{rng.random()}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 40
    got = op.digest(op.similar_documents(docs(*texts))).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(texts, list(range(len(texts))))


@pytest.mark.parametrize("bucket", [op.BUCKET_SHINGLES, 300])
def test_replies_are_a_row_per_bucket_and_part(docs, monkeypatch, bucket):
    """However many buckets: the same candidates, and at most a row for each bucket (and each home of heavy shingles) and part."""
    texts = corpus(6, [30, 40, 60, 90], 12) + [" ".join(f"z{k}_{j}" for j in range(20)) for k in range(200)]
    table = docs(*texts).select("doc_id", "text")
    described, frequent = op.describe(table, "doc_id", "text")
    whole = {r["node"]: tuple(r) for r in op.shared_sets(table, described, frequent, "text").collect()}
    monkeypatch.setattr(op, "BUCKET_SHINGLES", bucket)
    assert {r["node"]: tuple(r) for r in op.shared_sets(table, described, frequent, "text").collect()} == whole and len(whole) > 20
    total = described.select("node", "n").distinct().selectExpr("sum(n)").first()[0]
    buckets = -(-total // bucket)
    sent = table.select("text").mapInArrow(op._mapper(op.WIDTH, buckets, np.zeros(0, np.uint64)), "bucket long, nodes binary, lengths binary, tokens binary")
    replies = sent.groupBy("bucket").applyInArrow(op._reducer(buckets), op._REPLY)
    assert replies.count() <= buckets**2


def test_pairs_tried_between_components(docs, rows):
    """One list of a large component and a few other sets: members of the former do not meet each other."""
    large, few = [(1, 100 + k, 50, 50, 0, 7, 16, True) for k in range(1000)], [(1, k, 50 + k, 50, 0, k, 16 + k % 2, False) for k in range(5)]
    members = rows("token long, node long, n long, shared int, place int, root long, band long, major boolean", *large, *few, (1, 9, 5000, 5000, 0, 9, 36, False))
    assert op.pairs_tried(members) == 5 * 1005 + 1


@pytest.mark.parametrize("most", [10, 0])
def test_looked_up(rows, most):
    table = rows("k long, v string", *[(1, f"a{k}") for k in range(40)], *[(k, "b") for k in range(2, 9)], (None, "c"), (None, "d"))
    values = rows("k long, w int", *[(k, 10 * k) for k in range(1, 6)])
    got = looked_up(table, "k", values, most=most or 1, hot_rows=20)
    assert got.columns == ["k", "v", "w"]
    assert sorted(tuple(map(str, r)) for r in got.collect()) == sorted((str(r["k"]), r["v"], str(10 * r["k"] if r["k"] and r["k"] < 6 else None)) for r in table.collect())


def test_repeated_and_null_ids(rows):
    table = rows("doc_id long, text string, id int", (5, "a b c d e f", 0), (5, "a b c d e f", 0), (None, "a b c d e f", 0), (3, "a b c d e f", 0), (5, "other words", 0), (None, None, 0))
    texts = [r["text"] for r in table.collect()]
    got = op.digest(op.similar_documents(table)).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(texts, [5, 5, None, 3, 5, None])
    kept = op.first_of_each_group(table)
    assert kept.columns == table.columns
    assert sorted((str(r[0]), r[1]) for r in kept.collect()) == [("3", "a b c d e f"), ("5", "other words"), ("None", None)]


def test_one_row_of_equal_rows_stays(rows):
    table = rows("doc_id long, text string", (1, "x y"), (1, "x y"), (2, None), (2, None), (4, "z"), (1, "z"))
    assert sorted((r[0], str(r[1])) for r in op.first_of_each_group(table).collect()) == [(1, "x y"), (1, "z"), (2, "None"), (2, "None")]


def test_empty(docs):
    assert op.similar_documents(docs()).collect() == []
    assert op.first_of_each_group(docs()).collect() == []


def test_components(rows):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    found = {r["node"]: r["root"] for r in components(rows("a long, b long", *links)).collect()}
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert found == {k: find(k) for k in root}


@pytest.mark.parametrize("n,m", [(5, 4), (10, 8), (10, 9), (13, 16), (100, 120)])
def test_overlap_needed(n, m):
    need = op.overlap_needed(n, m)
    assert 100 * need >= 80 * (n + m - need) and 100 * (need - 1) < 80 * (n + m - need + 1)
