import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from corpusrules.llm import hmm as op


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def corpus(seed=0, n=160):
    rng = random.Random(seed)
    speech = [["a", "b", "c", "D"], ["x", "y", "z", "Ünder"]]
    return [" ".join(rng.choice(speech[k % 2]) for _ in range(rng.randint(3, 60))) for k in range(n)]


EXTRA = [None, "", "  ", "unseen words only", "a " * 9000, "A\tB\nc", "one", "one"]


@pytest.mark.parametrize("block_bytes,bucket", [(200, 5), (1 << 25, 1 << 20)])
def test_counts_and_base(docs, monkeypatch, block_bytes, bucket):
    monkeypatch.setattr(op, "BUCKET_WORDS", bucket)
    texts = corpus() + EXTRA
    got = {r["id"]: r for r in op.scores(docs(*texts), rounds=2, block_bytes=block_bytes).collect()}
    counts = Counter(t for k, text in enumerate(texts) if not got[k]["held_out"] for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    for k, text in enumerate(texts):
        own, r = tokens(text), got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in own), rel=1e-9)
        assert r["score"] < 0
    held = [k for k in range(160) if got[k]["held_out"]]
    assert sum(got[k]["score"] for k in held) > sum(got[k]["base_score"] for k in held)


def test_blocks_and_buckets_do_not_matter(docs, monkeypatch):
    texts = corpus(4) + EXTRA
    one = {r["id"]: r["score"] for r in op.scores(docs(*texts).coalesce(1), rounds=3).collect()}
    monkeypatch.setattr(op, "BUCKET_WORDS", 3)
    many = {r["id"]: r["score"] for r in op.scores(docs(*texts).repartition(5), rounds=3, block_bytes=300).collect()}
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], rel=1e-4) for k in one)


def made(words=6, states=3, seed=0):
    """A model and its emissions by word, for plain arrays of tokens."""
    rng = np.random.default_rng(seed)
    first, move, emit = rng.random(states), rng.random((states, states)), rng.random((words, states))
    return op.Hmm(first / first.sum(), move / move.sum(axis=1, keepdims=True), emit), emit / emit.sum(axis=0)


def sequences(lengths, words=6, seed=1):
    rng = np.random.default_rng(seed)
    return rng.integers(0, words, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])


@pytest.mark.parametrize("most", [1, 2, 7, 2048])
def test_likelihood_is_exact(most):
    model, emit = made()
    found, bounds = sequences([1, 2, 5, 40, 700, 3])
    got = op.edges(model, emit, found, op.stretches(bounds, most), 6).logs
    for k in range(6):
        own = found[bounds[k] : bounds[k + 1]]
        vector, log = model.first * emit[own[0]], 0.0
        for x in own[1:]:
            log, vector = log + math.log(vector.sum()), (vector / vector.sum()) @ model.move * emit[x]
        assert got[k] == pytest.approx(log + math.log(vector.sum()), rel=1e-9)


@pytest.mark.parametrize("most", [1, 2, 3, 2048])
def test_expected_counts_by_enumeration(most):
    """Every path of a short text, weighed: first states, moves (over stretches' edges too) and emissions."""
    model, emit = made()
    found, bounds = sequences([5])
    counts = op.Counts(3, 6)
    counts.add(model, emit, found, bounds, most)
    first, move, words, likelihood = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3)), 0.0
    for path in product(range(3), repeat=5):
        p = model.first[path[0]] * math.prod(model.move[a, b] for a, b in zip(path, path[1:], strict=False)) * math.prod(emit[x, s] for s, x in zip(path, found, strict=True))
        likelihood += p
        first[path[0]] += p
        for a, b in zip(path, path[1:], strict=False):
            move[a, b] += p
        for s, x in zip(path, found, strict=True):
            words[x, s] += p
    assert np.allclose(counts.first, first / likelihood) and np.allclose(counts.move, move / likelihood) and np.allclose(counts.symbols, words / likelihood)
    assert counts.total.tolist() == pytest.approx([math.log(likelihood), 5])


def test_counts_do_not_depend_on_stretches():
    model, emit = made(20, 4)
    found, bounds = sequences([900, 1, 33, 256, 257, 5000], 20)
    whole, cut = op.Counts(4, 20), op.Counts(4, 20)
    whole.add(model, emit, found, bounds, 10_000)
    cut.add(model, emit, found, bounds, 64)
    for name in ("first", "move", "symbols", "total"):
        assert np.allclose(getattr(whole, name), getattr(cut, name), rtol=1e-6)
    assert whole.move.sum() == pytest.approx(len(found) - 6)


def fitted(docs, texts, rounds, states=3, **shape):
    found = op.corpus(docs(*texts), id_col="doc_id", text_col="text", folds=7, fold=2, **shape)
    return found, *op.baum_welch(found, op.starting_model(found.lexicon, states), rounds)


@pytest.mark.parametrize("symbols", [op.SYMBOLS, 4])
def test_training_improves_and_emissions_are_distributions(docs, symbols):
    """Some words have symbols of their own (the most frequent ones, if not all may), the others share some."""
    texts = corpus(2) + [" ".join(f"r{k}_{j}" for j in range(k % 4)) for k in range(60)]
    found, model, history = fitted(docs, texts, 5, symbols=symbols)
    lexicon = found.lexicon
    assert all(a < b + 1e-4 for a, b in zip(history, history[1:], strict=False)) and history[-1] > history[0] + (0.05 if symbols > 4 else 0)
    assert model.first.sum() == pytest.approx(1) and np.allclose(model.move.sum(axis=1), 1)
    assert np.allclose(op.emissions(model, lexicon).sum(axis=0), 1) and lexicon.shares.sum() == pytest.approx(1)
    counts = Counter(t for row in op.scores(docs(*texts), rounds=0).select("id", "held_out").collect() if not row["held_out"] for t in tokens(texts[row["id"]]))
    own = sorted(c for w, c in counts.items() if w is not None and c >= op.OWN)
    assert len(own) == 8 and sorted(lexicon.counts.tolist()) == (own if symbols > 4 else [c for c in own if c >= min(op.OWN << k for k in range(20) if sum(x >= op.OWN << k for x in own) <= 4)])
    assert lexicon.class_words.sum() == len(counts) - 1 - len(lexicon.words) and lexicon.class_tokens.sum() + lexicon.counts.sum() + lexicon.ends == sum(counts.values())
    # A class's known words and one unknown word have all of it.
    of = Counter(int(c) for c in np.repeat(np.arange(op.CLASSES), lexicon.class_words.astype(int)))
    (k, n) = of.most_common(1)[0]
    rare = np.array([k] * n, np.uint64)
    known = lexicon.within(rare, np.full(n, lexicon.class_tokens[k] / n), np.full(n, lexicon.size))
    assert known.sum() + 1 / (lexicon.class_tokens[k] + lexicon.class_words[k] + 1) == pytest.approx(1)


def test_lookup():
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    others = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    for n in (0, 1, 3, len(words)):
        look_up = op.Lookup(words[:n])
        assert look_up(words[:n]).tolist() == list(range(n))
        assert look_up(others).tolist() == (n + (others % np.uint64(op.CLASSES)).astype(int)).tolist()


def test_noise_differs_by_state_and_word():
    weights = op.noise(np.arange(5000, dtype=np.uint64), 4)
    assert (weights > 0).all() and weights.mean() == pytest.approx(2, rel=0.05) and weights.var() == pytest.approx(2, rel=0.2)
    assert abs(np.corrcoef(weights.T) - np.eye(4)).max() < 0.06


def test_edges_of_tables(docs, rows):
    assert op.scores(docs()).collect() == []
    twins = rows("doc_id string, text string, block int, score int", (None, "a b", 1, 1), ("q", None, 1, 1), ("q", None, 1, 1))
    got = op.scores(twins, rounds=1).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 3] and all(r["train_tokens"] == got[0]["train_tokens"] for r in got)


def test_no_training_text(rows):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (row,) = op.scores(rows("doc_id long, text string", (held, "a b"))).collect()
    assert row["held_out"] and (row["n_known"], row["train_tokens"], row["base_score"]) == (0, 0, 0.0) and row["score"] <= 0
