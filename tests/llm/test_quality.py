import random
import zlib

import numpy as np
import pyarrow as pa

from corpusrules.llm import quality as op


def good(rng):
    return "\n".join(" ".join("".join(rng.choices("aeinorst", k=rng.randint(2, 9))) for _ in range(rng.randint(8, 30))) + "." for _ in range(rng.randint(1, 6)))


def bad(rng):
    kind = rng.randrange(4)
    word = "".join(rng.choices("aeinorst", k=6))
    return [" ".join([word] * 60), " | ".join("".join(rng.choices("aeinorst", k=7)) for _ in range(40)), " ".join(w.upper() + "!!" for w in good(rng).split()), " ".join(w + rng.choice(["%%%", "$$$", "&&&"]) for w in good(rng).split())][kind]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    marks = [int(rng.random() < 0.8) for _ in range(n)]
    return [good(rng) if m else bad(rng) for m in marks], marks


def test_held_out_rows(docs, rows):
    texts, marks = corpus()
    labels = rows("doc_id long, quality int, text string", *((k, m, "bad") for k, m in enumerate(marks)), (5, None, ""), (None, 1, ""), (10**9, 0, ""))
    got = {r["doc_id"]: r for r in op.quality(docs(*texts, None, "", "x" * 300000), labels).collect()}
    held = [k for k in range(len(texts)) if got[k]["held_out"]]
    right = sum(got[k]["predicted"] == marks[k] for k in held)
    assert len(held) > 50 and right / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert got[len(texts)]["score"] == got[len(texts) + 1]["score"]
    spoiled = rows("doc_id long, quality int", *((k, 1 - m if got[k]["held_out"] else m) for k, m in enumerate(marks)))
    again = {r["doc_id"]: r["score"] for r in op.quality(docs(*texts), spoiled).collect()}
    assert max(abs(again[k] - got[k]["score"]) for k in again) < 1e-6


def test_without_labels(docs, rows):
    none = rows("doc_id long, quality int")
    assert {r["score"] for r in op.quality(docs("a", None), none).collect()} == {0.5}
    ones = rows("doc_id long, quality int", (0, 1), (1, 1), (2, 1), (3, 1))
    assert {r["score"] for r in op.quality(docs("a", None, "b", "c"), ones).collect()} == {1.0}
    assert op.quality(docs(), none).collect() == []


def test_statistics_do_not_mix_rows():
    texts = ["a b a a", None, "", "X|Y|", "é!\né!\n\nü, 12.", "word " * 3000]
    together = op.document_statistics(pa.array(texts))
    assert np.allclose(together, np.concatenate([op.document_statistics(pa.array([t], pa.string())) for t in texts]))
    row = dict(zip(op.STATISTICS, together[0], strict=True))
    assert row["distinct"] == 0.5 and row["most_common"] == 0.75 and row["repeats"] == 1 / 4
    assert dict(zip(op.STATISTICS, together[4], strict=True))["repeated_lines"] == 1 - 2 / 3


def test_pooling():
    assert op.pool_adjacent(np.array([1.0, 0.0, 3.0]), np.array([2.0, 2.0, 3.0])).tolist() == [0.25, 0.25, 1.0]
    assert op.pool_adjacent(np.array([0.0, 1.0, 1.0]), np.array([1.0, 1.0, 1.0])).tolist() == [0.0, 1.0, 1.0]


def test_partition_sums_are_those_of_one_task(rows):
    rng = np.random.default_rng(0)
    values = [([float(x) for x in rng.normal(size=len(op.STATISTICS))], float(k % 3 > 0), k % op.FOLDS) for k in range(200)]
    schema = "x array<double>, y double, fold int"
    one, many = op.fit(rows(schema, *values).coalesce(1)), op.fit(rows(schema, *values).repartition(7))
    assert np.allclose(one.weights, many.weights) and np.allclose(one.chances, many.chances)


def test_against_plain_numpy(docs, rows):
    """Scores worked out again from all labelled rows at once: standardised statistics, cosines, ridge, isotonic means of out-of-fold scores."""
    texts, marks = corpus(300, 3)
    labels = rows("doc_id long, quality int", *enumerate(marks))
    table = docs(*texts)
    got = {r["doc_id"]: r for r in op.quality(table, labels).collect()}
    fold = {r[0]: r[1] for r in table.selectExpr("doc_id", f"pmod(xxhash64(doc_id, {op.SEED}), {op.FOLDS})").collect()}
    x = np.concatenate([op.document_statistics(pa.array([t])) for t in texts])
    assert np.allclose(x, [got[k]["statistics"] for k in range(len(texts))])
    learned = np.array([k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 4 != 2])
    y, folds = np.array(marks, float)[learned], np.array([fold[k] for k in learned])
    rng = np.random.default_rng(op.SEED)
    turns, shifts = rng.normal(size=(x.shape[1], op.FEATURES)) / op.WIDTH, rng.uniform(0, 2 * np.pi, op.FEATURES)
    mean, spread = x[learned].mean(0), np.maximum(x[learned].std(0), 1e-6)
    z = np.column_stack([np.cos(np.clip((x - mean) / spread, -6, 6) @ turns + shifts) * np.sqrt(2 / op.FEATURES), np.ones(len(x))])

    def ridge(kept):
        a, n = z[learned[kept]], kept.sum()
        return np.linalg.solve(a.T @ a + np.diag([op.RIDGE * n] * op.FEATURES + [1e-9]), a.T @ y[kept])

    raw = np.empty(len(learned))
    for f in range(op.FOLDS):
        raw[folds == f] = z[learned[folds == f]] @ ridge(folds != f)
    steps = np.clip(np.rint((raw + 0.5) * op.GRID / 2), 0, op.GRID)
    levels = np.unique(steps)
    # The isotonic fit by its minimax form.
    ones, counts = np.array([y[steps == s].sum() for s in levels]), np.array([(steps == s).sum() for s in levels])
    up, down = np.concatenate([[0], np.cumsum(ones)]), np.concatenate([[0], np.cumsum(counts)])
    chances = [max(min((up[b] - up[a]) / (down[b] - down[a]) for b in range(k + 1, len(levels) + 1)) for a in range(k + 1)) for k in range(len(levels))]
    expected = np.clip(np.interp(z @ ridge(np.ones(len(learned), bool)), levels / (op.GRID / 2) - 0.5, chances), 0, 1)
    assert max(abs(got[k]["score"] - expected[k]) for k in range(len(texts))) < 1e-6
