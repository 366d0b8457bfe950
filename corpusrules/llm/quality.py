"""Quality classifier: a Gaussian kernel over document statistics by random Fourier features, ridge regression, isotonic scores.

1. ``statistics``: one scan turns each whole text into ``len(STATISTICS)`` numbers (never its id, language or source).
2. Labelled rows give mean and spread of each number, and then the sums of the normal equations, per fold: every task adds
   up its rows, one task per block of the matrices adds up the tasks, and the driver solves systems of ``FEATURES + 1``.
3. Each fold is scored by the equations of the other folds.  These scores, counted in ``GRID`` steps, give the isotonic
   curve that turns a raw score into the probability of label 1; counts, not rows, reach the driver.

Null and empty texts have the statistics of a text without words and are scored like any other.  Null labels are not
learned from; a document labelled twice counts twice.  Without any label every score is 0.5; with labels of one kind only
it is that label.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusrules.llm.storage import written
from corpusrules.llm.words import hash_words, pieces, row_sums, split_words, text_buffer

STATISTICS = (
    "log_words", "log_bytes", "mean_word", "word_spread", "upper", "digits", "bars", "bangs", "symbols", "commas_stops",
    "beyond_ascii", "breaks", "distinct", "most_common", "repeats", "short", "repeated_lines",
)
FEATURES = 256
FOLDS = 5
RIDGE = 1e-3
#: Width of the kernel in standard deviations, for the number of statistics.
WIDTH = 4.0
GRID = 2000
SEED = 4
THRESHOLD = 0.7

_LINES = np.ones(256, dtype=bool)
_LINES[0x0A] = False


def _share_of(flags: np.ndarray, bounds: np.ndarray, over: np.ndarray) -> np.ndarray:
    return row_sums(flags.astype(np.float64), bounds) / np.maximum(over, 1)


def _repeats(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most common one, per row."""
    distinct, most = np.zeros(rows), np.zeros(rows)
    if not len(hashes):
        return distinct, most
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
    runs = np.diff(np.append(starts, len(h)))
    np.add.at(distinct, r[starts], 1)
    np.maximum.at(most, r[starts], runs)
    return distinct, most


def document_statistics(texts: pa.Array) -> np.ndarray:
    """One row per text, columns as ``STATISTICS``."""
    out = np.zeros((len(texts), len(STATISTICS)))
    flat, bounds = text_buffer(texts)
    for first, last in pieces(bounds):
        data = flat[bounds[first] : bounds[last]]
        at = bounds[first : last + 1] - bounds[first]
        size = np.diff(at)
        byte = {
            "upper": (data >= 0x41) & (data <= 0x5A), "digits": (data >= 0x30) & (data <= 0x39), "bars": data == 0x7C, "bangs": (data == 0x21) | (data == 0x3F),
            "symbols": np.isin(data, np.frombuffer(b"#$%&*+<=>@^_`{}~\\/[]", np.uint8)), "commas_stops": (data == 0x2C) | (data == 0x2E),
            "beyond_ascii": data >= 0x80, "breaks": data == 0x0A,
        }
        for name, flags in byte.items():
            out[first:last, STATISTICS.index(name)] = _share_of(flags, at, size)
        out[first:last, STATISTICS.index("log_bytes")] = np.log1p(size)
    for words in split_words(texts):
        part = out[words.first : words.last]
        at = words.bounds()
        n = np.diff(at)
        length = (words.end - words.start).astype(np.float64)
        mean = row_sums(length, at) / np.maximum(n, 1)
        hashes = hash_words(words)
        distinct, most = _repeats(hashes, words.row, words.rows)
        again = np.zeros(len(hashes), dtype=bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
        for name, value in (
            ("log_words", np.log1p(n)), ("mean_word", np.log1p(mean)), ("word_spread", np.log1p(np.sqrt(np.maximum(0, row_sums(length**2, at) / np.maximum(n, 1) - mean**2)))),
            ("distinct", distinct / np.maximum(n, 1)), ("most_common", most / np.maximum(n, 1)), ("repeats", _share_of(again, at, n)), ("short", _share_of(length <= 3, at, n)),
        ):
            part[:, STATISTICS.index(name)] = value
    for lines in split_words(texts, _LINES):
        n = np.bincount(lines.row, minlength=lines.rows)
        distinct, _ = _repeats(hash_words(lines), lines.row, lines.rows)
        out[lines.first : lines.last, STATISTICS.index("repeated_lines")] = 1 - distinct / np.maximum(n, 1)
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics(texts: pa.Array) -> pa.Array:
    """The numbers of each text as an array column."""
    values = document_statistics(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(values.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


class Lift(NamedTuple):
    """Standardised statistics to cosines: ``cos(x @ turns + shifts)``, and a constant."""

    mean: np.ndarray
    spread: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.cos(x @ self.turns + self.shifts) * np.sqrt(2 / FEATURES), np.ones(len(x))])


def fourier_features(mean: np.ndarray, spread: np.ndarray, seed: int = SEED) -> Lift:
    """Frequencies of a Gaussian kernel of ``WIDTH`` standard deviations."""
    rng = np.random.default_rng(seed)
    return Lift(mean, spread, rng.normal(size=(len(STATISTICS), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES))


class Model(NamedTuple):
    lift: Lift
    weights: np.ndarray
    levels: np.ndarray
    chances: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.lift(x) @ self.weights, self.levels, self.chances), 0, 1)


def _sums(lift: Lift):
    """Per task: the normal equations of each fold, as one row per fold and block of 32 lines."""
    schema = pa.schema([("fold", pa.int32()), ("block", pa.int32()), ("sums", pa.binary())])
    wide = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, wide, wide + 1))
        for batch in batches:
            z, y, fold = lift(_matrix(batch.column("x"))), batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
            for f in range(FOLDS):
                own = z[fold == f]
                total[f] += own.T @ np.column_stack([own, y[fold == f]])
        blocks = range(0, wide, 32)
        yield pa.RecordBatch.from_pydict(
            {"fold": [f for f in range(FOLDS) for _ in blocks], "block": [b for _ in range(FOLDS) for b in blocks], "sums": [total[f, b : b + 32].tobytes() for f in range(FOLDS) for b in blocks]}, schema=schema
        )

    return run


def _add_up(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column("sums"):
            part = np.frombuffer(value.as_buffer(), np.float64)
            total = part.copy() if total is None else total + part
    yield pa.RecordBatch.from_pydict(
        {"fold": [key[0].as_py()], "block": [key[1].as_py()], "sums": [total.tobytes()]}, schema=pa.schema([("fold", pa.int32()), ("block", pa.int32()), ("sums", pa.binary())])
    )


def _solve(sums: np.ndarray) -> np.ndarray:
    wide = FEATURES + 1
    penalty = np.eye(wide) * RIDGE * max(1.0, sums[-1, wide - 1])
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(sums[:, :wide] + penalty, sums[:, wide])


def pool_adjacent(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic (rising) means of ``ones / counts`` by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for good, n in zip(ones, counts, strict=True):
        blocks.append([good, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.repeat([good / n for good, n, _ in blocks], [int(width) for *_, width in blocks])


def fit(labelled: DataFrame) -> Model:
    """A model from rows ``x`` (statistics), ``y`` (0 or 1) and ``fold``."""
    wide = FEATURES + 1
    parts = [F.struct(F.avg(F.col("x")[k]).alias("mean"), F.stddev_pop(F.col("x")[k]).alias("spread")).alias(f"s{k}") for k in range(len(STATISTICS))]
    *moments, count, ones = labelled.agg(*parts, F.count("*").alias("count"), F.sum("y").alias("ones")).first()
    flat = fourier_features(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    if not count or ones in (0, count):
        same = 0.5 if not count else float(ones > 0)
        return Model(flat, np.zeros(wide), np.zeros(1), np.full(1, same))
    lift = fourier_features(np.array([m[0] for m in moments]), np.maximum([m[1] for m in moments], 1e-6))
    added = labelled.mapInArrow(_sums(lift), "fold int, block int, sums binary").groupBy("fold", "block").applyInArrow(_add_up, "fold int, block int, sums binary")
    sums = np.zeros((FOLDS, wide, wide + 1))
    for fold, block, part in added.collect():
        lines = np.frombuffer(part, np.float64).reshape(-1, wide + 1)
        sums[fold, block : block + len(lines)] = lines
    total = sums.sum(axis=0)
    others = np.stack([_solve(total - sums[f]) for f in range(FOLDS)])

    @F.arrow_udf(T.IntegerType())
    def step(x: pa.Array, fold: pa.Array) -> pa.Array:
        raw = (lift(_matrix(x)) * others[fold.to_numpy(zero_copy_only=False)]).sum(axis=1)
        return pa.array(np.clip(np.rint((raw + 0.5) * (GRID / 2)), 0, GRID).astype(np.int32))

    counted = labelled.groupBy(step("x", "fold").alias("step")).agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("step").collect()
    levels = np.array([r["step"] / (GRID / 2) - 0.5 for r in counted])
    return Model(lift, _solve(total), levels, pool_adjacent(np.array([float(r["ones"]) for r in counted]), np.array([float(r["n"]) for r in counted])))


def scores(docs: DataFrame, model: Model, x_col: str) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(x: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(_matrix(x)))

    return score(F.col(x_col))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``held_out`` (crc32 of the id as text leaves ``fold``), ``score``, ``predicted``, and ``statistics``."""
    left_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))
    known = written(docs.select(F.col(id_col), left_out.alias("held_out"), statistics(F.col(text_col).cast("string")).alias("x")), "statistics")
    named = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).where("y is not null")
    labelled = written(
        known.where(~F.col("held_out")).join(named, F.col(id_col) == F.col("label_id")).select("x", "y", F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(FOLDS)).cast("int").alias("fold")), "labelled"
    )
    model = fit(labelled)
    scored = known.withColumn("score", scores(known, model, "x"))
    return scored.select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.col("x").alias("statistics"))
