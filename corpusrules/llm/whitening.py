"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

1. Entries become whole numbers, ``x = floor(64 * c) + 1000000`` for an entry ``c`` as double.  The fit list holds each
   distinct ``x``-vector once; vectors are grouped as bytes (an entry takes 1 to 8 of them), pre-aggregated before the shuffle, so copies
   cost one row a task.
2. One pass sums the list per dimension, exactly; a second one sums products of centred entries (the whole part of the mean is taken away as integers,
   so nothing is lost to the size of ``x``), per task first, then row by row of the matrix.
3. The scatter is ``G G'``: Cholesky with the largest remaining diagonal as pivot, ended where only rounding is left.  Rotations of ``G``'s columns
   make them orthogonal: their squared norms are the scatter's eigenvalues, and the columns, at unit length, its eigenvectors.  Products of ``G`` with
   itself are never formed, so small eigenvalues keep their digits.  This works on ``dimensions ** 2`` numbers, whatever the number of rows.
4. Rows are centred, projected and divided by ``sqrt(e)`` in one narrow pass.  ``identity_error`` is measured on the fit list.

Rows take no part whose vector is null or holds null or non-finite entries; nor those with an entry of 2**56 or more, whose ``x`` is no
long, nor those of another length than most usable vectors have (of equally frequent lengths, the longest).  Empty vectors have no
components.  Repeated rows and ids, and null ids, keep their rows.  A list of rank ``r`` has ``r`` components, so one distinct vector has
none.  ``deviation`` is null where the exact number is no long.  Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusrules.llm.storage import written

#: ``x`` is kept without its offset of 1000000, which no covariance and no deviation sees.
SCALE = 64.0
COMPONENTS = 16
#: Entries at or above this have no long ``x``.
ENTRY_MOST = float(1 << 56)
#: Columns whose cosine is below this are orthogonal.
ORTHOGONAL = 1e-15
SWEEPS = 60


class Fit(NamedTuple):
    """Number of distinct vectors, their sums, eigenvalues of their covariance and unit eigenvectors (rows), and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def whole(self) -> np.ndarray:
        """The means' whole parts."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the sums have beyond ``n`` times the whole parts: less than ``n`` each."""
        return np.array([s % self.n for s in self.sums], np.int64)


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """``G`` with ``G G' = scatter``, one column per step, rows in the matrix's own order; as many columns as its rank.

    A dimension is exhausted when what is left of its own diagonal entry is rounding, so scales of dimensions do not matter.
    """
    d = len(scatter)
    factor, left = np.zeros((d, 0)), np.diag(scatter).copy()
    least = left * 4 * d * np.finfo(float).eps
    columns = []
    for _ in range(d):
        pivot = int(np.where(left > least, left, -np.inf).argmax())
        if not left[pivot] > least[pivot]:
            break
        column = (scatter[:, pivot] - factor @ factor[pivot]) / np.sqrt(left[pivot])
        column[[p for p, _ in columns]] = 0.0
        column[pivot] = np.sqrt(left[pivot])
        left -= column**2
        left[pivot] = -np.inf
        columns.append((pivot, column))
        factor = np.column_stack([c for _, c in columns])
    return factor


def _rounds(count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``count`` columns, in rounds of pairs that share none."""
    players = list(range(count)) + ([-1] if count % 2 else [])
    rounds = []
    for _ in range(len(players) - 1):
        half = len(players) // 2
        pairs = [(a, b) for a, b in zip(players[:half], players[: half - 1 : -1], strict=True) if a >= 0 and b >= 0]
        rounds.append((np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)))
        players = [players[0], players[-1], *players[1:-1]]
    return rounds


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms, falling, and unit columns (as rows) of ``factor`` rotated until all its columns are orthogonal."""
    g = factor.copy()
    if g.shape[1]:
        rounds = _rounds(g.shape[1])
        for _ in range(SWEEPS):
            worst = 0.0
            for a, b in rounds:
                one, two = g[:, a], g[:, b]
                alpha, beta, gamma = (one * one).sum(0), (two * two).sum(0), (one * two).sum(0)
                scale = np.sqrt(alpha * beta)
                cosine = np.divide(np.abs(gamma), scale, out=np.zeros_like(scale), where=scale > 0)
                worst = max(worst, cosine.max(initial=0.0))
                turn = cosine > ORTHOGONAL
                if not turn.any():
                    continue
                zeta = (beta[turn] - alpha[turn]) / (2.0 * gamma[turn])
                tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1.0 / np.hypot(1.0, tangent)
                sin = cos * tangent
                one, two = one[:, turn], two[:, turn]
                g[:, a[turn]], g[:, b[turn]] = cos * one - sin * two, sin * one + cos * two
            if worst <= ORTHOGONAL * 8:
                break
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 0]
    vectors = (g[:, order] / np.sqrt(values[order])).T
    if len(vectors):
        largest = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]
        vectors = vectors * np.sign(largest)[:, None]
    return values[order], vectors


_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def usable(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors take part (any length), the length of each, and the entries of those that do, one after the other."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = vectors.flatten()
    known = entries.is_valid().to_numpy(zero_copy_only=False)
    values = entries.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    good = known & np.isfinite(values) & (np.abs(values) < ENTRY_MOST)
    owner = np.repeat(np.arange(len(size)), size)
    ok = vectors.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(owner, ~good, len(size)) == 0)
    return ok, size, values[ok[owner]]


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """``x`` less its offset."""
    return np.floor(values * SCALE).astype(np.int64)


def _packed(x: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest whole numbers that hold all its entries; equal vectors are equal bytes."""
    out, at = [], 0
    for n in size.tolist():
        own = x[at : at + n]
        at += n
        low, high = (int(own.min()), int(own.max())) if n else (0, 0)
        out.append(own.astype(next(w for w in _WIDTHS if np.iinfo(w).min <= low and high <= np.iinfo(w).max)).tobytes())
    return out


def _unpacked(packed: pa.Array, size: int) -> np.ndarray:
    """Vectors of ``size`` entries as the rows of a matrix."""
    out = np.empty((len(packed), size), np.int64)
    width = np.array([len(x.as_buffer()) // size for x in packed], np.int64)
    for kind in _WIDTHS:
        own = np.flatnonzero(width == np.dtype(kind).itemsize)
        if len(own):
            out[own] = np.frombuffer(b"".join(packed[int(k)].as_buffer() for k in own), kind).reshape(len(own), size)
    return out


def _packer(vectors: pa.Array) -> pa.Array:
    ok, size, values = usable(vectors)
    out = np.full(len(ok), None, dtype=object)
    out[ok] = _packed(whole_numbers(values), size[ok])
    return pa.array(out, pa.binary())


def fit_list(rows: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """``x``: the distinct vectors of the commonest length, packed; and that length."""
    vector = F.col(vector_col).cast("array<double>")
    packed = rows.select(F.arrow_udf(_packer, T.BinaryType())(vector).alias("x"), F.size(F.col(vector_col)).alias("size")).where("x is not null")
    # Copies in a task, and then all, become one row that counts them.
    counted = written(packed.groupBy("size", "x").agg(F.count("*").alias("times")), "fit")
    lengths = counted.groupBy("size").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), F.desc("size")).limit(1).collect()
    size = lengths[0]["size"] if lengths else 0
    return counted.where(F.col("size") == size).select("x"), size


def _summer(size: int) -> Callable:
    schema = pa.schema([("n", pa.int64()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, dtype=object)
        for batch in batches:
            x = _unpacked(batch.column("x"), size)
            n += len(x)
            if len(x):
                # Halves of numbers: no sum of a batch leaves 64 bits.
                sums += (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": [b"".join(int(s).to_bytes(16, "little", signed=True) for s in sums)]}, schema=schema)

    return run


def _scatterer(size: int, whole: np.ndarray, part: np.ndarray, matrix: np.ndarray | None) -> Callable:
    """Sums of products of centred entries, or of those projected by ``matrix``; a row of the result to a row."""
    schema = pa.schema([("row", pa.int32()), ("sums", pa.binary())])
    wide = size if matrix is None else matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide + 1, wide))
        for batch in batches:
            y = (_unpacked(batch.column("x"), size) - whole).astype(np.float64) - part
            if matrix is not None:
                y = y @ matrix
            total[:wide] += y.T @ y
            total[wide] += y.sum(0)
        yield pa.RecordBatch.from_pydict({"row": np.arange(wide + 1, dtype=np.int32), "sums": [r.tobytes() for r in total]}, schema=schema)

    return run


def _added(table: pa.Table) -> pa.Table:
    sums = np.sum([np.frombuffer(x.as_buffer()) for x in table.column("sums")], axis=0)
    return pa.table({"row": table.column("row")[:1].cast(pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})


def _scatter(listed: DataFrame, run: Callable) -> np.ndarray:
    rows = listed.mapInArrow(run, "row int, sums binary").groupBy("row").applyInArrow(_added, "row int, sums binary")
    return np.array([np.frombuffer(r["sums"]) for r in sorted(rows.collect())])


def fit(listed: DataFrame, size: int) -> Fit:
    """Eigenvalues and eigenvectors of the covariance of the listed vectors."""
    n, sums = 0, [0] * size
    if size:
        for row in listed.mapInArrow(_summer(size), "n long, sums binary").collect():
            n += row["n"]
            sums = [s + int.from_bytes(row["sums"][16 * k : 16 * k + 16], "little", signed=True) for k, s in enumerate(sums)]
    if not n:
        return Fit(0, [], np.zeros(0), np.zeros((0, size)), 0.0)
    found = Fit(n, sums, np.zeros(0), np.zeros((0, size)), 0.0)
    products = _scatter(listed, _scatterer(size, found.whole, found.rest / n, None))[:size]
    products = (products + products.T) / 2
    values, vectors = one_sided_jacobi(pivoted_cholesky(products))
    return found._replace(values=values / n, vectors=vectors, trace=float(np.trace(products)) / n)


def identity_error(listed: DataFrame, found: Fit, components: int) -> float:
    """Largest absolute entry of the covariance of the list's whitened components, less the identity."""
    matrix = (found.vectors[:components] / np.sqrt(found.values[:components])[:, None]).T
    if not matrix.size:
        return 0.0
    sums = _scatter(listed, _scatterer(len(found.sums), found.whole, found.rest / found.n, matrix))
    mean = sums[-1] / found.n
    return float(np.abs(sums[:-1] / found.n - np.outer(mean, mean) - np.eye(matrix.shape[1])).max())


def deviations(x: np.ndarray, found: Fit) -> list[int | None]:
    """``sum((n * x - S) ** 2)``, None where that is no long."""
    y, rest = x - found.whole, found.rest
    about = ((y.astype(np.float64) * found.n - rest) ** 2).sum(1)
    out: list[int | None] = [None] * len(x)
    small = about < float(1 << 62)
    own = y[small] * found.n - rest
    for k, value in zip(np.flatnonzero(small).tolist(), (own * own).sum(1).tolist(), strict=True):
        out[k] = value
    for k in np.flatnonzero(~small & (about < float(1 << 64))).tolist():
        exact = sum((int(a) * found.n - int(r)) ** 2 for a, r in zip(y[k], rest, strict=True))
        out[k] = exact if exact < 1 << 63 else None
    return out


def whitened(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: ``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    listed, size = fit_list(rows, vector_col)
    found = fit(listed, size)
    count = min(components, len(found.values))
    error = identity_error(listed, found, count)
    matrix = (found.vectors[:count] / np.sqrt(found.values[:count])[:, None]).T
    explained = found.values[:count] / found.trace if count else np.zeros(0)
    slim = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fields = [slim.schema["id"], T.StructField("component", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("n", "deviation"))]
    fields += [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, sizes, values = usable(batch.column("vector"))
            own = ok & (sizes == size)
            x = whole_numbers(values[np.repeat(own[ok], sizes[ok])]).reshape(-1, size) if size else np.zeros((0, 0), np.int64)
            if not count or not len(x):
                continue
            y = ((x - found.whole).astype(np.float64) - found.rest / found.n) @ matrix
            ids = batch.column("id").filter(pa.array(own)).take(pa.array(np.repeat(np.arange(len(x)), count)))
            deviation = pa.array(deviations(x, found), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), count)))
            total = len(x) * count
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(arrow.field("id").type),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(total, found.n)),
                    deviation,
                    pa.array(y.reshape(-1)),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(total, error)),
                ],
                schema=arrow,
            )

    return slim.mapInArrow(project, schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's row per vector and component."""
    return found.withColumnRenamed("id", "vec_id")
