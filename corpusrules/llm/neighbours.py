"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, kept as flat arrays; results merged.

1. Equal vectors are one *point* with the ``k + 1`` smallest ids that have it (enough for any answer of ``k``), so a vector
   that very many rows share neither fills a shard nor breaks a graph.
2. Points are dealt to shards by hash, about ``SHARD_POINTS`` each.  A task builds a shard's graph: vectors of length one,
   a level per point, and neighbour numbers as one flat array per shard (``2 * LINKS`` on the ground level, ``LINKS``
   above, -1 for none).  The index is a table of shards; it is written and can be kept.
3. Queries travel in blocks, each block to every shard; a shard travels once for ``GROUP_BLOCKS`` of them.  It descends its levels greedily and searches the ground level
   with ``BREADTH`` candidates; the nearest ``k + 1`` points are measured again: the cosine in double precision, on the
   vectors as they were.
4. The shards' rows are ranked by score, then by id.

Vectors that are null, zero, or hold null or non-finite components are in no shard and ask nothing.  Vectors of different
lengths are not compared.  A query's own id is no answer to it, also where that id is repeated.  Fewer candidates than
``k`` give fewer rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrules.llm.storage import written

LINKS = 16
BREADTH_BUILD = 100
BREADTH = 128
SHARD_POINTS = 8192
SHARD_BYTES = 64 << 20
QUERY_BLOCK = 512
#: Query blocks that meet a shard together (64 MB of 64 numbers each).
GROUP_BLOCKS = 256
SEED = 6

_NONE = -1


class Graph:
    """A small-world graph over unit vectors: ``ground`` and, for points above it, ``upper`` rows from ``upper_at`` on."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: int = LINKS):
        self.vectors, self.levels, self.links = vectors, levels, links
        self.ground = np.full((len(vectors), 2 * links), _NONE, np.int32)
        self.upper_at = np.concatenate([[0], np.cumsum(levels)]).astype(np.int64)
        self.upper = np.full((int(self.upper_at[-1]), links), _NONE, np.int32)
        self.seen = np.zeros(len(vectors), np.int64)
        self.round = 0
        self.entry = int(levels.argmax()) if len(levels) else _NONE

    def row(self, point: int, level: int) -> np.ndarray:
        return self.ground[point] if level == 0 else self.upper[self.upper_at[point] + level - 1]

    def descend(self, query: np.ndarray, start: int, level: int) -> int:
        """The local best of a level, step by step to the best neighbour."""
        near = float(self.vectors[start] @ query)
        while True:
            around = self.row(start, level)
            around = around[around >= 0]
            if not len(around):
                return start
            scores = self.vectors[around] @ query
            best = int(scores.argmax())
            if scores[best] <= near:
                return start
            start, near = int(around[best]), float(scores[best])

    def search(self, query: np.ndarray, starts: list[int], level: int, breadth: int) -> list[tuple[float, int]]:
        """The ``breadth`` nearest points that a best-first search meets: (score, point), best first."""
        self.round += 1
        self.seen[starts] = self.round
        scores = (self.vectors[starts] @ query).tolist()
        ahead = [(-s, p) for s, p in zip(scores, starts, strict=True)]
        heapq.heapify(ahead)
        kept = list(zip(scores, starts, strict=True))
        heapq.heapify(kept)
        while ahead:
            far, point = heapq.heappop(ahead)
            if len(kept) >= breadth and -far < kept[0][0]:
                break
            around = self.row(point, level)
            around = around[around >= 0]
            around = around[self.seen[around] != self.round]
            if not len(around):
                continue
            self.seen[around] = self.round
            scores = self.vectors[around] @ query
            if len(kept) >= breadth:
                near = scores > kept[0][0]
                around, scores = around[near], scores[near]
            for s, p in zip(scores.tolist(), around.tolist(), strict=True):
                if len(kept) < breadth:
                    heapq.heappush(kept, (s, p))
                elif s > kept[0][0]:
                    heapq.heapreplace(kept, (s, p))
                else:
                    continue
                heapq.heappush(ahead, (-s, p))
        return sorted(kept, reverse=True)

    def diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: those nearer to the point than to any chosen one, then the nearest others."""
        points = [p for _, p in found]
        own = self.vectors[points]
        among = own @ own.T
        chosen: list[int] = []
        for k, (score, _) in enumerate(found):
            if len(chosen) == most:
                break
            if not chosen or among[k, chosen].max() < score:
                chosen.append(k)
        rest = [k for k in range(len(found)) if k not in set(chosen)][: most - len(chosen)]
        return [points[k] for k in chosen + rest]

    def insert(self, point: int, entry: int, top: int) -> None:
        query, level = self.vectors[point], int(self.levels[point])
        start = entry
        for above in range(top, level, -1):
            start = self.descend(query, start, above)
        starts = [start]
        for at in range(min(level, top), -1, -1):
            found = self.search(query, starts, at, BREADTH_BUILD)
            starts = [p for _, p in found]
            most = 2 * self.links if at == 0 else self.links
            chosen = self.diverse(found, self.links)
            self.row(point, at)[: len(chosen)] = chosen
            for other in chosen:
                row = self.row(other, at)
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = point
                    continue
                around = np.append(row, point)
                scores = self.vectors[around] @ self.vectors[other]
                order = np.argsort(-scores, kind="stable")
                kept = self.diverse([(float(scores[k]), int(around[k])) for k in order], most)
                row[:] = _NONE
                row[: len(kept)] = kept

    def build(self) -> Graph:
        entry, top = 0, int(self.levels[0]) if len(self.levels) else 0
        for point in range(1, len(self.vectors)):
            self.insert(point, entry, top)
            if self.levels[point] > top:
                entry, top = point, int(self.levels[point])
        self.entry = entry
        return self

    def nearest(self, query: np.ndarray, k: int, breadth: int) -> list[int]:
        if not len(self.vectors):
            return []
        start = self.entry
        for above in range(int(self.levels[self.entry]), 0, -1):
            start = self.descend(query, start, above)
        return [p for _, p in self.search(query, [start], 0, max(breadth, k))[:k]]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very long and very short vectors keep their direction."""
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The measure of the result, in double precision; vectors whose squares leave its range are scaled first."""
    q, v = query.astype(np.float64), vectors.astype(np.float64)
    with np.errstate(all="ignore"):
        lengths = np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum())
        found = (v @ q) / lengths
    odd = ~(np.isfinite(found) & np.isfinite(lengths) & (lengths > 1e-290))
    if odd.any():
        q, v = q / np.abs(q).max(), v[odd] / np.abs(v[odd]).max(axis=1, keepdims=True)
        found[odd] = (v @ q) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))
    return found


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))


def points(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct ``vector`` with its ``k + 1`` smallest ``ids``; ranks are cut before the shuffle too."""
    distinct = vectors.distinct()
    ranked = distinct.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


_SHARD = "shard int, dim int, vectors binary, ids binary, id_ends binary, levels binary, ground binary, upper binary, entry int"
_SHARD_ARROW = pa.schema(
    [("shard", pa.int32()), ("dim", pa.int32())] + [(c, pa.binary()) for c in ("vectors", "ids", "id_ends", "levels", "ground", "upper")] + [("entry", pa.int32())]
)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    shard, dim = (k.as_py() for k in key)
    order = np.argsort(np.array([x[0].as_py() for x in table.column("ids")], np.int64), kind="stable")
    table = table.take(pa.array(order))
    vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    ids = table.column("ids").combine_chunks()
    ends = np.cumsum([len(x) for x in ids]).astype(np.int64)
    rng = np.random.default_rng([SEED, shard, dim])
    levels = np.floor(-np.log(1 - rng.random(len(vectors))) / np.log(LINKS)).astype(np.int32)
    graph = Graph(unit(vectors), levels).build()
    parts = (vectors, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends, levels, graph.ground, graph.upper)
    return pa.Table.from_arrays([pa.array([shard], pa.int32()), pa.array([dim], pa.int32()), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts), pa.array([graph.entry], pa.int32())], schema=_SHARD_ARROW)


def build_index(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, shard_points: int = SHARD_POINTS) -> DataFrame:
    """The index: one row per shard and vector length.  Written."""
    found = written(points(_vectors(rows, id_col, vector_col), k).withColumn("dim", F.size("vector")), "points")
    sizes = {r[0]: r[1] for r in found.groupBy("dim").count().collect()}
    per_shard = F.lit(1)
    for dim, n in sizes.items():
        most = max(1, min(shard_points, SHARD_BYTES // (8 * dim)))
        per_shard = F.when(F.col("dim") == dim, F.lit(-(-n // most))).otherwise(per_shard)
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("vector", F.lit(SEED)), per_shard).cast("int"))
    # A shard is minutes of work: each has a task of its own, where no small shuffle is made smaller still.
    tasks = sum(-(-n // max(1, min(shard_points, SHARD_BYTES // (8 * dim)))) for dim, n in sizes.items())
    placed = dealt.repartition(max(1, 4 * tasks), "shard", "dim")
    return written(placed.groupBy("shard", "dim").applyInArrow(_build, _SHARD), "index")


def _block(key: tuple, table: pa.Table) -> pa.Table:
    matrix = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    block, dim = (pa.array([x.as_py()], pa.int32()) for x in key)
    return pa.table({"block": block, "dim": dim, "query_ids": pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()), "queries": pa.array([matrix.tobytes()], pa.binary())})


def _opened(row: dict[str, pa.Scalar]) -> tuple[np.ndarray, Graph, list[np.ndarray]]:
    """Vectors, graph and ids of a stored shard."""
    dim = row["dim"].as_py()
    vectors = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, dim)
    graph = Graph(unit(vectors), np.frombuffer(row["levels"].as_buffer(), np.int32))
    graph.ground = np.frombuffer(row["ground"].as_buffer(), np.int32).reshape(len(vectors), -1)
    graph.upper = np.frombuffer(row["upper"].as_buffer(), np.int32).reshape(-1, LINKS)
    graph.entry = row["entry"].as_py()
    ids = np.split(np.frombuffer(row["ids"].as_buffer(), np.int64), np.frombuffer(row["id_ends"].as_buffer(), np.int64)[:-1])
    return vectors, graph, ids


_MET = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _searcher(k: int, breadth: int) -> Callable:
    """A shard, which is there once, and the query blocks that come to it."""

    def run(shard: pa.Table, blocks: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(shard) and len(blocks):
            vectors, graph, ids = _opened({c: shard.column(c)[0] for c in shard.column_names})
            for query_ids, packed in zip(blocks.column("query_ids"), blocks.column("queries"), strict=True):
                queries = np.frombuffer(packed.as_buffer(), np.float64).reshape(-1, vectors.shape[1])
                for query_id, query, turned in zip(np.frombuffer(query_ids.as_buffer(), np.int64).tolist(), queries, unit(queries), strict=True):
                    near = graph.nearest(turned, k + 1, breadth)
                    scores = cosines(query, vectors[near])
                    ranked = sorted((-s, i) for s, p in zip(scores.tolist(), near, strict=True) for i in ids[p].tolist() if i != query_id)[:k]
                    out["query_id"] += [query_id] * len(ranked)
                    out["vec_id"] += [i for _, i in ranked]
                    out["score"] += [-s for s, _ in ranked]
        return pa.Table.from_pydict(out, schema=_MET)

    return run


def search(index: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, breadth: int = BREADTH) -> DataFrame:
    """The nearest rows of each query: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.  Queries of equal id and vector are one."""
    asked = _vectors(queries, id_col, vector_col).distinct().withColumn("dim", F.size("vector"))
    count = asked.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    made = asked.groupBy(block, "dim").applyInArrow(_block, "block int, dim int, query_ids binary, queries binary")
    # Every group of blocks goes to every shard of its length, and a shard to every group: rows per group, not per query.
    groups = -(-blocks // GROUP_BLOCKS)
    shards = {r[0]: r[1] for r in index.groupBy("dim").agg(F.max("shard")).collect()}
    last = F.lit(-1)
    for dim, shard in shards.items():
        last = F.when(F.col("dim") == dim, F.lit(shard)).otherwise(last)
    grouped = made.withColumn("last", last).where("last >= 0").withColumn("group", (F.col("block") / GROUP_BLOCKS).cast("int"))
    sent = grouped.select("dim", "group", "query_ids", "queries", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("shard"))
    dealt = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["shard", "dim", "group"]
    met = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_searcher(k, breadth), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Queries of one id with several vectors may meet a row twice; its best score counts.
    return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """The nearest rows of every row whose id is divisible by ``every``, among all rows."""
    index = build_index(rows, id_col=id_col, vector_col=vector_col, k=k)
    return search(index, rows.where(F.col(id_col) % every == 0), id_col=id_col, vector_col=vector_col, k=k)
