"""Merkle manifest of a dataset: hash trees of 16 children a node, their nodes in van Emde Boas order.

A document is a leaf: the digest of its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value.  A group's leaves
ascend by id (null first, equal ids by leaf); while several nodes remain, every 16 in a row (the last run: fewer, even one) become the
digest of their digests.  What remains is the group's subroot; subroots, ordered by group (null first, bytewise), give the root likewise.

Trees are cut into aligned *blocks* of ``BLOCK`` leaves, and block roots are the leaves of the next tier's blocks, until a tier has one block a
tree.  A block is one row: a flat array of its nodes, laid out by splitting the tree at half its height, top part first, then the parts below
it in order, each laid out the same way.  Trees are filled from the left, so all parts before a node's are full, and its address is arithmetic
(:func:`addresses`): neither construction nor the reading of siblings follows stored links, at any block or page size.

No tree is ever in one task: a group's rows are numbered by range and dealt to blocks, and only block roots go on to the next tier, so a group
of any share of the rows is split.  Proofs go down the tiers: a block hands its path to the blocks whose roots are its leaves.

Null and empty texts differ (``-`` and ``0:``).  Repeated rows are leaves of their own.  An empty table has no leaves and no root.  A table of one row has
its leaf as root and an empty proof.  Columns that are not fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusrules.llm.numbering import numbered, with_row
from corpusrules.llm.storage import written

FAN, HEIGHT = 16, 3
BLOCK = FAN**HEIGHT
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a group that find its start by one key.
STRIPE = 1 << 20


def height_of(total: int) -> int:
    """Levels above the leaves in a block of a tree whose tier has ``total`` nodes."""
    height = 0
    while FAN**height < min(total, BLOCK):
        height += 1
    return height


def counts_of(leaves: int, height: int) -> tuple[int, ...]:
    """Nodes on each level, leaves first."""
    counts = [leaves]
    for _ in range(height):
        counts.append(-(-counts[-1] // FAN))
    return tuple(counts)


def _part_size(counts: Sequence[int], top: int, low: int, root: np.ndarray) -> np.ndarray:
    """Nodes on levels ``low`` to ``top`` below node ``root`` of level ``top``."""
    size = np.zeros(len(root), np.int64)
    for level in range(low, top + 1):
        wide = FAN ** (top - level)
        size += np.clip(counts[level] - root * wide, 0, wide)
    return size


def addresses(counts: Sequence[int], level: int, index: np.ndarray, top: int | None = None, low: int = 0, root: np.ndarray | None = None) -> np.ndarray:
    """Where the nodes ``index`` of ``level`` lie in the flat array of a tree with ``counts`` nodes a level."""
    if top is None:
        top, root = len(counts) - 1, np.zeros(len(index), np.int64)
    if top == low:
        return np.zeros(len(index), np.int64)
    cut = low + (top - low + 1) // 2
    if level >= cut:
        return addresses(counts, level, index, top, cut, root)
    part = index // FAN ** (cut - 1 - level)
    full = sum(FAN**k for k in range(cut - low))
    before = (part - root * FAN ** (top - cut + 1)) * full
    return _part_size(counts, top, cut, root) + before + addresses(counts, level, index, cut - 1, low, part)


@lru_cache(maxsize=64)
def _layout(counts: tuple[int, ...]) -> list[np.ndarray]:
    return [addresses(counts, level, np.arange(n)) for level, n in enumerate(counts)]


class Block:
    """A block's nodes in one flat array."""

    def __init__(self, counts: tuple[int, ...], flat: np.ndarray):
        self.counts, self.flat, self.layout = counts, flat, _layout(counts)

    @classmethod
    def build(cls, leaves: np.ndarray, height: int) -> Block:
        """From leaf digests, a row each."""
        counts = counts_of(len(leaves), height)
        block = cls(counts, np.empty((sum(counts), DIGEST), np.uint8))
        block.flat[block.layout[0]] = leaves
        for level in range(height):
            made = b"".join(hashlib.sha256(block.run(level, FAN * k).encode()).digest() for k in range(counts[level + 1]))
            block.flat[block.layout[level + 1]] = np.frombuffer(made, np.uint8).reshape(-1, DIGEST)
        return block

    @classmethod
    def stored(cls, leaves: int, total: int, nodes: pa.Scalar) -> Block:
        return cls(counts_of(leaves, height_of(total)), np.frombuffer(nodes.as_buffer(), np.uint8).reshape(-1, DIGEST))

    def run(self, level: int, index: int) -> str:
        """A node and its siblings in order, as one text of hex digits."""
        first = index // FAN * FAN
        return self.flat[self.layout[level][first : first + FAN]].tobytes().hex()

    @property
    def height(self) -> int:
        return len(self.counts) - 1

    @property
    def root(self) -> bytes:
        return self.flat[self.layout[-1][0]].tobytes()


def _siblings(run: str, at: int) -> str:
    return run[: 64 * at] + run[64 * at + 64 :]


def folded(leaf: str, path: Sequence[tuple[str, int]]) -> str:
    """The root that a leaf and its path (runs from below, each with the node's place in it) give; the node in the run is not trusted."""
    for run, at in path:
        leaf = hashlib.sha256((run[: 64 * at] + leaf + run[64 * at + 64 :]).encode()).hexdigest()
    return leaf


_BLOCKS = "tree string, block long, total long, leaves int, nodes binary, root binary"
_BLOCKS_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("leaves", pa.int32()), ("nodes", pa.binary()), ("root", pa.binary())])


def _build(table: pa.Table) -> pa.Table:
    place, total = table.column("place").to_numpy(), table.column("total")[0].as_py()
    digests = np.frombuffer(b"".join(x.as_buffer() for x in table.column("digest")), np.uint8).reshape(-1, DIGEST)
    block = Block.build(digests[np.argsort(place)], height_of(total))
    row = {"tree": table.column("tree")[0].as_py(), "block": int(place[0]) // BLOCK, "total": total, "leaves": len(place), "nodes": block.flat.tobytes(), "root": block.root}
    return pa.Table.from_pylist([row], schema=_BLOCKS_ARROW)


def tiers_of(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of trees, tier by tier, from ``tree``, ``place`` (from 0 within the tree), ``total`` and ``digest``."""
    tiers = []
    while True:
        own = nodes.select("tree", "place", "total", "digest", F.expr(f"place div {BLOCK}").alias("block"))
        tiers.append(written(own.groupBy("tree", "block").applyInArrow(_build, _BLOCKS), "tier"))
        nodes = tiers[-1].where(F.col("total") > BLOCK).select("tree", F.col("block").alias("place"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.col("root").alias("digest"))
        if nodes.isEmpty():
            return tiers


class Manifest(NamedTuple):
    """``leaves``: ``id``, ``tree``, ``place``, ``digest``, ``altered``; blocks of groups and of the tree over them; ``groups``: ``tree``, ``place``, ``subroot``."""

    leaves: DataFrame
    tiers: list[DataFrame]
    groups: DataFrame
    upper: list[DataFrame]
    root: str | None


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Lowercase hex digest of the fields."""
    values = [f.cast("string") for f in fields]
    framed = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with ``place`` and ``total`` within their tree, from their numbers; a tree's start is looked up stripe by stripe."""
    starts = rows.groupBy("tree").agg(F.min("number").alias("start"), F.count("*").alias("total"))
    striped = starts.select("*", F.explode(F.sequence(F.expr(f"start div {STRIPE}"), F.expr(f"(start + total - 1) div {STRIPE}"))).alias("stripe"))
    own = rows.withColumn("stripe", F.expr(f"number div {STRIPE}"))
    joined = own.alias("r").join(striped.alias("s"), (F.col("r.stripe") == F.col("s.stripe")) & F.col("r.tree").eqNullSafe(F.col("s.tree")))
    return joined.select("r.*", (F.col("r.number") - F.col("s.start")).alias("place"), "s.total").drop("stripe", "number", "row")


def manifest(
    docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, altered: Column | None = None, altered_fields: Sequence[Column] = ()
) -> Manifest:
    """The trees of ``docs``.  Where ``altered`` holds, the digest of ``altered_fields`` is kept beside the leaf, to be tried against its proof."""
    other = F.when(altered, F.unhex(leaf_digest(altered_fields))) if altered is not None else F.lit(None).cast("binary")
    leaf = F.unhex(leaf_digest([F.col(f"`{c}`") for c in fields]))
    slim = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("tree"), leaf.alias("digest"), other.alias("altered"))
    order = [F.col("tree").asc_nulls_first(), F.col("id").asc_nulls_first(), "digest", "row"]
    leaves = written(_placed(numbered(with_row(slim, "row"), order, "number")[0]), "leaves")
    tiers = tiers_of(leaves)
    subroots = None
    for tier in tiers:
        last = tier.where(F.col("total") <= BLOCK).select("tree", F.col("root").alias("subroot"))
        subroots = last if subroots is None else subroots.union(last)
    groups, count = numbered(subroots, [F.col("tree").asc_nulls_first()], "place")
    # One tree over all groups.
    upper = tiers_of(groups.select(F.lit("").alias("tree"), "place", F.lit(count).cast("long").alias("total"), F.col("subroot").alias("digest")))
    top = upper[-1].select("root").collect()
    return Manifest(leaves, tiers, groups, upper, top[0]["root"].hex() if top else None)


_PATH = "array<struct<run:string,at:int>>"
_PATHS = f"tree string, block long, path {_PATH}"
_PATH_ARROW = pa.list_(pa.struct([("run", pa.string()), ("at", pa.int32())]))
#: Paths that leave a block together.
PATH_ROWS = 256


def _expander() -> Callable:
    """The path of every leaf of blocks that have theirs."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", _PATH_ARROW)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.drop_columns("nodes").to_pylist()):
                block = Block.stored(row["leaves"], row["total"], batch.column("nodes")[k])
                above = row["path"]
                for first in range(0, row["leaves"], PATH_ROWS):
                    out = []
                    for leaf in range(first, min(first + PATH_ROWS, row["leaves"])):
                        own = [{"run": block.run(level, leaf // FAN**level), "at": leaf // FAN**level % FAN} for level in range(block.height)]
                        out.append({"tree": row["tree"], "block": row["block"] * BLOCK + leaf, "path": own + above})
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _met(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    same = F.col("b.tree").eqNullSafe(F.col("p.tree")) & (F.col("b.block") == F.col("p.block"))
    return blocks.alias("b").join(paths.alias("p"), same).select("b.*", "p.path")


def block_paths(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Blocks of the lowest tier with the paths of their roots; ``tops`` has the paths above the trees (``tree``, ``block`` 0, ``path``)."""
    own = None
    for level in reversed(range(len(tiers))):
        found = _met(tiers[level].where(F.col("total") <= BLOCK), tops)
        if own is not None:
            lower = own.select("tree", "block", "total", "leaves", "nodes", "path").mapInArrow(_expander(), _PATHS)
            found = found.union(_met(tiers[level].where(F.col("total") > BLOCK), lower))
        own = written(found, "paths") if level else found
    return own


def _prover(schema: pa.Schema, root: str, paths: bool) -> Callable:
    def run(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(leaves):
            return schema.empty_table()
        row = blocks.drop_columns("nodes").to_pylist()[0]
        block = Block.stored(row["leaves"], row["total"], blocks.column("nodes")[0])
        leaves = leaves.sort_by("place")
        above = [(step["run"], step["at"]) for step in row["path"]]
        # Siblings of a node and of all nodes above it, level by level from the top; a level's runs are shared by the nodes below.
        tails = ["".join(_siblings(*step) for step in above)]
        runs: list[list[str]] = []
        for level in reversed(range(block.height)):
            runs.insert(0, [block.run(level, FAN * k) for k in range(block.counts[level + 1])])
            tails = [_siblings(runs[0][k // FAN], k % FAN) + tails[k // FAN] for k in range(block.counts[level])] if level else tails
        known: dict[tuple[int, int, str], str] = {}
        out: dict[str, list] = {c: [] for c in schema.names if c != "id"}
        for k, (leaf, altered) in enumerate(zip(leaves.column("digest").to_pylist(), leaves.column("altered").to_pylist(), strict=True)):
            proof = _siblings(runs[0][k // FAN], k % FAN) + tails[k // FAN] if runs else tails[0]
            node, value = k, (leaf if altered is None else altered).hex()
            for level in range(block.height):
                key = (level, node // FAN, value) if level else None
                if key not in known or key is None:
                    made = folded(value, [(runs[level][node // FAN], node % FAN)])
                    if key is not None:
                        known[key] = made
                else:
                    made = known[key]
                node, value = node // FAN, made
            key = (block.height, 0, value)
            if key not in known:
                known[key] = folded(value, above)
            fold = known[key]
            values = {"leaf": leaf.hex(), "subroot": row["subroot"].hex(), "root": root, "proof_sha256": hashlib.sha256(proof.encode()).hexdigest(), "folded_root": fold, "verified": fold == root}
            if paths:
                own = [(runs[level][k // FAN ** (level + 1)], k // FAN**level % FAN) for level in range(block.height)]
                values["path"] = [{"run": r, "at": a} for r, a in own + above]
            for name, value in values.items():
                out[name].append(value)
        return pa.Table.from_pydict({"id": leaves.column("id").cast(schema.field("id").type), **out}, schema=schema)

    return run


def proofs(made: Manifest, *, paths: bool = False) -> DataFrame:
    """A row per leaf: ``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``, and if asked for its ``path`` (runs and places)."""
    fields = [T.StructField("id", made.leaves.schema["id"].dataType), *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))]
    fields.append(T.StructField("verified", T.BooleanType()))
    schema = T.StructType(fields + ([T.StructField("path", T._parse_datatype_string(_PATH))] if paths else []))
    if made.root is None:
        return made.leaves.sparkSession.createDataFrame([], schema)
    nothing = made.upper[-1].select("tree", "block", F.array().cast(_PATH).alias("path"))
    above = block_paths(made.upper, nothing).select("tree", "block", "total", "leaves", "nodes", "path").mapInArrow(_expander(), _PATHS)
    # The upper tree's leaves are the groups, in order.
    tops = written(made.groups.alias("g").join(above.alias("a"), F.col("g.place") == F.col("a.block")).select("g.tree", F.lit(0).cast("long").alias("block"), "a.path", "g.subroot"), "tops")
    blocks = block_paths(made.tiers, tops)
    blocks = blocks.alias("b").join(tops.alias("t"), F.col("b.tree").eqNullSafe(F.col("t.tree"))).select("b.*", "t.subroot")
    leaves = made.leaves.withColumn("block", F.expr(f"place div {BLOCK}"))
    return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(_prover(to_arrow_schema(schema), made.root, paths), schema)


def tampered(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] = FIELDS) -> tuple[Column, list[Column]]:
    """Which rows are tampered with (a fifth, by the CRC of the id as text), and their fields then: the text in lower case (A-Z)."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return chosen, [lower if c == text_col else F.col(f"`{c}`") for c in fields]


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    chosen, fields = tampered(docs)
    return proofs(manifest(docs, altered=chosen, altered_fields=fields)).withColumnRenamed("id", "doc_id")
