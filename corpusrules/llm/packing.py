"""Token-ID output: documents encoded, packed into rows of a fixed length by best fit decreasing, written as id matrices.

A document is its tokens and one end token.  One longer than a row is cut losslessly into full rows and a rest.  Pieces are
packed group by group inside tasks (about ``GROUP_TOKENS`` tokens a group): longest first, each into the open row with the
least space that still holds it.  That row is found in a segment tree over capacities, whose leaves hold the open rows
with exactly that much space, in ``log2(length)`` steps.

Each row of the result is a line of a matrix: ``input_ids`` (little-endian uint32, ``length`` of them, padded),
``cu_seqlens`` (0 and the end of each segment), ``position_ids`` (little-endian uint32, from 0 again in every segment, and
in the padding), ``doc_ids`` and ``starts`` (each segment's document, and the token of it that the segment begins with).
``group`` and ``line`` order the lines; a group is named by its task's partition and place in it.

A null or empty text is its end token alone, so no document is lost and repeated rows stay.  A null id is a null among
``doc_ids``.  An empty table gives no lines.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusrules.llm.tokens import VOCABULARY, encoded, encoding, vocabulary
from corpusrules.llm.words import released

LENGTH = 2048
END = PAD = 50256
GROUP_TOKENS = 1_000_000


class Capacities:
    """Open rows by the space they have left, under a segment tree that finds the least space that is enough."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most).bit_length()
        self.filled = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        node = space + self.size
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least space of ``need`` or more, and its space; it is no longer open."""
        node = need + self.size
        if not self.filled[node]:
            # Up to the first right neighbour that holds a row, then down its left side.
            while node > 1 and (node & 1 or not self.filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        space = node - self.size
        row = self.rows[space].pop()
        while node and not (self.rows[space] if node >= self.size else self.filled[2 * node] or self.filled[2 * node + 1]):
            self.filled[node] = 0
            node >>= 1
        return row, space


def best_fit_decreasing(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; equal lengths keep their order."""
    rows: list[list[int]] = []
    open_rows = Capacities(capacity)
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = open_rows.take(lengths[piece])
        if found is None:
            found = len(rows), capacity
            rows.append([])
        row, space = found
        rows[row].append(piece)
        if space > lengths[piece]:
            open_rows.add(space - lengths[piece], row)
    return rows


def _pack(docs: list[tuple], length: int, pad: int) -> dict[str, list]:
    """The lines of one group of (id, tokens)."""
    whole, pieces = [], []
    for doc, tokens in docs:
        full = len(tokens) // length * length
        whole += [(doc, start, tokens[start : start + length]) for start in range(0, full, length)]
        if full < len(tokens):
            pieces.append((doc, full, tokens[full:]))
    rows = [[piece] for piece in whole]
    rows += [[pieces[k] for k in row] for row in best_fit_decreasing([len(p[2]) for p in pieces], length)]
    out: dict[str, list] = {"input_ids": [], "cu_seqlens": [], "position_ids": [], "doc_ids": [], "starts": []}
    counting = np.arange(length, dtype="<u4")
    for row in rows:
        ends = np.cumsum([0] + [len(p[2]) for p in row])
        ids = np.full(length, pad, "<u4")
        ids[: ends[-1]] = np.concatenate([p[2] for p in row])
        segment_start = np.repeat(np.append(ends[:-1], ends[-1]), np.append(np.diff(ends), length - ends[-1]))
        out["input_ids"].append(ids.tobytes())
        out["position_ids"].append((counting - segment_start.astype("<u4")).tobytes())
        out["cu_seqlens"].append(ends.astype(np.int32))
        out["doc_ids"].append([p[0] for p in row])
        out["starts"].append(np.array([p[1] for p in row], np.int32))
    return out


def packed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, pad: int = PAD, group_tokens: int = GROUP_TOKENS, path: str = VOCABULARY) -> DataFrame:
    """Lines of ``length`` ids; see the module for the columns."""
    if length < 1:
        raise ValueError("length must be positive")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("group", T.StringType()),
            T.StructField("line", T.IntegerType()),
            T.StructField("input_ids", T.BinaryType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("position_ids", T.BinaryType()),
            T.StructField("doc_ids", T.ArrayType(slim.schema["id"].dataType)),
            T.StructField("starts", T.ArrayType(T.IntegerType())),
        ]
    )
    arrow = to_arrow_schema(schema)
    shared = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(shared.value)
        task, place = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def lines() -> Iterator[pa.RecordBatch]:
            packed = _pack(held, length, pad)
            n = len(packed["input_ids"])
            packed |= {"group": [f"{task}-{place}"] * n, "line": list(range(n))}
            table = pa.Table.from_pydict({c: packed[c] for c in arrow.names}, schema=arrow)
            yield from table.to_batches(max_chunksize=1024)

        for batch in released(batches):
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                tokens = np.array([*(encoded(encoder, text.as_py()) if text.is_valid else ()), end], "<u4")
                held.append((doc, tokens))
                size += len(tokens)
                if size >= group_tokens:
                    yield from lines()
                    held, size, place = [], 0, place + 1
        if held:
            yield from lines()

    return slim.mapInArrow(run, schema)


def unpacked(packed: DataFrame) -> DataFrame:
    """The tokens of every document again: ``id`` and ``tokens``, cut pieces joined; equal ids are one document here."""
    element = packed.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", element), T.StructField("start", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"id": [], "start": [], "tokens": []}
            for ids, ends, docs, starts in zip(*(batch.column(c).to_pylist() for c in ("input_ids", "cu_seqlens", "doc_ids", "starts")), strict=True):
                values = np.frombuffer(ids, "<u4").astype(np.int64)
                out["id"] += docs
                out["start"] += starts
                out["tokens"] += [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    pieces = packed.mapInArrow(run, schema)
    return pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "tokens"))).alias("p")).select("id", F.flatten("p.tokens").alias("tokens"))


def write_matrices(packed: DataFrame, path: str) -> None:
    """The lines as Parquet files, ordered within each; every file is a matrix of ids, of positions, and of segment ends."""
    packed.write.option("compression", "zstd").parquet(path)
