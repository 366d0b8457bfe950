"""Sharding by a Feistel permutation of global row numbers: a reproducible shuffle whose shards and slots can be computed.

Rows are numbered from 0 in the order of id (null last), size, CRC and hash of the text, so numbers depend on the rows alone, not on
files or tasks.  A Feistel network permutes the numbers below the next power of two; a number that leaves the range of rows
walks on along its cycle until it is back (fewer than two steps on average).  Place ``p`` of the permutation is slot ``p // shards`` of shard ``p %
shards``: shards differ by one row at most, slots have no gaps, and :func:`row_at` computes which row a slot holds without a
look at the data.  Nothing is stored but the seed and the number of rows.

A row moves once, to be numbered, as id, size and two hashes (whole texts travel only where they are carried or written).  Rows
that are equal in all of these are interchangeable; a staging number tells them apart, so a range never holds a hot group whole.

Size: UTF-8 bytes of the text plus 16; a null text has none, and the CRC of an empty one.  Null and repeated ids and repeated
rows are rows like others; empty tables give empty results; other columns are not read unless carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusrules.llm.numbering import numbered, with_row
from corpusrules.llm.storage import free_name

SHARDS = 40
SEED = 11
OVERHEAD = 16
ROUNDS = 8
#: Multipliers below 2**31: products of 32-bit numbers with them stay below 2**63, in any engine.
MULTIPLIERS = (0x5851F42D, 0x2545F491)


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """A 31-bit number a round."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:4], "big") >> 1 for k in range(rounds)]


def halves(count: int) -> tuple[int, int]:
    """Bits of the left and the right half of numbers below ``count``; each has one at least."""
    bits = max(2, (max(count, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _scrambled(half: np.ndarray, key: int) -> np.ndarray:
    one, two = MULTIPLIERS
    y = (half + key) * one
    y = ((y ^ (y >> 23)) & 0xFFFFFFFF) * two
    return (y ^ (y >> 29)) >> 20


def _network(x: np.ndarray, widths: tuple[int, int], keys: Sequence[int], back: bool) -> np.ndarray:
    """All rounds, or their inverse; halves swap in each, so an even number of rounds leaves their widths as they were."""
    left_bits, right_bits = widths
    left, right = x >> right_bits, x & ((1 << right_bits) - 1)
    for k in range(len(keys)):
        if back:
            # The round to undo made (right, left ^ f(right)) of (left, right).
            key, wide = keys[-1 - k], left_bits if (len(keys) - 1 - k) % 2 == 0 else right_bits
            left, right = right ^ (_scrambled(left, key) & ((1 << wide) - 1)), left
        else:
            wide = left_bits if k % 2 == 0 else right_bits
            left, right = right, left ^ (_scrambled(right, keys[k]) & ((1 << wide) - 1))
    return (left << right_bits) | right


def permuted(numbers: np.ndarray, count: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Places of row numbers below ``count``, or with ``back`` the row numbers at places; a bijection."""
    widths, keys = halves(count), round_keys(seed)
    out = _network(np.asarray(numbers, np.int64), widths, keys, back)
    outside = np.flatnonzero(out >= count)
    while len(outside):
        out[outside] = _network(out[outside], widths, keys, back)
        outside = outside[out[outside] >= count]
    return out


def slot_of(number: int, count: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    place = int(permuted(np.array([number]), count, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, count: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number in a slot of a shard."""
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= slot and place < count):
        raise IndexError(f"no slot {slot} in shard {shard}")
    return int(permuted(np.array([place]), count, seed, back=True)[0])


def sharded(
    docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """A row per document: ``id``, ``size``, ``crc``, ``number``, ``shard``, ``slot``, and the columns of ``carry`` in one struct, ``carried``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    fields = [F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("hash")]
    if carry:
        fields.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"))
    rows, count = numbered(with_row(docs.select(*fields), "row"), [F.col("id").asc_nulls_last(), "size", "crc", "hash", "row"], "number")

    def places(numbers: pa.Array) -> pa.Array:
        return pa.array(permuted(numbers.to_numpy(), count, seed))

    rows = rows.withColumn("place", F.arrow_udf(places, T.LongType())("number"))
    shard = (F.col("place") % shards).cast("int").alias("shard")
    return rows.select("id", "size", "crc", "number", shard, F.expr(f"place div {shards}").alias("slot"), *(["carried"] if carry else []))


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> None:
    """``docs`` as Parquet in folders ``shard=K``, in slot order within each; a large shard is several files in order."""
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    rows = sharded(docs, shards=shards, seed=seed, id_col=id_col, text_col=text_col, carry=docs.columns)
    own = rows.select("carried.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    own.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def digest(rows: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return rows.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

