"""Grouping that stays within bounds when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusrules.session import ensure_checkpoint_dir

# Spark ranks before the shuffle only for limits below its own threshold of the same name.
_GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def group_limit(df: DataFrame) -> int:
    """Ranks below this are cut before the shuffle."""
    return int(df.sparkSession.conf.get(_GROUP_LIMIT_CONF, "1000"))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order``.

    For ``n`` below Spark's group-limit threshold every task drops all but its own first ``n`` rows of a key before the
    shuffle, so a task gets at most ``n`` rows of a key from each.  A larger ``n`` is ranked by range instead: no task
    holds a key that does not fit into one range.
    """
    out = rank or "_rank"
    if n < group_limit(df):
        ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        ranked = ranked_by_range(df, keys, order, out)
    ranked = ranked.where(F.col(out) <= n)
    return ranked if rank else ranked.drop(out)


def _placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows range-partitioned and sorted, then checkpointed so that they stay put; ``_id`` counts within ``_p``."""
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    return placed.withColumn("_p", F.shiftright("_id", 33))


def ranked_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``name``: each row's place within its key, from the places in its range and the sizes of the key's ranges before."""
    placed = _placed(df, [*keys, *order])
    sizes = placed.groupBy("_p", *keys).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = F.col("r._p") == F.col("s._p")
    for key in keys:
        same &= F.col(f"r.{key}").eqNullSafe(F.col(f"s.{key}"))
    joined = placed.alias("r").join(starts.alias("s"), same)
    place = F.col("s._start") + F.col("r._id") - F.col("s._first") + 1
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], place.alias(name))


def with_position(df: DataFrame, order: Sequence[str], name: str = "index", total: str | None = None) -> DataFrame:
    """Number rows 1..N in ``order``, and optionally add N, without a single-task sort.

    The number is the row's place in its range plus the sizes of the ranges before it (one short row per range).  The
    ranges are checkpointed, in ``spark.checkpoint.dir`` or below the warehouse.
    """
    placed = _placed(df, order)
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    by_partition = Window.partitionBy(F.lit(0)).orderBy("_p")
    starts = sizes.select(
        "_p",
        F.coalesce(F.sum("_n").over(by_partition.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # One row per range, as many as the session's shuffle partitions at most: small by construction.
    numbered = placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + place)
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop("_id", "_p", "_start", "_total")
