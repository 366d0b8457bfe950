"""Looking values up by a key that very many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrules.llm.storage import free_name, written

#: Rows of one or two numbers that a broadcast may hold.
BROADCAST_ROWS = 1_000_000
#: Rows of a key beyond which it is hot.
HOT_ROWS = 50_000


def small_side(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of one or two numbers a row, broadcast if it has few rows, else left to a shuffled join."""
    return F.broadcast(rows) if rows.count() <= most else rows


def looked_up(rows: DataFrame, key: str, values: DataFrame, most: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` (written, or cheap to read) with the columns of ``values``, which has a row per ``key``; nulls where it has none.

    Few ``values`` are broadcast.  Of more, those of hot keys are, which at most ``most`` keys can be; the others' rows are shuffled, and
    rows without a key go nowhere.  So no task gets all rows of a hot key.
    """
    values = written(values, "values")
    if values.count() <= most:
        return rows.join(F.broadcast(values), key, "left").select(*rows.columns, *[c for c in values.columns if c != key])
    least = max(hot_rows, -(-rows.count() // most))
    mark = free_name(rows, "_hot")
    hot = written(rows.groupBy(key).count().where((F.col("count") >= least) & F.col(key).isNotNull()).select(key), "hot")
    marked = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), key, "left")
    own = [*rows.columns, *[c for c in values.columns if c != key]]
    common = marked.where(mark).join(F.broadcast(values.join(F.broadcast(hot), key, "left_semi")), key, "left").select(*own)
    other = marked.where(F.col(mark).isNull() & F.col(key).isNotNull()).join(values, key, "left").select(*own)
    none = rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in values.schema if f.name != key])
    return common.union(other).union(none)
