"""Global row numbers in a total order, without a window over all rows and without a task that holds one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrules.llm.storage import free_name, written

_PLACE_BITS = 33


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> tuple[DataFrame, int]:
    """``rows`` with ``name``, from 0 in ``order``, and how many there are.

    Rows are range-partitioned, sorted within their range and written; a number is the place in the range after all ranges
    before it.  Only the ranges' sizes (as many as the session's shuffle partitions at most) visit the driver.  ``order``
    should tell all rows apart: equal rows share a range, and their numbers follow the order in which they were written.
    """
    place, part = free_name(rows, "_place"), free_name(rows, "_part")
    at = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, at), "numbered")
    placed = placed.withColumn(part, F.shiftright(place, _PLACE_BITS))
    starts, total = [], 0
    for row in sorted(placed.groupBy(part).count().collect()):
        starts.append((row[0], total))
        total += row[1]
    first = free_name(placed, "_first")
    table = F.broadcast(rows.sparkSession.createDataFrame(starts, f"`{part}` long, `{first}` long"))
    number = F.col(first) + F.col(place).bitwiseAND((1 << _PLACE_BITS) - 1)
    return placed.join(table, part).select(*[F.col(f"`{c}`") for c in rows.columns], number.alias(name)), total


def with_row(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a number that tells them apart (not successive), written, so that it stays theirs."""
    return written(rows.withColumn(name, F.monotonically_increasing_id()), "rows")
