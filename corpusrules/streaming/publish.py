"""Tables that a stream keeps up to date, and readers that only ever see whole batches (ST2, ST3).

Every batch is written to a folder of its number, and counts from when its number stands among the commits, which is one small file put in
place at once.  A batch that failed on the way leaves rows that no reader looks at, and the stream's next start writes them anew; a batch that is committed is not
written again, whatever the stream remembers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

_COMMIT = "batch long, base boolean"


def _rows(out: str, batch: int, base: bool) -> str:
    return f"{out}/{'base' if base else 'rows'}/batch={batch}"


def commits(spark: SparkSession, out: str) -> list[tuple[int, bool]]:
    """Committed batches in order; a base (see :func:`compact`) holds all that was known up to its number."""
    try:
        found = spark.read.schema(_COMMIT).parquet(f"{out}/commits/*").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((r["batch"], r["base"]) for r in found)


def write_batch(rows: DataFrame, out: str, batch: int, base: bool = False) -> None:
    """One batch, then its commit; what is committed already stays."""
    spark = rows.sparkSession
    if (batch, base) in commits(spark, out):
        return
    rows.write.mode("overwrite").parquet(_rows(out, batch, base))
    mark = spark.createDataFrame([(batch, base)], _COMMIT).coalesce(1)
    mark.write.mode("overwrite").parquet(f"{out}/commits/{'base' if base else 'batch'}-{batch}")


def publish(rows: DataFrame, out: str, checkpoint: str, mode: str = "update", prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Publish each batch of a stream: all rows (``complete``), or those that changed (``update``)."""

    def write(batch: DataFrame, number: int) -> None:
        write_batch(prepare(batch) if prepare else batch, out, number)

    writer = rows.writeStream.outputMode(mode).foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, out: str, schema: StructType | str, batches: Sequence[int], base: bool) -> DataFrame:
    """Rows of some batches with their ``batch``, in one scan."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    numbered = StructType([*kind.fields, StructField("batch", LongType())])
    if not batches:
        return spark.createDataFrame([], numbered)
    root = _rows(out, 0, base).rsplit("/", 1)[0]
    return spark.read.schema(numbered).option("basePath", root).parquet(*[_rows(out, b, base) for b in batches])


def read_published(spark: SparkSession, out: str, schema: StructType | str) -> DataFrame:
    """The last committed batch of a table that is published whole; no rows before the first."""
    known = commits(spark, out)[-1:]
    return _read(spark, out, schema, [b for b, _ in known], any(base for _, base in known)).drop("batch")


def read_latest(spark: SparkSession, out: str, schema: StructType | str, keys: Sequence[str]) -> DataFrame:
    """The current rows of a table that is published by changes: of each key, all rows of the last committed batch that has any."""
    known = commits(spark, out)
    start = max((b for b, base in known if base), default=-1)
    later = [b for b, base in known if not base and b > start]
    found = _read(spark, out, schema, [start] if start >= 0 else [], True).union(_read(spark, out, schema, later, False))
    last = found.groupBy(*keys).agg(F.max("batch").alias("last"))
    same = F.col("r.batch") == F.col("l.last")
    for key in keys:
        same &= F.col(f"r.{key}").eqNullSafe(F.col(f"l.{key}"))
    return found.alias("r").join(last.alias("l"), same).select(*[F.col(f"r.{c}") for c in found.columns if c != "batch"])


def compact(spark: SparkSession, out: str, schema: StructType | str, keys: Sequence[str]) -> None:
    """The current rows as one base, so that readers need not go through all batches; readers see the same rows before and after."""
    known = commits(spark, out)
    if known and not known[-1][1]:
        write_batch(read_latest(spark, out, schema, keys), out, known[-1][0], base=True)
