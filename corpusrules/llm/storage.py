"""Table reading and written steps of the ``llm`` operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusrules.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder (``spark.checkpoint.dir``), read back: computed once, whatever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written by hash of ``key``, one file a partition, as many as the session's shuffle partitions: it moves this once, and rows that are
    grouped by ``key`` with it later come to it."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[1]}"
    df.repartition(parts, key).write.option("path", path).bucketBy(parts, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


#: What a task hands to Python at a time.  Spark's own 10,000 rows or 64 MB are held several times over, by either side.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches that suit whole texts."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it until no column of ``df`` is called so (any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
