"""Result logs read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusrules.schemas import SCAN_LOG, SEARCH_LOG

_RESULT = ("timestamp", "project_name", "project_path", "python_version", "detection_source", "error", "index", "total_projects")
_STARTED = ("timestamp", "gitlab_url", "total_projects")
_COMPLETED = (
    "timestamp",
    "total_projects",
    "python_projects",
    "non_python_projects",
    "error_count",
)


#: The column that holds a line no record could be read from.
BROKEN = "_broken"


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records and broken lines; the latter have nothing else.  Logs of several runs (``run=`` folders) have a column ``run``."""
    whole = StructType([*schema.fields, StructField(BROKEN, StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)


def read_scan_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of a scan log; lines that are torn or no records are left out, see :func:`broken_lines`."""
    return _whole(_read(spark, path, SCAN_LOG))


def read_search_log(spark: SparkSession, path: str) -> DataFrame:
    return _whole(_read(spark, path, SEARCH_LOG))


def _whole(log: DataFrame) -> DataFrame:
    """Records alone.  Spark reads no log for its broken lines alone, as a count of records would: the time goes with them."""
    row, none = F.struct(BROKEN, "timestamp"), F.struct(F.lit(None).cast("string").alias(BROKEN), "timestamp")
    return log.where(row.eqNullSafe(none)).drop(BROKEN)


def broken_lines(spark: SparkSession, path: str, schema: StructType = SCAN_LOG) -> DataFrame:
    """One row: ``records`` that can be read from a log, and ``broken`` lines beside them."""
    # Every record has a time.
    times = F.when(F.col(BROKEN).isNull(), F.col("timestamp"))
    return _read(spark, path, schema).agg(F.count(times).alias("records"), F.count(BROKEN).alias("broken"))


def scan_log_results(log: DataFrame, *more: str) -> DataFrame:
    return log.where(F.col("type").isNull()).select(*more, *_RESULT)


def scan_log_headers(log: DataFrame) -> DataFrame:
    return log.where(F.col("type") == "scan_started").select(*_STARTED)


def scan_log_summaries(log: DataFrame) -> DataFrame:
    return log.where(F.col("type") == "scan_completed").select(*_COMPLETED)


def scan_log_versions(log: DataFrame) -> DataFrame:
    """Projects per detected version: from a record each, or from the map in the summary of an older log."""
    single = log.where(F.col("type") == "version_count").select("python_version", "projects")
    mapped = log.where(F.col("type") == "scan_completed").select(F.explode("version_counts").alias("python_version", "projects"))
    return single.union(mapped)


def search_log_projects(log: DataFrame) -> DataFrame:
    """One row per project and search; an older log's rows still nest their matches."""
    return log.where(F.col("type").isNull()).drop("type", "file_path")


def search_log_matches(log: DataFrame) -> DataFrame:
    """All matches as rows, with their project's name and place."""
    return log.select("project_name", "project_path", "search_term", "index", "total_projects", F.inline("matches"))
