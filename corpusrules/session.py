"""Session facts the operators need: where shared scratch data goes, and whether a small table really is small."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or else one below the session's warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


# The folder of the run that is under way, below the shared one.
RUN_CONF = "spark.corpusrules.run"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or the run's; nothing is ever reused or cleared."""
    run = spark.conf.get(RUN_CONF, None)
    return "/".join([shared_dir(spark), *([run] if run else []), f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def run_folder(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """What is written on the way while this lasts goes into one folder, whose path is given: results read from it, so whoever has
    stored them may drop it as a whole."""
    before, own = spark.conf.get(RUN_CONF, None), f"{name}-{uuid.uuid4().hex}"
    spark.conf.set(RUN_CONF, own)
    try:
        yield f"{shared_dir(spark)}/{own}"
    finally:
        if before is None:
            spark.conf.unset(RUN_CONF)
        else:
            spark.conf.set(RUN_CONF, before)


def collect_small(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be small by nature (rules, searches); refuses anything larger."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows
