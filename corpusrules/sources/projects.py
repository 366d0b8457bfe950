"""Project listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrules.schemas import PROJECTS


def read_projects(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Snapshot of a project listing, read with the fixed schema."""
    return spark.read.schema(PROJECTS).format(fmt).load(path)


def list_projects(
    projects: DataFrame, archived: bool | None = None, group: str = "", include_subgroups: bool = True
) -> DataFrame:
    """``archived`` None keeps all; a group holds its own projects and, unless told otherwise, its subgroups'.

    All conditions are on plain columns, so they reach the scan; without a group every project qualifies.
    """
    if archived is not None:
        projects = projects.where(F.col("archived") == F.lit(archived))
    group = group.strip("/")
    if group:
        path = F.col("path_with_namespace")
        projects = projects.where(path.startswith(group + "/"))
        if not include_subgroups:
            projects = projects.where(~F.substr(path, F.lit(len(group) + 2)).contains("/"))
    return projects


def list_active_projects(projects: DataFrame, group: str = "") -> DataFrame:
    """S2."""
    return list_projects(projects, archived=False, group=group)
