"""The requirements of pip requirements files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrules.functions.requirement_lines import (
    is_requirement_file,
    name,
    requirement_columns,
    requirement_labels,
)
from corpusrules.functions.text import as_text, trim_space


def requirement_rows(files: DataFrame, keep_requirement_files: bool = False) -> DataFrame:
    """One row per requirement line; ``-r`` lines are dropped unless asked for."""
    keys = [c for c in ("project_id", "file_path") if c in files.columns]
    lines = F.transform(F.split(as_text(F.col("content")), "\n"), trim_space)
    rows = files.select(*keys, F.posexplode(lines).alias("_pos", "line"))
    line = F.col("line")
    keep = name(line) != ""
    if keep_requirement_files:
        keep = keep | is_requirement_file(line)
    parts = [c.alias(n) for n, c in requirement_columns(line).items()]
    return rows.where(keep).select(*keys, (F.col("_pos") + 1).cast("bigint").alias("line_no"), *parts)


def dependency_counts(files: DataFrame) -> DataFrame:
    """Requirements per manifest, none for files without any.  A file is one row, so nothing leaves that row."""
    keys = [c for c in ("project_id", "file_path") if c in files.columns]
    count = F.size(requirement_labels(as_text(F.col("content"))))
    return files.select(*keys, count.cast("bigint").alias("dependency_count"))
