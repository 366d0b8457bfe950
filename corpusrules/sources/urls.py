"""Source URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_source_url(url: Column) -> Column:
    """Struct ``(base_url, namespace)``: scheme (https when missing) with host, and the path without outer slashes."""
    full = F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))
    parts = r"\A(https?://[^/?#]*)([^?#]*)"
    return F.struct(
        F.regexp_extract(full, parts, 1).alias("base_url"),
        F.trim(F.regexp_extract(full, parts, 2), F.lit("/")).alias("namespace"),
    )


def namespace_rollup(rows: DataFrame, url: str = "url") -> DataFrame:
    """Rows per base URL and namespace."""
    parts = rows.select(split_source_url(F.col(url)).alias("u")).select("u.*")
    return parts.groupBy("base_url", "namespace").agg(F.count("*").alias("sources"))
