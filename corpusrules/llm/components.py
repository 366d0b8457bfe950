"""Connected components of a link table, by alternating large and small stars; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrules.llm.storage import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, keep) -> DataFrame:
    """For each ``a``, its smallest neighbour or itself; ``keep`` says which neighbours are handed to it."""
    roots = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return pairs.join(roots, "a").where(keep).select(F.col("b").alias("x"), "root")


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node that has a link (loops are ignored).

    Rounds are few (about the logarithm of the longest path).  Each is written to the shared folder, so no lineage grows
    and a lost executor costs one round at most.  A hot node is one row of ``roots`` that its edges join, and that join
    may be split; its minimum is pre-aggregated.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct()
    while True:
        large = _star(_both_ways(edges), F.col("b") > F.col("a")).where("x <> root")
        down = large.select(F.greatest("x", "root").alias("a"), F.least("x", "root").alias("b")).distinct()
        roots = down.groupBy("a").agg(F.min("b").alias("root"))
        small = down.join(roots, "a").select(F.col("b").alias("x"), "root").where("x <> root")
        edges = written(
            small.union(roots.select(F.col("a").alias("x"), "root")).select(F.col("x").alias("a"), F.col("root").alias("b")).distinct(),
            "stars",
        )
        # Stars: every node has one root, and no root has one.
        several = edges.groupBy("a").count().where("count > 1")
        if several.isEmpty() and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
