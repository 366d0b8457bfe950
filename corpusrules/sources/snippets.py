"""Literal search that answers with snippets, the input of snippet matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrules.functions.search_lines import line_test
from corpusrules.functions.text import as_text, base_name
from corpusrules.sources.projects import list_projects

SNIPPET_LINES = 3


def search_snippets(files: DataFrame, query: str, project_id: object = None, ref: str = "") -> DataFrame:
    """``(file_path, data, startline)`` for every run of three lines that holds the query in any case.

    Files are cut at fixed places, so no line is in two snippets and every matching line is in one.
    """
    if not query:
        raise ValueError("search query cannot be empty")
    if project_id is not None:
        files = files.where(F.col("project_id") == F.lit(project_id))
    if ref:
        files = files.where(F.col("ref") == ref)
    test = line_test(query)
    content = as_text(F.col("content"))
    keys = [c for c in ("project_id", "file_path") if c in files.columns]
    lines = files.where(test.matches(content)).select(*keys, F.split(content, "\n").alias("_lines"))
    starts = F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(SNIPPET_LINES))
    snippets = F.transform(
        starts,
        lambda i: F.struct(
            F.array_join(F.slice("_lines", i + 1, SNIPPET_LINES), "\n").alias("data"),
            (i + 1).cast("bigint").alias("startline"),
        ),
    )
    rows = lines.select(*keys, F.inline(snippets)).where(test.matches(F.col("data")))
    return rows.select(*keys, base_name(F.col("file_path")).alias("file_name"), "data", "startline")


def search_group_snippets(files: DataFrame, projects: DataFrame, group: str, query: str) -> DataFrame:
    """Snippets from all projects of a group and its subgroups; only snippets, not files, meet the project list."""
    members = list_projects(projects, group=group).select(F.col("id").alias("project_id"))
    return search_snippets(files, query).join(members, "project_id", "left_semi")
