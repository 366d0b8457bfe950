"""Results per project from a stream of files: winners as they change (ST1, X4) and capped searches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusrules.operators.projects import candidate_files
from corpusrules.operators.rules import first_match
from corpusrules.operators.search import search_files
from corpusrules.rulepack import RulePack, Search

#: What :func:`stream_winners` gives, and what readers of its published form ask for.
WINNERS = "project_id {id}, found boolean, file_path string, rule_name string, priority int, version string, source string, confidence double, error string, files_found long, files_failed long"
TOP_MATCHES = "project_id {id}, position int, file_path string, line_number long, line_content string, matched_text string"


def _id_type(rows: DataFrame) -> str:
    return rows.schema["project_id"].dataType.simpleString()


def winners_schema(files: DataFrame) -> str:
    return WINNERS.format(id=_id_type(files))


def stream_winners(files: DataFrame, pack: RulePack, pattern_mode: str = "glob", depth: str = "root") -> DataFrame:
    """Per project, the detection that is first by priority, rule name and path among all files so far, for output mode ``update``.

    A project is a row of every batch that changes what is known of it; a better file that comes late replaces the winner.  A project that has only failures is
    represented by its first one.  ``files_found`` and ``files_failed`` count its files with a detection, and with an error only.  The state is one row per project, and
    batches are added up before they meet it.  Files are judged as they came: a later version of a file is one more file.
    """
    hits = first_match(candidate_files(files, pack, pattern_mode, depth), pack, need_version=True, pattern_mode=pattern_mode)
    missed = (~F.col("found")).alias("missed")
    row = F.struct(missed, "priority", "rule_name", "file_path", "version", "source", "confidence", "error")
    grouped = hits.groupBy("project_id").agg(
        F.min(row).alias("w"), F.count(F.when(F.col("found"), 1)).alias("files_found"), F.count(F.when(~F.col("found"), 1)).alias("files_failed")
    )
    found = ~F.col("w.missed")
    return grouped.select(
        "project_id",
        found.alias("found"),
        *[F.when(found, F.col(f"w.{c}")).alias(c) for c in ("file_path", "rule_name", "priority", "version", "source", "confidence")],
        F.when(~found, F.col("w.error")).alias("error"),
        "files_found",
        "files_failed",
    )


def with_projects(projects: DataFrame, winners: DataFrame) -> DataFrame:
    """J3 over the current winners: one row per project in the shape of ``operators.projects.project_versions``."""
    known = winners.select(
        F.col("project_id").alias("_pid"),
        "file_path",
        "rule_name",
        "priority",
        F.col("version").alias("python_version"),
        F.col("source").alias("detection_source"),
        "confidence",
        "error",
    )
    return projects.join(known, F.col("id") == F.col("_pid"), "left").drop("_pid")


def top_matches_schema(files: DataFrame) -> str:
    return TOP_MATCHES.format(id=_id_type(files))


def stream_top_matches(files: DataFrame, search: Search) -> DataFrame:
    """C5 over a stream: per project its first ``max_matches`` matches by file and line among all files so far, all of them whenever they change.

    The state is a project's matches up to the cap.  A file hands on no more than the cap either, before the shuffle.
    """
    n = search.max_matches
    if n < 1:
        raise ValueError("a capped search needs max_matches")
    kept = search_files(files, search).select("project_id", "file_path", F.inline(F.slice("matches", 1, n)))
    fields = ("file_path", "line_number", "line_content", "matched_text")

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = [tuple(m) for m in json.loads(state.get[0])] if state.exists else []
        best = before
        for frame in frames:
            rows = zip(*(frame[c].tolist() for c in fields), strict=True)
            best = sorted({*best, *((p, int(k), line, text) for p, k, line, text in rows)}, key=lambda m: m[:2])[:n]
        if best != before:
            state.update((json.dumps(best),))
            yield pd.DataFrame({"project_id": [key[0]] * len(best), "position": range(1, len(best) + 1)} | {c: [m[k] for m in best] for k, c in enumerate(fields)})

    return kept.groupBy("project_id").applyInPandasWithState(merge, top_matches_schema(files), "matches string", "update", GroupStateTimeout.NoTimeout)
