"""From files to projects: candidate files, the winning detection, and its place in the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrules.operators.rules import any_rule_applies, first_match
from corpusrules.operators.skew import top_n, with_position
from corpusrules.functions.text import base_name
from corpusrules.rulepack import RulePack


NO_RULES = "no enabled rules found"
_DETECTION = {
    "file_path": "string",
    "rule_name": "string",
    "priority": "int",
    "python_version": "string",
    "detection_source": "string",
    "confidence": "double",
}


def candidate_files(files: DataFrame, pack: RulePack, pattern_mode: str = "glob", depth: str = "root") -> DataFrame:
    """Files some rule can apply to; ``depth="root"`` keeps top-level files, ``"any"`` looks everywhere."""
    path = F.col("file_path")
    name = F.col("file_name") if "file_name" in files.columns else base_name(path)
    keep = any_rule_applies(pack.enabled(), name, path, pattern_mode)
    if depth == "root" and pattern_mode == "glob":
        keep = keep & ~path.contains("/")
    return files.where(keep)


def project_winners(
    files: DataFrame, pack: RulePack, pattern_mode: str = "glob", depth: str = "root"
) -> DataFrame:
    """X4 without J3: per project the accepted detection that is first by priority, rule name and path.

    A project without one, but with a file that failed, is represented by its first such file (``found`` is false).
    """
    files = candidate_files(files, pack, pattern_mode, depth)
    hits = first_match(files, pack, need_version=True, pattern_mode=pattern_mode).withColumn("_missed", ~F.col("found"))
    return top_n(hits, ["project_id"], ["_missed", "priority", "rule_name", "file_path"], 1).drop("_missed")


def project_versions(
    projects: DataFrame, files: DataFrame, pack: RulePack, pattern_mode: str = "glob", depth: str = "root"
) -> DataFrame:
    """One scan result per project; projects without a detection keep null version and source.

    ``error`` says why nothing was detected: the first failure among the project's files, or a pack without enabled rules.
    """
    if not len(pack.enabled()):
        nothing = {c: F.lit(None).cast(k) for c, k in _DETECTION.items()}
        return projects.withColumns({**nothing, "error": F.lit(NO_RULES)})
    winners = project_winners(files, pack, pattern_mode, depth).select(
        F.col("project_id").alias("_pid"),
        F.when(F.col("found"), F.col("file_path")).alias("file_path"),
        "rule_name",
        "priority",
        F.col("version").alias("python_version"),
        F.col("source").alias("detection_source"),
        "confidence",
        F.when(~F.col("found"), F.col("error")).alias("error"),
    )
    return projects.join(winners, F.col("id") == F.col("_pid"), "left").drop("_pid")


def number_results(results: DataFrame, order: tuple[str, ...] = ("project_path",)) -> DataFrame:
    """The ``[index/total]`` of a report, in the given order."""
    return with_position(results, list(order), "index", "total_projects")
