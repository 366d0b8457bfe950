"""Summary statistics (A1-A6): aggregations whose partial results are small whatever the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrules.functions.text import blank_to_null
from corpusrules.rulepack import RulePack


def _scan_state() -> tuple[Column, Column]:
    return F.col("error").isNotNull(), blank_to_null(F.col("python_version")).isNotNull()


def scan_statistics(results: DataFrame) -> DataFrame:
    """A1: one row of counters over scan results; a result with an error counts only there and in the total."""
    failed, detected = _scan_state()
    return results.agg(
        F.count("*").alias("total_projects"),
        F.count_if(~failed & detected).alias("python_projects"),
        F.count_if(~failed & ~detected).alias("non_python_projects"),
        F.count_if(failed).alias("error_count"),
    )


def version_distribution(results: DataFrame) -> DataFrame:
    """A2: results per detected version."""
    failed, detected = _scan_state()
    return results.where(~failed & detected).groupBy("python_version").agg(F.count("*").alias("projects"))


def search_statistics(project_counts: DataFrame, *keys: str) -> DataFrame:
    """A3: counters over one ``(match_count, error, skipped_files)`` row per project (and key); the last two may be missing.

    ``skipped_files`` counts files left out for their size (F6).
    """
    failed = F.col("error").isNotNull() if "error" in project_counts.columns else F.lit(False)
    n = F.coalesce(F.col("match_count"), F.lit(0))
    return project_counts.groupBy(*keys).agg(
        F.count("*").alias("total_projects"),
        F.count_if(~failed & (n > 0)).alias("projects_with_hits"),
        F.count_if(~failed & (n == 0)).alias("projects_no_hits"),
        F.coalesce(F.sum(F.when(~failed, n)), F.lit(0)).alias("total_matches"),
        F.count_if(failed).alias("error_count"),
        (F.coalesce(F.sum("skipped_files"), F.lit(0)) if "skipped_files" in project_counts.columns else F.lit(0))
        .cast("bigint")
        .alias("skipped_files"),
    )


def matches_by_file(matches: DataFrame, *keys: str) -> DataFrame:
    """A4: matches per path (and key); the same path in different projects counts as one."""
    return matches.groupBy(*keys, "file_path").agg(F.count("*").alias("matches"))


def average_confidence(detections: DataFrame, *keys: str) -> DataFrame:
    """Mean confidence of the detections, per key if any are given."""
    return detections.where("found").groupBy(*keys).agg(
        F.avg("confidence").alias("avg_confidence"), F.count("*").alias("detections")
    )


# -- rules -------------------------------------------------------------------------------------------------------------


def rule_coverage(outcomes: DataFrame) -> DataFrame:
    """A5 per rule: files tried, detections, errors."""
    return outcomes.groupBy("rule_name").agg(
        F.count("*").alias("files_tried"),
        F.count_if(F.col("found")).alias("detections"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def _roll_up(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(
        F.count("*").alias("rules"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("files_tried", "detections", "errors")],
    )


def _pack_table(outcomes: DataFrame, pack: RulePack) -> DataFrame:
    rows = [(r.name, r.priority, list(r.tags), r.enabled) for r in pack]
    schema = "rule_name string, priority int, tags array<string>, enabled boolean"
    return outcomes.sparkSession.createDataFrame(rows, schema)


def coverage_by_priority(outcomes: DataFrame, pack: RulePack) -> DataFrame:
    """A5 by priority.  Outcomes shrink to one row per rule before they meet the pack."""
    rules = _pack_table(outcomes, pack).join(rule_coverage(outcomes), "rule_name", "left")
    return _roll_up(rules, "priority")


def coverage_by_tag(outcomes: DataFrame, pack: RulePack) -> DataFrame:
    """A5 by tag; a rule counts under each of its tags."""
    rules = _pack_table(outcomes, pack).join(rule_coverage(outcomes), "rule_name", "left")
    return _roll_up(rules.withColumn("tag", F.explode("tags")), "tag")


def pack_statistics(pack: RulePack) -> dict[str, object]:
    """A5 over the pack itself: how many rules there are, by state, priority and tag."""
    by_priority: dict[int, int] = {}
    by_tag: dict[str, int] = {}
    for rule in pack:
        by_priority[rule.priority] = by_priority.get(rule.priority, 0) + 1
        for tag in rule.tags:
            by_tag[tag] = by_tag.get(tag, 0) + 1
    active = sum(r.enabled for r in pack)
    return {
        "total_rules": len(pack),
        "enabled_rules": active,
        "disabled_rules": len(pack) - active,
        "rules_by_priority": by_priority,
        "rules_by_tag": by_tag,
    }
