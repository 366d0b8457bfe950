"""The two end-to-end jobs: version scan and content search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrules.operators.projects import number_results, project_versions
from corpusrules.operators.search import project_matches, search_content, skipped_counts
from corpusrules.operators.skew import with_position
from corpusrules.operators.stats import matches_by_file, scan_statistics, search_statistics, version_distribution
from corpusrules.rulepack import RulePack, Search, builtin_pack
from corpusrules.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class ScanReport:
    """``results`` is stored (see X8), so statistics and logs read it without scanning the corpus again."""

    results: DataFrame
    statistics: DataFrame
    distribution: DataFrame


@dataclass(frozen=True)
class SearchReport:
    """A search pack's report, keyed by ``search_name``: project rows with their counts, matches, counters, matches per file."""

    results: DataFrame
    matches: DataFrame
    statistics: DataFrame
    by_file: DataFrame

    def of(self, search: Search) -> SearchReport:
        """One search's part."""

        def own(df: DataFrame) -> DataFrame:
            return df.where(F.col("search_name") == search.name).drop("search_name")

        return SearchReport(*(own(df) for df in (self.results, self.matches, self.statistics, self.by_file)))


def version_scan(
    projects: DataFrame,
    files: DataFrame,
    pack: RulePack | None = None,
    pattern_mode: str = "glob",
    depth: str = "root",
) -> ScanReport:
    """Scan the files of every project with a rule pack and report one version per project."""
    found = project_versions(projects, files, pack or builtin_pack(), pattern_mode, depth)
    results = number_results(
        found.select(
            F.col("id").alias("project_id"),
            F.col("name").alias("project_name"),
            F.col("path_with_namespace").alias("project_path"),
            "python_version",
            "detection_source",
            "confidence",
            "error",
        )
    )
    return ScanReport(results, scan_statistics(results), version_distribution(results))


def content_search(projects: DataFrame, files: DataFrame, searches: Sequence[Search]) -> SearchReport:
    """Run a search pack over the files of the given projects and report all its searches.

    The corpus is read once: all searches share a pass, and the matches are checkpointed before they are summed up, for
    all searches together.
    """
    ensure_checkpoint_dir(files.sparkSession)
    listed = projects.select("id", F.col("name").alias("project_name"), F.col("path_with_namespace").alias("project_path"))
    ids = listed.select(F.col("id").alias("project_id"))
    numbered = with_position(listed, ["project_path"], "index", "total_projects")
    # Projects are matched against the few hits, never against the files: contents do not move.
    matches = search_content(files, searches).join(ids, "project_id", "left_semi").checkpoint()
    named = numbered.select("*", F.explode(F.array(*[F.lit(s.name) for s in searches])).alias("search_name"))
    results = project_matches(named, matches)
    skipped = skipped_counts(files, searches).join(ids, "project_id", "left_semi").withColumnRenamed("project_id", "id")
    counts = results.join(skipped, ["search_name", "id"], "left")
    return SearchReport(results, matches, search_statistics(counts, "search_name"), matches_by_file(matches, "search_name"))
