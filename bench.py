"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from corpusrules.plans.catalog import QUERIES

HEADLINE = [
    "search_regex_lines",
    "search_literal_ci",
    "search_literal_cs",
    "search_secret_tokens",
    "search_top_n_per_project",
    "search_context",
    "search_pack_one_pass",
    "search_project_rollup",
    "rules_first_match",
    "rules_best_match",
    "rules_all_matches",
    "rule_coverage_by_tag",
    "rules_ten_per_file",
    "rules_none_matching",
    "page_lang_regex",
    "manifest_pyproject",
    "manifest_requirements",
    "requirement_rows",
    "project_versions",
    "scan_statistics",
    "event_scan_statistics",
    "event_version_distribution",
    "result_index",
    "url_namespace_rollup",
    "file_contents",
]
FILES = {
    "documents": ["search_regex_lines", "search_literal_ci", "search_pack_one_pass", "rules_first_match", "rules_all_matches"],
    "part": ["project_versions"],
    "events": ["rules_ten_per_file", "rules_none_matching"],
}


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusrules-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        # The benchmark tables are single row groups; this deals them out, as their readers cannot.
        .config("spark.corpusrules.inputPartitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            consume(QUERIES[name](spark, sf_dir))
            runs.append(time.perf_counter() - start)
        # The first run pays for class loading and code generation.
        seconds[name] = round(min(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr)
    counts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in FILES}
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    report = {
        "metric": "headline_query_seconds_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "files_per_second": {q: round(counts[t] / seconds[q]) for t, names in FILES.items() for q in names},
        "mb_per_second": {q: round(text / 1e6 / seconds[q], 1) for q in FILES["documents"]},
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
