"""K1-K5: result logs as JSON lines or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrules.functions.text import blank_to_null
from corpusrules.operators.search import nest_by_file
from corpusrules.operators.stats import scan_statistics, version_distribution

RFC3339 = "yyyy-MM-dd'T'HH:mm:ssXXX"


def _now(df: DataFrame) -> Column:
    return F.col("timestamp") if "timestamp" in df.columns else F.current_timestamp()


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return (blank_to_null(F.col(name)) if kind == "string" else F.col(name)) if name in df.columns else F.lit(None).cast(kind)


def _place() -> Column:
    return F.format_string("[%d/%d] ", F.col("index"), F.col("total_projects"))


def _stamp(df: DataFrame) -> Column:
    return F.concat(F.lit("["), F.date_format(_now(df), RFC3339), F.lit("] "))


def _write(df: DataFrame, path: str, mode: str, fmt: str) -> None:
    if fmt not in ("json", "text"):
        raise ValueError(f"unknown log format: {fmt}")
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown log mode: {mode}")
    df.write.mode(mode).format(fmt).save(path)


# -- version scans -----------------------------------------------------------------------------------------------------


def scan_log_records(results: DataFrame) -> DataFrame:
    """K1: one record per scan result; empty fields become nulls, which the JSON writer leaves out."""
    return results.select(
        _now(results).alias("timestamp"),
        "project_name",
        *[_optional(results, c).alias(c) for c in ("project_path", "python_version", "detection_source", "error")],
        "index",
        "total_projects",
    )


def render_scan_results(results: DataFrame, timestamps: bool = False) -> DataFrame:
    """K2: a line of text per scan result: an error, nothing detected, or the version and where it came from."""
    version, error = _optional(results, "python_version"), _optional(results, "error")
    text = (
        F.when(error.isNotNull(), F.concat(F.lit("Error - "), error))
        .when(version.isNull(), F.lit("Python not detected"))
        .otherwise(F.concat(F.lit("Python "), version, F.lit(" (from "), F.col("detection_source"), F.lit(")")))
    )
    parts = [_place(), F.col("project_name"), F.lit(": "), text]
    return results.select(F.concat(*([_stamp(results)] if timestamps else []), *parts).alias("value"))


def write_scan_log(results: DataFrame, path: str, mode: str = "overwrite", fmt: str = "json") -> None:
    """K1, K2: ``mode`` "overwrite" starts the log anew, "append" adds to it."""
    rows = scan_log_records(results) if fmt == "json" else render_scan_results(results, timestamps=True)
    _write(rows, path, mode, fmt)


def _run_path(path: str, run: str) -> str:
    if not run or "/" in run:
        raise ValueError("a run needs a name without slashes")
    return f"{path}/run={run}"


def write_scan_run(results: DataFrame, path: str, run: str, source_url: str = "") -> None:
    """K1, K5: one run's records in a log of many; a run that is written again replaces its own records and no others."""
    write_full_scan_log(results, _run_path(path, run), source_url)


def write_search_run(results: DataFrame, matches: DataFrame, path: str, run: str, search_term: str) -> None:
    """K3: the same for a content search."""
    write_search_log(results, matches, _run_path(path, run), search_term)


def scan_started(statistics: DataFrame, source_url: str) -> DataFrame:
    """K5: header record of a JSON log."""
    return statistics.select(
        F.lit("scan_started").alias("type"),
        F.current_timestamp().alias("timestamp"),
        F.lit(source_url).alias("gitlab_url"),
        "total_projects",
    )


def scan_completed(statistics: DataFrame) -> DataFrame:
    """K5: summary record with the counters."""
    return statistics.select(F.lit("scan_completed").alias("type"), F.current_timestamp().alias("timestamp"), *statistics.columns)


def version_records(distribution: DataFrame) -> DataFrame:
    """K5: one record per detected version beside the summary, however many there are."""
    return distribution.select(
        F.lit("version_count").alias("type"), F.current_timestamp().alias("timestamp"), "python_version", "projects"
    )


def write_full_scan_log(results: DataFrame, path: str, source_url: str, mode: str = "overwrite") -> None:
    """K1 and K5 in one JSON-lines log; ``results`` should be a stored table, since all kinds of record read it."""
    statistics = scan_statistics(results)
    _write(scan_started(statistics, source_url), path, mode, "json")
    _write(scan_log_records(results), path, "append", "json")
    _write(version_records(version_distribution(results)), path, "append", "json")
    _write(scan_completed(statistics), path, "append", "json")


def write_full_text_log(results: DataFrame, path: str, source_url: str, mode: str = "overwrite") -> None:
    """K2 and K5 in one text log: the header block, a stamped line per result, the summary block."""
    statistics = scan_statistics(results)
    # A block's lines belong together, and are few: counters, and a line per version.
    _write(render_scan_header(statistics, source_url, log=True).coalesce(1), path, mode, "text")
    _write(render_scan_results(results, timestamps=True), path, "append", "text")
    _write(render_scan_summary(statistics, version_distribution(results)), path, "append", "text")


def _lines(rows: DataFrame, *lines: Column) -> DataFrame:
    return rows.select(F.explode(F.array_compact(F.array(*lines))).alias("value"))


def _labelled(label: str, value: str | Column) -> Column:
    return F.concat(F.lit(f"{label}: "), (F.col(value) if isinstance(value, str) else value).cast("string"))


def render_scan_header(statistics: DataFrame, source_url: str, title: str = "Scan Log", log: bool = False) -> DataFrame:
    """K5 as text: the console's one line, or a log file's block."""
    if not log:
        return statistics.select(F.format_string("Found %d projects in organization", "total_projects").alias("value"))
    return _lines(
        statistics,
        F.lit(f"=== {title} ==="),
        _labelled("Timestamp", F.date_format(F.current_timestamp(), RFC3339)),
        F.lit(f"Source URL: {source_url}"),
        _labelled("Total Projects", "total_projects"),
        F.lit("====================================="),
    )


def _errors_line(label: str) -> Column:
    return F.when(F.col("error_count") > 0, _labelled(label, "error_count"))


def render_scan_summary(statistics: DataFrame, distribution: DataFrame | None = None) -> DataFrame:
    """K5 as text: the console's summary, or with a version distribution the log file's block."""
    if distribution is None:
        done = F.format_string(
            "Scan complete: %d projects, %d Python projects, %d non-Python",
            "total_projects",
            "python_projects",
            "non_python_projects",
        )
        return _lines(statistics, done, _errors_line("Errors encountered"))
    head = _lines(
        statistics,
        F.lit("=== Scan Summary ==="),
        _labelled("Timestamp", F.date_format(F.current_timestamp(), RFC3339)),
        _labelled("Total Projects", "total_projects"),
        _labelled("Python Projects", "python_projects"),
        _labelled("Non-Python Projects", "non_python_projects"),
        _errors_line("Errors"),
        F.when(F.col("python_projects") > 0, F.lit("Python Version Distribution:")),
    )
    body = distribution.select(F.format_string("  %s: %d", "python_version", "projects").alias("value"))
    return head.unionByName(body).unionByName(statistics.select(F.lit("====================").alias("value")))


# -- content searches ----------------------------------------------------------------------------------------------------


def search_log_records(results: DataFrame, matches: DataFrame, search_term: str) -> DataFrame:
    """K3: one record per project with its counts, and one per file with matches (``type`` "file_matches") that nests them.

    ``results`` are project rows, ``matches`` flat or nested by file.
    """
    nested = matches if "matches" in matches.columns else nest_by_file(matches)
    stamp = _now(results).alias("timestamp")
    keys = [stamp, "project_name", _optional(results, "project_path").alias("project_path"), F.lit(search_term).alias("search_term")]
    place = ["index", "total_projects"]
    projects = results.select(*keys, "match_count", "files_with_matches", _optional(results, "error").alias("error"), *place)
    by_file = nested.select(F.col("project_id").alias("id"), "file_path", F.col("matches").alias("_matches"), F.col("match_count").alias("_n"))
    entries = F.transform(
        "_matches",
        lambda m: F.struct(F.col("file_path").alias("file_path"), *[m[c].alias(c) for c in ("line_number", "line_content", "matched_text")]),
    )
    files = results.drop("match_count").join(by_file, "id").select(
        F.lit("file_matches").alias("type"), *keys, "file_path", entries.alias("matches"), F.col("_n").alias("match_count"), *place
    )
    return projects.unionByName(files, allowMissingColumns=True)


def render_search_results(results: DataFrame, matches: DataFrame, timestamps: bool = False) -> DataFrame:
    """K4: a heading per project and a line per match.  Ordered by ``index``, ``file_path`` and ``line_number``, a heading
    (where the latter two are null) stands above its lines."""
    error = _optional(results, "error")
    found = "%d match(es)" if timestamps else "%d match(es) found"
    text = (
        F.when(error.isNotNull(), F.concat(F.lit("Error - "), error))
        .when(F.col("match_count") == 0, F.lit("no matches"))
        .otherwise(F.format_string(found, "match_count"))
    )
    heading = F.concat(*([_stamp(results)] if timestamps else []), _place(), F.col("project_name"), F.lit(": "), text)
    headings = results.select("index", heading.alias("value"))
    line = F.format_string("  %s:%d: %s", "file_path", "line_number", "line_content")
    shown = results.where(error.isNull()).select("id", "index")
    lines = matches.withColumnRenamed("project_id", "id").join(shown, "id").select("index", "file_path", "line_number", line.alias("value"))
    return headings.unionByName(lines, allowMissingColumns=True)


def write_search_log(
    results: DataFrame, matches: DataFrame, path: str, search_term: str, mode: str = "overwrite", fmt: str = "json"
) -> None:
    """K3, K4."""
    if fmt == "text":
        rows = render_search_results(results, matches, timestamps=True).orderBy("index", "file_path", "line_number").select("value")
    else:
        rows = search_log_records(results, matches, search_term)
    _write(rows, path, mode, fmt)


def render_search_header(statistics: DataFrame, search_term: str) -> DataFrame:
    """K5 for searches."""
    term = search_term.replace("\\", "\\\\").replace('"', '\\"')
    text = F.concat(F.format_string("Searching %d projects for ", "total_projects"), F.lit(f'"{term}"'))
    return statistics.select(text.alias("value"))


def render_search_summary(statistics: DataFrame) -> DataFrame:
    """K5 for searches."""
    done = F.format_string(
        "Search complete: %d projects scanned, %d with matches (%d total matches)",
        "total_projects",
        "projects_with_hits",
        "total_matches",
    )
    return _lines(statistics, done, _errors_line("Errors encountered"))
