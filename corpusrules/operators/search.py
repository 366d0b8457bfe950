"""Content search (C1-C8): lines matching a literal or a regular expression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrules.functions.patterns import search_globs_match
from corpusrules.functions.search_lines import LineTest, line_test
from corpusrules.functions.text import as_text, base_name, strip_cr
from corpusrules.operators.skew import group_limit, ranked_by_range, top_n
from corpusrules.rulepack import Search

MATCH_COLUMNS = ("line_number", "line_content", "matched_text")


def _test(search: Search) -> LineTest:
    return line_test(search.term, search.is_regex, search.case_sensitive)


def _names_and_sizes(search: Search, columns: Sequence[str]) -> list[Column]:
    """what can be decided before any content is read."""
    name = F.col("file_name") if "file_name" in columns else base_name(F.col("file_path"))
    tests = []
    globs = search_globs_match(name, search.file_patterns)
    if globs is not None:
        tests.append(globs)
    if search.max_file_size:
        tests.append(~_too_large(search, columns))
    return tests


def _too_large(search: Search, columns: Sequence[str]) -> Column:
    size = F.col("size") if "size" in columns else F.octet_length(F.col("content"))
    return size > F.lit(search.max_file_size)


def skipped_counts(files: DataFrame, searches: Sequence[Search] | Search) -> DataFrame:
    """files per search and project that would be read but for their size; contents are not read where sizes are known."""
    searches = [searches] if isinstance(searches, Search) else searches
    name = F.col("file_name") if "file_name" in files.columns else base_name(F.col("file_path"))
    names = [F.lit(None).cast("string")]
    for search in searches:
        if search.max_file_size:
            globs = search_globs_match(name, search.file_patterns)
            large = _too_large(search, files.columns)
            names.append(F.when(large if globs is None else globs & large, F.lit(search.name)))
    rows = files.select("project_id", F.explode(F.array(*names)).alias("search_name")).where("search_name is not null")
    return rows.groupBy("search_name", "project_id").agg(F.count("*").alias("skipped_files"))


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _keys(files: DataFrame) -> list[str]:
    return [c for c in ("project_id", "file_path") if c in files.columns]


def search_lines(files: DataFrame, search: Search) -> DataFrame:
    """One row per matching line.  With ``context_lines`` (C6) neighbours come as ``before`` and ``after``."""
    test, keys = _test(search), _keys(files)
    content = as_text(F.col("content"))
    split = _split(content, test)
    files = files.where(_all(_names_and_sizes(search, files.columns)))
    if search.context_lines > 0:
        return _with_context(files, keys, split, test, search.context_lines)
    lines = files.select(*keys, F.posexplode(split).alias("_pos", "_line"))
    return lines.where(test.matches(F.col("_line"))).select(*keys, *_match_columns(test))


def _split(content: Column, test: LineTest) -> Column:
    """Lines of a text; null where no line can match.  The test gates the split, because filters move in front of a
    repartitioning of the files."""
    possible = test.may_occur_in(content)
    return F.split(content, "\n") if possible is None else F.when(possible, F.split(content, "\n"))


def search_files(files: DataFrame, search: Search) -> DataFrame:
    """One row per file with matches, which are nested within the file's own row: ``matches`` and ``match_count``."""
    test, keys = _test(search), _keys(files)
    split = _split(as_text(F.col("content")), test)
    files = files.where(_all(_names_and_sizes(search, files.columns)))
    hits = F.transform(
        split,
        lambda line, i: F.when(
            test.matches(line),
            F.struct(
                (i + 1).cast("bigint").alias("line_number"),
                strip_cr(line).alias("line_content"),
                test.matched_text(line).alias("matched_text"),
            ),
        ),
    )
    rows = files.select(*keys, F.array_compact(hits).alias("matches"))
    return rows.withColumn("match_count", F.size("matches").cast("bigint")).where("match_count > 0")


def nest_by_file(matches: DataFrame) -> DataFrame:
    """Matches that were found line by line, in the shape of :func:`search_files`; a group is one file's matches."""
    keys = [c for c in ("search_name", "project_id", "file_path") if c in matches.columns]
    nested = matches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*MATCH_COLUMNS))).alias("matches"))
    return nested.withColumn("match_count", F.size("matches").cast("bigint"))


def _match_columns(test: LineTest) -> list[Column]:
    return [
        (F.col("_pos") + 1).cast("bigint").alias("line_number"),
        strip_cr(F.col("_line")).alias("line_content"),
        test.matched_text(F.col("_line")).alias("matched_text"),
    ]


def _neighbours(i: Column, n: int) -> list[Column]:
    """Up to ``n`` lines on either side of line ``i`` (from 0) of the array column ``_lines``."""
    start = F.greatest(i - F.lit(n), F.lit(0))
    before = F.slice("_lines", start + 1, i - start)
    after = F.slice("_lines", i + 2, F.greatest(F.least(F.lit(n), F.size("_lines") - i - 1), F.lit(0)))
    return [F.transform(before, strip_cr).alias("before"), F.transform(after, strip_cr).alias("after")]


def _with_context(files: DataFrame, keys: list[str], split: Column, test: LineTest, n: int) -> DataFrame:
    """Neighbouring lines are cut out beside each hit, so the exploded rows never carry the whole file."""
    lines = files.select(*keys, split.alias("_lines"))
    hits = F.transform(
        "_lines",
        lambda line, i: F.when(test.matches(line), F.struct(i.alias("_pos"), line.alias("_line"), *_neighbours(i, n))),
    )
    rows = lines.select(*keys, F.inline(F.array_compact(hits)))
    return rows.select(*keys, *_match_columns(test), "before", "after")


def cap_per_file(matches: DataFrame, n: int) -> DataFrame:
    """C5 within a file: its first ``n`` matching lines."""
    keys = [c for c in ("search_name", "project_id", "file_path") if c in matches.columns]
    return top_n(matches, keys, ["line_number"], n)


def cap_per_project(matches: DataFrame, n: int) -> DataFrame:
    """C5 within a project: its first ``n`` matches by file and line."""
    keys = [c for c in ("search_name", "project_id") if c in matches.columns]
    return top_n(matches, keys, ["file_path", "line_number"], n)


def search_content(files: DataFrame, searches: Sequence[Search] | Search) -> DataFrame:
    """All searches of a pack in one pass over the lines, with ``search_name`` and per-project caps applied."""
    searches = [searches] if isinstance(searches, Search) else list(searches)
    if not searches:
        raise ValueError("config holds no search definitions")
    found = _one_pass(files, searches, any(s.context_lines for s in searches))
    return apply_caps(found, searches) if any(s.max_matches > 0 for s in searches) else found


def apply_caps(matches: DataFrame, searches: Sequence[Search]) -> DataFrame:
    """Hits of capped searches are ranked per project; a hit of any other search is alone in a lane of its own.

    The largest cap also stands as a literal, so that Spark cuts hot projects before the shuffle where it can.  Caps too large for that are ranked by range: no task
    gets a project's hits together, and hits of searches without a cap are in no window.
    """
    caps = {s.name: s.max_matches for s in searches if s.max_matches > 0}
    capped = F.col("search_name").isin(*caps)
    keys = [c for c in ("search_name", "project_id") if c in matches.columns]
    pairs = [F.lit(x) for item in caps.items() for x in item]
    cap = F.create_map(*pairs)[F.col("search_name")]
    if max(caps.values()) >= group_limit(matches):
        ranked = ranked_by_range(matches, keys, ["file_path", "line_number"], "_rank")
        return ranked.where(~capped | (F.col("_rank") <= cap)).drop("_rank")
    lanes = [F.when(~capped, F.col(c)) for c in ("file_path", "line_number")]
    place = F.row_number().over(Window.partitionBy(*keys, *lanes).orderBy("file_path", "line_number"))
    cap = F.when(capped, cap).otherwise(F.lit(1))
    return matches.withColumn("_rank", place).where((F.col("_rank") <= max(caps.values())) & (F.col("_rank") <= cap)).drop("_rank")


def _one_pass(files: DataFrame, searches: Sequence[Search], with_context: bool) -> DataFrame:
    keys, content = _keys(files), as_text(F.col("content"))
    tests = [_test(s) for s in searches]
    metadata = [_all(_names_and_sizes(s, files.columns)) for s in searches]
    possible = [t.may_occur_in(content) for t in tests]
    gates = {f"_gate{i}": m if p is None else m & p for i, (m, p) in enumerate(zip(metadata, possible))}
    # Only metadata is filtered on: a filter on the gates would move below them and scan every text twice.
    gated = files.where(_any(metadata)).select(*keys, content.alias("_content"), *[g.alias(n) for n, g in gates.items()])
    split = F.when(_any([F.col(n) for n in gates]), F.split("_content", "\n"))

    def here(line: Column) -> list[Column]:
        if len(tests) == 1:  # the only gate was passed when the file was split
            return [tests[0].matches(line)]
        return [F.col(gate) & test.matches(line) for gate, test in zip(gates, tests)]

    def hits(line: Column, i: Column) -> Column:
        found = []
        for search, test, holds in zip(searches, tests, here(line)):
            fields = [F.lit(search.name).alias("search_name"), test.matched_text(line).alias("matched_text")]
            if with_context:
                fields += _neighbours(i, search.context_lines)
            found.append(F.when(holds, F.struct(*fields)))
        return F.array_compact(F.array(*found))

    if with_context:
        lines = gated.select(*keys, *gates, split.alias("_lines"))
        per_line = F.transform(
            "_lines",
            lambda line, i: F.when(
                _any(here(line)), F.struct(i.alias("_pos"), line.alias("_line"), hits(line, i).alias("_hits"))
            ),
        )
        rows = lines.select(*keys, F.inline(F.array_compact(per_line)))
        rows = rows.select(*keys, "_pos", "_line", F.inline("_hits"))
    else:
        lines = gated.select(*keys, *gates, F.posexplode(split).alias("_pos", "_line"))
        lines = lines.where(_any(here(F.col("_line"))))
        rows = lines.select(*keys, "_pos", "_line", F.inline(hits(F.col("_line"), F.col("_pos"))))
    return rows.select(
        *keys,
        (F.col("_pos") + 1).cast("bigint").alias("line_number"),
        strip_cr(F.col("_line")).alias("line_content"),
        "matched_text",
        "search_name",
        *(["before", "after"] if with_context else []),
    )


# -- snippets ----------------------------------------------------------------------------------------------------------


def snippet_matches(snippets: DataFrame, search: Search) -> DataFrame:
    """Absolute line numbers of the matching lines inside snippets ``(file_path, data, startline)``."""
    test, keys = _test(search), _keys(snippets)
    name = F.col("file_name") if "file_name" in snippets.columns else base_name(F.col("file_path"))
    globs = search_globs_match(name, search.file_patterns)
    if globs is not None:
        snippets = snippets.where(globs)
    lines = snippets.select(*keys, "startline", F.posexplode(F.split("data", "\n")).alias("_pos", "_raw"))
    lines = lines.withColumn("_line", strip_cr(F.col("_raw")))
    found = lines.where(test.matches(F.col("_line"))).select(
        *keys,
        (F.col("startline") + F.col("_pos")).cast("bigint").alias("line_number"),
        F.col("_line").alias("line_content"),
        test.matched_text(F.col("_line")).alias("matched_text"),
    )
    return cap_per_project(found, search.max_matches) if search.max_matches > 0 else found


# -- projects ----------------------------------------------------------------------------------------------------------


def match_counts(matches: DataFrame) -> DataFrame:
    """Matches per project (and search); partial counts leave the map side, so hot projects cost nothing extra."""
    keys = [c for c in ("search_name", "project_id") if c in matches.columns]
    return matches.groupBy(*keys).agg(F.count("*").alias("match_count"))


def project_matches(projects: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per project with ``match_count`` and ``files_with_matches``, projects without hits included.

    Projects listed once per search (``search_name``) meet their own search's matches.  Counts are taken per file first,
    from partial sums; the matches themselves stay rows, or go by file (:func:`search_files`, :func:`nest_by_file`).
    """
    keys = [c for c in ("search_name",) if c in matches.columns and c in projects.columns]
    per_file = matches.groupBy(*keys, "project_id", "file_path").agg(F.count("*").alias("_n"))
    counts = per_file.groupBy(*keys, F.col("project_id").alias("id")).agg(
        F.sum("_n").alias("match_count"), F.count("*").alias("files_with_matches")
    )
    joined = projects.join(counts, [*keys, "id"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("match_count", "files_with_matches")})


def projects_with_matches(projects: DataFrame, matches: DataFrame) -> DataFrame:
    """Projects with at least one match."""
    return projects.join(_hit_ids(matches), "id", "left_semi")


def projects_without_matches(projects: DataFrame, matches: DataFrame) -> DataFrame:
    """Projects without any match."""
    return projects.join(_hit_ids(matches), "id", "left_anti")


def _hit_ids(matches: DataFrame) -> DataFrame:
    return matches.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("_n")).select("id")
