"""Every registered query with its reference answer in SQL, where SQL can give one."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrules.functions import manifests as ML
from corpusrules.functions.extractors import CI_IMAGE, register_extractor
from corpusrules.functions.text import VERSION
from corpusrules.operators import projects as P
from corpusrules.operators import rule_table as RT
from corpusrules.operators import rules as R
from corpusrules.operators import search as S
from corpusrules.operators import search_table as SM
from corpusrules.operators import stats as A
from corpusrules.operators.requirements import dependency_counts, requirement_rows
from corpusrules.plans.oracles import (
    CONVERSATION_FILES,
    DOCUMENT_FILES,
    DOCUMENT_PROJECTS,
    LINES,
    MANIFEST_PROJECTS,
    MANIFESTS,
    hits,
    literal_hits,
    q,
    regex_hits,
    regex_outcomes,
    trimmed,
    with_,
)
from corpusrules.plans.reports import content_search, version_scan
from corpusrules.rulepack import Rule, RulePack, Search, builtin_pack
from corpusrules.session import scratch_path
from corpusrules.sinks import logs as K
from corpusrules.sources import corpus as C
from corpusrules.sources import index as X
from corpusrules.sources.files import fetch_content, file_contents, file_metadata, inventory
from corpusrules.sources.logs import (
    broken_lines,
    read_scan_log,
    read_search_log,
    scan_log_headers,
    scan_log_results,
    scan_log_summaries,
    scan_log_versions,
    search_log_matches,
    search_log_projects,
)
from corpusrules.sources.packs import load_rules, load_searches, read_pack, rules_table, searches_table
from corpusrules.sources.projects import list_active_projects, list_projects
from corpusrules.sources.snippets import search_group_snippets, search_snippets
from corpusrules.sources.urls import namespace_rollup
from corpusrules.streaming import projects as SJ
from corpusrules.streaming import publish as SP
from corpusrules.streaming import scan as ST

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


MATCH = "project_id, file_path, line_number, line_content, matched_text"
IN_DOCUMENTS = with_(DOCUMENT_FILES, LINES)[:-1] + ",\n"

LICENSE_GRANT = Search(r"licen[sc]ed? [^.]*", "license-grant", is_regex=True)
SECRET = Search(
    r"""\b(?:api_key|token|secret)\s*=\s*['"][0-9a-f]{40}['"]""",
    "secret",
    is_regex=True,
    file_patterns=("*.env", "[0-9]*.txt"),
)

# -- content search ----------------------------------------------------------------------------------------------------


@query(
    "search_regex_lines",
    IN_DOCUMENTS + regex_hits("(?i)" + LICENSE_GRANT.term) + f" SELECT {MATCH} FROM hits",
)
def search_regex_lines(spark, sf):
    return S.search_lines(C.document_files(spark, sf), LICENSE_GRANT)


@query("search_literal_ci", IN_DOCUMENTS + literal_hits("LICENSE") + f" SELECT {MATCH} FROM hits")
def search_literal_ci(spark, sf):
    return S.search_lines(C.document_files(spark, sf), Search("LICENSE"))


@query(
    "search_literal_cs",
    IN_DOCUMENTS + hits("contains(line, 'License')", "'License'") + f" SELECT {MATCH} FROM hits",
)
def search_literal_cs(spark, sf):
    return S.search_lines(C.document_files(spark, sf), Search("License", case_sensitive=True))


@query(
    "search_secret_tokens",
    IN_DOCUMENTS + regex_hits("(?i)" + SECRET.term) + f" SELECT {MATCH} FROM hits",
)
def search_secret_tokens(spark, sf):
    return S.search_lines(C.document_files(spark, sf), SECRET)


SIZED_SEARCH = Search("license", "sized", max_file_size=3000)


@query(
    "search_size_limit",
    with_(DOCUMENT_FILES, LINES.replace("FROM files", "FROM files WHERE size <= 3000"))[:-1] + ",\n" + literal_hits("license") + f" SELECT {MATCH} FROM hits",
)
def search_size_limit(spark, sf):
    return S.search_lines(C.document_files(spark, sf), SIZED_SEARCH)


@query(
    "search_top_n_per_project",
    IN_DOCUMENTS
    + literal_hits("license")
    + f""" SELECT {MATCH} FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_path, line_number) AS rn FROM hits) AS r WHERE rn <= 2""",
)
def search_top_n_per_project(spark, sf):
    return S.cap_per_project(S.search_lines(C.document_files(spark, sf), Search("license")), 2)


@query(
    "search_top_n_per_file",
    IN_DOCUMENTS
    + literal_hits("thing")
    + f""" SELECT {MATCH} FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY line_number) AS rn FROM hits) AS r WHERE rn <= 2""",
)
def search_top_n_per_file(spark, sf):
    return S.cap_per_file(S.search_lines(C.document_files(spark, sf), Search("thing")), 2)


@query(
    "search_context",
    with_(DOCUMENT_FILES)[:-1]
    + """, split AS (SELECT project_id, file_path, string_split(content, chr(10)) AS parts FROM files),
lines AS (SELECT project_id, file_path, parts, unnest(parts) AS line,
  CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_number FROM split)
SELECT project_id, file_path, line_number, rtrim(line, chr(13)) AS line_content,
  array_to_string(parts[greatest(line_number - 2, 1):line_number - 1], '|') AS before_text,
  array_to_string(parts[line_number + 1:line_number + 2], '|') AS after_text
FROM lines WHERE contains(lower(line), 'licen')""",
)
def search_context(spark, sf):
    found = S.search_lines(C.document_files(spark, sf), Search("licen", context_lines=2))
    joined = {f"{side}_text": F.array_join(side, "|") for side in ("before", "after")}
    return found.select("project_id", "file_path", "line_number", "line_content", *[c.alias(n) for n, c in joined.items()])


PACK_SEARCHES = [
    LICENSE_GRANT,
    Search("token", "token-word", case_sensitive=True),
    Search(r"[\w.]+@mail\d+\.example\.com", "mail", is_regex=True, file_patterns=("*.txt",)),
    Search("release", "first-releases", max_matches=1),
]
_PACK_HITS = [
    ("license-grant", regex_hits("(?i)" + LICENSE_GRANT.term), ""),
    ("token-word", hits("contains(line, 'token')", "'token'"), ""),
    ("mail", regex_hits(r"(?i)[\w.]+@mail\d+\.example\.com"), ""),
    ("first-releases", literal_hits("release"), "1"),
]


def _pack_sql() -> str:
    ctes, selects = [], []
    for i, (name, cte, cap) in enumerate(_PACK_HITS):
        ctes.append(cte.replace("hits AS", f"hits{i} AS", 1))
        rank = "row_number() OVER (PARTITION BY project_id ORDER BY file_path, line_number)" if cap else "0"
        selects.append(
            f"SELECT {q(name)} AS search_name, {MATCH} FROM (SELECT *, {rank} AS rn FROM hits{i}) AS r WHERE rn <= {cap or 0}"
        )
    return with_(DOCUMENT_FILES, LINES, *ctes) + " UNION ALL ".join(selects)


@query("search_pack_one_pass", _pack_sql())
def search_pack_one_pass(spark, sf):
    return S.search_content(C.document_files(spark, sf), PACK_SEARCHES)


@query(
    "search_conversations",
    with_(CONVERSATION_FILES, LINES)[:-1] + ",\n" + regex_hits(r"(?i)\b(?:the|der) \w+ing\b") + f" SELECT {MATCH} FROM hits",
)
def search_conversations(spark, sf):
    return S.search_lines(C.conversation_files(spark, sf), Search(r"\b(?:the|der) \w+ing\b", is_regex=True))


# -- search over an index, and by very many terms -----------------------------------------------------------------------------


def _index(spark: SparkSession, files: DataFrame) -> str:
    path = scratch_path(spark, "index")
    X.write_index(files, path)
    return path


@query("indexed_search_literal", IN_DOCUMENTS + literal_hits("LICENSE") + f" SELECT {MATCH} FROM hits")
def indexed_search_literal(spark, sf):
    path = _index(spark, C.document_files(spark, sf))
    return X.indexed_search(spark, path, Search("LICENSE")).drop("search_name")


@query("indexed_search_regex", IN_DOCUMENTS + regex_hits("(?i)" + LICENSE_GRANT.term) + f" SELECT {MATCH} FROM hits")
def indexed_search_regex(spark, sf):
    path = _index(spark, C.document_files(spark, sf))
    return X.indexed_search(spark, path, LICENSE_GRANT).drop("search_name")


def _trigram_test(text: str, term: str) -> str:
    return " AND ".join(f"contains({text}, {q(term[k : k + 3])})" for k in range(len(term) - 2))


@query(
    "index_report",
    with_(DOCUMENT_FILES)
    + f"""SELECT 'license-grant' AS search_name, CAST(count(*) AS BIGINT) AS files,
  CAST(count(*) FILTER (WHERE ({_trigram_test("lower(content)", "licensed")}) OR ({_trigram_test("lower(content)", "licenced")})
    OR ({_trigram_test("lower(content)", "license ")}) OR ({_trigram_test("lower(content)", "licence ")})) AS BIGINT) AS files_read FROM files
UNION ALL SELECT 'License', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE {_trigram_test("lower(content)", "license")}) AS BIGINT) FROM files""",
)
def index_report(spark, sf):
    """How many files an indexed search reads: those that have all trigrams that the search asks for."""
    path = _index(spark, C.document_files(spark, sf))
    return X.index_report(spark, path, [LICENSE_GRANT, Search("License", case_sensitive=True)])


def _item_searches(spark: SparkSession, sf: str) -> list[Search]:
    """A search for every word of six letters or more in the benchmark, case-sensitive for every other one."""
    words = C.table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0))).alias("word")).distinct()
    return [Search(r[0], case_sensitive=len(r[0]) % 2 == 0) for r in words.orderBy("word").collect()]


_ITEM_WORDS = "words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{6,}')) AS word FROM benchmark)"
_WORD_HITS = (
    with_(DOCUMENT_FILES, LINES, _ITEM_WORDS)
    + """SELECT project_id, file_path, line_number, rtrim(line, chr(13)) AS line_content, word AS search_name,
  CASE WHEN length(word) % 2 = 0 THEN word ELSE substr(line, strpos(lower(line), word), length(word)) END AS matched_text
FROM lines JOIN words ON CASE WHEN length(word) % 2 = 0 THEN contains(line, word) ELSE contains(lower(line), word) END"""
)


@query("search_many_terms", _WORD_HITS)
def search_many_terms(spark, sf):
    return SM.search_many(C.document_files(spark, sf), _item_searches(spark, sf))


@query(
    "search_large_caps",
    IN_DOCUMENTS
    + literal_hits("e").replace("hits AS", "hits0 AS")
    + ",\n"
    + literal_hits("license").replace("hits AS", "hits1 AS")
    + f"""SELECT 'e' AS search_name, {MATCH} FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_path, line_number) AS rn FROM hits0) AS r WHERE rn <= 5000
UNION ALL SELECT 'license' AS search_name, {MATCH} FROM hits1""",
)
def search_large_caps(spark, sf):
    """A cap too large to rank before the shuffle, beside a search without one."""
    return S.search_content(C.document_files(spark, sf), [Search("e", max_matches=5000), Search("license")])


_SNIPPETS = """parts AS (SELECT project_id, file_path, string_split(content, chr(10)) AS p FROM files),
starts AS (SELECT project_id, file_path, p, unnest(range(0, len(p), 3)) AS s FROM parts),
snippets AS (
  SELECT project_id, file_path, CAST(s + 1 AS BIGINT) AS startline, array_to_string(p[s + 1:s + 3], chr(10)) AS data FROM starts)"""


@query(
    "search_snippets",
    with_(DOCUMENT_FILES, _SNIPPETS)
    + "SELECT project_id, file_path, startline, data FROM snippets WHERE contains(lower(data), 'license')",
)
def snippets(spark, sf):
    found = search_snippets(C.document_files(spark, sf), "License")
    return found.select("project_id", "file_path", "startline", "data")


@query("search_snippet_lines", IN_DOCUMENTS + literal_hits("license") + f" SELECT {MATCH} FROM hits")
def search_snippet_lines(spark, sf):
    found = search_snippets(C.document_files(spark, sf), "License")
    return S.snippet_matches(found, Search("License"))


@query(
    "search_group_snippets",
    with_(DOCUMENT_FILES, DOCUMENT_PROJECTS, _SNIPPETS)
    + """SELECT project_id, file_path, startline, data FROM snippets
WHERE contains(lower(data), 'token')
  AND project_id IN (SELECT id FROM projects WHERE starts_with(path_with_namespace, 'corpus/'))""",
)
def group_snippets(spark, sf):
    found = search_group_snippets(C.document_files(spark, sf), C.document_projects(spark, sf), "corpus", "token")
    return found.select("project_id", "file_path", "startline", "data")


def _conversation_projects(spark: SparkSession, sf: str) -> DataFrame:
    ids = C.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("turns"))
    name = F.concat(F.lit("conversation-"), F.col("id").cast("string"))
    return ids.select("id", name.alias("name"), name.alias("path_with_namespace"))


_CONVERSATIONS = with_(CONVERSATION_FILES, LINES)[:-1] + ",\n" + literal_hits("ing ")


def _conversation_hits(spark: SparkSession, sf: str) -> DataFrame:
    return S.search_lines(C.conversation_files(spark, sf), Search("ing "))


@query(
    "search_project_rollup",
    _CONVERSATIONS
    + """ SELECT p.id, concat('conversation-', p.id) AS name, CAST(count(h.file_path) AS BIGINT) AS match_count,
  CAST(count(DISTINCT h.file_path) AS BIGINT) AS files_with_matches
FROM (SELECT DISTINCT conv_id AS id FROM conversations) AS p LEFT JOIN hits AS h ON h.project_id = p.id GROUP BY p.id""",
)
def search_project_rollup(spark, sf):
    rows = S.project_matches(_conversation_projects(spark, sf), _conversation_hits(spark, sf))
    return rows.select("id", "name", "match_count", "files_with_matches")


@query(
    "search_nested_results",
    _CONVERSATIONS
    + """ SELECT project_id, file_path, CAST(count(*) AS BIGINT) AS match_count,
  string_agg(concat(line_number, ':', matched_text, ':', line_content), '|' ORDER BY line_number) AS matches FROM hits GROUP BY 1, 2""",
)
def search_nested_results(spark, sf):
    rows = S.search_files(C.conversation_files(spark, sf), Search("ing "))
    shown = F.transform("matches", lambda m: F.concat_ws(":", m["line_number"].cast("string"), m["matched_text"], m["line_content"]))
    return rows.select("project_id", "file_path", "match_count", F.array_join(shown, "|").alias("matches"))


@query(
    "search_stats",
    _CONVERSATIONS
    + """, counts AS (SELECT p.id, count(h.file_path) AS n FROM (SELECT DISTINCT conv_id AS id FROM conversations) AS p
  LEFT JOIN hits AS h ON h.project_id = p.id GROUP BY p.id)
SELECT CAST(count(*) AS BIGINT) AS total_projects, CAST(count(*) FILTER (n > 0) AS BIGINT) AS projects_with_hits,
  CAST(count(*) FILTER (n = 0) AS BIGINT) AS projects_no_hits, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_matches,
  CAST(0 AS BIGINT) AS error_count, CAST(0 AS BIGINT) AS skipped_files FROM counts""",
)
def search_stats(spark, sf):
    counts = S.match_counts(_conversation_hits(spark, sf)).withColumnRenamed("project_id", "id")
    return A.search_statistics(_conversation_projects(spark, sf).join(counts, "id", "left"))


@query(
    "search_report_statistics",
    with_(DOCUMENT_FILES, DOCUMENT_PROJECTS, LINES)[:-1]
    + ",\n"
    + literal_hits("license")
    + """, large AS (SELECT project_id, file_path FROM files WHERE size > 3000),
found AS (SELECT 'all' AS search_name, h.* FROM hits AS h UNION ALL
  SELECT 'sized' AS search_name, h.* FROM hits AS h ANTI JOIN large USING (project_id, file_path)),
counts AS (SELECT s.search_name, p.id, count(f.file_path) AS n,
    CASE WHEN s.search_name = 'sized' THEN (SELECT count(*) FROM large WHERE large.project_id = p.id) ELSE 0 END AS skipped
  FROM projects AS p CROSS JOIN (VALUES ('all'), ('sized')) AS s(search_name)
  LEFT JOIN found AS f ON f.project_id = p.id AND f.search_name = s.search_name GROUP BY s.search_name, p.id)
SELECT search_name, CAST(count(*) AS BIGINT) AS total_projects, CAST(count(*) FILTER (n > 0) AS BIGINT) AS projects_with_hits,
  CAST(count(*) FILTER (n = 0) AS BIGINT) AS projects_no_hits, CAST(sum(n) AS BIGINT) AS total_matches,
  CAST(0 AS BIGINT) AS error_count, CAST(sum(skipped) AS BIGINT) AS skipped_files FROM counts GROUP BY 1""",
)
def search_report_statistics(spark, sf):
    searches = [Search("license", "all"), SIZED_SEARCH]
    return content_search(C.document_projects(spark, sf), C.document_files(spark, sf), searches).statistics


@query("matches_by_file", _CONVERSATIONS + " SELECT file_path, CAST(count(*) AS BIGINT) AS matches FROM hits GROUP BY 1")
def matches_by_file(spark, sf):
    return A.matches_by_file(_conversation_hits(spark, sf))


_PROJECT_IDS = "(SELECT DISTINCT conv_id AS id FROM conversations) AS p"


@query("projects_with_matches", _CONVERSATIONS + f" SELECT id FROM {_PROJECT_IDS} WHERE id IN (SELECT project_id FROM hits)")
def projects_with_matches(spark, sf):
    return S.projects_with_matches(_conversation_projects(spark, sf), _conversation_hits(spark, sf)).select("id")


@query(
    "projects_without_matches",
    _CONVERSATIONS + f" SELECT id FROM {_PROJECT_IDS} WHERE id NOT IN (SELECT project_id FROM hits)",
)
def projects_without_matches(spark, sf):
    return S.projects_without_matches(_conversation_projects(spark, sf), _conversation_hits(spark, sf)).select("id")


# -- rule execution ------------------------------------------------------------------------------------------------------

LICENSES = builtin_pack("licenses")
# The same rules, two of them with a size limit: for queries about errors.
SIZED = RulePack(tuple(replace(r, max_file_size={"mit": 20_000, "any-license": 8_000}.get(r.name)) for r in LICENSES))


def _described(pack: RulePack) -> list[dict]:
    return [
        {
            "name": r.name,
            "priority": r.priority,
            "pattern": r.parser_config["pattern"],
            "group": 0 if r.name == "any-license" else 1,
            "confidence": r.parser_config["confidence"],
            "size": r.max_file_size,
            "required": r.required_content,
        }
        for r in pack
    ]


LICENSE_RULES = with_(DOCUMENT_FILES, regex_outcomes(_described(LICENSES)))
SIZED_RULES = with_(DOCUMENT_FILES, regex_outcomes(_described(SIZED)))
KEYS = "project_id, file_path"
RESULT = "rule_name, priority, version, confidence, raw_value"
_RESULT_COLUMNS = RESULT.split(", ")


def _results(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select("project_id", "file_path", *_RESULT_COLUMNS, *extra)


def _license_results(spark: SparkSession, sf: str, **options) -> DataFrame:
    executed = R.execute_rules(C.document_files(spark, sf), LICENSES, **options)
    return _results(R.rule_results(executed), "position")


def _ranked(where: str = "TRUE") -> str:
    return (
        LICENSE_RULES
        + f"""SELECT {KEYS}, {RESULT}, CAST(place AS BIGINT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY priority, rule_name) AS place
  FROM found WHERE {where}) AS r"""
    )


@query("rules_all_matches", _ranked())
def rules_all_matches(spark, sf):
    return _license_results(spark, sf)


@query("rules_max_results", _ranked() + " WHERE place <= 1")
def rules_max_results(spark, sf):
    return _license_results(spark, sf, max_results=1)


@query("rules_min_confidence", _ranked("confidence >= 0.8"))
def rules_min_confidence(spark, sf):
    return _license_results(spark, sf, min_confidence=0.8)


@query("rules_tags", _ranked("rule_name IN ('mit', 'apache', 'any-license')"))
def rules_tags(spark, sf):
    return _license_results(spark, sf, tags=["permissive", "inferred"])


@query(
    "rules_applied",
    SIZED_RULES
    + f"""SELECT o.project_id, o.file_path, CAST(coalesce(f.position, 5) AS BIGINT) AS rules_applied,
  CAST(count(o.error) FILTER (o.position <= coalesce(f.position, 5)) AS BIGINT) AS errors
FROM outcomes AS o LEFT JOIN found AS f ON f.rank = 1 AND f.project_id = o.project_id AND f.file_path = o.file_path
GROUP BY o.project_id, o.file_path, f.position""",
)
def rules_applied(spark, sf):
    executed = R.execute_rules(C.document_files(spark, sf), SIZED, stop_on_first_match=True)
    return executed.select(
        "project_id",
        "file_path",
        F.col("rules_applied").cast("bigint").alias("rules_applied"),
        F.size("errors").cast("bigint").alias("errors"),
    )


@query("rules_errors", SIZED_RULES + f"SELECT {KEYS}, rule_name, error FROM outcomes WHERE error IS NOT NULL")
def rules_errors(spark, sf):
    outcomes = R.rule_outcomes(C.document_files(spark, sf), SIZED)
    return outcomes.where(F.col("error").isNotNull()).select("project_id", "file_path", "rule_name", "error")


# Every file that was tried, its chosen hit if there is one, and its first error: before the hit, or of all rules.
_MATCHED = (
    SIZED_RULES
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY {order}priority, rule_name) AS r FROM found),
chosen AS (SELECT * FROM ranked WHERE r = 1),
failed AS (SELECT o.project_id, o.file_path, arg_min(o.error, o.position) AS error FROM outcomes AS o
  LEFT JOIN chosen AS c ON c.project_id = o.project_id AND c.file_path = o.file_path
  WHERE o.error IS NOT NULL{before} GROUP BY 1, 2),
matched AS (SELECT t.project_id, t.file_path, c.rule_name, c.priority, c.version, c.confidence, c.raw_value, f.error
  FROM (SELECT DISTINCT project_id, file_path FROM outcomes) AS t
  LEFT JOIN chosen AS c ON c.project_id = t.project_id AND c.file_path = t.file_path
  LEFT JOIN failed AS f ON f.project_id = t.project_id AND f.file_path = t.file_path
  WHERE c.rule_name IS NOT NULL OR f.error IS NOT NULL) """
)
_FIRST = _MATCHED.replace("{order}", "").replace("{before}", " AND (c.position IS NULL OR o.position < c.position)")
_BEST = _MATCHED.replace("{order}", "confidence DESC, ").replace("{before}", "")


@query("rules_first_match", _FIRST + f"SELECT {KEYS}, {RESULT}, error FROM matched")
def rules_first_match(spark, sf):
    return _results(R.first_match(C.document_files(spark, sf), SIZED), "error")


@query("rules_best_match", _BEST + f"SELECT {KEYS}, {RESULT}, error FROM matched")
def rules_best_match(spark, sf):
    return _results(R.best_match(C.document_files(spark, sf), SIZED), "error")


@query(
    "rules_strict_match",
    _BEST
    + "SELECT project_id, file_path, CASE WHEN error IS NULL THEN rule_name END AS rule_name, "
    "CASE WHEN error IS NULL THEN version END AS version, error IS NULL AS found, error FROM matched",
)
def rules_strict_match(spark, sf):
    rows = R.best_match(C.document_files(spark, sf), SIZED, strict=True)
    return rows.select("project_id", "file_path", "rule_name", "version", "found", "error")


_PACK_DOCUMENT = {
    "settings": {"default_priority": 40},
    "rules": [
        {"name": "mit-name", "match": {"file_pattern": "*.txt"}, "parser": {"type": "regex", "config": {"pattern": "under the (MIT) License"}}},
        {"name": "any-grant", "enabled": False, "priority": 1, "match": {"file_pattern": "*"}, "parser": {"type": "regex", "config": {"pattern": "(?i)licen"}}},
        {"name": "gnu", "priority": 50, "match": {"file_pattern": "*.txt", "required_content": "GNU"}, "parser": {"type": "regex", "config": {"pattern": "version (?P<version>\\d)", "confidence": "0.9"}}},
    ],
    "searches": [
        {"name": "mit", "search_term": "MIT", "case_sensitive": True},
        {"name": "everything", "search_term": "e", "enabled": False},
        {"name": "grant", "search_term": "licen[sc]e", "is_regex": True, "max_matches": 2},
    ],
}


def _written_pack(spark: SparkSession) -> DataFrame:
    """A pack document as a user has it: JSON in a file, read by Spark."""
    path = scratch_path(spark, "pack")
    spark.createDataFrame([(json.dumps(_PACK_DOCUMENT),)], "value string").coalesce(1).write.text(path)
    return read_pack(spark, path)


@query(
    "pack_document_rules",
    with_(
        DOCUMENT_FILES,
        regex_outcomes(
            [
                {"name": "mit-name", "priority": 40, "pattern": "under the (MIT) License", "group": 1, "confidence": 0.5},
                {"name": "gnu", "priority": 50, "pattern": r"version (\d)", "group": 1, "confidence": 0.9, "required": "GNU"},
            ]
        ),
    )
    + f"SELECT {KEYS}, {RESULT} FROM found",
)
def pack_document_rules(spark, sf):
    pack = load_rules(rules_table(_written_pack(spark)))
    return _results(R.rule_results(R.execute_rules(C.document_files(spark, sf), pack)))


@query(
    "pack_document_searches",
    with_(DOCUMENT_FILES, LINES, hits("contains(line, 'MIT')", "'MIT'").replace("hits AS", "hits0 AS"), regex_hits("(?i)licen[sc]e").replace("hits AS", "hits1 AS"))
    + f"""SELECT 'mit' AS search_name, {MATCH} FROM hits0 UNION ALL SELECT 'grant' AS search_name, {MATCH} FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_path, line_number) AS rn FROM hits1) AS r WHERE rn <= 2""",
)
def pack_document_searches(spark, sf):
    searches = load_searches(searches_table(_written_pack(spark)))
    return S.search_content(C.document_files(spark, sf), searches)


_PATH_RULES = RulePack(
    (
        Rule("english", "1*.txt", "simple_version", path_pattern="^en/", priority=5),
        Rule("numbered", "?7?.txt", "simple_version", priority=7),
        Rule("first", "0.txt", "simple_version", priority=3),
        Rule("text", "*.txt", "simple_version", priority=9),
        Rule("romance", None, "simple_version", path_pattern="^(fr|es)/[0-9]*5", priority=5),
    )
)
_PATH_RULES_SQL = (
    with_(DOCUMENT_FILES)
    + """SELECT f.project_id, f.file_path, r.rule_name, r.priority FROM files AS f JOIN (VALUES
  ('english', 5, '^1.*[.]txt$', '^en/'), ('numbered', 7, '^.7.[.]txt$', ''), ('first', 3, '^0[.]txt$', ''),
  ('text', 9, '[.]txt$', ''), ('romance', 5, '', '^(fr|es)/[0-9]*5')) AS r(rule_name, priority, name_regex, path_regex)
ON regexp_matches(f.file_name, r.name_regex) AND regexp_matches(f.file_path, r.path_regex)"""
)


@query("rules_theta_join", _PATH_RULES_SQL)
def rules_theta_join(spark, sf):
    rows = R.join_rules(C.document_files(spark, sf), _PATH_RULES)
    return rows.select("project_id", "file_path", "rule_name", "priority")


@query(
    "rules_matching",
    f"""SELECT *, CAST(row_number() OVER (PARTITION BY project_id, file_path ORDER BY priority, rule_name) AS BIGINT) AS position
FROM ({_PATH_RULES_SQL}) AS m""",
)
def rules_matching(spark, sf):
    rows = R.matching_rules(C.document_files(spark, sf), _PATH_RULES)
    return rows.select("project_id", "file_path", "rule_name", "priority", "position")


# The two micro-benchmarks on record: ten rules that all match a tiny file, and a hundred that do not.
_TEN_RULES = RulePack(
    tuple(
        Rule(f"rule-{i}", "*.py", "simple_version", {"confidence": 0.5 + i / 100}, priority=i) for i in range(10)
    )
)
_NO_RULES = RulePack(tuple(Rule(f"rule-{i}", f"file{i}.txt", "simple_version", priority=i) for i in range(100)))


@query(
    "rules_ten_per_file",
    """SELECT user_id AS project_id, concat('event-', event_id, '.py') AS file_path, CAST(10 AS BIGINT) AS rules_applied,
  CAST(10 AS BIGINT) AS results, 'rule-9' AS best_rule, props AS version FROM events""",
)
def rules_ten_per_file(spark, sf):
    executed = R.execute_rules(C.event_files(spark, sf), _TEN_RULES)
    return executed.select(
        "project_id",
        "file_path",
        F.col("rules_applied").cast("bigint").alias("rules_applied"),
        F.col("result_count").cast("bigint").alias("results"),
        F.col("best_result.rule_name").alias("best_rule"),
        F.col("best_result.version").alias("version"),
    )


@query(
    "rules_none_matching",
    """SELECT user_id AS project_id, concat('event-', event_id, '.py') AS file_path, CAST(0 AS BIGINT) AS rules_matching FROM events""",
)
def rules_none_matching(spark, sf):
    executed = R.execute_rules(C.event_files(spark, sf), _NO_RULES, all_files=True)
    return executed.select("project_id", "file_path", F.col("rules_applied").cast("bigint").alias("rules_matching"))


# A pack as large as the corpus: five rules for every document, made of its number and of its first word.
_RULES_FROM_DOCUMENTS = """
SELECT concat('r', doc_id, '-', k) AS rule_name, CAST(doc_id % 50 AS INT) AS priority, CAST(k AS INT) AS k, word,
  CASE k WHEN 1 THEN concat(substr(number, 1, length(number) - 1), '?.txt') WHEN 2 THEN concat('?', substr(number, 2), '.txt') ELSE concat(number, '.txt') END AS file_pattern,
  CASE WHEN k = 3 THEN concat('^', lang, '/') END AS path_pattern,
  CASE WHEN k = 4 THEN '[0-9]' END AS required_content,
  concat(word, '[ ]+([A-Za-z]+)') AS pattern
FROM (SELECT doc_id, lang, CAST(doc_id AS STRING) AS number, regexp_extract(text, '[A-Za-z]+', 0) AS word FROM documents) AS d
CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS n(k)
WHERE word <> ''
"""
_FIRST_LINE = "list_filter(string_split(content, chr(10)), lambda line: contains(line, word))[1]"
_TABLE_OUTCOMES = (
    with_(DOCUMENT_FILES)[:-1]
    + f""",
rules AS ({_RULES_FROM_DOCUMENTS}),
pairs AS (
  SELECT f.project_id, f.file_path, f.content, r.* FROM files AS f JOIN rules AS r
  ON f.file_name LIKE replace(r.file_pattern, '?', '_') AND (r.path_pattern IS NULL OR regexp_matches(f.file_path, r.path_pattern))),
outcomes AS (
  SELECT project_id, file_path, rule_name, priority, CASE WHEN k = 3 THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence,
    CASE WHEN k = 3 THEN nullif(rtrim({_FIRST_LINE}, chr(13)), '') WHEN k = 4 AND NOT regexp_matches(content, required_content) THEN NULL
         ELSE nullif(regexp_extract(content, pattern, 1), '') END AS raw_value,
    CASE WHEN k = 3 THEN word END AS matched
  FROM pairs)
"""
)


def _rules_from_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same pack as a rules table."""
    made = spark.sql(_RULES_FROM_DOCUMENTS.replace("FROM documents", "FROM {documents}"), documents=C.table(spark, sf, "documents"))
    search = F.col("k") == 3
    config = F.when(search, F.create_map(F.lit("search_term"), "word", F.lit("case_sensitive"), F.lit("true"))).otherwise(F.create_map(F.lit("pattern"), "pattern"))
    return made.select(
        F.col("rule_name").alias("name"),
        F.lit("").alias("description"),
        "priority",
        F.lit(True).alias("enabled"),
        F.array().cast("array<string>").alias("tags"),
        F.struct("file_pattern", "path_pattern", "required_content", F.lit(None).cast("long").alias("max_file_size")).alias("match"),
        F.struct(F.when(search, "string_search").otherwise("regex").alias("type"), config.alias("config")).alias("parser"),
    )


@query(
    "rules_table_outcomes",
    _TABLE_OUTCOMES + "SELECT project_id, file_path, rule_name, priority, raw_value IS NOT NULL AS found, coalesce(matched, raw_value) AS version, raw_value FROM outcomes WHERE raw_value IS NOT NULL OR matched IS NULL",
)
def rules_table_outcomes(spark, sf):
    rows = RT.table_outcomes(C.document_files(spark, sf), RT.prepare_rules(_rules_from_documents(spark, sf)))
    return rows.select("project_id", "file_path", "rule_name", "priority", "found", "version", "raw_value")


def _table_choice(order: str) -> str:
    return (
        _TABLE_OUTCOMES
        + f"""SELECT project_id, file_path, rule_name, coalesce(matched, raw_value) AS version, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY {order}priority, rule_name) AS place FROM outcomes WHERE raw_value IS NOT NULL) AS o
WHERE place = 1"""
    )


@query("rules_table_first_match", _table_choice(""))
def rules_table_first_match(spark, sf):
    rows = RT.table_first_match(C.document_files(spark, sf), RT.prepare_rules(_rules_from_documents(spark, sf)))
    return rows.select("project_id", "file_path", "rule_name", "version", "confidence")


@query("rules_table_best_match", _table_choice("confidence DESC, "))
def rules_table_best_match(spark, sf):
    rows = RT.table_best_match(C.document_files(spark, sf), RT.prepare_rules(_rules_from_documents(spark, sf)))
    return rows.select("project_id", "file_path", "rule_name", "version", "confidence")


@query(
    "page_lang_regex",
    """SELECT page_id AS project_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS version, CAST(0.5 AS DOUBLE) AS confidence
FROM pages WHERE regexp_matches(html, '<html lang="[a-z]+"')""",
)
def page_lang_regex(spark, sf):
    pack = RulePack((Rule("html-lang", "*.html", parser_config={"pattern": r'<html lang="(?P<lang>[a-z]+)"', "version_group": "lang"}),))
    return R.first_match(C.page_files(spark, sf), pack).select("project_id", "version", "confidence")


def _ci_image_extractor(config) -> Callable[[Column, Column], Column]:
    """U1 by example: a user extractor that leaves the source to be filled in."""

    def build(content: Column, name: Column) -> Column:
        image = CI_IMAGE.group(content, 0)
        version = F.regexp_extract(image, rf"{VERSION}$", 0)
        return F.when(
            version != "",
            F.struct(
                version.alias("version"),
                F.lit("").alias("source"),
                F.lit(float(config.get("confidence", 0.4))).alias("confidence"),
                image.alias("raw_value"),
                F.create_map(F.lit("by"), F.lit("custom")).alias("metadata"),
            ),
        )

    return build


register_extractor("example_ci_image", _ci_image_extractor)


@query(
    "custom_extractor",
    with_(MANIFESTS)
    + rf"""SELECT project_id, file_path, regexp_extract(content, 'image:\s*python:({VERSION})', 1) AS version,
  file_name AS source, CAST(0.4 AS DOUBLE) AS confidence
FROM files WHERE file_name = '.gitlab-ci.yml' AND regexp_matches(content, 'image:\s*python:({VERSION})')""",
)
def custom_extractor(spark, sf):
    pack = RulePack((Rule("custom", ".gitlab-ci.yml", "example_ci_image"),))
    rows = R.first_match(C.manifest_files(spark, sf), pack)
    return rows.select("project_id", "file_path", "version", "source", "confidence")


def _ci_image_pandas(config) -> Callable[[Column, Column], Column]:
    """U1 as a ``pandas_udf``: Arrow batches in, result structs out; rows of other files are nulls."""

    @F.pandas_udf("version string, source string, confidence double, raw_value string, metadata map<string,string>")
    def build(content: pd.Series) -> pd.DataFrame:
        raw = content.str.extract(rf"(image:\s*python:{VERSION})", expand=False)
        version = raw.str.extract(rf"({VERSION})$", expand=False)
        return pd.DataFrame({"version": version, "source": "", "confidence": 0.4, "raw_value": raw, "metadata": [{} for _ in raw]})

    def made(content: Column, name: Column) -> Column:
        found = build(content)
        return F.when(found["version"].isNotNull(), found)

    return made


register_extractor("example_ci_image_pandas", _ci_image_pandas)


@query("custom_pandas_extractor", ORACLES["custom_extractor"])
def custom_pandas_extractor(spark, sf):
    pack = RulePack((Rule("custom", ".gitlab-ci.yml", "example_ci_image_pandas"),))
    rows = R.first_match(C.manifest_files(spark, sf), pack).where("found")
    return rows.select("project_id", "file_path", "version", "source", "confidence")


# -- manifests -----------------------------------------------------------------------------------------------------------

_MANIFEST = "project_id, file_path, version, confidence, raw_value"


def _manifest(name: str, rule_name: str, raw: str, version: str, confidence: str, extra: dict[str, str] | None = None):
    """Register one extraction job over the manifests it is for; ``extra`` compares metadata entries."""
    extra = extra or {}
    rule = next(r for r in builtin_pack("default+comments") if r.name == rule_name)
    glob = rule.file_pattern.replace(".", "[.]").replace("*", ".*")
    size = f"strlen(content) <= {rule.max_file_size}"
    required = f" AND regexp_matches(content, {q(rule.required_content)})" if rule.required_content else ""
    columns = "".join(f", {sql} AS {key}" for key, sql in extra.items())
    sql = (
        with_(MANIFESTS, f"m AS (SELECT * FROM files WHERE regexp_matches(file_name, '^{glob}$') AND {size}{required})")
        + f""", r AS (SELECT *, {raw} AS raw_value FROM m), v AS (SELECT *, {version} AS version FROM r)
SELECT project_id, file_path, version, CAST({confidence} AS DOUBLE) AS confidence, raw_value{columns} FROM v WHERE version <> ''"""
    )

    @query(name, sql)
    def run(spark, sf):
        rows = R.first_match(C.manifest_files(spark, sf), RulePack((rule,)))
        metadata = [F.col("metadata")[key].alias(key) for key in extra]
        return rows.where(F.col("version") != "").select(*_MANIFEST.split(", "), *metadata)

    return run


def _section(header: str) -> str:
    return "regexp_extract(content, " + q(rf"(?ms)^[ \t]*\[{header}\][^\n]*\n(.*?)(?:^[ \t]*\[|\z)") + ", 1)"


def _value(section: str, key: str) -> str:
    return f"regexp_extract({section}, " + q(rf"""(?m)^[ \t]*{key}[ \t]*=[ \t]*["']([^"'\n]*)["']""") + ", 1)"


_LEADING = f"regexp_extract({trimmed('raw_value')}, {q(f'^({VERSION})')}, 1)"
_ANYWHERE = f"regexp_extract(raw_value, {q(f'({VERSION})')}, 1)"

_manifest(
    "manifest_python_version",
    "python-version-file",
    f"regexp_replace(regexp_replace(regexp_replace({trimmed('content')}, '^python-', ''), '^Python-', ''), '^py', '')",
    _LEADING,
    "1.0",
    {"source_type": "'explicit_version_file'"},
)
_manifest(
    "manifest_runtime_txt",
    "runtime-txt",
    "content",
    f"regexp_extract({trimmed('content')}, {q(f'^(?:python-)?(?:Python-)?({VERSION})')}, 1)",
    "0.95",
)
_manifest(
    "manifest_setup_py",
    "setup-py",
    "regexp_extract(content, " + q(r"""python_requires\s*=\s*['"]([^'"]+)['"]""") + ", 1)",
    _ANYWHERE,
    "0.9",
    {"constraint": "raw_value"},
)
_manifest(
    "manifest_pipfile",
    "pipfile",
    f"coalesce(nullif({_value(_section('requires'), 'python_full_version')}, ''), {_value(_section('requires'), 'python_version')})",
    _LEADING,
    "0.9",
)

_PROJECT = _section("project")
_POETRY = _section(r"tool\.poetry\.dependencies")
_POETRY_PYTHON = q(
    r"""(?m)^[ \t]*python[ \t]*=[ \t]*(?:["']([^"'\n]*)["']|\{[^}\n]*?version[ \t]*=[ \t]*["']([^"'\n]*)["'])"""
)
_HAS_PEP621 = f"regexp_matches({_value(_PROJECT, 'requires-python')}, {q(VERSION)})"
_LIST = q(r"(?ms)^[ \t]*dependencies[ \t]*=[ \t]*\[(.*?)\][ \t]*(?:#[^\n]*)?$")
_ITEMS = (
    f"len(regexp_extract_all(regexp_replace(regexp_extract({_PROJECT}, {_LIST}, 1), "
    + q(r"(?m)^[ \t]*#[^\n]*")
    + ", '', 'g'), "
    + q(r"""("[^"]*"|'[^']*')""")
    + "))"
)
_KEYS = f"len(regexp_extract_all({_POETRY}, " + q(r"(?m)^[ \t]*([A-Za-z0-9_.-]+)[ \t]*=") + "))"
_manifest(
    "manifest_pyproject",
    "pyproject-toml",
    f"CASE WHEN {_HAS_PEP621} THEN {_value(_PROJECT, 'requires-python')} ELSE "
    f"concat(regexp_extract({_POETRY}, {_POETRY_PYTHON}, 1), regexp_extract({_POETRY}, {_POETRY_PYTHON}, 2)) END",
    _ANYWHERE,
    "0.9",
    {
        "format": f"CASE WHEN {_HAS_PEP621} THEN 'PEP621' ELSE 'Poetry' END",
        "dependency_count": f"CAST(nullif(CASE WHEN {_HAS_PEP621} THEN {_ITEMS} ELSE {_KEYS} - 1 END, 0) AS VARCHAR)",
    },
)
_FROM = rf"FROM[\t\f\r ]+python:({VERSION})"
_manifest(
    "manifest_dockerfile",
    "dockerfile",
    f"list_filter(list_transform(string_split(content, chr(10)), lambda x: {trimmed('x')}), lambda x: regexp_matches(x, {q('^' + _FROM)}))[1]",
    f"regexp_extract(raw_value, {q('^' + _FROM)}, 1)",
    "0.8",
    {"from_image": "raw_value"},
)
_manifest(
    "manifest_gitlab_ci",
    "gitlab-ci",
    f"regexp_extract(content, {q(rf'image:\s*python:({VERSION})')}, 0)",
    f"regexp_extract(raw_value, {q(f'({VERSION})')}, 1)",
    "0.75",
    {"image": "raw_value"},
)
_manifest(
    "manifest_tox_ini",
    "tox-ini",
    f"coalesce(nullif({_value(_section('tox'), 'envlist')}, ''), regexp_extract(content, {q(r'envlist\s*=\s*([^\n]+)')}, 1))",
    f"CASE WHEN regexp_matches(raw_value, {q(r'py\d\d+')}) THEN concat(regexp_extract(raw_value, {q(r'py(\d)(\d+)')}, 1), '.', regexp_extract(raw_value, {q(r'py(\d)(\d+)')}, 2)) ELSE '' END",
    "0.7",
    {"envlist": "raw_value"},
)
_COMMENTS = [
    rf"#\s*[Pp]ython\s+({VERSION})",
    rf"#\s*[Rr]equires\s+[Pp]ython\s*[><=]+\s*({VERSION})",
    rf"#\s*[Pp]y\s*[><=]+\s*({VERSION})",
]
_COMMENT_RAW = (
    "coalesce(list_filter(string_split(content, chr(10)), lambda x: "
    + " OR ".join(f"regexp_matches(x, {q(p)})" for p in _COMMENTS)
    + ")[1], '')"
)
_COMMENT_VERSION = (
    "coalesce(" + ", ".join(f"nullif(regexp_extract(raw_value, {q(p)}, 1), '')" for p in _COMMENTS) + ", '')"
)
_manifest("manifest_requirements_comment", "requirements-txt", _COMMENT_RAW, _COMMENT_VERSION, "0.6")

# Requirement lines, stage by stage: editable, comment, options, hashes, markers, extras, name.
_REQUIREMENT_FILES = MANIFESTS + ",\nreq AS (SELECT * FROM files WHERE regexp_matches(file_name, '^requirements.*[.]txt$'))"
_REQUIREMENTS = (
    with_(_REQUIREMENT_FILES)
    + rf""", l0 AS (
  SELECT project_id, file_path, unnest(string_split(content, chr(10))) AS raw,
    CAST(generate_subscripts(string_split(content, chr(10)), 1) AS BIGINT) AS line_no FROM req),
l1 AS (SELECT *, {trimmed('raw')} AS line FROM l0),
l2 AS (SELECT *, regexp_matches(line, '^(-e|--editable) ') AS is_editable FROM l1 WHERE line <> '' AND line NOT LIKE '#%'),
l3 AS (SELECT *, trim(CASE WHEN is_editable THEN line ELSE string_split(line, '#')[1] END) AS body,
  CASE WHEN NOT is_editable AND contains(line, '#') THEN trim(substr(line, strpos(line, '#') + 1)) ELSE '' END AS comment FROM l2),
l4 AS (SELECT *, NOT is_editable AND regexp_matches(body, '^(-r|--requirement) ') AS is_requirement_file,
  NOT is_editable AND starts_with(body, '-') AS is_option FROM l3),
l5 AS (SELECT *, CASE WHEN is_editable THEN body ELSE trim(string_split(body, '--hash')[1]) END AS spec,
  CASE WHEN is_editable THEN '' ELSE array_to_string(regexp_extract_all(body, '--hash=([^ ]+)', 1), '|') END AS hashes FROM l4),
l6 AS (SELECT *, CASE WHEN is_editable THEN spec ELSE trim(string_split(spec, ';')[1]) END AS package,
  CASE WHEN NOT is_editable AND contains(spec, ';') THEN trim(substr(spec, strpos(spec, ';') + 1)) ELSE '' END AS markers FROM l5),
l7 AS (SELECT *, CASE WHEN is_editable THEN package ELSE regexp_replace(package, '\[[^\]]*\]', '') END AS named,
  CASE WHEN is_editable THEN '' ELSE regexp_replace(regexp_extract(package, '\[([^\]]*)\]', 1), '\s*,\s*', '|', 'g') END AS extras FROM l6),
requirements AS (SELECT project_id, file_path, line_no,
  CASE WHEN is_editable THEN trim(regexp_replace(line, '^(-e|--editable) ', '')) ELSE regexp_extract(named, '^([a-zA-Z0-9_-]+)(.*)$', 1) END AS name,
  CASE WHEN is_editable THEN '' ELSE trim(regexp_extract(named, '^([a-zA-Z0-9_-]+)(.*)$', 2)) END AS specifier,
  extras, markers, hashes, is_editable, comment
  FROM l7 WHERE NOT is_requirement_file AND NOT is_option)
"""
)


def _requirement_files(spark: SparkSession, sf: str) -> DataFrame:
    files = C.manifest_files(spark, sf)
    return files.where(F.col("file_name").startswith("requirements") & F.col("file_name").endswith(".txt"))


@query("requirement_rows", _REQUIREMENTS + "SELECT * FROM requirements WHERE name <> ''")
def requirements(spark, sf):
    rows = requirement_rows(_requirement_files(spark, sf)).drop("is_requirement_file")
    return rows.withColumns({c: F.array_join(c, "|") for c in ("extras", "hashes")})


@query(
    "dependency_counts",
    _REQUIREMENTS
    + "SELECT project_id, file_path, CAST(count(*) AS BIGINT) AS dependency_count FROM requirements WHERE name <> '' GROUP BY 1, 2",
)
def dependencies(spark, sf):
    return dependency_counts(_requirement_files(spark, sf))


@query(
    "manifest_requirements",
    _REQUIREMENTS
    + f""", packages AS (SELECT project_id, file_path, CAST(count(*) AS VARCHAR) AS dependency_count,
    list(concat(name, specifier) ORDER BY line_no) AS examples FROM requirements WHERE name <> '' GROUP BY 1, 2),
  commented AS (SELECT project_id, file_path, {_COMMENT_RAW} AS raw_value FROM req),
  versions AS (SELECT *, {_COMMENT_VERSION} AS version FROM commented)
SELECT project_id, file_path, version, CAST(CASE WHEN version <> '' THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence, raw_value,
  dependency_count, examples[1] AS dependency_1, examples[5] AS dependency_5,
  CASE WHEN version <> '' THEN 'requirements_txt' ELSE 'dependencies_only' END AS source_type
FROM versions JOIN packages USING (project_id, file_path)""",
)
def manifest_requirements(spark, sf):
    rule = next(r for r in builtin_pack() if r.name == "requirements-txt-dependencies")
    rows = R.first_match(C.manifest_files(spark, sf), RulePack((rule,)))
    keys = ("dependency_count", "dependency_1", "dependency_5", "source_type")
    return rows.select(*_MANIFEST.split(", "), *[F.col("metadata")[k].alias(k) for k in keys])


_TOML_ENTRIES = r"""lines AS (
  SELECT project_id, file_path, CAST(i AS INTEGER) AS line, string_split(content, chr(10))[i] AS text
  FROM (SELECT *, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files WHERE file_name IN ('pyproject.toml', 'Pipfile')) AS f),
placed AS (
  SELECT *, last_value(nullif(regexp_extract(text, '^\[([^\]]+)\]', 1), '') IGNORE NULLS) OVER (PARTITION BY project_id, file_path ORDER BY line) AS section,
    regexp_extract(text, '^([A-Za-z0-9_-]+) = (.*)$', 1) AS key, regexp_extract(text, '^([A-Za-z0-9_-]+) = (.*)$', 2) AS value
  FROM lines)
"""


@query(
    "manifest_lines",
    with_(MANIFESTS)[:-1]
    + ",\n"
    + _TOML_ENTRIES
    + r"""SELECT project_id, file_path, line, section || '.' || key AS path, starts_with(value, '"') AS quoted,
  CASE WHEN starts_with(value, '"') THEN replace(value, '"', '') ELSE value END AS value
FROM placed WHERE key <> '' AND value <> '['""",
)
def manifest_lines(spark, sf):
    """H4 as a relation; lists over several lines are left to ``manifest_pyproject``."""
    files = C.manifest_files(spark, sf).where(F.col("file_name").isin("pyproject.toml", "Pipfile"))
    rows = ML.manifest_lines(files).where(~F.col("value").contains("\n"))
    return rows.select("project_id", "file_path", "line", "path", "value", "quoted")


@query(
    "whole_file_version",
    with_(MANIFESTS)
    + f"""SELECT project_id, file_path, {trimmed('content')} AS version, CAST(1.0 AS DOUBLE) AS confidence
FROM files WHERE file_name = '.python-version'""",
)
def whole_file_version(spark, sf):
    pack = RulePack((Rule("whole-file", ".python-version", "simple_version"),))
    rows = R.first_match(C.manifest_files(spark, sf), pack)
    return rows.select("project_id", "file_path", "version", "confidence")


@query(
    "search_as_rule",
    IN_DOCUMENTS
    + regex_hits(r"(?i)\btoken = \S+")
    + """ SELECT project_id, file_path, min_by(matched_text, line_number) AS version, min_by(line_content, line_number) AS raw_value,
  CAST(0 AS DOUBLE) AS confidence, CAST(count(*) AS VARCHAR) AS match_count, CAST(min(line_number) AS VARCHAR) AS line_number
FROM hits GROUP BY project_id, file_path""",
)
def search_as_rule(spark, sf):
    config = {"search_term": r"\btoken = \S+", "is_regex": True}
    pack = RulePack((Rule("tokens", "*.txt", "string_search", config),))
    rows = R.first_match(C.document_files(spark, sf), pack)
    metadata = [F.col("metadata")[k].alias(k) for k in ("match_count", "line_number")]
    return rows.select("project_id", "file_path", "version", "raw_value", "confidence", *metadata)


# -- projects and statistics ------------------------------------------------------------------------------------------------


def _detections() -> str:
    """All accepted manifest detections, from the per-kind answers above."""
    kinds = {
        "manifest_python_version": "python-version-file",
        "manifest_runtime_txt": "runtime-txt",
        "manifest_setup_py": "setup-py",
        "manifest_pipfile": "pipfile",
        "manifest_pyproject": "pyproject-toml",
        "manifest_dockerfile": "dockerfile",
        "manifest_gitlab_ci": "gitlab-ci",
        "manifest_tox_ini": "tox-ini",
        "manifest_requirements": "requirements-txt-dependencies",
    }
    priorities = {r.name: r.priority for r in builtin_pack()}
    selects = [
        f"SELECT {q(rule)} AS rule_name, {priorities[rule]} AS priority, project_id, file_path, version, confidence FROM ({ORACLES[key]}) AS x"
        for key, rule in kinds.items()
    ]
    return "detections AS (" + "\nUNION ALL\n".join(selects) + ")"


_WINNERS = """winners AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY project_id ORDER BY priority, rule_name, file_path) AS rn FROM detections WHERE version <> ''{}) AS d WHERE rn = 1)"""


def _versions_sql(where: str = "") -> str:
    return with_(_detections(), _WINNERS.format(where), MANIFEST_PROJECTS)


_SCAN_COLUMNS = """SELECT p.id, p.path_with_namespace, w.version AS python_version,
  regexp_extract(w.file_path, '[^/]+$') AS detection_source, w.rule_name, w.confidence
FROM projects AS p LEFT JOIN winners AS w ON w.project_id = p.id"""
_AT_ROOT = " AND NOT contains(file_path, '/')"


def _scan(spark: SparkSession, sf: str, **options) -> DataFrame:
    return P.project_versions(C.manifest_projects(spark, sf), C.manifest_files(spark, sf), builtin_pack(), **options)


_SCAN_OUT = ("id", "path_with_namespace", "python_version", "detection_source", "rule_name", "confidence")


@query("project_versions", _versions_sql() + _SCAN_COLUMNS)
def project_versions(spark, sf):
    return _scan(spark, sf, depth="any").select(*_SCAN_OUT)


@query("project_versions_root", _versions_sql(_AT_ROOT) + _SCAN_COLUMNS)
def project_versions_root(spark, sf):
    return _scan(spark, sf).select(*_SCAN_OUT)


@query(
    "project_versions_literal",
    _versions_sql(_AT_ROOT + " AND file_path <> 'Dockerfile' AND file_path <> 'Dockerfile.dev' AND NOT starts_with(file_path, 'requirements')")
    + _SCAN_COLUMNS,
)
def project_versions_literal(spark, sf):
    return _scan(spark, sf, pattern_mode="literal").select(*_SCAN_OUT)


@query(
    "scan_version_distribution",
    _versions_sql() + "SELECT version AS python_version, CAST(count(*) AS BIGINT) AS projects FROM winners GROUP BY 1",
)
def scan_version_distribution(spark, sf):
    return A.version_distribution(_scan(spark, sf, depth="any"))


_STATISTICS = """SELECT CAST(count(*) AS BIGINT) AS total_projects,
  CAST(count(*) FILTER (error IS NULL AND python_version IS NOT NULL) AS BIGINT) AS python_projects,
  CAST(count(*) FILTER (error IS NULL AND python_version IS NULL) AS BIGINT) AS non_python_projects,
  CAST(count(*) FILTER (error IS NOT NULL) AS BIGINT) AS error_count"""


@query(
    "scan_statistics",
    _versions_sql()
    + _STATISTICS
    + " FROM (SELECT p.id, w.version AS python_version, NULL AS error FROM projects AS p LEFT JOIN winners AS w ON w.project_id = p.id) AS s",
)
def scan_statistics(spark, sf):
    return A.scan_statistics(_scan(spark, sf, depth="any"))


_SMALL_VERSIONS = RulePack((Rule("whole-file", ".python-version", "simple_version", max_file_size=6),))


@query(
    "scan_errors",
    with_(
        MANIFESTS,
        f"""tried AS (SELECT project_id, file_path, strlen(content) > 6 AS large, {trimmed('content')} AS version, strlen(content) AS size
  FROM files WHERE file_name = '.python-version')""",
        """won AS (SELECT project_id, arg_min(version, file_path) AS version FROM tried WHERE NOT large AND version <> '' GROUP BY 1)""",
        """lost AS (SELECT project_id, concat('rule whole-file: file size ', arg_min(size, file_path), ' exceeds maximum 6 bytes') AS error
  FROM tried WHERE large GROUP BY 1)""",
        MANIFEST_PROJECTS,
    )
    + """SELECT p.id, w.version AS python_version, CASE WHEN w.version IS NULL THEN l.error END AS error
FROM projects AS p LEFT JOIN won AS w ON w.project_id = p.id LEFT JOIN lost AS l ON l.project_id = p.id""",
)
def scan_errors(spark, sf):
    rows = P.project_versions(C.manifest_projects(spark, sf), C.manifest_files(spark, sf), _SMALL_VERSIONS, depth="any")
    return rows.select("id", "python_version", "error")


@query(
    "scan_error_statistics",
    "WITH s AS (" + ORACLES["scan_errors"] + ") " + _STATISTICS + " FROM s",
)
def scan_error_statistics(spark, sf):
    return A.scan_statistics(scan_errors(spark, sf))


_EVENT_RESULTS = """results AS (SELECT CASE WHEN event_type <> 'view' THEN json_extract_string(props, '$.k') END AS python_version,
  CASE WHEN event_type = 'error' THEN concat('user ', user_id) END AS error FROM events)"""


@query("event_scan_statistics", with_(_EVENT_RESULTS) + _STATISTICS + " FROM results")
def event_scan_statistics(spark, sf):
    return A.scan_statistics(C.event_results(spark, sf))


@query(
    "event_version_distribution",
    with_(_EVENT_RESULTS)
    + """SELECT python_version, CAST(count(*) AS BIGINT) AS projects FROM results
WHERE error IS NULL AND python_version IS NOT NULL GROUP BY 1""",
)
def event_version_distribution(spark, sf):
    return A.version_distribution(C.event_results(spark, sf))


@query(
    "average_confidence",
    with_(_detections())
    + """SELECT priority, CAST(round(avg(confidence), 6) AS DOUBLE) AS avg_confidence, CAST(count(*) AS BIGINT) AS detections
FROM detections GROUP BY priority""",
)
def average_confidence(spark, sf):
    outcomes = R.rule_outcomes(C.manifest_files(spark, sf), builtin_pack())
    return A.average_confidence(outcomes, "priority").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    "result_index",
    with_(MANIFEST_PROJECTS)
    + """SELECT id, path_with_namespace, CAST(row_number() OVER (ORDER BY path_with_namespace) AS BIGINT) AS index,
  CAST(count(*) OVER () AS BIGINT) AS total_projects FROM projects""",
)
def result_index(spark, sf):
    projects = C.manifest_projects(spark, sf).select("id", "path_with_namespace")
    return P.number_results(projects, ("path_with_namespace",))


_COVERAGE = (
    with_(DOCUMENT_FILES, regex_outcomes(_described(LICENSES)))[:-1]
    + """, coverage AS (SELECT rule_name, CAST(count(*) AS BIGINT) AS files_tried, CAST(count(*) FILTER (found) AS BIGINT) AS detections,
  CAST(count(error) AS BIGINT) AS errors FROM outcomes GROUP BY rule_name),
pack AS (SELECT * FROM (VALUES """
    + ", ".join(f"({q(r.name)}, {r.priority}, [{', '.join(q(t) for t in r.tags)}])" for r in LICENSES)
    + ") AS v(rule_name, priority, tags)) "
)
_ROLL_UP = """CAST(count(*) AS BIGINT) AS rules, CAST(sum(coalesce(files_tried, 0)) AS BIGINT) AS files_tried,
  CAST(sum(coalesce(detections, 0)) AS BIGINT) AS detections, CAST(sum(coalesce(errors, 0)) AS BIGINT) AS errors"""


def _license_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return R.rule_outcomes(C.document_files(spark, sf), LICENSES)


@query("rule_coverage", _COVERAGE + "SELECT * FROM coverage")
def rule_coverage(spark, sf):
    return A.rule_coverage(_license_outcomes(spark, sf))


@query(
    "rule_coverage_by_priority",
    _COVERAGE + f"SELECT priority, {_ROLL_UP} FROM pack LEFT JOIN coverage USING (rule_name) GROUP BY priority",
)
def rule_coverage_by_priority(spark, sf):
    return A.coverage_by_priority(_license_outcomes(spark, sf), LICENSES)


@query(
    "rule_coverage_by_tag",
    _COVERAGE
    + f"""SELECT tag, {_ROLL_UP} FROM (SELECT rule_name, unnest(tags) AS tag FROM pack) AS t
LEFT JOIN coverage USING (rule_name) GROUP BY tag""",
)
def rule_coverage_by_tag(spark, sf):
    return A.coverage_by_tag(_license_outcomes(spark, sf), LICENSES)


# -- sources -----------------------------------------------------------------------------------------------------------------


@query("active_projects", with_(MANIFEST_PROJECTS) + "SELECT id, path_with_namespace FROM projects WHERE NOT archived")
def active_projects(spark, sf):
    return list_active_projects(C.manifest_projects(spark, sf)).select("id", "path_with_namespace")


@query(
    "archived_group_projects",
    with_(MANIFEST_PROJECTS)
    + "SELECT id, path_with_namespace FROM projects WHERE archived AND starts_with(path_with_namespace, 'group2/')",
)
def archived_group_projects(spark, sf):
    return list_projects(C.manifest_projects(spark, sf), archived=True, group="group2").select("id", "path_with_namespace")


@query(
    "group_projects",
    with_(MANIFEST_PROJECTS)
    + "SELECT id, path_with_namespace FROM projects WHERE regexp_replace(path_with_namespace, '/[^/]*$', '') = 'group3'",
)
def group_projects(spark, sf):
    rows = list_projects(C.manifest_projects(spark, sf), group="group3", include_subgroups=False)
    return rows.select("id", "path_with_namespace")


@query(
    "file_inventory",
    with_(MANIFESTS) + "SELECT project_id, file_name, file_path FROM files WHERE NOT contains(file_path, '/')",
)
def file_inventory(spark, sf):
    return inventory(C.manifest_files(spark, sf), recursive=False)


@query(
    "file_inventory_folder",
    with_(DOCUMENT_FILES) + "SELECT project_id, file_name, file_path FROM files WHERE starts_with(file_path, 'de/')",
)
def file_inventory_folder(spark, sf):
    return inventory(C.document_files(spark, sf), path="de")


def _stored_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a repository export: every other file base64-encoded, some without a last commit."""
    files = C.table(spark, sf, "documents")
    odd = F.col("doc_id") % 2 == 1
    rows = C.as_document_files(files.select("*")).drop("size")
    number = F.substring_index("file_name", ".", 1).cast("bigint")
    odd = number % 2 == 1
    return rows.withColumns(
        {
            "encoding": F.when(odd, "base64").otherwise("text"),
            "content": F.when(odd, F.base64(F.encode("content", "UTF-8"))).otherwise(F.col("content")),
            "commit_id": F.concat(F.lit("c"), number.cast("string")),
            "last_commit_id": F.when(number % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("l"), number.cast("string"))),
            "size": F.octet_length("content").cast("bigint"),
        }
    )


_COMMITS = "CASE WHEN doc_id % 3 = 0 THEN concat('c', doc_id) ELSE concat('l', doc_id) END AS last_commit_id"


@query(
    "file_contents",
    f"""SELECT source AS project_id, concat(lang, '/', doc_id, '.txt') AS file_path, sha256(text) AS content_sha256,
  CAST(strlen(text) AS BIGINT) AS bytes, {_COMMITS} FROM documents""",
)
def contents(spark, sf):
    rows = file_contents(_stored_files(spark, sf))
    size = F.octet_length("content").cast("bigint").alias("bytes")
    return rows.select("project_id", "file_path", "content_sha256", size, "last_commit_id")


@query(
    "file_metadata",
    f"SELECT source AS project_id, concat(doc_id, '.txt') AS file_name, concat(lang, '/', doc_id, '.txt') AS file_path, {_COMMITS} FROM documents",
)
def metadata(spark, sf):
    return file_metadata(_stored_files(spark, sf)).select("project_id", "file_name", "file_path", "last_commit_id")


@query(
    "fetch_content",
    with_(MANIFESTS)
    + """SELECT project_id, file_path, content FROM files WHERE file_path IN ('pyproject.toml', '.python-version')""",
)
def fetch(spark, sf):
    wanted = C.manifest_projects(spark, sf).select(
        F.col("id").alias("project_id"), F.explode(F.array(F.lit("pyproject.toml"), F.lit(".python-version"))).alias("file_path")
    )
    return fetch_content(C.manifest_files(spark, sf), wanted).select("project_id", "file_path", "content")


@query(
    "url_namespace_rollup",
    r"""SELECT regexp_extract(url, '^(https?://[^/?#]*)([^?#]*)', 1) AS base_url,
  trim(regexp_extract(url, '^(https?://[^/?#]*)([^?#]*)', 2), '/') AS namespace, CAST(count(*) AS BIGINT) AS sources
FROM pages GROUP BY 1, 2""",
)
def url_namespaces(spark, sf):
    return namespace_rollup(C.table(spark, sf, "pages"))


# -- logs ----------------------------------------------------------------------------------------------------------------------

_INDEXED = (
    _versions_sql()[:-1]
    + """, numbered AS (SELECT p.id, p.name, p.path_with_namespace, w.version, regexp_extract(w.file_path, '[^/]+$') AS source,
  row_number() OVER (ORDER BY p.path_with_namespace) AS i, count(*) OVER () AS n
  FROM projects AS p LEFT JOIN winners AS w ON w.project_id = p.id) """
)


def _report(spark: SparkSession, sf: str):
    return version_scan(C.manifest_projects(spark, sf), C.manifest_files(spark, sf), depth="any")


@query(
    "render_results",
    _INDEXED
    + """SELECT concat('[', i, '/', n, '] ', name, ': ',
  CASE WHEN version IS NULL THEN 'Python not detected' ELSE concat('Python ', version, ' (from ', source, ')') END) AS value
FROM numbered""",
)
def render_results(spark, sf):
    return K.render_scan_results(_report(spark, sf).results)


@query(
    "scan_log_round_trip",
    _INDEXED
    + """SELECT name AS project_name, path_with_namespace AS project_path, version AS python_version, source AS detection_source,
  CAST(i AS BIGINT) AS index, CAST(n AS BIGINT) AS total_projects FROM numbered""",
)
def scan_log_round_trip(spark, sf):
    path = scratch_path(spark, "scan-log")
    K.write_full_scan_log(_report(spark, sf).results, path, "https://example.com/group")
    return scan_log_results(read_scan_log(spark, path)).drop("timestamp", "error")


@query(
    "scan_log_summary",
    _versions_sql()
    + """SELECT version AS label, CAST(count(*) AS BIGINT) AS n FROM winners GROUP BY 1
UNION ALL SELECT 'total_projects', CAST(count(*) AS BIGINT) FROM projects UNION ALL SELECT 'error_count', CAST(0 AS BIGINT)""",
)
def scan_log_summary(spark, sf):
    path = scratch_path(spark, "scan-log")
    K.write_full_scan_log(_report(spark, sf).results, path, "https://example.com/group")
    log = read_scan_log(spark, path)
    counters = [F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in ("total_projects", "error_count")]
    return scan_log_versions(log).toDF("label", "n").union(scan_log_summaries(log).select(F.inline(F.array(*counters))))


@query(
    "scan_log_header",
    _versions_sql() + "SELECT 'https://example.com/group' AS gitlab_url, CAST(count(*) AS BIGINT) AS total_projects FROM projects",
)
def scan_log_header(spark, sf):
    path = scratch_path(spark, "scan-log")
    K.write_full_scan_log(_report(spark, sf).results, path, "https://example.com/group")
    return scan_log_headers(read_scan_log(spark, path)).select("gitlab_url", "total_projects")


@query(
    "scan_text_log",
    _INDEXED
    + """, lines AS (SELECT concat('[<time>] [', i, '/', n, '] ', name, ': ',
  CASE WHEN version IS NULL THEN 'Python not detected' ELSE concat('Python ', version, ' (from ', source, ')') END) AS value FROM numbered),
s AS (SELECT count(*) AS n, count(version) AS p FROM numbered)
SELECT value FROM lines
UNION ALL SELECT unnest(['=== Scan Log ===', 'Timestamp: <time>', 'Source URL: https://example.com/group', concat('Total Projects: ', n),
  '=====================================', '=== Scan Summary ===', 'Timestamp: <time>', concat('Total Projects: ', n),
  concat('Python Projects: ', p), concat('Non-Python Projects: ', n - p), 'Python Version Distribution:', '====================']) AS value FROM s
UNION ALL SELECT concat('  ', version, ': ', count(*)) AS value FROM winners GROUP BY version""",
)
def scan_text_log(spark, sf):
    path = scratch_path(spark, "scan-text")
    K.write_full_text_log(_report(spark, sf).results, path, "https://example.com/group")
    stamp = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:Z|[+-]\d\d:\d\d)"
    return spark.read.text(path).select(F.regexp_replace("value", stamp, "<time>").alias("value"))


_SEARCHED = (
    with_(DOCUMENT_FILES, DOCUMENT_PROJECTS, LINES)[:-1]
    + ",\n"
    + literal_hits("license")
    + """, numbered AS (SELECT id, name, path_with_namespace, row_number() OVER (ORDER BY path_with_namespace) AS i,
  count(*) OVER () AS n FROM projects) """
)


def _search_report(spark: SparkSession, sf: str):
    search = Search("license")
    return content_search(C.document_projects(spark, sf), C.document_files(spark, sf), [search]).of(search)


@query(
    "render_matches",
    _SEARCHED
    + """, counts AS (SELECT p.*, count(h.file_path) AS c FROM numbered AS p LEFT JOIN hits AS h ON h.project_id = p.id GROUP BY ALL)
SELECT concat('[', i, '/', n, '] ', name, ': ', CASE WHEN c = 0 THEN 'no matches' ELSE concat(c, ' match(es) found') END) AS value FROM counts
UNION ALL SELECT concat('  ', file_path, ':', line_number, ': ', line_content) AS value FROM hits""",
)
def render_matches(spark, sf):
    report = _search_report(spark, sf)
    return K.render_search_results(report.results, report.matches).select("value")


@query(
    "search_log_round_trip",
    _SEARCHED
    + """SELECT name AS project_name, path_with_namespace AS project_path, CAST(i AS BIGINT) AS index, CAST(n AS BIGINT) AS total_projects,
  file_path, line_number, line_content, matched_text FROM numbered LEFT JOIN hits ON hits.project_id = numbered.id""",
)
def search_log_round_trip(spark, sf):
    path = scratch_path(spark, "search-log")
    report = _search_report(spark, sf)
    K.write_search_log(report.results, report.matches, path, "license")
    log = read_search_log(spark, path)
    keys = ["project_name", "project_path", "index", "total_projects"]
    found = search_log_matches(log).drop("search_term")
    return search_log_projects(log).select(*keys).join(found, keys, "left")


@query(
    "scan_log_runs",
    _INDEXED
    + """SELECT run, CAST(count(*) AS BIGINT) AS records, CAST(count(version) AS BIGINT) AS detected, CAST(1 AS BIGINT) AS broken
FROM numbered, (VALUES ('a'), ('b')) AS r(run) GROUP BY run""",
)
def scan_log_runs(spark, sf):
    """A log of two runs, one written twice, each with a torn last line."""
    path, report = scratch_path(spark, "runs"), _report(spark, sf)
    for run in ("a", "b", "a"):
        K.write_scan_run(report.results, path, run, "https://example.com")
    torn = spark.createDataFrame([('{"timestamp":"2024-01-01T00:00:00Z","project_name":"lo',)], "value string").coalesce(1)
    for run in ("a", "b"):
        torn.write.mode("append").text(f"{path}/run={run}")
    results = scan_log_results(read_scan_log(spark, path), "run")
    counted = results.groupBy("run").agg(F.count("*").alias("records"), F.count("python_version").alias("detected"))
    broken = [(run, broken_lines(spark, f"{path}/run={run}").first()["broken"]) for run in ("a", "b")]
    return counted.join(spark.createDataFrame(broken, "run string, broken long"), "run")


# -- streams ---------------------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ST.stream_table(spark, C.table(spark, sf, name).schema, sf, glob=f"{name}.parquet")


@query(
    "stream_scan",
    LICENSE_RULES + "SELECT project_id, file_path, rule_name, version, confidence FROM found WHERE rank = 1",
)
def stream_scan(spark, sf):
    out, checkpoint = scratch_path(spark, "stream-scan"), scratch_path(spark, "stream-state")
    files = C.as_document_files(_stream(spark, sf, "documents"))
    ST.append_detections(files, LICENSES, out, checkpoint).awaitTermination()
    schema = "project_id string, file_path string, rule_name string, version string, confidence double"
    return spark.read.schema(schema).json(out)


@query(
    "stream_restart",
    LICENSE_RULES + "SELECT project_id, file_path, rule_name, version, confidence FROM found WHERE rank = 1",
)
def stream_restart(spark, sf):
    """ST3: the documents land in two parts; the stream is started anew for the second and goes on where it was."""
    landed, out, checkpoint = (scratch_path(spark, f"restart-{n}") for n in ("in", "out", "state"))
    documents = C.table(spark, sf, "documents")
    later = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    for part in (~later, later):
        documents.where(part).write.mode("append").parquet(landed)
        files = C.as_document_files(ST.stream_table(spark, documents.schema, landed))
        ST.append_detections(files, LICENSES, out, checkpoint).awaitTermination()
    schema = "project_id string, file_path string, rule_name string, version string, confidence double"
    return spark.read.schema(schema).json(out)


@query("stream_matches", IN_DOCUMENTS + literal_hits("license") + f" SELECT {MATCH} FROM hits")
def stream_matches(spark, sf):
    out, checkpoint = scratch_path(spark, "stream-matches"), scratch_path(spark, "stream-state")
    files = C.as_document_files(_stream(spark, sf, "documents"))
    ST.append_matches(files, Search("license"), out, checkpoint).awaitTermination()
    schema = "project_id string, file_path string, line_number bigint, line_content string, matched_text string"
    return spark.read.schema(schema).json(out)


@query("stream_statistics", with_(_EVENT_RESULTS) + _STATISTICS + " FROM results")
def stream_statistics(spark, sf):
    out, checkpoint = scratch_path(spark, "stream-stats"), scratch_path(spark, "stream-state")
    results = C.as_event_results(_stream(spark, sf, "events"))
    counters = ST.running_statistics(results)
    ST.publish_running(counters, out, checkpoint).awaitTermination()
    return SP.read_published(spark, out, counters.schema)


def _landings(spark: SparkSession, rows: DataFrame, parts: list[Column], start: Callable[[DataFrame], object]) -> None:
    """Rows land in parts; a stream is started anew for each and goes on where it was."""
    landed = scratch_path(spark, "landed")
    for part in parts:
        rows.where(part).write.mode("append").parquet(landed)
        start(ST.stream_table(spark, rows.schema, landed)).awaitTermination()


@query("stream_project_versions", _versions_sql() + _SCAN_COLUMNS)
def stream_project_versions(spark, sf):
    """ST1 by project: three landings, the file names that win last, so that winners change; published by batch and made one base on the way."""
    files, out, state = C.manifest_files(spark, sf), scratch_path(spark, "winners"), scratch_path(spark, "winners-state")
    pack, schema = builtin_pack(), SJ.winners_schema(files)
    first = F.col("file_name").isin(".python-version", "setup.py", "runtime.txt")
    second = F.col("file_name").startswith("req") | F.col("file_name").startswith("tox")

    def start(stream: DataFrame):
        SP.compact(spark, out, schema, ["project_id"])
        return SP.publish(SJ.stream_winners(stream, pack, depth="any"), out, state)

    _landings(spark, files, [second, ~first & ~second, first], start)
    projects = C.manifest_projects(spark, sf)
    return SJ.with_projects(projects, SP.read_latest(spark, out, schema, ["project_id"])).select(*_SCAN_OUT)


@query(
    "stream_top_matches",
    IN_DOCUMENTS
    + literal_hits("license")
    + f""" SELECT {MATCH}, CAST(rn AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY file_path, line_number) AS rn FROM hits) AS r WHERE rn <= 3""",
)
def stream_top_matches(spark, sf):
    """C5 in a stream: three landings; each may push out matches of the one before."""
    documents, out, state = C.table(spark, sf, "documents"), scratch_path(spark, "top"), scratch_path(spark, "top-state")
    schema = SJ.top_matches_schema(C.as_document_files(documents))
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))

    def start(stream: DataFrame):
        return SP.publish(SJ.stream_top_matches(C.as_document_files(stream), Search("license", max_matches=3)), out, state)

    _landings(spark, documents, [third == k for k in (2, 0, 1)], start)
    return SP.read_latest(spark, out, schema, ["project_id"])
