"""SQL building blocks for the reference answers; patterns stay in the dialect packs are written in."""

from __future__ import annotations

from corpusrules.sources.corpus import MANIFEST_PROJECTS_SQL, MANIFEST_SQL

DOCUMENT_FILES = """files AS (
  SELECT source AS project_id, concat(lang, '/', doc_id, '.txt') AS file_path, concat(doc_id, '.txt') AS file_name,
         CAST(strlen(text) AS BIGINT) AS size, text AS content
  FROM documents)"""

DOCUMENT_PROJECTS = """projects AS (
  SELECT source AS id, source AS name, concat('corpus/', source) AS path_with_namespace,
         CAST(substr(source, 4) AS INTEGER) % 4 = 1 AS archived
  FROM documents GROUP BY source)"""

CONVERSATION_FILES = """files AS (
  SELECT conv_id AS project_id, concat(role, '/', turn) AS file_path, text AS content FROM conversations)"""

MANIFESTS = f"files AS ({MANIFEST_SQL})"
MANIFEST_PROJECTS = f"projects AS ({MANIFEST_PROJECTS_SQL})"

LINES = """lines AS (
  SELECT project_id, file_path, unnest(string_split(content, chr(10))) AS line,
         CAST(generate_subscripts(string_split(content, chr(10)), 1) AS BIGINT) AS line_number
  FROM files)"""

SPACES = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(text: str) -> str:
    """Text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def trimmed(expr: str) -> str:
    return f"regexp_replace({expr}, {q(f'^{SPACES}+|{SPACES}+$')}, '', 'g')"


def hits(where: str, matched: str) -> str:
    return f"""hits AS (
  SELECT project_id, file_path, line_number, rtrim(line, chr(13)) AS line_content, {matched} AS matched_text
  FROM lines WHERE {where})"""


def regex_hits(pattern: str, extra: str = "") -> str:
    return hits(f"regexp_matches(line, {q(pattern)}){extra}", f"regexp_extract(line, {q(pattern)}, 0)")


def literal_hits(term: str) -> str:
    low = q(term.lower())
    return hits(f"contains(lower(line), {low})", f"substr(line, strpos(lower(line), {low}), {len(term)})")


def regex_outcomes(rules: list[dict]) -> str:
    """``outcomes``: one row per (file, rule) for rules given as name, priority, pattern, group, confidence, ..."""
    rows = []
    for r in rules:
        size = f"size > {r['size']}" if r.get("size") else "FALSE"
        required = f"regexp_matches(content, {q(r['required'])})" if r.get("required") else "TRUE"
        rows.append(
            f"""  SELECT project_id, file_path, size, {q(r['name'])} AS rule_name, {r['priority']} AS priority,
    CAST({r['confidence']} AS DOUBLE) AS confidence,
    CASE WHEN {size} THEN concat('rule {r['name']}: file size ', size, ' exceeds maximum {r.get('size')} bytes') END AS error,
    CASE WHEN NOT ({size}) AND {required} THEN regexp_extract(content, {q(r['pattern'])}, {r['group']}) ELSE '' END AS raw_value
  FROM files"""
        )
    union = "\n  UNION ALL\n".join(rows)
    return f"""tried AS ({union}),
outcomes AS (
  SELECT *, raw_value <> '' AS found, {trimmed('raw_value')} AS version,
         row_number() OVER (PARTITION BY project_id, file_path ORDER BY priority, rule_name) AS position
  FROM tried),
found AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY priority, rule_name) AS rank
  FROM outcomes WHERE found)"""
