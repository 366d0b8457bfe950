"""Schemas of the relations this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_text, _long, _int, _bool, _double = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
_texts = T.ArrayType(_text)
_counts = T.MapType(_text, _long)

PROJECTS = _struct(
    id=_long,
    name=_text,
    path=_text,
    path_with_namespace=_text,
    web_url=_text,
    default_branch=_text,
    archived=_bool,
    last_activity_at=T.TimestampType(),
)

FILES = _struct(
    project_id=_long,
    file_path=_text,
    file_name=_text,
    ref=_text,
    size=_long,
    encoding=_text,
    content=T.BinaryType(),
    content_sha256=_text,
    blob_id=_text,
    commit_id=_text,
    last_commit_id=_text,
)

MATCH = _struct(file_pattern=_text, path_pattern=_text, required_content=_text, max_file_size=_long)
PARSER = _struct(type=_text, config=T.MapType(_text, _text))
RULES = _struct(
    name=_text, description=_text, priority=_int, enabled=_bool, tags=_texts, match=MATCH, parser=PARSER
)

SEARCHES = _struct(
    name=_text,
    description=_text,
    search_term=_text,
    is_regex=_bool,
    case_sensitive=_bool,
    file_patterns=_texts,
    context_lines=_int,
    max_matches=_int,
    max_file_size=_long,
    enabled=_bool,
)

SETTINGS = _struct(default_enabled=_bool, default_priority=_int)
PACK = _struct(
    version=_text, rules=T.ArrayType(RULES), searches=T.ArrayType(SEARCHES), settings=SETTINGS
)

RESULT = _struct(
    version=_text, source=_text, confidence=_double, raw_value=_text, metadata=T.MapType(_text, _text)
)

MATCH_ENTRY = _struct(file_path=_text, line_number=_long, line_content=_text, matched_text=_text)

# One JSON-lines file holds several kinds of record; a result record carries no "type".  ``version_counts`` is what older
# logs hold instead of a record per version.
SCAN_LOG = _struct(
    type=_text,
    timestamp=T.TimestampType(),
    gitlab_url=_text,
    project_name=_text,
    project_path=_text,
    python_version=_text,
    detection_source=_text,
    error=_text,
    index=_long,
    total_projects=_long,
    python_projects=_long,
    non_python_projects=_long,
    error_count=_long,
    version_counts=_counts,
    projects=_long,
)

SEARCH_LOG = _struct(
    type=_text,
    timestamp=T.TimestampType(),
    project_name=_text,
    project_path=_text,
    search_term=_text,
    file_path=_text,
    matches=T.ArrayType(MATCH_ENTRY),
    match_count=_long,
    files_with_matches=_long,
    error=_text,
    index=_long,
    total_projects=_long,
)
