"""J1 and X1-X3 for packs that are data: rules as a table, joined with the files that they ask for.

1. :func:`prepare_rules` writes the table once: every rule with a key under which files find it by equality, its patterns in Java's dialect, and the
   options of its extractor as columns.  Rules are prepared in tasks, however many there are.
2. A file has a key for its name, each of its extensions, and each shape of a pattern with wildcards that occurs: how long its literal beginning and end are and, if
   no ``*`` is between them, how long the name is.  Few rules are broadcast (their number is checked), so contents stay where they are read; more rules meet names
   first, and contents follow to the pairs found.
3. One stage works out all rules of an extractor kind, reading pattern and options from the rule's columns.  Kinds with code of their own, and users' kinds, are a
   stage per kind and options.

Results are those of the unrolled form (``operators.rules``); they are rows, one per file and applicable rule.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusrules.functions import text as t
from corpusrules.functions.extractors import get_extractor, is_built_in, job_of, result, version_group
from corpusrules.functions.patterns import java_quote, regex, rule_glob
from corpusrules.functions.search_lines import line_test
from corpusrules.operators.rules import _FLAT, _keys, _Job, _name_keys, worked
from corpusrules.schemas import RESULT
from corpusrules.session import collect_small, scratch_path

#: Rules that are broadcast; what a rule holds is short.
BROADCAST_RULES = 100_000
#: Kinds and options that need a stage of their own.
MAX_JOBS = 1_000
_TABLE = ("regex", "simple_version", "string_search")

PREPARED = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("rule_name", "key", "name_pattern", "path_pattern", "required", "kind", "job", "config", "pattern", "guard")),
        *(T.StructField(c, T.IntegerType()) for c in ("priority", "version_group", "match_limit")),
        T.StructField("max_file_size", T.LongType()),
        T.StructField("fixed_confidence", T.DoubleType()),
        T.StructField("trimmed", T.BooleanType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("shape", T.ArrayType(T.IntegerType())),
    ]
)
#: Keys of patterns with wildcards: shape, then beginning and end.  Other keys start with ``=`` or ``*``.
_SHAPED = "{},{},{}:"


def _literal_end(pattern: str) -> tuple[str, str]:
    """The text before the first wildcard and after the last one."""
    wild = [k for k, c in enumerate(pattern) if c in "*?"]
    return pattern[: wild[0]], pattern[wild[-1] + 1 :]


def rule_key(pattern: str | None) -> tuple[str, bool]:
    """The key of a file pattern, and whether it says all that the pattern does."""
    if not pattern:
        return "", True
    if rule_glob(pattern) is None:
        return "=" + pattern, True
    if pattern.startswith("*.") and rule_glob(pattern[1:]) is None:
        return pattern, True
    head, tail = _literal_end(pattern)
    return (("^" + head) if len(head) >= len(tail) else ("$" + tail)) if head or tail else "", False


def meeting_key(pattern: str | None) -> tuple[str, tuple[int, int, int] | None, bool]:
    """The key under which files meet a file pattern, its shape if it has one, and whether the key says all that the pattern does.

    A shape is the lengths of the literal beginning and end, and of the whole name (-1 if a ``*`` leaves that open).  Beginning and end count together: what one of them
    says alone (an extension that all files have) would meet files and rules by the square.
    """
    key, whole = rule_key(pattern)
    if whole:
        return key, None, True
    head, tail = _literal_end(pattern)
    shape = len(head), len(tail), -1 if "*" in pattern else len(pattern)
    if not any(shape[:2]) and shape[2] < 0:
        return "", None, False
    return _SHAPED.format(*shape) + head + tail, shape, False


def _prepared(record: dict) -> dict | None:
    """One rule of a rules table; raises for a rule that cannot be.  Users' kinds are checked where they are built."""
    match, parser = record.get("match") or {}, record.get("parser") or {}
    name, kind, config = record.get("name") or "", parser.get("type"), dict(parser.get("config") or [])
    if record.get("enabled") is False:
        return None
    if not name:
        raise ValueError("rule name cannot be empty")
    if not kind:
        raise ValueError(f"rule {name}: parser type is required")
    file_pattern, path_pattern = match.get("file_pattern") or None, match.get("path_pattern") or None
    if not file_pattern and not path_pattern:
        raise ValueError(f"rule {name}: a file_pattern or path_pattern is required")
    key, shape, whole = meeting_key(file_pattern)
    priority = record.get("priority")
    row = dict.fromkeys(PREPARED.names) | {
        "rule_name": name,
        "priority": 50 if priority is None else int(priority),
        "tags": record.get("tags"),
        "key": key,
        "shape": shape,
        "name_pattern": None if whole else rule_glob(file_pattern),
        "path_pattern": regex(path_pattern).java if path_pattern else None,
        "required": regex(match["required_content"]).java if match.get("required_content") else None,
        "max_file_size": int(match["max_file_size"]) if match.get("max_file_size") else None,
        "kind": kind,
    }
    if kind not in _TABLE:
        return row | {"job": job_of(kind, config), "config": json.dumps(config, sort_keys=True)}
    fixed = get_extractor(kind, config).stages.confidence
    if kind == "regex":
        pattern = regex(str(config["pattern"]))
        guard = pattern.literal if len(pattern.literal) >= 2 and not pattern.literal_folded else None
        return row | {"pattern": pattern.java, "guard": guard, "version_group": version_group(pattern, str(config.get("version_group") or "version")), "fixed_confidence": fixed}
    if kind == "simple_version":
        return row | {"trimmed": str(config.get("trim_whitespace", True)).strip().lower() == "true", "fixed_confidence": fixed}
    options = {c: str(config.get(c, False)).strip().lower() == "true" for c in ("is_regex", "case_sensitive")}
    test = line_test(str(config["search_term"]), **options)
    java = test.pattern.java if test.pattern else java_quote(test.term)
    literal = test.term if test.pattern is None else test.pattern.literal if len(test.pattern.literal) >= 2 and not test.pattern.literal_folded else None
    return row | {"pattern": java, "guard": literal, "match_limit": int(float(config.get("max_matches") or 0))}


def _preparer(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for row in map(_prepared, batch.to_pylist()) if row is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


class RuleTable(NamedTuple):
    """Prepared rules, how many, the shapes of their patterns, and the jobs of kinds that need stages of their own."""

    rules: DataFrame
    count: int
    shapes: list[list[int]]
    kinds: list[str]
    jobs: list[tuple[str, str, str]]


def prepare_rules(rules: DataFrame) -> RuleTable:
    """A rules table (``RULES``, as ``sources.packs.rules_table`` gives it) made ready to be joined; only enabled rules.  Written."""
    path = scratch_path(rules.sparkSession, "rules")
    rules.mapInArrow(_preparer(to_arrow_schema(PREPARED)), PREPARED).write.parquet(path)
    made = rules.sparkSession.read.schema(PREPARED).parquet(path)
    repeated = made.groupBy("rule_name").count().where("count > 1").orderBy("rule_name").limit(5).collect()
    if repeated:
        raise ValueError(f"duplicate rule name: {', '.join(r[0] for r in repeated)}")
    found = made.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set("shape")).alias("shapes"),
        F.sort_array(F.collect_set(F.when(F.col("kind").isin(*_TABLE), F.col("kind")))).alias("kinds"),
    ).first()
    jobs = collect_small(made.where("job is not null").select("job", "kind", "config").distinct(), MAX_JOBS, "extractors with options of their own")
    return RuleTable(made, found["n"], found["shapes"], found["kinds"], sorted(tuple(j) for j in jobs))


def _file_keys(name: Column, table: RuleTable) -> Column:
    shapes = F.array(*[F.array(*map(F.lit, shape)) for shape in table.shapes]).cast("array<array<int>>")
    length = F.length(name)
    fits = F.filter(shapes, lambda s: F.when(s[2] < 0, length >= s[0] + s[1]).otherwise(length == s[2]))
    said = F.transform(fits, lambda s: F.concat(F.array_join(s, ","), F.lit(":"), F.left(name, s[0]), F.right(name, s[1])))
    return F.array_distinct(F.array_compact(F.concat(_name_keys(name), F.array(F.lit("")), said)))


def table_pairs(files: DataFrame, table: RuleTable, *carried: Column) -> DataFrame:
    """One row per (file, applicable rule), with the rule's columns and what is ``carried`` of the file."""
    slim = files.select(*_keys(files), *carried)
    keyed = slim.withColumn("_key", F.explode(_file_keys(F.col("file_name"), table)))
    rules = F.broadcast(table.rules) if table.count <= BROADCAST_RULES else table.rules
    met = keyed.join(rules.drop("shape").withColumnRenamed("key", "_key"), "_key").drop("_key")
    return met.where("(name_pattern IS NULL OR rlike(file_name, name_pattern)) AND (path_pattern IS NULL OR rlike(file_path, path_pattern))")


def _stages(rows: DataFrame, table: RuleTable) -> DataFrame:
    """``_x``, the result struct of each pair, or null."""
    found = []
    content, name = F.col("_text"), F.col("file_name")
    asked = {k: F.col("_open") & (F.col("kind") == k) for k in table.kinds}
    if "regex" in table.kinds:
        raw = F.expr("CASE WHEN _open AND kind = 'regex' AND (guard IS NULL OR contains(_text, guard)) THEN regexp_extract(_text, pattern, version_group) END")
        rows = rows.withColumn("_raw", raw)
        found.append(F.when(F.col("_raw") != "", result(t.trim_space(F.col("_raw")), name, F.col("fixed_confidence"), F.col("_raw"))))
    if "simple_version" in table.kinds:
        rows = rows.withColumn("_plain", F.when(asked["simple_version"], F.when(F.col("trimmed"), F.col("_trimmed")).otherwise(content)))
        found.append(F.when(F.col("_plain") != "", result(F.col("_plain"), name, F.col("fixed_confidence"), F.col("_plain"))))
    if "string_search" in table.kinds:
        lines = "filter(transform(split(_text, '\\\\n'), (line, i) -> named_struct('line', line, 'i', i)), x -> rlike(x.line, pattern))"
        rows = rows.withColumn("_hits", F.expr(f"CASE WHEN _open AND kind = 'string_search' AND (guard IS NULL OR contains(_text, guard)) THEN {lines} END"))
        count, first = F.size("_hits"), F.get("_hits", F.lit(0))
        made = result(
            F.expr("regexp_extract(get(_hits, 0).line, pattern, 0)"),
            name,
            0.0,
            t.strip_cr(first["line"]),
            match_count=F.when(F.col("match_limit") > 0, F.least(count, F.col("match_limit"))).otherwise(count).cast("string"),
            line_number=(first["i"] + 1).cast("string"),
        )
        found.append(F.when(F.coalesce(count, F.lit(0)) > 0, made))
    jobs = [_Job((k,), get_extractor(kind, json.loads(config)), is_built_in(kind)) for k, (_, kind, config) in enumerate(table.jobs)]
    opens = [F.col("_open") & (F.col("job") == job) for job, _, _ in table.jobs]
    rows = worked(rows, jobs, opens)
    failed = []
    for k, job in enumerate(jobs):
        x = F.col(f"_x{k}")
        if job.extractor.can_fail:
            failed.append(F.when(opens[k], x["error"]))
            x = F.when(x["error"].isNull() & x["version"].isNotNull(), x.dropFields("error"))
        found.append(F.when(opens[k], x))
    kind = RESULT.simpleString()
    return rows.select("*", F.coalesce(*found, F.lit(None).cast(kind)).alias("_x"), F.coalesce(*failed, F.lit(None).cast("string")).alias("_failed"))


def table_outcomes(files: DataFrame, table: RuleTable) -> DataFrame:
    """One row per (file, applicable rule): found or not, with the result or the error, as ``operators.rules.rule_outcomes`` gives them."""
    size = F.col("size") if "size" in files.columns else F.octet_length(F.col("content"))
    content = [F.col("content").cast("string").alias("_text"), size.alias("_size")]
    if table.count <= BROADCAST_RULES:
        pairs = table_pairs(files, table, *content)
    else:
        # Names, each once, meet the rules; contents, each once, go to the pairs.  Keys may be null, and files may have the same ones.
        held = files.select(*_keys(files), *content)
        own = [c for c in held.columns if c not in ("_text", "_size")]
        names = table_pairs(held.select(*own).distinct(), table)
        same = reduce(and_, [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in own])
        pairs = names.alias("p").join(held.alias("f"), same).select("p.*", "f._text", "f._size")
    keys = [c for c in ("project_id", "file_path", "file_name") if c in pairs.columns]
    small = F.col("max_file_size").isNull() | (F.col("_size") <= F.col("max_file_size"))
    rows = pairs.withColumn("_small", small).withColumn("_open", F.expr("_small AND (required IS NULL OR rlike(_text, required))"))
    rows = _stages(rows.withColumn("_trimmed", t.trim_space(F.col("_text"))), table)
    too_large = F.concat(F.lit("rule "), "rule_name", F.lit(": file size "), F.col("_size").cast("string"), F.lit(" exceeds maximum "), F.col("max_file_size").cast("string"), F.lit(" bytes"))
    parser = F.concat(F.lit("rule "), "rule_name", F.lit(": parser error in rule "), "rule_name", F.lit(": "), "_failed")
    error = F.coalesce(F.when(~F.col("_small"), too_large), parser)
    found = F.col("_x").isNotNull()
    fields = {f: F.col(f"_x.{f}") for f in ("version", "source", "confidence", "raw_value", "metadata")}
    fields["source"] = F.when(found, F.coalesce(t.blank_to_null(fields["source"]), F.col("file_name")))
    return rows.select(*keys, "rule_name", "priority", found.alias("found"), *[c.alias(f) for f, c in fields.items()], error.alias("error"))


def _chosen(outcomes: DataFrame, order: Column) -> DataFrame:
    """Per file, the found outcome that comes first; results are narrow, and partial choices leave the map side.

    What was not found has no place in the order: a filter would move down through the stages and work every pair out again.
    """
    keys = [c for c in ("project_id", "file_path", "file_name") if c in outcomes.columns]
    row = F.struct("rule_name", "priority", "version", "source", "confidence", "raw_value", "metadata")
    return outcomes.groupBy(*keys).agg(F.min_by(row, F.when(F.col("found"), order)).alias("r")).where("r is not null").select(*keys, "r.*")


def table_first_match(files: DataFrame, table: RuleTable) -> DataFrame:
    """Per file, the first rule in priority order that finds something."""
    return _chosen(table_outcomes(files, table), F.struct("priority", "rule_name"))


def table_best_match(files: DataFrame, table: RuleTable) -> DataFrame:
    """Per file, the result with the highest confidence, the earlier rule on ties."""
    return _chosen(table_outcomes(files, table), F.struct((-F.col("confidence")).alias("c"), "priority", "rule_name"))


def table_results(files: DataFrame, table: RuleTable) -> DataFrame:
    """Per file, all results in priority order, their number, and how many rules applied."""
    outcomes = table_outcomes(files, table)
    keys = [c for c in ("project_id", "file_path", "file_name") if c in outcomes.columns]
    flat = F.struct("rule_name", "priority", "found", "version", "source", "confidence", "raw_value", "metadata").cast(_FLAT)
    listed = F.collect_list(F.when(F.col("found"), flat))
    ordered = F.array_sort(listed, lambda a, b: F.when(F.struct(a["priority"], a["rule_name"]) < F.struct(b["priority"], b["rule_name"]), -1).otherwise(1))
    grouped = outcomes.groupBy(*keys).agg(ordered.alias("results"), F.count("*").cast("int").alias("rules_applied"))
    return grouped.withColumn("result_count", F.size("results"))
