"""Applying a rule pack to files.

The pack is unrolled into literal columns, stage by stage: which rules apply, what their extractors find first, what comes
of it, the results.  A stage is one projection for all rules, so a file is read once whatever the number of rules, no rule
ever crosses a shuffle, no value is worked out twice, and everything about one file is decided inside its row.  Rules with
the same extractor and options share its values, and what all rules have in common is written as SQL text: building the
plan of a long pack takes few calls into the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrules.functions import sqltext as q
from corpusrules.functions.extractors import Extractor, Given, is_built_in, job_of
from corpusrules.functions.patterns import regex, rule_glob, rule_glob_matches, rule_glob_sql
from corpusrules.functions.text import as_text, base_name, trim_space
from corpusrules.rulepack import Rule, RulePack
from corpusrules.schemas import RESULT

_KINDS = {"rule_name": "string", "priority": "int", "found": "boolean", **{f.name: f.dataType.simpleString() for f in RESULT.fields}}
_FLAT = "struct<" + ",".join(f"{k}:{v}" for k, v in _KINDS.items()) + ">"
_NOTHING = {k: f"CAST(NULL AS {v})" for k, v in _KINDS.items()}


@dataclass(frozen=True)
class _Shape:
    """What a file table offers, with defaults for what it leaves out."""

    named: bool
    sized: bool

    @classmethod
    def of(cls, files: DataFrame) -> _Shape:
        return cls("file_name" in files.columns, "size" in files.columns)

    @property
    def path(self) -> Column:
        return F.col("file_path")

    @property
    def name(self) -> Column:
        return F.col("file_name") if self.named else base_name(self.path)

    @property
    def size(self) -> Column:
        return F.col("size") if self.sized else F.octet_length(F.col("content"))


def _keys(files: DataFrame) -> list[Column]:
    name = F.col("file_name") if "file_name" in files.columns else base_name(F.col("file_path")).alias("file_name")
    project = [F.col("project_id")] if "project_id" in files.columns else []
    return [*project, F.col("file_path"), name]


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def rule_applies(rule: Rule, name: Column, path: Column, pattern_mode: str = "glob") -> Column:
    """an enabled rule whose file pattern (F2) and path pattern (F4) both hold; a missing pattern always holds."""
    if not rule.enabled:
        return F.lit(False)
    tests = []
    if rule.file_pattern:
        literal = pattern_mode == "literal"
        tests.append(path == F.lit(rule.file_pattern) if literal else rule_glob_matches(name, rule.file_pattern))
    if rule.path_pattern:
        tests.append(regex(rule.path_pattern).found_in(path))
    return _all(tests)


def _applies_sql(rule: Rule, pattern_mode: str) -> str:
    """:func:`rule_applies` over the columns ``file_name`` and ``file_path``."""
    if not rule.enabled:
        return "FALSE"
    tests = []
    if rule.file_pattern:
        literal = pattern_mode == "literal"
        tests.append(f"file_path = {q.text(rule.file_pattern)}" if literal else rule_glob_sql("file_name", rule.file_pattern))
    if rule.path_pattern:
        tests.append(regex(rule.path_pattern).found_sql("file_path"))
    return q.all_of(tests)


def any_rule_applies(pack: RulePack, name: Column, path: Column, pattern_mode: str = "glob") -> Column:
    """Files worth reading at all; needs no content, so it reaches the scan."""
    plain = _plain_names(pack.rules, pattern_mode)
    tests = [rule_applies(r, name, path, pattern_mode) for r in pack if not _is_plain(r, pattern_mode)]
    return _any([name.isin(plain), *tests] if plain else tests)


def _is_plain(rule: Rule, pattern_mode: str) -> bool:
    """Whether a rule asks for nothing but one file name."""
    return bool(rule.enabled and rule.file_pattern and not rule.path_pattern and pattern_mode == "glob" and rule_glob(rule.file_pattern) is None)


def _plain_names(rules: Sequence[Rule], pattern_mode: str) -> list[str]:
    return sorted({r.file_pattern for r in rules if _is_plain(r, pattern_mode)})


@dataclass(frozen=True)
class _Job:
    """What rules with one extractor and the same options share: the rules' positions and the extractor."""

    rules: tuple[int, ...]
    extractor: Extractor
    built_in: bool


def _jobs(pack: RulePack) -> list[_Job]:
    rules: dict[str, list[int]] = {}
    for i, rule in enumerate(pack):
        rules.setdefault(job_of(rule.parser_type, rule.parser_config), []).append(i)
    return [_Job(tuple(own), pack.rules[own[0]].extractor(), is_built_in(pack.rules[own[0]].parser_type)) for own in rules.values()]


def worked(rows: DataFrame, jobs: Sequence[_Job], opens: Sequence[Column]) -> DataFrame:
    """``rows`` (with ``_text``, ``_trimmed``, ``file_name``) with ``_x``, a result struct or null, of every job where it is open."""
    given = [Given(F.col("_text"), F.col("_trimmed"), F.col("file_name")) for _ in jobs]
    steps = [job.extractor.stages.steps for job in jobs]
    # A function of the user's may be Python, which runs before any ``when``: it gets nulls where it is not wanted.
    handed = [Given(F.when(o, g.content), F.when(o, g.trimmed), g.name) if j.extractor.can_fail else g for j, g, o in zip(jobs, given, opens)]
    for step in range(max(map(len, steps), default=0)):
        made = []
        for k, job in enumerate(jobs):
            if step < len(steps[k]):
                named = steps[k][step]((handed if step == 0 else given)[k])
                first = step == 0 and not job.extractor.can_fail
                made += [(F.when(opens[k], c) if first else c).alias(f"_s{k}_{n}") for n, c in named.items()]
                given[k] = given[k].with_columns({n: F.col(f"_s{k}_{n}") for n in named})
        rows = rows.select("*", *made)
    made, cast = [], {}
    for k, job in enumerate(jobs):
        described = job.extractor.stages.describe(given[k])
        # Without stages nothing has asked yet whether the rule applies.
        made.append((described if job.extractor.stages.steps else F.when(opens[k], described)).alias(f"_x{k}"))
        if not job.built_in:
            fields = {f.name: f"CAST(_x{k}.{f.name} AS {f.dataType.simpleString()})" for f in RESULT.fields}
            if job.extractor.can_fail:
                fields["error"] = f"CAST(_x{k}.error AS STRING)"
            cast[f"_x{k}"] = f"CASE WHEN _x{k} IS NOT NULL THEN {q.struct(**fields)} END AS _x{k}"
    rows = rows.select("*", *made)
    return rows.selectExpr(*[cast.get(c, q.name(c)) for c in rows.columns]) if cast else rows


class _Tried:
    """A pack tried on files: ``rows`` has the file keys and what the jobs found (``_x``).

    For rule ``i``, :meth:`applies`, :meth:`found`, :meth:`confidence` and :meth:`error` are SQL text over these rows.
    Tests that cost something are columns of their own, worked out once for all rules that share them.
    """

    def __init__(self, files: DataFrame, pack: RulePack, pattern_mode: str, all_files: bool = False):
        self.pack = pack
        shape = _Shape.of(files)
        keys = _keys(files)
        plain = _plain_names(pack.rules, pattern_mode)
        # One look-up says whether any rule for a single name applies; most files stop there.
        self.named = bool(plain)
        rows = files.select(*keys, F.col("content").alias("_content"), shape.size.alias("_size"))
        self.keys = rows.columns[: len(keys)]
        listed = f"file_name IN ({', '.join(map(q.text, plain))})" if plain else "FALSE"
        self.always = [not _is_plain(r, pattern_mode) for r in pack]
        others = dict.fromkeys(_applies_sql(r, pattern_mode) for r, a in zip(pack, self.always) if a)
        if not all_files:
            rows = rows.where(F.expr(q.any_of([*([listed] if plain else []), *others])))
        columns = {test: f"_a{k}" for k, test in enumerate(others)}
        rows = rows.selectExpr("*", *([f"{listed} AS _named"] if plain else []), *[f"{test} AS {c}" for test, c in columns.items()])
        self._applies = [
            columns[_applies_sql(r, pattern_mode)] if a else f"(_named AND file_name = {q.text(r.file_pattern)})" for r, a in zip(pack, self.always)
        ]
        content = as_text(F.col("_content"))
        rows = rows.select(*[c for c in rows.columns if c != "_content"], content.alias("_text"), trim_space(content).alias("_trimmed"))
        required = dict.fromkeys(r.required_content for r in pack if r.required_content)
        needed = {r: f"_r{k}" for k, r in enumerate(required)}
        asked = {r: [i for i, rule in enumerate(pack) if rule.required_content == r] for r in required}
        opened = [f"CASE WHEN {q.any_of(self._ready(i) for i in asked[r])} THEN {regex(r).found_sql('_text')} ELSE FALSE END AS {c}" for r, c in needed.items()]
        if opened:
            rows = rows.selectExpr("*", *opened)
        self._open = [q.all_of([self._ready(i), *([needed[r.required_content]] if r.required_content else [])]) for i, r in enumerate(pack)]
        self.jobs = _jobs(pack)
        self._job = {i: k for k, job in enumerate(self.jobs) for i in job.rules}
        self._fixed = [r.extractor().stages.confidence for r in pack]
        rows = worked(rows, self.jobs, [F.expr(q.any_of(dict.fromkeys(self._open[i] for i in job.rules))) for job in self.jobs])
        gates = ["_named"] if plain else []
        kept = [c for c in rows.columns if c[:2] in ("_a", "_r") or c == "_size"]
        described = [f"_x{k}" for k in range(len(self.jobs))]
        self.rows = rows.select(*self.keys, *gates, *kept, *described)

    def _ready(self, i: int) -> str:
        """The rule applies, and the file is not too large."""
        rule = self.pack.rules[i]
        return f"{self._applies[i]} AND _size <= {rule.max_file_size}" if rule.max_file_size else self._applies[i]

    def applies(self, i: int) -> str:
        return self._applies[i]

    def found(self, i: int) -> str:
        k = self._job[i]
        tests = [self._open[i], f"_x{k} IS NOT NULL"]
        if self.jobs[k].extractor.can_fail:
            tests += [f"_x{k}.error IS NULL", f"_x{k}.version IS NOT NULL"]
        return q.all_of(tests)

    def confidence(self, i: int) -> str:
        own = self._fixed[i]
        return f"_x{self._job[i]}.confidence" if own is None else f"{own!r}D"

    def can_fail(self, i: int) -> bool:
        return bool(self.pack.rules[i].max_file_size) or self.jobs[self._job[i]].extractor.can_fail

    def error(self, i: int) -> str:
        rule, k, errors = self.pack.rules[i], self._job[i], []
        if rule.max_file_size:
            said = f"concat({q.text(f'rule {rule.name}: file size ')}, CAST(_size AS STRING), ' exceeds maximum {rule.max_file_size} bytes')"
            errors.append(f"CASE WHEN {self._applies[i]} AND _size > {rule.max_file_size} THEN {said} END")
        if self.jobs[k].extractor.can_fail:
            errors.append(f"CASE WHEN {self._open[i]} THEN concat({q.text(f'rule {rule.name}: parser error in rule {rule.name}: ')}, _x{k}.error) END")
        return q.nested("coalesce", errors, "CAST(NULL AS STRING)")

    def fields(self, i: int) -> dict[str, str]:
        """Rule ``i``'s result by field, where it found something; the source defaults to the file's name."""
        rule, x = self.pack.rules[i], f"_x{self._job[i]}"
        return {
            "rule_name": q.text(rule.name),
            "priority": str(rule.priority),
            "found": "TRUE",
            "version": f"{x}.version",
            "source": f"coalesce(nullif({x}.source, ''), file_name)",
            "confidence": self.confidence(i),
            "raw_value": f"{x}.raw_value",
            "metadata": f"{x}.metadata",
        }

    def flat(self, i: int) -> str:
        """Rule ``i``'s outcome, found or not, as a struct."""
        rule = self.pack.rules[i]
        missed = _NOTHING | {"rule_name": q.text(rule.name), "priority": str(rule.priority), "found": "FALSE"}
        return f"CASE WHEN {self.found(i)} THEN {q.struct(**self.fields(i))} ELSE {q.struct(**missed)} END"

    def chosen(self, position: str) -> dict[str, str]:
        """The result at a position that found something, by field; all are null for no position.

        Names, priorities and confidences are looked up by position, the rest is read from the job of the rule there.
        """

        def at(values: list[str], kind: str) -> str:
            return f"get(CAST(array({', '.join(values)}) AS ARRAY<{kind}>), {position})" if values else f"CAST(NULL AS {kind})"

        def by_job(field: str) -> str:
            cases = [f"WHEN {position} IN ({', '.join(map(str, job.rules))}) THEN _x{k}.{field}" for k, job in enumerate(self.jobs)]
            return f"CASE {' '.join(cases)} END" if cases else _NOTHING[field]

        confidences = [f"{c!r}D" if c is not None else "CAST(NULL AS DOUBLE)" for c in self._fixed]
        own = at(confidences, "DOUBLE") if any(c is not None for c in self._fixed) else "CAST(NULL AS DOUBLE)"
        return {
            "rule_name": at([q.text(r.name) for r in self.pack], "STRING"),
            "priority": at([str(r.priority) for r in self.pack], "INT"),
            "found": f"{position} IS NOT NULL",
            "version": by_job("version"),
            "source": f"CASE WHEN {position} IS NOT NULL THEN coalesce(nullif({by_job('source')}, ''), file_name) END",
            "confidence": f"coalesce({own}, {by_job('confidence')})" if None in self._fixed else own,
            "raw_value": by_job("raw_value"),
            "metadata": by_job("metadata"),
        }

    def first(self, tests: Sequence[str]) -> str:
        """Position of the first rule whose test holds; null if none does."""
        return q.nested("least", [f"CASE WHEN {test} THEN {i} END" for i, test in enumerate(tests)], "CAST(NULL AS INT)")

    def count(self, tests: Sequence[str]) -> str:
        """How many of the tests hold; those of rules for a single name only after the look-up said so."""

        def total(own: list[str]) -> str:
            return " + ".join(f"CAST(({t}) AS INT)" for t in own) or "0"

        free = total([t for t, a in zip(tests, self.always) if a])
        named = [t for t, a in zip(tests, self.always) if not a]
        return f"{free} + CASE WHEN _named THEN {total(named)} ELSE 0 END" if named else free

    def errors(self, position: str | None = None) -> str:
        """The first error, among rules tried before ``position`` if one was reached."""
        parts = []
        for i in range(len(self.pack)):
            if self.can_fail(i):
                error = self.error(i)
                parts.append(error if position is None else f"CASE WHEN {position} IS NULL OR {position} > {i} THEN {error} END")
        return q.nested("coalesce", parts, "CAST(NULL AS STRING)")


def rule_outcomes(files: DataFrame, pack: RulePack, pattern_mode: str = "glob") -> DataFrame:
    """One row per (file, applicable rule): found or not, with the result or the error."""
    tried = _Tried(files, pack.enabled(), pattern_mode)
    outcomes = [f"CASE WHEN {tried.applies(i)} THEN {q.struct(r=tried.flat(i), error=tried.error(i))} END" for i in range(len(tried.pack))]
    nothing = f"CAST(NULL AS STRUCT<r:{_FLAT},error:STRING>)"
    rows = tried.rows.selectExpr(*tried.keys, f"explode(array({', '.join([*outcomes, nothing])})) AS o").where("o is not null")
    return rows.select(*tried.keys, "o.r.*", "o.error")


def execute_rules(
    files: DataFrame,
    pack: RulePack,
    stop_on_first_match: bool = False,
    max_results: int = 0,
    min_confidence: float = 0.0,
    tags: Iterable[str] = (),
    pattern_mode: str = "glob",
    all_files: bool = False,
) -> DataFrame:
    """Every result of every file in priority order, one row per file.

    Columns: the file keys, ``results`` (array) and their number ``result_count``, ``best_result``, ``rules_applied`` and
    ``errors``.  Files no rule applies to are left out unless ``all_files``.
    """
    tried = _Tried(files, pack.enabled().tagged(tags), pattern_mode, all_files)
    n = len(tried.pack)
    hits = [q.all_of([tried.found(i), f"{tried.confidence(i)} >= {float(min_confidence)!r}D"]) if min_confidence > 0 else tried.found(i) for i in range(n)]
    limit = 1 if stop_on_first_match else max_results
    rows = tried.rows
    applies = [tried.applies(i) for i in range(n)]
    if limit > 0 and n:
        # What follows the hit that fills the limit would not have been tried.
        if limit == 1:
            last = tried.first(hits)
        else:
            last = f"get(sort_array(array({', '.join(f'CASE WHEN {h} THEN {i} ELSE {n} END' for i, h in enumerate(hits))})), {limit - 1})"
        rows = rows.selectExpr("*", f"coalesce({last}, {n}) AS _last")
        hits = [f"{h} AND _last >= {i}" for i, h in enumerate(hits)]
        applies = [f"({a} AND _last >= {i})" for i, a in enumerate(applies)]
    # Whether a rule found something is asked several times from here on.
    rows = rows.selectExpr("*", *[f"{h} AS _h{i}" for i, h in enumerate(hits)])
    hits = [f"_h{i}" for i in range(n)]
    confidences = [f"CASE WHEN {h} THEN {tried.confidence(i)} END" for i, h in enumerate(hits)]
    rows = rows.selectExpr("*", f"{q.nested('greatest', confidences, 'CAST(NULL AS DOUBLE)')} AS _top")
    best = tried.first([f"{h} AND {tried.confidence(i)} = _top" for i, h in enumerate(hits)])
    rows = rows.selectExpr("*", f"{best} AS _best")
    none, no_text = f"CAST(array() AS ARRAY<{_FLAT}>)", "CAST(array() AS ARRAY<STRING>)"
    results = [f"CASE WHEN {h} THEN array({q.struct(**tried.fields(i))}) ELSE {none} END" for i, h in enumerate(hits)]
    failed = [f"CASE WHEN {applies[i]} AND {tried.error(i)} IS NOT NULL THEN array({tried.error(i)}) ELSE {no_text} END" for i in range(n) if tried.can_fail(i)]
    return rows.selectExpr(
        *tried.keys,
        f"concat({', '.join([*results, none])}) AS results",
        f"{tried.count(hits)} AS result_count",
        f"{tried.count(applies)} AS rules_applied",
        f"concat({', '.join([*failed, no_text])}) AS errors",
        f"CASE WHEN _best IS NOT NULL THEN {q.struct(**tried.chosen('_best'))} END AS best_result",
    )


def rule_results(executed: DataFrame) -> DataFrame:
    """Results of :func:`execute_rules` as rows, with ``position`` counting from 1 within a file."""
    keys = [c for c in ("project_id", "file_path", "file_name") if c in executed.columns]
    # Exploding the bare column would infer a filter on its size, which moves down and works every result out twice.
    rows = executed.select(*keys, F.posexplode(F.slice("results", F.lit(1), F.size("results"))).alias("_pos", "r"))
    return rows.select(*keys, (F.col("_pos") + 1).cast("bigint").alias("position"), "r.*")


def _match(tried: _Tried, position: str, error: str, strict: bool) -> DataFrame:
    """A row per file with a hit or an error; without a hit, ``found`` is false and the result null."""
    rows = tried.rows.selectExpr("*", f"{position} AS _position").selectExpr("*", f"{error} AS _error")
    fields = tried.chosen("_position")
    if strict:
        fields = {c: f"CASE WHEN _error IS NULL THEN {v} END" for c, v in fields.items()} | {"found": "_error IS NULL AND _position IS NOT NULL"}
    row = q.struct(**fields, error="_error")
    # A filter would move down through the stages and work every one of them out a second time; a generator stays.
    kept = rows.selectExpr(*tried.keys, f"explode(CASE WHEN _position IS NOT NULL OR _error IS NOT NULL THEN array({row}) END) AS r")
    return kept.select(*tried.keys, "r.*")


def first_match(
    files: DataFrame,
    pack: RulePack,
    strict: bool = False,
    need_version: bool = False,
    pattern_mode: str = "glob",
) -> DataFrame:
    """The first rule, in priority order, that finds something; a file without a hit or an error gives no row.

    ``need_version`` (F10) passes over hits without a version.  ``error`` is the first error met on the way; ``strict``
    blanks the result then.  A file that has only errors has ``found`` false and no rule.
    """
    tried = _Tried(files, pack.enabled(), pattern_mode)
    n = range(len(tried.pack))
    hits = [q.all_of([tried.found(i), f"_x{tried._job[i]}.version != ''"]) if need_version else tried.found(i) for i in n]
    return _match(tried, tried.first(hits), tried.errors("_position"), strict)


def best_match(files: DataFrame, pack: RulePack, strict: bool = False, pattern_mode: str = "glob") -> DataFrame:
    """The result with the highest confidence, the earlier rule on ties; a file without a hit or an error gives no row."""
    tried = _Tried(files, pack.enabled(), pattern_mode)
    n = range(len(tried.pack))
    confidences = [f"CASE WHEN {tried.found(i)} THEN {tried.confidence(i)} END" for i in n]
    tried.rows = tried.rows.selectExpr("*", f"{q.nested('greatest', confidences, 'CAST(NULL AS DOUBLE)')} AS _top")
    position = tried.first([f"{c} = _top" for c in confidences])
    return _match(tried, position, tried.errors(), strict)


def matching_rules(files: DataFrame, pack: RulePack, pattern_mode: str = "glob") -> DataFrame:
    """J1, unrolled: one row per (file, applicable rule) in ``position`` order, from names and paths alone."""
    pack = pack.enabled()
    names = files.select(*_keys(files))
    tests = [_applies_sql(r, pattern_mode) for r in pack]
    hits = [f"CASE WHEN {t} THEN {q.struct(rule_name=q.text(r.name), priority=str(r.priority))} END" for t, r in zip(tests, pack)]
    nothing = "CAST(NULL AS STRUCT<rule_name:STRING,priority:INT>)"
    rows = names.where(F.expr(q.any_of(dict.fromkeys(tests)))).selectExpr(
        *names.columns, f"posexplode(array_compact(array({', '.join([*hits, nothing])}))) AS (_pos, r)"
    )
    return rows.select(*names.columns, (F.col("_pos") + 1).cast("bigint").alias("position"), "r.*")


def _join_key(rule: Rule) -> str | None:
    """Key under which a plain name or an extension pattern finds its files by equality, None for other rules."""
    pattern = rule.file_pattern
    if not pattern or rule.path_pattern:
        return None
    if rule_glob(pattern) is None:
        return "=" + pattern
    return pattern if pattern.startswith("*.") and rule_glob(pattern[1:]) is None else None


def _name_keys(name: Column) -> Column:
    """Keys of a file: its name and, as ``*.tar.gz`` and ``*.gz``, each of its extensions."""
    parts = F.split(name, r"\.")
    starts = F.when((F.size(parts) > 1) & ~name.contains("\n"), F.sequence(F.lit(2), F.size(parts)))
    extensions = F.transform(
        F.coalesce(starts, F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("*."), F.array_join(F.slice(parts, i, F.size(parts)), ".")),
    )
    return F.concat(F.array(F.concat(F.lit("="), name)), extensions)


def join_rules(files: DataFrame, pack: RulePack) -> DataFrame:
    """J1 as a join, for packs too long to unroll: a file's keys meet their rules by equality, in one scan of names.

    A plain name and each extension are keys; a rule with another pattern is tested on the spot and has a key of its own.
    Spark knows the size of the rule side and picks the join.
    """
    pack = pack.enabled()
    names = files.select(*_keys(files))
    name = F.col("file_name")
    keyed, others = [], []
    for i, rule in enumerate(pack):
        key = _join_key(rule)
        if key is None:
            key = f"#{i}"
            others.append(f"CASE WHEN {_applies_sql(rule, 'glob')} THEN '{key}' END")
        keyed.append((key, rule.name, rule.priority))
    rules = files.sparkSession.createDataFrame(keyed, "_key string, rule_name string, priority int")
    found = F.concat(_name_keys(name), F.expr(f"array({', '.join(others)})")) if others else _name_keys(name)
    rows = names.withColumn("_key", F.explode(F.array_distinct(found))).where("_key is not null")
    return rows.join(rules, "_key").select(*names.columns, "rule_name", "priority")
