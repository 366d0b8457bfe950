"""Extraction jobs P1-P14 as native column expressions, and the registry users extend.

A job is worked out in stages: each stage names columns over the file and over what earlier stages named, and a last step
describes the result.  Stages of all rules of a pack share one projection each, so no value is worked out twice and no
expression needs a lambda.  A factory takes a parser configuration and gives :class:`Stages`, or simply a function
``build(content, file_name) -> Column``; the result is a struct, or null when nothing was found.  Sizes, file patterns and
required content are the rule's business.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusrules.functions import manifests as m
from corpusrules.functions import text as t
from corpusrules.functions.patterns import Regex, regex
from corpusrules.functions.requirement_lines import requirement_labels
from corpusrules.functions.search_lines import line_test, matching_lines


class Given:
    """What a stage may use: ``content``, ``trimmed`` and ``name`` of the file, and earlier stages' columns by name."""

    def __init__(self, content: Column, trimmed: Column, name: Column, columns: Mapping[str, Column] | None = None):
        self.content, self.trimmed, self.name, self._columns = content, trimmed, name, dict(columns or {})

    def __getitem__(self, name: str) -> Column:
        return self._columns[name]

    def with_columns(self, columns: Mapping[str, Column]) -> Given:
        return Given(self.content, self.trimmed, self.name, {**self._columns, **columns})


Stage = Callable[[Given], dict[str, Column]]
Build = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Stages:
    """``steps`` one after the other, then ``describe``; columns of the first step are null for files out of question.

    ``confidence`` is set where the configuration gives every result the same one and says nothing else by it.
    """

    steps: tuple[Stage, ...]
    describe: Callable[[Given], Column]
    confidence: float | None = None


Factory = Callable[[Mapping[str, object]], "Stages | Build"]


@dataclass(frozen=True)
class Extractor:
    """A built extractor.  ``can_fail`` marks user extractors whose struct also has an ``error`` field."""

    stages: Stages
    can_fail: bool = False

    def build(self, content: Column, name: Column) -> Column:
        """The whole job as one expression, for use outside packs; values used twice are written out twice."""
        given = Given(content, t.trim_space(content), name)
        for step in self.stages.steps:
            given = given.with_columns(step(given))
        return self.stages.describe(given)


_FACTORIES: dict[str, tuple[Factory, bool]] = {}
_CONFIGURED: set[str] = set()


def register_extractor(kind: str, factory: Factory, can_fail: bool = False) -> None:
    """Make ``parser.type = kind`` available to rule packs.

    ``factory(config)`` returns ``build(content, file_name)``.  Its column may come from built-in functions or from a
    ``pandas_udf``; a struct with an extra string field ``error`` needs ``can_fail=True``.
    """
    _FACTORIES[kind] = (factory, can_fail)
    _CONFIGURED.discard(kind)


def is_built_in(kind: str) -> bool:
    """Whether a kind is this module's own, and not replaced by a user."""
    return BUILT_IN.get(kind) is not None and _FACTORIES.get(kind) is BUILT_IN[kind]


def extractor_kinds() -> list[str]:
    return sorted(_FACTORIES)


def extractor_factory(kind: str) -> Factory:
    if kind not in _FACTORIES:
        raise ValueError(f"unknown parser type: {kind}")
    return _FACTORIES[kind][0]


def job_of(kind: str, config: Mapping[str, object]) -> str:
    """Rules of one job get the same values from a file, if not the same confidence."""
    same = {k: v for k, v in config.items() if k != "confidence" or kind not in _CONFIGURED}
    return f"{kind} {json.dumps(same, sort_keys=True, default=repr)}"


def get_extractor(kind: str, config: Mapping[str, object] | None = None) -> Extractor:
    made = extractor_factory(kind)(config or {})
    if not isinstance(made, Stages):
        build = made
        made = Stages((lambda given: {"made": build(given.content, given.name)},), lambda given: given["made"])
    return Extractor(made, _FACTORIES[kind][1])


def extractor(kind: str, *steps: Stage):
    """Decorator for the last step of extractors that take no configuration."""

    def wrap(describe: Callable[[Given], Column]) -> Callable[[Given], Column]:
        register_extractor(kind, lambda config: Stages(steps, describe))
        return describe

    return wrap


def result(version: Column, source: Column, confidence: float | Column, raw: Column, **metadata: str | Column) -> Column:
    """A result struct; metadata entries whose column is null are left out."""
    values = {k: v if isinstance(v, Column) else F.lit(v) for k, v in metadata.items()}
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    entries = F.create_map(*pairs).cast("map<string,string>")
    confidence = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(
        version.alias("version"),
        source.alias("source"),
        confidence.alias("confidence"),
        raw.alias("raw_value"),
        entries.alias("metadata"),
    )


def filled_map(**entries: Column) -> Column:
    """A map of the entries that are not null; one small map per entry, so no lambda runs over them."""
    parts = [F.when(v.isNotNull(), F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,string>")) for k, v in entries.items()]
    return F.map_concat(*parts)


def found(describe: Callable[[Given], Column]) -> Callable[[Given], Column]:
    """The result where the stages found a ``version``, else null."""
    return lambda given: F.when(given["version"] != "", describe(given))


def raw_then_version(raw: Callable[[Given], Column], version: Callable[[Column], Column]) -> tuple[Stage, Stage]:
    """The two stages of most jobs: a raw value, and the version in it."""
    return lambda given: {"raw": raw(given)}, lambda given: {"version": version(given["raw"])}


# -- P1, P2: files that hold nothing but a version ---------------------------------------------------------------------

# Fixed values from here on: the confidence and the metadata of each kind of finding.


def _without(given: Given, *prefixes: str) -> Column:
    text = given.trimmed
    for prefix in prefixes:
        text = t.drop_prefix(text, prefix)
    return text


@extractor("python_version_file", *raw_then_version(lambda g: _without(g, "python-", "Python-", "py"), t.leading_version))
@found
def python_version_file(given: Given) -> Column:
    return result(given["version"], given.name, 1.0, given["raw"], source_type="explicit_version_file")


@extractor("runtime_txt", *raw_then_version(lambda g: _without(g, "python-", "Python-"), t.leading_version))
@found
def runtime_txt(given: Given) -> Column:
    return result(given["version"], given.name, 0.95, given.content, source_type="heroku_runtime")


# -- P3-P5: packaging manifests ------------------------------------------------------------------------------------------

SETUP_PY = regex(r"""python_requires\s*=\s*['"]([^'"]+)['"]""")


@extractor("setup_py", *raw_then_version(lambda g: SETUP_PY.group(g.content, 1), t.constraint_version))
@found
def setup_py(given: Given) -> Column:
    return result(given["version"], given.name, 0.9, given["raw"], source_type="setup_py", constraint=given["raw"])


@extractor(
    "pipfile",
    lambda g: {"read": m.read_manifest(g.content)},
    *raw_then_version(
        lambda g: F.coalesce(
            *[t.blank_to_null(m.text_of(_sound(g["read"]), f"requires.{key}")) for key in ("python_full_version", "python_version")], F.lit("")
        ),
        t.leading_version,
    ),
)
@found
def pipfile(given: Given) -> Column:
    return result(given["version"], given.name, 0.9, given["raw"], source_type="pipfile", format="pipenv")


def _sound(read: Column) -> Column:
    """The entries of a manifest, null if it is broken."""
    return F.when(~read["broken"], read["entries"])


_POETRY = "tool.poetry.dependencies"
_TABLE_VERSION = r"""\A\{(?:[^}]*?[,\s])?version[ \t]*=[ \t]*["']([^"'\n]*)["']"""


def _positive(n: Column) -> Column:
    return F.when(n > 0, n.cast("string"))


def _pyproject_raw(given: Given) -> dict[str, Column]:
    entries = given["entries"]
    plain, table = m.text_of(entries, f"{_POETRY}.python"), F.regexp_extract(F.coalesce(m.value_of(entries, f"{_POETRY}.python"), F.lit("")), _TABLE_VERSION, 1)
    own = m.text_of(entries, f"{_POETRY}.python.version")
    return {
        "standard": m.text_of(entries, "project.requires-python"),
        "tool": F.coalesce(*[t.blank_to_null(c) for c in (plain, table, own)], F.lit("")),
    }


@extractor(
    "pyproject_toml",
    # A file that cannot be TOML gives nothing.
    lambda g: {"read": m.read_manifest(g.content)},
    lambda g: {"entries": _sound(g["read"])},
    _pyproject_raw,
    lambda g: {"version": t.constraint_version(g["standard"]), "tool_version": t.constraint_version(g["tool"])},
)
def pyproject_toml(given: Given) -> Column:
    def constrained(version: str, form: str, raw: str, dependencies: Column) -> Column:
        entries = filled_map(format=F.lit(form), constraint=given[raw], dependency_count=_positive(dependencies))
        made = result(given[version], given.name, 0.9, given[raw]).withField("metadata", entries)
        return F.when(given[version] != "", made)

    listed = m.value_of(given["entries"], "project.dependencies")
    return F.coalesce(
        constrained("version", "PEP621", "standard", F.size(m.items_of(listed))),
        constrained("tool_version", "Poetry", "tool", F.size(m.keys_below(given["entries"], _POETRY)) - 1),
    )


# -- P6-P8: images and test environments -------------------------------------------------------------------------------

# White space that can occur inside one line.
_IN_LINE = t.WHITE_SPACE.replace("\n", "")
_FROM_IMAGE = rf"FROM[\t\f\r ]+python:({t.VERSION})"
_FROM_PYTHON = rf"(?:\A|\n)[{_IN_LINE}]*({_FROM_IMAGE}[^\n]*)"


@extractor(
    "dockerfile",
    *raw_then_version(
        lambda g: t.trim_space(F.regexp_extract(g.content, _FROM_PYTHON, 1)),
        lambda line: F.regexp_extract(line, rf"\A{_FROM_IMAGE}", 1),
    ),
)
@found
def dockerfile(given: Given) -> Column:
    return result(given["version"], given.name, 0.8, given["raw"], source_type="dockerfile", from_image=given["raw"])


CI_IMAGE = regex(rf"image:\s*python:({t.VERSION})")


@extractor("gitlab_ci", *raw_then_version(lambda g: CI_IMAGE.group(g.content, 0), t.constraint_version))
@found
def gitlab_ci(given: Given) -> Column:
    return result(given["version"], given.name, 0.75, given["raw"], source_type="gitlab_ci", image=given["raw"])


TOX_ENVLIST = regex(r"envlist\s*=\s*([^\n]+)")


@extractor(
    "tox_ini",
    lambda g: {"quoted": m.text_of(m.read_manifest(g.content, ini=True)["entries"], "tox.envlist"), "plain": TOX_ENVLIST.group(g.content, 1)},
    lambda g: {"version": t.tox_env_version(g["quoted"]), "plain_version": t.tox_env_version(g["plain"])},
)
def tox_ini(given: Given) -> Column:
    def listed(version: str, raw: str) -> Column:
        made = result(given[version], given.name, 0.7, given[raw], source_type="tox_ini", envlist=given[raw])
        return F.when(given[version] != "", made)

    return F.coalesce(listed("version", "quoted"), listed("plain_version", "plain"))


# -- P9, P10: requirements files --------------------------------------------------------------------------------------

# The three ways a comment names its Python version, tried in this order on each line.
_COMMENT_VERSIONS = (
    rf"#[\t\f\r ]*[Pp]ython[\t\f\r ]+({t.VERSION})",
    rf"#[\t\f\r ]*[Rr]equires[\t\f\r ]+[Pp]ython[\t\f\r ]*[><=]+[\t\f\r ]*({t.VERSION})",
    rf"#[\t\f\r ]*[Pp]y[\t\f\r ]*[><=]+[\t\f\r ]*({t.VERSION})",
)
_COMMENT_LINE = r"(?:\A|\n)((?:" + "|".join(r"[^\n]*?" + p for p in _COMMENT_VERSIONS) + r")[^\n]*)"


def comment_version_line(content: Column) -> Column:
    """First line with a version comment, '' when there is none."""
    line = F.regexp_replace(F.regexp_extract(content, _COMMENT_LINE, 1), r"\r\z", "")
    return F.when(content.contains("#"), line).otherwise("")


def comment_version(line: Column) -> Column:
    return F.coalesce(*[t.blank_to_null(F.regexp_extract(line, p, 1)) for p in _COMMENT_VERSIONS], F.lit(""))


@extractor("requirements_comment", *raw_then_version(lambda g: comment_version_line(g.content), comment_version))
@found
def requirements_comment(given: Given) -> Column:
    return result(given["version"], given.name, 0.6, given["raw"], source_type="requirements_comment")


@extractor(
    "requirements_dependencies",
    lambda g: {"line": comment_version_line(g.content), "labels": requirement_labels(g.content)},
    lambda g: {"version": comment_version(g["line"]), "count": F.size(g["labels"])},
)
def requirements_dependencies(given: Given) -> Column:
    has_version, count = given["line"] != "", given["count"]
    entries = filled_map(
        python_version_source=F.when(has_version, "comment"),
        dependency_count=_positive(count),
        has_dependencies=F.when(count > 0, "true"),
        source_type=F.when(has_version, "requirements_txt").otherwise("dependencies_only"),
        **{f"dependency_{i + 1}": F.get(given["labels"], F.lit(i)) for i in range(5)},
    )
    made = result(given["version"], given.name, F.when(has_version, 0.6).otherwise(0.5), given["line"])
    return F.when(has_version | (count > 0), made.withField("metadata", entries))


# -- P12-P14: extractors that rule packs configure ---------------------------------------------------------------------


def _as_bool(value: object, default: bool) -> bool:
    if value is None:
        return default
    return value if isinstance(value, bool) else str(value).strip().lower() == "true"


def _as_float(value: object, default: float) -> float:
    return default if value is None else float(value)


def version_group(pattern: Regex, name: str) -> int:
    """Index of the group holding the version: the named one, else the first, else the whole match."""
    return pattern.names.get(name, min(pattern.groups, 1))


def regex_extractor(config: Mapping[str, object]) -> Stages:
    if not config.get("pattern"):
        raise ValueError("regex parser requires 'pattern' string in config")
    pattern = regex(str(config["pattern"]))
    index = version_group(pattern, str(config.get("version_group") or "version"))
    confidence = _as_float(config.get("confidence"), 0.5)

    def raw(given: Given) -> dict[str, Column]:
        group, guard = pattern.group(given.content, index), pattern.may_occur_in(given.content)
        return {"raw": group if guard is None else F.when(guard, group)}

    def describe(given: Given) -> Column:
        return F.when(given["raw"] != "", result(t.trim_space(given["raw"]), given.name, confidence, given["raw"]))

    return Stages((raw,), describe, confidence)


def simple_version_extractor(config: Mapping[str, object]) -> Stages:
    confidence = _as_float(config.get("confidence"), 1.0)
    trim = _as_bool(config.get("trim_whitespace"), True)

    def describe(given: Given) -> Column:
        version = given.trimmed if trim else given.content
        return F.when(version != "", result(version, given.name, confidence, version))

    return Stages((), describe, confidence)


def string_search_extractor(config: Mapping[str, object]) -> Stages:
    if not config.get("search_term"):
        raise ValueError("string_search parser requires 'search_term' string in config")
    limit = int(_as_float(config.get("max_matches"), 0))
    test = line_test(str(config["search_term"]), _as_bool(config.get("is_regex"), False), _as_bool(config.get("case_sensitive"), False))

    def describe(given: Given) -> Column:
        count, first = F.size(given["hits"]), given["first"]
        made = result(
            test.matched_text(first["line"]),
            given.name,
            0.0,
            t.strip_cr(first["line"]),
            match_count=(F.least(count, F.lit(limit)) if limit > 0 else count).cast("string"),
            line_number=(first["i"] + 1).cast("string"),
        )
        return F.when(count > 0, made)

    return Stages(
        (lambda g: {"hits": matching_lines(g.content, test)}, lambda g: {"first": F.get(g["hits"], F.lit(0))}), describe
    )


register_extractor("regex", regex_extractor)
register_extractor("simple_version", simple_version_extractor)
register_extractor("string_search", string_search_extractor)

#: Kinds whose ``confidence`` option is their results' confidence, and kinds whose results need no casts.
_CONFIGURED |= {"regex", "simple_version"}
BUILT_IN = dict(_FACTORIES)
