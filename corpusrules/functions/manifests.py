"""H4: manifests as entries ``(line, path, value, quoted)``, by a fold over the lines of a file.

The fold carries the section, and what is open: a text of several lines, or a list or table with brackets to close.  A path is section and key with dots between; quotes
and blanks around its parts go.  Values of several lines are one value; comments in lists go.  ``quoted`` says that a value is a text, which then stands without its quotes.  A file
is ``broken`` if a line is neither header, nor key with a value, nor comment, or if something is left open.  The ``ini`` dialect knows no texts of several lines, but lines that go on by being
indented, and nothing in it is broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrules.functions.text import as_text, trim_space

ENTRIES = "array<struct<line:int,path:string,value:string,quoted:boolean>>"

_KEY = r"""(?:[A-Za-z0-9_-]++|"[^"\n]*+"|'[^'\n]*+')"""
_DOTTED = rf"{_KEY}(?:[ \t]*\.[ \t]*{_KEY})*+"
_HEADER = rf"\A[ \t]*\[\[?[ \t]*({_DOTTED})[ \t]*\]\]?[ \t]*(?:#.*)?\z"
_PAIR = rf"\A[ \t]*({_DOTTED})[ \t]*=[ \t]*(.*)\z"
_INI_HEADER = r"\A\[([^\]]*)\]"
_INI_PAIR = r"\A([^\s=:#;\[][^=:]*?)[ \t]*[=:][ \t]*(.*)\z"
# A text within one line; the loops give nothing back, so long texts need no stack.
_TEXT = r"""(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^']*+')"""
_TEXT_OR_COMMENT = rf"({_TEXT})|#.*"
_PLAIN = r"[A-Za-z0-9+_.:-][A-Za-z0-9+_.: -]*?"
_WHOLE = rf"\A(?:{_TEXT}|{_PLAIN}|\[.*\]|\{{.*\}})[ \t]*(?:#.*)?\z"
_LONG = {1: '"""', 2: "'''"}
_OUTSIDE, _NESTED = 0, 3


def _change(line: Column) -> Column:
    """Brackets that a line opens, less those that it closes, outside texts and comments."""
    bare = F.regexp_replace(line, _TEXT_OR_COMMENT, "")
    return F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))


def _without_comment(line: Column) -> Column:
    return F.regexp_replace(line, _TEXT_OR_COMMENT, "$1")


def _path(section: Column, key: Column) -> Column:
    parts = F.regexp_replace(F.regexp_replace(key, r"[ \t]*\.[ \t]*", "."), r"""["']""", "")
    return F.when(section == "", parts).otherwise(F.concat(section, F.lit("."), parts))


def _entry(line: Column, path: Column, value: Column, quoted: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), path.alias("path"), value.alias("value"), quoted.alias("quoted"))


def _state(old: Column, **new: Column) -> Column:
    """``old`` with some fields replaced."""
    names = ("section", "key", "text", "mode", "depth", "line", "broken", "entries")
    return F.struct(*[(new[n] if n in new else old[n]).alias(n) for n in names])


def _added(s: Column, line: Column, path: Column, value: Column, quoted: Column) -> Column:
    return F.array_append(s["entries"], _entry(line, path, value, quoted))


def _short(s: Column, x: Column, section: Column, key: Column, value: Column) -> Column:
    """The state after a key whose value ends with its line, or opens something."""
    path = _path(section, key)
    states = []
    for mode, mark in _LONG.items():
        rest = F.substr(value, F.lit(4))
        ended = _state(s, entries=_added(s, x["i"], path, F.substring_index(rest, mark, 1), F.lit(True)))
        opened = _state(s, key=path, text=rest, mode=F.lit(mode), line=x["i"])
        states.append((value.startswith(mark), F.when(rest.contains(mark), ended).otherwise(opened)))
    opened = _state(s, key=path, text=_without_comment(value), mode=F.lit(_NESTED), depth=_change(value), line=x["i"])
    states.append((value.rlike(r"\A[\[{]") & (_change(value) > 0), opened))
    plain = F.rtrim(_without_comment(value))
    quoted = plain.rlike(rf"\A{_TEXT}\z")
    held = F.when(quoted, F.substr(plain, F.lit(2), F.length(plain) - 2)).otherwise(plain)
    whole = _state(s, entries=_added(s, x["i"], path, held, quoted))
    states.append((value.rlike(_WHOLE), whole))
    chosen = F.when(*states[0])
    for test, state in states[1:]:
        chosen = chosen.when(test, state)
    return chosen.otherwise(_state(s, broken=F.lit(True)))


def _toml_step(s: Column, x: Column) -> Column:
    line = x["raw"]
    header = F.regexp_extract(line, _HEADER, 1)
    key, value = F.regexp_extract(line, _PAIR, 1), F.regexp_extract(line, _PAIR, 2)
    outside = (
        F.when(line.rlike(r"\A[ \t]*(?:#.*)?\z"), s)
        .when(header != "", _state(s, section=_path(F.lit(""), header)))
        .when(key != "", _short(s, x, s["section"], key, value))
        .otherwise(_state(s, broken=F.lit(True)))
    )
    more = F.concat(s["text"], F.lit("\n"), line)
    mark = F.when(s["mode"] == 1, F.lit(_LONG[1])).otherwise(F.lit(_LONG[2]))
    before = F.when(s["mode"] == 1, F.substring_index(line, _LONG[1], 1)).otherwise(F.substring_index(line, _LONG[2], 1))
    text = F.when(
        F.contains(line, mark), _state(s, mode=F.lit(_OUTSIDE), entries=_added(s, s["line"], s["key"], F.concat(s["text"], F.lit("\n"), before), F.lit(True)))
    ).otherwise(_state(s, text=more))
    depth = s["depth"] + _change(line)
    inside = F.concat(s["text"], F.lit("\n"), _without_comment(line))
    nested = F.when(depth <= 0, _state(s, mode=F.lit(_OUTSIDE), entries=_added(s, s["line"], s["key"], inside, F.lit(False)))).otherwise(
        _state(s, text=inside, depth=depth)
    )
    return F.when(s["mode"] == _OUTSIDE, outside).when(s["mode"] == _NESTED, nested).otherwise(text)


def _ini_step(s: Column, x: Column) -> Column:
    line = x["raw"]
    header, key, value = F.regexp_extract(line, _INI_HEADER, 1), F.regexp_extract(line, _INI_PAIR, 1), F.rtrim(F.regexp_extract(line, _INI_PAIR, 2))
    quoted = value.rlike(rf"\A{_TEXT}\z")
    held = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    last = F.element_at(s["entries"], -1)
    grown = _entry(last["line"], last["path"], F.concat_ws("\n", last["value"], trim_space(line)), F.lit(False))
    going_on = line.rlike(r"\A[ \t]+\S") & (s["mode"] == _NESTED)
    return (
        F.when(going_on, _state(s, entries=F.array_append(F.slice(s["entries"], F.lit(1), F.size(s["entries"]) - 1), grown)))
        .when(line.rlike(_INI_HEADER), _state(s, section=trim_space(header), mode=F.lit(_OUTSIDE)))
        .when(key != "", _state(s, mode=F.lit(_NESTED), entries=_added(s, x["i"], F.concat_ws(".", F.when(s["section"] != "", s["section"]), key), held, quoted)))
        .otherwise(s)
    )


def read_manifest(content: Column, ini: bool = False) -> Column:
    """A struct of ``entries`` and ``broken``; null for null."""
    lines = F.transform(F.split(content, "\n"), lambda raw, i: F.struct((i + 1).alias("i"), F.regexp_replace(raw, r"\r\z", "").alias("raw")))
    nothing, empty = F.lit(""), F.array().cast(ENTRIES)
    start = F.struct(
        nothing.alias("section"), nothing.alias("key"), nothing.alias("text"), F.lit(_OUTSIDE).alias("mode"), F.lit(0).alias("depth"), F.lit(0).alias("line"), F.lit(False).alias("broken"), empty.alias("entries")
    )

    def finish(s: Column) -> Column:
        broken = F.lit(False) if ini else s["broken"] | (s["mode"] != _OUTSIDE)
        return F.struct(s["entries"].alias("entries"), broken.alias("broken"))

    return F.aggregate(lines, start, _ini_step if ini else _toml_step, finish)


def value_of(entries: Column, path: str) -> Column:
    """The first value at a path, null without one."""
    return F.get(F.filter(entries, lambda e: e["path"] == path), F.lit(0))["value"]


def text_of(entries: Column, path: str) -> Column:
    """The same for texts, '' without one."""
    return F.coalesce(F.get(F.filter(entries, lambda e: (e["path"] == path) & e["quoted"]), F.lit(0))["value"], F.lit(""))


def items_of(value: Column) -> Column:
    """The texts of a list."""
    return F.regexp_extract_all(value, F.lit(f"({_TEXT})"), F.lit(1))


def keys_below(entries: Column, path: str) -> Column:
    """Distinct keys of a table, whether they are given in its section, by dotted keys or by sections of their own."""
    below = F.filter(entries, lambda e: e["path"].startswith(path + "."))
    return F.array_distinct(F.transform(below, lambda e: F.substring_index(F.substr(e["path"], F.lit(len(path) + 2)), ".", 1)))


def manifest_lines(files: DataFrame, ini: bool = False) -> DataFrame:
    """H4 as a relation: one row per entry, with the file's keys, ``line``, ``path``, ``value``, ``quoted``, and whether the file is ``broken``."""
    keys = [c for c in ("project_id", "file_path") if c in files.columns]
    read = files.select(*keys, read_manifest(as_text(F.col("content")), ini).alias("m"))
    return read.select(*keys, F.col("m.broken").alias("broken"), F.inline("m.entries"))
