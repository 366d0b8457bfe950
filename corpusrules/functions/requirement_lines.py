"""Parsing one trimmed line of a pip requirements file, as native columns over that line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusrules.functions.text import drop_prefix, trim_space

COLUMNS = ("name", "specifier", "extras", "markers", "hashes", "is_editable", "is_requirement_file", "comment")

_NAME_AND_SPECIFIER = r"\A([a-zA-Z0-9_-]+)([^\n]*)\z"
# Extras count only where the first bracket of the line opens them.
_EXTRAS = r"\A([^\[\]]*)\[([^\]]*)\]"


def _before(text: Column, mark: str) -> Column:
    return trim_space(F.substring_index(text, mark, 1))


def _after(text: Column, mark: str) -> Column:
    at = F.locate(mark, text)
    return F.when(at > 0, trim_space(F.substr(text, at + 1))).otherwise("")


def is_editable(line: Column) -> Column:
    return line.startswith("-e ") | line.startswith("--editable ")


def _target(line: Column) -> Column:
    """What an editable line installs; its ``#`` belongs to the URL."""
    return trim_space(F.regexp_replace(line, r"\A(?:-e|--editable) ", ""))


def _body(line: Column) -> Column:
    return _before(line, "#")


def is_requirement_file(line: Column) -> Column:
    body = _body(line)
    return body.startswith("-r ") | body.startswith("--requirement ")


def _package(line: Column) -> Column:
    """Name, extras and specifier: what precedes comment, hashes and markers."""
    return _before(_before(_body(line), "--hash"), ";")


def _named(line: Column, group: int) -> Column:
    return F.regexp_extract(F.regexp_replace(_package(line), _EXTRAS, "$1"), _NAME_AND_SPECIFIER, group)


def name(line: Column) -> Column:
    """Package name, or an editable line's target; '' for options, ``-r`` lines and what cannot be read."""
    return F.when(is_editable(line), _target(line)).when(line.startswith("-"), "").otherwise(_named(line, 1))


def specifier(line: Column) -> Column:
    return F.when(line.startswith("-"), "").otherwise(trim_space(_named(line, 2)))


def _hashes(line: Column) -> Column:
    parts = F.split(_body(line), "--hash")
    values = F.transform(
        F.slice(parts, F.lit(2), F.size(parts) - 1),
        lambda part: drop_prefix(trim_space(F.substring_index(part, " ", 1)), "="),
    )
    return F.when(F.size(parts) > 1, F.filter(values, lambda h: h != ""))


def _extras(line: Column) -> Column:
    package = _package(line)
    inner = F.regexp_extract(package, _EXTRAS, 2)
    return F.when(package.rlike(_EXTRAS), F.transform(F.split(inner, ","), trim_space))


def requirement_columns(line: Column) -> dict[str, Column]:
    """All parts of a requirement line by column name."""
    plain = ~line.startswith("-")
    nothing = F.array().cast("array<string>")
    return {
        "name": name(line),
        "specifier": specifier(line),
        "extras": F.coalesce(F.when(plain, _extras(line)), nothing),
        "markers": F.when(plain, _after(_before(_body(line), "--hash"), ";")).otherwise(""),
        "hashes": F.coalesce(F.when(plain, _hashes(line)), nothing),
        "is_editable": is_editable(line),
        "is_requirement_file": is_requirement_file(line),
        "comment": F.when(is_editable(line), "").otherwise(_after(line, "#")),
    }


def requirement_labels(content: Column) -> Column:
    """``name + specifier`` of every requirement of one file, in line order, as an array."""
    lines = F.transform(F.split(content, "\n"), trim_space)
    labels = F.transform(lines, lambda line: F.concat(name(line), specifier(line)))
    return F.filter(labels, lambda label: label != "")
