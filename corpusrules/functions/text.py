"""Text helpers shared by the extraction and search jobs; every one is a native column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusrules.functions.patterns import java_quote

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

VERSION = r"\d+\.\d+(?:\.\d+)?"


def trim_space(col: Column) -> Column:
    return F.trim(col, F.lit(WHITE_SPACE))


def strip_cr(col: Column) -> Column:
    return F.rtrim(col, F.lit("\r"))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def drop_prefix(col: Column, prefix: str) -> Column:
    """Text without the prefix, once; ``col`` is mentioned a single time, so chains of these stay short."""
    return F.regexp_replace(col, r"\A" + java_quote(prefix), "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def as_text(content: Column) -> Column:
    """Content as a string without validating its encoding; broken bytes stay as they are."""
    return content.cast("string")


# -- H1-H3: versions -------------------------------------------------------------------------------------------------


def leading_version(col: Column) -> Column:
    """Version at the very start of the trimmed text, '' when there is none."""
    return F.regexp_extract(trim_space(col), rf"\A({VERSION})", 1)


def constraint_version(col: Column) -> Column:
    """First version anywhere in a constraint such as ``>=3.10,<4``, '' when there is none."""
    return F.regexp_extract(col, rf"({VERSION})", 1)


def tox_env_version(col: Column) -> Column:
    """``py311`` -> ``3.11`` for the first such environment, '' when there is none."""
    env = r"py(\d)(\d+)"
    return F.when(col.rlike(env), F.concat_ws(".", F.regexp_extract(col, env, 1), F.regexp_extract(col, env, 2))).otherwise("")


# -- H4: sections and keys of ini-like manifests ----------------------------------------------------------------------


def section_body(content: Column, header: str) -> Column:
    """Text between ``[header]`` and the next header, '' when the section is missing."""
    name = header.replace(".", r"\.")
    return F.regexp_extract(content, rf"(?msd)^[ \t]*\[{name}\][^\n]*\n(.*?)(?:^[ \t]*\[|\z)", 1)


def quoted_value(section: Column, key: str) -> Column:
    """Value of ``key = "text"``, '' when missing."""
    return F.regexp_extract(section, rf"""(?md)^[ \t]*{key}[ \t]*=[ \t]*["']([^"'\n]*)["']""", 1)


def list_items(section: Column, key: str) -> Column:
    """Quoted items of ``key = [ ... ]``, over as many lines as the list takes."""
    body = F.regexp_extract(section, rf"(?msd)^[ \t]*{key}[ \t]*=[ \t]*\[(.*?)\][ \t\r]*(?:#[^\n]*)?$", 1)
    code = F.regexp_replace(body, r"(?md)^[ \t]*#[^\n]*", "")
    return F.regexp_extract_all(code, F.lit(r"""("[^"]*"|'[^']*')"""), F.lit(1))


def key_count(section: Column) -> Column:
    return F.regexp_count(section, F.lit(r"(?md)^[ \t]*([A-Za-z0-9_.-]+)[ \t]*="))
