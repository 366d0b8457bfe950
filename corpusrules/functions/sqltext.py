"""Pieces of SQL text.  A long expression costs one call into the JVM as text, but several calls per node as columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

_PLAIN = re.compile(r"[A-Za-z0-9 _.:,;/*+=<>()#@!%&|~\[\]{}?^$-]*")


def text(value: str) -> str:
    """A string literal, whatever the session says about escapes."""
    return f"'{value}'" if _PLAIN.fullmatch(value) else f"CAST(X'{value.encode().hex()}' AS STRING)"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def any_of(tests: Iterable[str]) -> str:
    return " OR ".join(f"({t})" for t in tests) or "FALSE"


def all_of(tests: Iterable[str]) -> str:
    return " AND ".join(f"({t})" for t in tests) or "TRUE"


def nested(function: str, values: list[str], otherwise: str) -> str:
    """``function`` of all values; of one it is the value, of none ``otherwise``."""
    return otherwise if not values else values[0] if len(values) == 1 else f"{function}({', '.join(values)})"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
