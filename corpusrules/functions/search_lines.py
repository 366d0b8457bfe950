"""Line tests behind content search (C1, C2) and search-as-rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusrules.functions.patterns import Regex, folded_literal, regex


@dataclass(frozen=True)
class LineTest:
    """One search term compiled to columns; built by :func:`line_test`.  Without a pattern the term is found as bytes."""

    term: str
    pattern: Regex | None
    literal: bool

    def may_occur_in(self, content: Column) -> Column | None:
        """Cheap whole-file condition every file with a matching line meets; lets files go before they are split."""
        return self.matches(content) if self.literal else self.pattern.may_occur_in(content)

    def matches(self, line: Column) -> Column:
        return F.contains(line, F.lit(self.term)) if self.pattern is None else self.pattern.found_in(line)

    def matched_text(self, line: Column) -> Column:
        """Text of the first match, to be read only where :meth:`matches` holds."""
        return F.lit(self.term) if self.pattern is None else self.pattern.group(line)


def line_test(term: str, is_regex: bool = False, case_sensitive: bool = False) -> LineTest:
    if not term:
        raise ValueError("search term cannot be empty")
    if is_regex:
        return LineTest(term, regex(term, not case_sensitive), False)
    return LineTest(term, None if case_sensitive else folded_literal(term), True)


def matching_lines(content: Column, test: LineTest) -> Column:
    """The matching lines of a text as structs of ``line`` and ``i`` (from 0); null where none can match."""
    numbered = F.transform(F.split(content, "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    hits = F.filter(numbered, lambda x: test.matches(x["line"]))
    gate = test.may_occur_in(content)
    return hits if gate is None else F.when(gate, hits)
