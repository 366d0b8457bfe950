"""C7 for very many searches: one gate per file says which of them can match which of its lines, and only those pairs are tested.

The gate finds the strings that searches ask for (``functions.trigrams``) in a file, all at once, and says which lines hold what a search needs.  Searches are rows: a line
meets those that the gate names by number, and every pair is tested by the pattern in the search's row.  A file is split once, and only lines that may match leave it.  The
plan does not grow with the number of searches, and neither does the work for a file that few can match.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusrules.functions import trigrams as G
from corpusrules.functions.patterns import java_quote, search_glob
from corpusrules.functions.search_lines import line_test
from corpusrules.functions.text import as_text, base_name, strip_cr
from corpusrules.operators.search import MATCH_COLUMNS, apply_caps
from corpusrules.rulepack import Search

#: Searches that one table may hold; what a search holds is short.
MOST_SEARCHES = 100_000
#: First bytes of a string that are looked up as a number, and bytes of a text that are looked up at a time.
_HEAD, _STRETCH = 8, 1 << 18
_NEVER = "(?!)"
_PART = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("part", T.BinaryType()), T.StructField("searches", T.ArrayType(T.IntegerType()))])


def _row(number: int, search: Search) -> tuple:
    test = line_test(search.term, search.is_regex, search.case_sensitive)
    globs = [g for g in map(search_glob, search.file_patterns) if g is not None]
    names = "|".join(f"(?:{g})" for g in globs) or _NEVER if search.file_patterns else None
    return number, search.name, java_quote(search.term) if test.pattern is None else test.pattern.java, names, search.max_file_size or None


class _Terms:
    """Finds very many strings of two bytes and more in a text at once, by their first bytes (eight at most) as a number."""

    def __init__(self, terms: Sequence[bytes]):
        self.terms = terms
        heads: dict[int, dict[int, list[int]]] = {}
        for k, term in enumerate(terms):
            size = min(len(term), _HEAD)
            heads.setdefault(size, {}).setdefault(int.from_bytes(term[:size], "big"), []).append(k)
        self.heads = {}
        for size, own in heads.items():
            # Most numbers of a text are in no slot that a term's number is in.
            bits = max(10, (16 * len(own)).bit_length())
            slots = np.zeros(1 << bits, bool)
            slots[self._slot(np.array(list(own), np.uint64), bits)] = True
            self.heads[size] = bits, slots, own

    @staticmethod
    def _slot(codes: np.ndarray, bits: int) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def lines(self, text: bytes) -> dict[int, set[int]]:
        """The terms that occur, by number, with the lines where they do, from 0."""
        terms, places = [], []
        for start in range(0, len(text), _STRETCH):
            data = np.frombuffer(text[start : start + _STRETCH + _HEAD - 1], np.uint8).astype(np.uint64)
            codes = data
            for size in range(2, min(_HEAD, len(data)) + 1):
                codes = codes[:-1] << np.uint64(8) | data[size - 1 :]
                if size not in self.heads:
                    continue
                bits, slots, own = self.heads[size]
                here = codes[:_STRETCH]
                at = np.flatnonzero(slots[self._slot(here, bits)])
                for place, code in zip((at + start).tolist(), here[at].tolist()):
                    for k in own.get(code, ()):
                        if len(self.terms[k]) <= _HEAD or text.startswith(self.terms[k], place):
                            terms.append(k)
                            places.append(place)
        breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == ord("\n")) if places else []
        found: dict[int, set[int]] = {}
        for k, line in zip(terms, np.searchsorted(breaks, places).tolist()):
            # No line holds a line end.
            if b"\n" not in self.terms[k]:
                found.setdefault(k, set()).add(line)
        return found


def _strings(condition: G.Condition) -> list[str]:
    """All strings that a condition mentions."""
    if isinstance(condition, bool):
        return []
    return [condition] if isinstance(condition, str) else [s for c in condition[1] for s in _strings(c)]


def _numbered(condition: G.Condition, numbers: dict[str, int]) -> int | tuple:
    """A condition with numbers for its strings."""
    return numbers[condition] if isinstance(condition, str) else (condition[0], tuple(_numbered(c, numbers) for c in condition[1]))


def _asked(condition: int | tuple, used: dict[int, int]) -> list[int]:
    """Strings one of which any line has that meets the condition; those that few other searches use."""
    if isinstance(condition, int):
        return [condition]
    read = [_asked(c, used) for c in condition[1]]
    return min(read, key=lambda own: sum(used[k] for k in own)) if condition[0] == "and" else [k for own in read for k in own]


def _lines(condition: int | tuple, found: dict[int, set[int]]) -> set[int]:
    """The lines that meet a condition, from those where its strings are."""
    if isinstance(condition, int):
        return found.get(condition, set())
    own = [_lines(c, found) for c in condition[1]]
    return set.intersection(*own) if condition[0] == "and" else set.union(*own)


def gate(searches: Sequence[Search], content: Column) -> Column:
    """Parts of a text with the numbers of the searches that may match there: single lines, with their place from 0, and the whole text for searches that ask for
    nothing."""
    conditions = [G.of_search(s) for s in searches]
    always = [k for k, c in enumerate(conditions) if c is True]
    used = Counter(s for c in conditions for s in _strings(c))
    numbers = {s: k for k, s in enumerate(used)}
    terms = [s.encode("latin-1") for s in numbers]
    made = [None if c is True else _numbered(c, numbers) for c in conditions]
    asked: dict[int, list[int]] = {}
    uses = {numbers[s]: n for s, n in used.items()}
    for k, c in enumerate(made):
        for term in set(_asked(c, uses)) if c is not None else ():
            asked.setdefault(term, []).append(k)
    finder: list[_Terms] = []

    def look_up(texts: pa.Array) -> pa.Array:
        if not finder:
            finder.append(_Terms(terms))
        places, parts, searching, ends = [], [], [], [0]
        for value in texts:
            raw = value.as_py()
            if raw is not None:
                if always:
                    places.append(0)
                    parts.append(raw)
                    searching.append(always)
                found = finder[0].lines(G.normalised(raw))
                by_line: dict[int, list[int]] = {}
                for k in sorted({k for term in found for k in asked.get(term, ())}):
                    for line in _lines(made[k], found):
                        by_line.setdefault(line, []).append(k)
                if by_line:
                    # Normalising may move bytes, but not line ends.
                    lines = raw.split(b"\n")
                    for line in sorted(by_line):
                        places.append(line)
                        parts.append(lines[line])
                        searching.append(by_line[line])
            ends.append(len(places))
        fields = [pa.array(places, pa.int32()), pa.array(parts, pa.binary()), pa.array(searching, pa.list_(pa.int32()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["first", "part", "searches"]))

    return F.arrow_udf(look_up, T.ArrayType(_PART))(content.cast("binary"))


def search_many(files: DataFrame, searches: Sequence[Search]) -> DataFrame:
    """``operators.search.search_content`` for thousands of searches; without context lines."""
    searches = list(searches)
    if not searches:
        raise ValueError("config holds no search definitions")
    if len(searches) > MOST_SEARCHES:
        raise ValueError(f"more than {MOST_SEARCHES} searches")
    if any(s.context_lines for s in searches):
        raise ValueError("searches with context lines are a pack's, not a table's")
    table = files.sparkSession.createDataFrame([_row(k, s) for k, s in enumerate(searches)], "_search int, search_name string, _pattern string, _names string, _most long")
    keys = [c for c in ("project_id", "file_path") if c in files.columns]
    name = F.col("file_name") if "file_name" in files.columns else base_name(F.col("file_path"))
    size = F.col("size") if "size" in files.columns else F.octet_length(F.col("content"))
    gated = files.select(*keys, name.alias("_name"), size.alias("_size"), gate(searches, as_text(F.col("content"))).alias("_may"))
    # Exploding the bare column would infer a filter on its size, which asks the gate a second time.
    parts = gated.select(*keys, "_name", "_size", F.explode(F.slice("_may", F.lit(1), F.size("_may"))).alias("_may")).select(*keys, "_name", "_size", "_may.first", as_text(F.col("_may.part")).alias("_part"), "_may.searches")
    pairs = parts.select(*keys, "_name", "_size", "first", "_part", F.explode("searches").alias("_search")).join(F.broadcast(table), "_search")
    pairs = pairs.where("(_names IS NULL OR rlike(_name, _names)) AND (_most IS NULL OR _size <= _most)")
    lines = pairs.select(*keys, "search_name", "_pattern", "first", F.posexplode(F.split("_part", "\n")).alias("_pos", "_line"))
    found = lines.where("rlike(_line, _pattern)").select(
        *keys,
        (F.col("first") + F.col("_pos") + 1).cast("bigint").alias(MATCH_COLUMNS[0]),
        strip_cr(F.col("_line")).alias(MATCH_COLUMNS[1]),
        F.expr("regexp_extract(_line, _pattern, 0)").alias(MATCH_COLUMNS[2]),
        "search_name",
    )
    return apply_caps(found, searches) if any(s.max_matches > 0 for s in searches) else found
