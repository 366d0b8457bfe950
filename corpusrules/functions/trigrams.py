"""Trigrams of texts, and what a search asks of them: a condition that every file with a matching line meets.

Trigrams are of UTF-8 bytes with ASCII letters in lower case and the few letters that fold to ASCII ones folded, so they serve searches of any case.  A condition is
``True`` (nothing is known), a string that must occur, or ``("and" | "or", conditions)``.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
import warnings

import numpy as np

from corpusrules.functions.patterns import regex
from corpusrules.rulepack import Search

#: Characters outside ASCII that match ASCII letters when case is ignored.
_FOLDED = {"K".encode(): b"k", "ſ".encode(): b"s", "İ".encode(): b"i"}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Strings kept apart before they become a condition, and their length.
MOST_STRINGS, LONGEST = 24, 64

Condition = bool | str | tuple


def normalised(raw: bytes) -> bytes:
    for letter, plain in _FOLDED.items():
        if letter in raw:
            raw = raw.replace(letter, plain)
    return _LOWER[np.frombuffer(raw, np.uint8)].tobytes() if raw else raw


def all_codes(text: bytes) -> np.ndarray:
    """The trigrams of a normalised text as numbers, in its order."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    return data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:] if len(data) > 2 else np.zeros(0, np.uint32)


def codes(raw: bytes) -> np.ndarray:
    """The distinct trigrams of a text as numbers, ascending."""
    return np.unique(all_codes(normalised(raw)))


def _and(parts: list) -> Condition:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _or(parts: list) -> Condition:
    kept = list(dict.fromkeys(parts))
    return True if not kept or True in kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _holds(text: str, folded: bool) -> Condition:
    """What a file with ``text`` holds; without case, only runs of ASCII are known."""
    runs = re.findall(r"[\x00-\x7f]+", text) if folded else [text]
    long = [r for r in (normalised(run.encode()) for run in runs) if len(r) >= 3]
    return _and([r.decode("latin-1") for r in long])


class _Reader:
    """From a pattern's parse tree to its strings (all that it can match, if few) or a condition."""

    def __init__(self, ignore_case: bool):
        self.folded = ignore_case

    def sequence(self, items) -> tuple[set[str] | None, Condition]:
        strings: set[str] = {""}
        conditions: list = []
        for op, value in items:
            own, condition = self.item(op, value)
            if own is not None and len(own) * len(strings) <= MOST_STRINGS and max(map(len, own)) + max(map(len, strings)) <= LONGEST:
                strings = {a + b for a in strings for b in own}
                continue
            conditions += [self.flushed(strings), condition]
            strings = {""} if own is None else own
        if not conditions:
            return strings, True
        return None, _and([*conditions, self.flushed(strings)])

    def flushed(self, strings: set[str] | None) -> Condition:
        return True if strings is None else _or([_holds(s, self.folded) for s in sorted(strings)])

    def item(self, op, value) -> tuple[set[str] | None, Condition]:
        if op is sre.LITERAL:
            return {chr(value)}, True
        if op is sre.AT:
            return {""}, True
        if op is sre.IN:
            chars = self.members(value)
            return (chars, True) if chars else (None, True)
        if op is sre.SUBPATTERN:
            _, add, remove, inner = value
            if add or remove:
                reader = _Reader((self.folded or bool(add & re.IGNORECASE)) and not remove & re.IGNORECASE)
                strings, condition = reader.sequence(inner)
                return None, _and([condition, reader.flushed(strings)])
            return self.sequence(inner)
        if op is sre.BRANCH:
            read = [self.sequence(branch) for branch in value[1]]
            if all(s is not None for s, _ in read) and sum(len(s) for s, _ in read) <= MOST_STRINGS:
                return set().union(*(s for s, _ in read)), True
            return None, _or([c if s is None else self.flushed(s) for s, c in read])
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            strings, condition = self.sequence(inner)
            if strings is not None and low == high == 1:
                return strings, True
            if strings is not None and (low, high) == (0, 1):
                return strings | {""}, True
            if low == 0:
                return None, True
            return None, condition if strings is None else self.flushed(strings)
        return None, True

    def members(self, value) -> set[str] | None:
        found: set[str] = set()
        for op, item in value:
            if op is sre.LITERAL:
                found.add(chr(item))
            elif op is sre.RANGE and item[1] - item[0] < 4:
                found |= {chr(c) for c in range(item[0], item[1] + 1)}
            else:
                return None
        return found if 0 < len(found) <= 4 else None


# What the parser used here reads in another way than the dialect of patterns does.
_OTHERWISE = re.compile(r"\[:|\[\^?\]|\\[^\sA-Za-z0-9]?[QECpPxzZAabBdDsSwW0-9]|\(\?[^:P]|--|&&|\|\||~~")


def of_pattern(pattern: str, ignore_case: bool = False) -> Condition:
    """What a file with a match of an RE2 pattern holds."""
    checked = regex(pattern, ignore_case)
    plain = pattern[4:] if pattern.startswith("(?i)") else pattern
    folded = ignore_case or plain is not pattern
    safe = re.sub(r"\\[bBdDsSwW]", ".", plain)
    if not _OTHERWISE.search(re.sub(r"\\[^A-Za-z0-9]", "_", safe)):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("error")
                tree = sre_parse.parse(plain)
            reader = _Reader(folded)
            strings, condition = reader.sequence(tree)
            return _and([condition, reader.flushed(strings)])
        except (re.error, FutureWarning, DeprecationWarning, OverflowError, RecursionError):
            pass
    return _holds(checked.literal, checked.literal_folded) if checked.literal else True


def of_search(search: Search) -> Condition:
    """What a file with a line that the search matches holds."""
    if not search.is_regex:
        return _holds(search.term, not search.case_sensitive)
    return of_pattern(search.term, not search.case_sensitive)


def trigrams(condition: Condition) -> np.ndarray:
    """All trigrams that a condition mentions, ascending."""
    if condition is True:
        return np.zeros(0, np.uint32)
    if isinstance(condition, str):
        return codes(condition.encode("latin-1"))
    return np.unique(np.concatenate([trigrams(c) for c in condition[1]]))


def met(condition: Condition, known: np.ndarray) -> bool:
    """Whether a text with these trigrams may meet a condition."""
    if condition is True:
        return True
    if isinstance(condition, str):
        own = codes(condition.encode("latin-1"))
        at = np.searchsorted(known, own)
        return bool(len(known)) and bool((known[np.minimum(at, len(known) - 1)] == own).all())
    tests = (met(c, known) for c in condition[1])
    return all(tests) if condition[0] == "and" else any(tests)

