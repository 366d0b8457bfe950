"""Pattern dialects, translated once on the driver.

Rule packs carry RE2 regular expressions and two kinds of glob.  Spark evaluates ``java.util.regex``, so every pattern
becomes a literal Java pattern before it enters a plan; executors only ever see constants.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusrules.functions import sqltext

# RE2's white space and its complement, written as the inside of a Java character class.
RE2_SPACE = r"\t\n\f\r "
RE2_NOT_SPACE = r"\x00-\x08\x0B\x0E-\x1F\x21-\x{10FFFF}"

# Bracket class names RE2 accepts.
POSIX_CLASSES = {
    "alnum": "Alnum",
    "alpha": "Alpha",
    "ascii": "ASCII",
    "blank": "Blank",
    "cntrl": "Cntrl",
    "digit": "Digit",
    "graph": "Graph",
    "lower": "Lower",
    "print": "Print",
    "punct": "Punct",
    "space": "Space",
    "upper": "Upper",
    "xdigit": "XDigit",
}

MAX_REPEAT = 1000
_QUANTIFIER = re.compile(r"[*+?]|\{(\d+)(?:(,)(\d*))?\}")
_WORD_EDGE = r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"
_NOT_WORD_EDGE = r"(?:(?=\w)(?<=\w)|(?!\w)(?<!\w))"
_WORD_ITEM = r"(?:(?<!\\)\w|\\[wd]|\[[\w-]+\])"
_WORD_AHEAD = re.compile(rf"({_WORD_ITEM})(?![*?]|\{{0)", re.ASCII)
_WORD_BEHIND = re.compile(rf"({_WORD_ITEM})(?:\+|\{{[1-9]\d*(?:,\d*)?\}})?\Z", re.ASCII)
_SIMPLE_GROUP = re.compile(r"\((?:\?:|\?P?<\w+>)?((?:[^()\\?]|\\.)[^()]*)\)(?![*?]|\{0)")
_CONTROL = {"a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0B"}

# ASCII letters with a case variant outside ASCII, under RE2's folding and under plain lower-casing.
_REGEX_FOLDS = {"k": "[kK\u212a]", "s": "[sS\u017f]"}
_LOWER_FOLDS = {"k": "[kK\u212a]", "i": "[iI\u0130]"}
_FOLDS_OUTSIDE_ASCII = set("kKsS")


class PatternError(ValueError):
    """A pattern that is not valid in the dialect it was written in."""


@dataclass(frozen=True)
class Regex:
    """An RE2 pattern with its Java form and what the driver knows about it."""

    source: str
    java: str
    groups: int
    names: dict[str, int] = field(hash=False, default_factory=dict)
    literal: str = ""
    literal_folded: bool = False

    def found_in(self, text: Column) -> Column:
        """Boolean column; a byte-level ``contains`` runs first where every match must hold a known literal."""
        test = text.rlike(self.java)
        return test if self.literal_folded or len(self.literal) < 2 else F.contains(text, F.lit(self.literal)) & test

    def found_sql(self, text: str) -> str:
        """:meth:`found_in` as SQL text."""
        test = f"rlike({text}, {sqltext.text(self.java)})"
        return test if self.literal_folded or len(self.literal) < 2 else f"contains({text}, {sqltext.text(self.literal)}) AND {test}"

    def may_occur_in(self, text: Column) -> Column | None:
        """Cheap necessary condition for a match, or None when the pattern has no usable literal."""
        if len(self.literal) < 2:
            return None
        if self.literal_folded:
            return text.rlike("(?i)" + "".join(_fold_like_regex(c) for c in self.literal))
        return F.contains(text, F.lit(self.literal))

    def group(self, text: Column, index: int = 0) -> Column:
        return F.regexp_extract(text, self.java, index)


@dataclass
class _Item:
    """One part of a sequence: whether it can be empty, the quantifier that lets it go on for ever, and a group's alternatives."""

    empty: bool
    body: list[list[_Item]] | None = None
    repeat: str = ""

    def repeats_itself(self) -> bool:
        """Whether some alternative of a group is an endless repeat and else nothing that has to be there: repeated in turn, it can
        cut the same text in exponentially many ways, and Java tries them all where there is no match."""
        return any((x.repeat or x.repeats_itself()) and all(o.empty for o in items if o is not x) for items in self.body or () for x in items)

    def single_repeat(self) -> str:
        """``*`` or ``+`` if the group is nothing but one such repeat of a single character."""
        if self.body and len(self.body) == 1 and len(self.body[0]) == 1 and self.body[0][0].body is None:
            return self.body[0][0].repeat if self.body[0][0].repeat in ("*", "+") else ""
        return ""


class _Rewriter:
    """Single left-to-right pass from RE2 syntax to Java syntax."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.src = pattern
        self.pos = 0
        self.out: list[str] = ["(?i)"] if ignore_case else []
        self.flags = {"i": ignore_case, "m": False, "s": False, "U": False}
        self.scopes: list[dict] = []
        self.groups = 0
        self.names: dict[str, int] = {}
        self.runs: list[list[tuple[str, bool]]] = [[]]
        self.bodies: list[list[list[_Item]]] = [[[]]]
        self.top_level_choice = False
        self.quantifiable = False

    def fail(self, why: str):
        raise PatternError(f"invalid regex pattern {self.src!r}: {why}")

    # -- literals every match must contain ------------------------------------------------------------------------

    def _note_literal(self, ch: str):
        folded = self.flags["i"]
        usable = not self.scopes and (ch.isascii() or not folded)
        if usable:
            self.runs[-1].append((ch, folded))
        else:
            self._break_run()

    def _break_run(self):
        if self.runs[-1]:
            self.runs.append([])

    def required_literal(self) -> tuple[str, bool]:
        if self.top_level_choice:
            return "", False
        best = max(self.runs, key=len)
        folded = any(f for _, f in best)
        text = "".join(c for c, _ in best)
        if folded and not text.isascii():
            return "", False
        return (text.lower(), True) if folded else (text, False)

    # -- emitting ----------------------------------------------------------------------------------------------------

    def _atom(self, java: str, literal: str | None = None, wide: bool = True):
        self.out.append(java)
        if java != ")":
            self.bodies[-1][-1].append(_Item(not wide))
        self.quantifiable = True
        if literal is None:
            self._break_run()
        else:
            self._note_literal(literal)

    def _literal(self, ch: str):
        java = _fold_like_regex(ch) if self.flags["i"] else java_quote(ch)
        self._atom(java, ch)

    def run(self) -> Regex:
        while self.pos < len(self.src):
            self._step()
        if self.scopes:
            self.fail("missing closing )")
        literal, folded = self.required_literal()
        return Regex(self.src, "".join(self.out), self.groups, self.names, literal, folded)

    def _step(self):
        c = self.src[self.pos]
        if c == "(":
            self._open()
        elif c == ")":
            if not self.scopes:
                self.fail("unexpected )")
            self.flags = self.scopes.pop()
            self.pos += 1
            body = self.bodies.pop()
            self.bodies[-1][-1].append(_Item(any(all(x.empty for x in items) for items in body), body))
            self._atom(")")
        elif c == "|":
            self.top_level_choice |= not self.scopes
            self.pos += 1
            self.out.append("|")
            self.bodies[-1].append([])
            self._break_run()
            self.quantifiable = False
        elif c == "[":
            self._atom(self._bracket())
        elif c == "\\":
            self._escape()
        elif c in "*+?" or (c == "{" and _QUANTIFIER.match(self.src, self.pos)):
            self._quantifier()
        else:
            self.pos += 1
            if c == ".":
                self._atom("(?s:.)" if self.flags["s"] else r"[^\n]")
            elif c == "^":
                self._atom(r"(?:\A|(?<=\n))" if self.flags["m"] else r"\A", wide=False)
            elif c == "$":
                self._atom(r"(?=\n|\z)" if self.flags["m"] else r"\z", wide=False)
            else:
                self._literal(c)

    def _quantifier(self):
        m = _QUANTIFIER.match(self.src, self.pos)
        if not self.quantifiable:
            self.fail(f"missing argument to repetition operator {m.group()}")
        low, high = m.group(1), m.group(3)
        if low is not None:
            if int(low) > MAX_REPEAT or (high and (int(high) > MAX_REPEAT or int(high) < int(low))):
                self.fail(f"invalid repeat count {m.group()}")
            at_least = int(low)
        else:
            at_least = 1 if m.group() == "+" else 0
        self.pos = m.end()
        lazy = self.src.startswith("?", self.pos)
        self.pos += lazy
        if _QUANTIFIER.match(self.src, self.pos):
            self.fail("invalid nested repetition operator")
        lazy = lazy != self.flags["U"]
        java = m.group() + ("?" if lazy else "")
        item = self.bodies[-1][-1][-1]
        endless = m.group() in "*+" or (m.group(2) == "," and not high)
        if endless and item.repeats_itself():
            inner = item.single_repeat()
            if not inner or lazy or m.group() not in "*+":
                self.fail(f"{m.group()} repeats a group that can match the same text in many ways, which would take exponential time")
            # The inner repeat does all that both do.
            java = "?" if (inner, m.group()) == ("+", "*") else ""
        self.out.append(java)
        item.empty |= at_least == 0
        item.repeat = (m.group() if not lazy else "lazy") if endless else item.repeat
        if at_least == 0 and self.runs[-1]:
            self.runs[-1].pop()
        self._break_run()
        self.quantifiable = False

    def _open(self):
        src = self.src
        if not src.startswith("(?", self.pos):
            self.groups += 1
            self.pos += 1
            java = "("
        else:
            named = re.compile(r"\(\?P?<([A-Za-z0-9_]+)>").match(src, self.pos)
            flagged = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])").match(src, self.pos)
            if named:
                self.groups += 1
                if named.group(1) in self.names:
                    self.fail(f"duplicate group name {named.group(1)}")
                self.names[named.group(1)] = self.groups
                self.pos = named.end()
                java = "("
            elif flagged and (flagged.group(1) or flagged.group(2) or flagged.group(3) == ":"):
                return self._flags(flagged)
            else:
                self.fail("unsupported group syntax (look-around, atomic groups and conditionals are not available)")
        self._enter(java, dict(self.flags))

    def _enter(self, java: str, saved: dict):
        self._break_run()
        self.bodies.append([[]])
        self.scopes.append(saved)
        self.out.append(java)
        self.quantifiable = False

    def _flags(self, m: re.Match):
        before = dict(self.flags)
        for name in m.group(1):
            self.flags[name] = True
        for name in m.group(2) or "":
            self.flags[name] = False
        self.pos = m.end()
        fold = "" if self.flags["i"] == before["i"] else ("i" if self.flags["i"] else "-i")
        if m.group(3) == ":":
            self._enter(f"(?{fold}:", before)
        elif fold:
            self.out.append(f"(?{fold})")
            self.quantifiable = False

    # -- escapes ---------------------------------------------------------------------------------------------------

    def _code_point(self) -> str | None:
        """Consume an escape that denotes one character; leave the position alone otherwise."""
        m = re.compile(r"\\(?:x\{([0-9A-Fa-f]{1,8})\}|x([0-9A-Fa-f]{2})|(0[0-7]{0,2}|[1-7][0-7]{1,2}))").match(
            self.src, self.pos
        )
        if m:
            self.pos = m.end()
            code = int(m.group(1) or m.group(2), 16) if not m.group(3) else int(m.group(3), 8)
            if code > 0x10FFFF:
                self.fail("code point out of range")
            return chr(code)
        c = self.src[self.pos + 1 : self.pos + 2]
        if c and not (c.isascii() and c.isalnum()) and ord(c) < 128:
            self.pos += 2
            return c
        return None

    def _class_escape(self, inside: bool) -> str | None:
        """Consume a class escape and give its Java form, bare when already inside brackets."""
        src = self.src
        c = src[self.pos + 1 : self.pos + 2]
        if c in ("d", "D", "w", "W"):
            self.pos += 2
            return "\\" + c
        if c in ("s", "S"):
            self.pos += 2
            body = RE2_SPACE if c == "s" else RE2_NOT_SPACE
            return body if inside else f"[{body}]"
        m = re.compile(r"\\([pP])(?:([A-Za-z])|\{(\^?)(\w+)\})").match(src, self.pos)
        if m:
            self.pos = m.end()
            name = m.group(2) or m.group(4)
            negated = (m.group(1) == "P") != bool(m.group(3))
            if name == "Any":
                return r"\x00-\x{10FFFF}" if inside else "(?s:.)"
            return rf"\{'P' if negated else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if c in _CONTROL:
            self.pos += 2
            return _CONTROL[c]
        return None

    def _escape(self):
        src = self.src
        c = src[self.pos + 1 : self.pos + 2]
        if not c:
            self.fail("trailing backslash at end of expression")
        if c == "Q":
            end = src.find("\\E", self.pos + 2)
            text = src[self.pos + 2 : end if end >= 0 else len(src)]
            self.pos = end + 2 if end >= 0 else len(src)
            for ch in text:
                self._literal(ch)
            return
        if c in "AzbB":
            java = self._word_edge() if c == "b" else {"A": r"\A", "z": r"\z", "B": _NOT_WORD_EDGE}[c]
            self.pos += 2
            return self._atom(java, wide=False)
        point = self._code_point()
        if point is not None:
            return self._literal(point)
        java = self._class_escape(inside=False)
        if java is None:
            self.fail(f"invalid escape sequence \\{c}")
        self._atom(java)

    def _word_edge(self) -> str:
        """``\\b``: one look-around is enough where the pattern itself fixes the character on the other side."""

        def certain(m: re.Match | None) -> bool:
            return bool(m) and not (self.flags["i"] and _folds_beyond_ascii(m.group(1)))

        def certain_start(at: int) -> bool:
            group = _SIMPLE_GROUP.match(self.src, at)
            if group and "[" not in group.group(1):
                return all(certain(_WORD_AHEAD.match(choice)) for choice in group.group(1).split("|"))
            return certain(_WORD_AHEAD.match(self.src, at))

        if certain_start(self.pos + 2):
            return r"(?<!\w)"
        if certain(_WORD_BEHIND.search(self.src[: self.pos])):
            return r"(?!\w)"
        return _WORD_EDGE

    # -- bracket expressions -----------------------------------------------------------------------------------------

    def _bracket(self) -> str:
        start = self.pos
        java = self._bracket_body()
        if self.flags["i"] and _folds_beyond_ascii(self.src[start : self.pos]):
            return f"(?iu:{java})"
        return java

    def _bracket_body(self) -> str:
        src = self.src
        self.pos += 1
        body = ["["]
        if src.startswith("^", self.pos):
            body.append("^")
            self.pos += 1
        first = True
        while True:
            if self.pos >= len(src):
                self.fail("missing closing ]")
            if src[self.pos] == "]" and not first:
                self.pos += 1
                return "".join(body) + "]"
            first = False
            named = re.compile(r"\[:(\^?)(\w+):\]").match(src, self.pos)
            if named:
                self.pos = named.end()
                name = named.group(2)
                if name == "word":
                    body.append(r"\W" if named.group(1) else r"\w")
                elif name in POSIX_CLASSES:
                    body.append(rf"\{'P' if named.group(1) else 'p'}{{{POSIX_CLASSES[name]}}}")
                else:
                    self.fail(f"invalid character class range [:{name}:]")
                continue
            if src[self.pos] == "\\":
                point = self._code_point()
                if point is None:
                    control = src[self.pos + 1 : self.pos + 2] in _CONTROL
                    java = self._class_escape(inside=True)
                    if java is None:
                        self.fail("invalid escape sequence in character class")
                    if not control or not re.compile(r"-[^\]]").match(src, self.pos):
                        body.append(java)
                        continue
                    low = java
                else:
                    low = java_quote(point)
            else:
                low = java_quote(src[self.pos])
                self.pos += 1
            if re.compile(r"-[^\]]").match(src, self.pos):
                self.pos += 1
                low += "-" + self._range_end()
            body.append(low)

    def _range_end(self) -> str:
        if self.src[self.pos] != "\\":
            self.pos += 1
            return java_quote(self.src[self.pos - 1])
        point = self._code_point()
        if point is not None:
            return java_quote(point)
        c = self.src[self.pos + 1 : self.pos + 2]
        if c in _CONTROL:
            self.pos += 2
            return _CONTROL[c]
        self.fail("invalid character class range")


def _folds_beyond_ascii(item: str) -> bool:
    """Whether a word character or bracket expression can match a non-ASCII letter once case is ignored."""
    if not item.isascii() or re.search(r"\\[xpP0-7]|\[:|\\w", item):
        return True
    chars = set(re.sub(r"\\.", "", item))
    for low, high in re.findall(r"(\w)-(\w)", item):
        chars |= {chr(c) for c in range(ord(low), ord(high) + 1)}
    return bool(chars & _FOLDS_OUTSIDE_ASCII)


def _fold_like_regex(ch: str) -> str:
    """One character of a case-insensitive pattern, to stand under Java's ASCII-only ``(?i)``."""
    if ch.isascii():
        return _REGEX_FOLDS.get(ch.lower()) or java_quote(ch)
    return f"(?iu:{java_quote(ch)})" if ch.lower() != ch or ch.upper() != ch else java_quote(ch)


@lru_cache(maxsize=1)
def _lower_sources() -> dict[str, str]:
    """Characters outside ASCII by what they become in lower case."""
    sources: dict[str, str] = {}
    for ch in map(chr, range(0x80, 0x110000)):
        low = ch.lower()
        if len(low) == 1 and low != ch:
            sources[low] = sources.get(low, "") + ch
    return sources


@lru_cache(maxsize=4096)
def folded_literal(term: str) -> Regex:
    """Pattern matching ``term`` as it would be found if text and term were lower-cased character by character."""
    out = ["(?i)"]
    for ch in term:
        low = "i" if ch == "\u0130" else ch.lower()
        if low.isascii():
            out.append(_LOWER_FOLDS.get(low) or java_quote(low))
        else:
            out.append("[" + java_quote(low + _lower_sources().get(low, "")) + "]")
    return Regex(term, "".join(out), 0)


def java_quote(text: str) -> str:
    """Text as a Java pattern matching exactly that text, inside or outside brackets."""
    return "".join(
        c if c.isalnum() or c in " _/" else f"\\{c}" if c.isascii() and c.isprintable() else f"\\x{{{ord(c):X}}}"
        for c in text
    )


@lru_cache(maxsize=4096)
def regex(pattern: str, ignore_case: bool = False) -> Regex:
    """Translate an RE2 pattern; raises :class:`PatternError` for anything RE2 would reject."""
    if re.search(r"\((?:[^()\\]|\\.)*\|(?:[^()\\]|\\.)*\)(?:[*+]|\{\d+,)", pattern):
        warnings.warn(
            f"pattern {pattern!r} repeats a group holding a choice; Java recurses once per repetition, "
            "so long inputs can exhaust the executor's stack",
            stacklevel=2,
        )
    return _Rewriter(pattern, ignore_case).run()


# -- globs -----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def rule_glob(pattern: str) -> str | None:
    """Java regex of a rule's file pattern (``*`` and ``?`` only, crossing ``/``); None when it is a plain name."""
    if "*" not in pattern and "?" not in pattern:
        return None
    wild = {"*": r"[^\n]*", "?": r"[^\n]"}
    return r"\A" + "".join(wild.get(c) or java_quote(c) for c in pattern) + r"\z"


def rule_glob_matches(name: Column, pattern: str) -> Column:
    """File-name test of a rule; the plain name also counts as a match of a pattern with wildcards in it."""
    java = rule_glob(pattern)
    if java is None:
        return name == F.lit(pattern)
    if re.fullmatch(r"[^*?]+\*", pattern):
        return name.startswith(pattern[:-1]) & ~name.contains("\n")
    if re.fullmatch(r"\*[^*?]+", pattern):
        return name.endswith(pattern[1:]) & ~name.contains("\n")
    return name.rlike(java)


def rule_glob_sql(name: str, pattern: str) -> str:
    """:func:`rule_glob_matches` as SQL text."""
    java = rule_glob(pattern)
    if java is None:
        return f"{name} = {sqltext.text(pattern)}"
    no_break = f"NOT contains({name}, {sqltext.text(chr(10))})"
    if re.fullmatch(r"[^*?]+\*", pattern):
        return f"startswith({name}, {sqltext.text(pattern[:-1])}) AND {no_break}"
    if re.fullmatch(r"\*[^*?]+", pattern):
        return f"endswith({name}, {sqltext.text(pattern[1:])}) AND {no_break}"
    return f"rlike({name}, {sqltext.text(java)})"


@lru_cache(maxsize=4096)
def search_glob(pattern: str) -> str | None:
    """Java regex of a search's file pattern (shell style, ``/`` never crossed); None when it is malformed."""
    out, i = [r"\A"], 0

    def one(i: int) -> tuple[str, int]:
        if i < len(pattern) and pattern[i] == "\\":
            i += 1
        elif i < len(pattern) and pattern[i] in "-]":
            raise PatternError(pattern)
        if i >= len(pattern):
            raise PatternError(pattern)
        return pattern[i], i + 1

    try:
        while i < len(pattern):
            c = pattern[i]
            if c in "*?":
                out.append("[^/]*" if c == "*" else "[^/]")
                i += 1
            elif c == "[":
                i += 1
                negated = pattern.startswith("^", i)
                i += negated
                items: list[str] = []
                while not (items and pattern.startswith("]", i)):
                    low, i = one(i)
                    high = low
                    if pattern.startswith("-", i):
                        high, i = one(i + 1)
                    if low <= high:
                        items.append(f"{java_quote(low)}-{java_quote(high)}")
                    else:
                        items.append("")
                i += 1
                ranges = "".join(items)
                never, always = r"(?!)", r"(?s:.)"
                out.append(f"[{'^' if negated else ''}{ranges}]" if ranges else (always if negated else never))
            elif c == "\\":
                if i + 1 >= len(pattern):
                    raise PatternError(pattern)
                out.append(java_quote(pattern[i + 1]))
                i += 2
            else:
                out.append(java_quote(c))
                i += 1
    except PatternError:
        return None
    return "".join(out) + r"\z"


def search_globs_match(name: Column, patterns: list[str] | tuple[str, ...]) -> Column | None:
    """OR over file patterns; None means "no restriction", a pack of malformed patterns matches nothing."""
    if not patterns:
        return None
    test = F.lit(False)
    for pattern in patterns:
        java = search_glob(pattern)
        if java is not None:
            test = test | name.rlike(java)
    return test
