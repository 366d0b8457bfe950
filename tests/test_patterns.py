"""The pattern translators, checked against the dialects' own engines where one is at hand (DuckDB runs RE2)."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusrules.functions.patterns import (
    PatternError,
    folded_literal,
    regex,
    rule_glob_matches,
    search_glob,
    search_globs_match,
)

SUBJECTS = [
    "",
    "a",
    "abc",
    "ABC",
    "foo bar",
    "foo\nbar",
    "foo\r\nbar\n",
    "a\x0bb",
    "tab\tsep",
    "key = 'v1'",
    "KEY=\"x\"",
    "python-3.11.5\n",
    "Straße ÉTÉ été",
    "naïve_word x9",
    "a.b*c+d?",
    "[x]{2}",
    "ends with dollar$",
    "line1\nline2",
    "0123456789abcdef",
    "kelvin K and long ſ",
    " sep\u0085next",
    "x{,3} \\ back",
]

PATTERNS = [
    r"a",
    r"^foo",
    r"bar$",
    r"(?m)^bar$",
    r"(?m)^line\d$",
    r"foo.bar",
    r"(?s)foo.+bar",
    r"a\sb",
    r"a[\s]b",
    r"a[^\S]b",
    r"tab\tsep",
    r"\bkey\b",
    r"\w+\b",
    r"\Bo",
    r"\b(?:foo|bar)\b",
    r"\b(foo|\.b)",
    r"\b(?:x*|key)",
    r"\b(?P<k>K\w+)\s",
    r"\b(key)?\b",
    r"\b[a-c]+\b",
    r"é\b|\bÉ",
    r"(?i)abc",
    r"(?i)straße",
    r"(?i)été",
    r"(?i)[a-f]+c",
    r"(?i:A)bc",
    r"(?P<name>\d+)\.(?P<minor>\d+)",
    r"['\"]([^'\"]+)['\"]",
    r"[[:alpha:]]+ [[:upper:]]",
    r"[^[:space:]]+$",
    r"\pL+",
    r"\p{Greek}|\p{Lu}\p{Ll}",
    r"[]x]",
    r"[a&&b]",
    r"\Qa.b*\E",
    r"\x{41}B\x43",
    r"\101",
    r"x\{,3\}",
    r"x{,3}",
    r"a*?b",
    r"(a|b)+c",
    r"(?U)o+",
    r"[0-9a-f]{8,}?",
    r"\.\d$",
    r"[\]\-x]",
    r"\z",
    r"\Afoo",
    r"(?i)k",
    r"(?i)[s-t]ep",
    r"[^\n]+",
    r"a||b",
    r"()",
]

BAD = [
    "a**",
    "a*+",
    "(",
    ")",
    "[a",
    "*a",
    "(?=a)",
    "(?<!a)b",
    r"(a)\1",
    "(?>a)",
    "a{1001}",
    "a{3,2}",
    "\\",
    r"\Z",
    "(?x)a",
    "[invalid",
    "(?P<n>a)(?P<n>b)",
]


def test_patterns_match_like_re2(spark):
    subjects = spark.createDataFrame([(i, s) for i, s in enumerate(SUBJECTS)], "i int, s string")
    for pattern in PATTERNS:
        ours = regex(pattern)
        rows = subjects.select("i", ours.found_in(F.col("s")).alias("hit"), ours.group(F.col("s")).alias("text"))
        got = [(r.hit, r.text) for r in rows.orderBy("i").collect()]
        want = [
            duckdb.execute("SELECT regexp_matches(?, ?), regexp_extract(?, ?)", [s, pattern, s, pattern]).fetchone()
            for s in SUBJECTS
        ]
        assert got == want, pattern


def test_literal_guard_never_loses_a_match(spark):
    subjects = spark.createDataFrame([(s,) for s in SUBJECTS], "s string")
    for pattern in PATTERNS:
        for ignore_case in (False, True):
            ours = regex(pattern, ignore_case)
            guard = ours.may_occur_in(F.col("s"))
            if guard is not None:
                lost = subjects.where(F.col("s").rlike(ours.java) & ~guard).count()
                assert lost == 0, (pattern, ignore_case)


@pytest.mark.parametrize("pattern", BAD)
def test_invalid_patterns_are_rejected(pattern):
    with pytest.raises(PatternError):
        regex(pattern)


def test_named_groups_have_indexes():
    r = regex(r"(a)(?P<version_x>\d+)(?:b)(?<other>c)")
    assert (r.groups, r.names) == (3, {"version_x": 2, "other": 3})


def test_repeated_choice_warns():
    with pytest.warns(UserWarning, match="stack"):
        regex(r"(?:ab|c)*d-unique")


@given(st.text(alphabet="abkKsSiIéÉßσΣςİıſK .*[", min_size=1, max_size=4))
@settings(max_examples=30, deadline=None)
def test_folded_literals(spark, term):
    """A line holds a term when their character-wise lower cases do."""

    def low(text):
        return "".join("i" if c == "İ" else c.lower() for c in text)

    lines = [term, term.upper(), term.lower(), "x" + term + "y", "kelvin K", "ſs", "İi", "nothing"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string")
    pattern = folded_literal(term)
    got = [r.hit for r in df.select("i", F.col("s").rlike(pattern.java).alias("hit")).orderBy("i").collect()]
    assert got == [low(term) in low(line) for line in lines]


@pytest.mark.parametrize(
    "pattern,name,expected",
    [
        ("*.txt", "file.txt", True),
        ("*.txt", "file.txt.bak", False),
        ("?.txt", "a.txt", True),
        ("?.txt", "ab.txt", False),
        ("Dockerfile*", "Dockerfile", True),
        ("Dockerfile*", "Dockerfile.dev", True),
        ("test*", "mytest", False),
        ("pyproject.toml", "pyproject.toml", True),
        ("pyproject.toml", "pyprojectXtoml", False),
        ("*", "a/b", True),
        ("a*c?e", "abc/e", True),
        ("[ab].txt", "a.txt", False),
        ("a\\*b", "a\\xyb", True),
    ],
)
def test_rule_globs(spark, pattern, name, expected):
    row = spark.range(1).select(rule_glob_matches(F.lit(name), pattern).alias("m")).first()
    assert row.m is expected


@pytest.mark.parametrize(
    "pattern,name,expected",
    [
        ("*.py", "a.py", True),
        ("*.py", "d/a.py", False),
        ("?b", "ab", True),
        ("?b", "/b", False),
        ("[a-c]x", "bx", True),
        ("[^a-c]x", "bx", False),
        ("[^a-c]x", "dx", True),
        (r"\*x", "*x", True),
        (r"\*x", "ax", False),
        ("[a", "a", False),
        ("[]a]", "]", False),
        ("a\\", "a", False),
        ("[b-a]", "b", False),
        ("a[\\]]b", "a]b", True),
        ("*", "", True),
    ],
)
def test_search_globs(spark, pattern, name, expected):
    row = spark.range(1).select(search_globs_match(F.lit(name), [pattern]).alias("m")).first()
    assert row.m is expected


def test_search_globs_combine(spark):
    assert search_globs_match(F.lit("x"), []) is None
    assert search_glob("[a") is None
    row = spark.range(1).select(search_globs_match(F.lit("a.yml"), ["*.py", "[bad", "*.yml"]).alias("m")).first()
    assert row.m is True


@pytest.mark.parametrize("pattern,java", [("(a+)+$", r"(a+)\z"), ("(?:a*)*b", "(?:a*)b"), ("(a+)*", "(a+)?"), (r"([^x]+)+", "([^x]+)"), ("(a*)+", "(a*)")])
def test_repeated_repeats_become_one(pattern, java):
    assert regex(pattern).java == java


@pytest.mark.parametrize("pattern", [r"(\w+\s?)*$", "(a+b?)+c", "((a+)b*)+", "(a|b+)*c", "(a+){2,}", "(?:a+?)+b", r"(\b\w+)+!"])
def test_ambiguous_repeats_are_refused(pattern):
    with pytest.raises(PatternError, match="exponential"):
        regex(pattern)


@pytest.mark.parametrize("pattern", ["(ab+)+", "(a+,)*", "(?:a{2,5})+", "(a?b)*", r"(?:\d+\.)+\d+", "(abc)+"])
def test_other_repeats_stay(pattern):
    assert regex(pattern).groups == pattern.count("(") - pattern.count("(?:")


def test_repeated_repeats_end_quickly(spark):
    line = "a" * 200_000 + "b"
    df = spark.createDataFrame([(line,)], "s string")
    assert not df.select(regex("(a+)+$").found_in(F.col("s"))).first()[0]
