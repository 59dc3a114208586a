"""Matchers over lines: marks are asked first, and what they leave out would not have matched."""

import re

import pytest
from pyspark.sql import functions as F

from faultline import queries as Q
from faultline.functions.text import ascii_bounds, marks, somewhere
from faultline.operators import lines as L

ODD = [
    None, "", " ", "@", "a@b", "x.y@mail.example.org", "write to A-1@b.co, or 10.20.30.40", "é@b.co", "a@b.c", "token", "token :", "api_key=1", "my secret :x", "passwordé:", "TOKEN:", "token  =",
    "Licensed under", "licensed  under", "Not released under", "Released under the MIT", "a" * 39, "a" * 40, "ab" * 30, "_" + "a" * 40, "é" + "0" * 41, "1.2.3.4", "1.2.3.4567", "v1.2.3.4", "token: x@y.zz 1.2.3.4", "٣1.2.3.4",
]


@pytest.mark.parametrize(
    "pattern, want",
    [
        (r"[a-z]+@[a-z]+\.[a-z]{2,}", ["@"]), (r"(password|token) *[:=]", ["password", "token"]), (r"\bab{2}cde", ["cde"]), (r"ab(c|def)+gh", ["ab"]), (r"ab?", ["a"]),
        (r"\d+", []), ("", []), ("a*", []), ("x|yz", []), ("(?i)token", []), ("(a|(b))c", []), ("(a|)b", []), ("[a[b]]c", []), ("[a&&b]c", []), (r"\Qa+\Ebc", []), ("^abc$", []), (r"\x20abc", []),
    ],
)
def test_marks(pattern, want):
    assert marks(pattern) == want


def test_patterns_with_marks_are_tried_where_one_stands(spark):
    rows = spark.createDataFrame([(1, "x")], "k long, raw string")
    plan = L.matched(rows, Q.MATCHERS)._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"Contains(raw, {m})" in re.sub(r"#\d+L?", "", plan) for m in ("@", "password", "token", "secret", "api_key", "Licensed under", "Released under", "licensed under"))


def test_odd_lines_match_as_patterns_say(spark):
    """Null, empty and repeated lines, marks that no match follows, and lines of several matches."""
    rows = [(i % 30, s) for i, s in enumerate(ODD * 2)] + [(None, ODD[5])]
    want = [(k, s, kind, detail) for k, s in rows for kind, detail, p in Q.MATCHERS if s is not None and re.search(p, s, re.A)]
    got = [tuple(r) for r in L.matched(spark.createDataFrame(rows, "k long, raw string").repartition(3), Q.MATCHERS).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {d for *_, d in got} == {d for _, d, _ in Q.MATCHERS}


_BOTH = ascii_bounds(r"\b")


@pytest.mark.parametrize(
    "pattern, want",
    [
        (r"\b[0-9]{1,3}\.[0-9]{1,3}\b", r"(?<!\w)[0-9]{1,3}\.[0-9]{1,3}(?!\w)"), (r"x\b|\b\w+\b", rf"x{_BOTH}|(?<!\w)\w+(?!\w)"), (r"\\[ab]\b", r"\\[ab](?!\w)"),
        (r"\b[a-z]?x", rf"{_BOTH}[a-z]?x"), (r"\b\d*x", rf"{_BOTH}\d*x"), (r"\b\d{0,2}x", rf"{_BOTH}\d{{0,2}}x"), (r"\d*\b", rf"\d*{_BOTH}"), (r"\[ab]\b", rf"\[ab]{_BOTH}"), (r"[A-z]\b", rf"[A-z]{_BOTH}"),
        (r"\b[a-z.]", rf"{_BOTH}[a-z.]"), (r"[^a]\b", rf"[^a]{_BOTH}"), (r"\b[é]", rf"{_BOTH}[é]"), (r"\\b[a]", r"\\b[a]"),
    ],
)
def test_one_side_is_asked_beside_word_sets(pattern, want):
    assert ascii_bounds(pattern) == want


def test_bounds_hold_on_odd_lines(spark):
    patterns = [r"\b[0-9]{1,3}\b", r"\b\w+\b", r"[a-z]\b", r"\b[A-Z]", r"\b[a-z]?@", r"\d*\b\.", r"\b[a-f0-9]{40,}\b", r"\b[b]@b\b"]
    lines = [s for s in ODD if s is not None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string")
    got = rows.select("i", *(F.col("s").rlike(ascii_bounds(p)) for p in patterns)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: tuple(bool(re.search(p, s, re.A)) for p in patterns) for i, s in enumerate(lines)}


@pytest.mark.parametrize("pattern, want", [(r"[a-z._]+@[a-z]+", r"[a-z._]@[a-z]+"), (r"[^a]+b|[c]+", r"[^a]b|[c]+"), ("[a]++a", "[a]++a"), ("[a]+?b", "[a]+?b"), ("[a]*b", "[a]*b"), ("[a[b]]+c", "[a[b]]+c"), ("(?i)[a]+b", "(?i)[a]+b"), ("", "")])
def test_one_of_a_leading_run_is_enough(pattern, want):
    assert somewhere(pattern) == want


def test_long_words_are_not_read_from_each_character(spark):
    """A run before the mark, one that ends elsewhere, and only the run."""
    run = "k" * 300
    rows = spark.createDataFrame([(1, f"{run}@b.cc"), (2, f"{run} a@b.cc"), (3, f"{run} @b.cc"), (4, f"{run}@"), (5, run), (6, None), (6, "")], "k int, raw string")
    out = L.matched(rows, Q.MATCHERS)
    assert sorted((r.k, r.detail) for r in out.collect()) == [(1, "e-mail"), (2, "e-mail")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ", [A-Za-z0-9._-]@" in plan and "[A-Za-z0-9._-]+@" not in plan
