"""Scopes: what heads bind and how far, and names resolved to the innermost of them."""

import pytest

from faultline.operators import scopes

JS = "const a = 1; f((x = g(a, 2), { b, c: [d] }, ...e) => { a(b); }); try { } catch (z) { z(); } for (const q of r) q(); class K { m(p, n = 2) { return p; } } if (a) { b }"


def names(code, lang):
    return {(n, code[lo:hi]) for n, lo, hi in scopes.scopes(code, lang)}


def test_javascript_heads():
    got = names(JS, "js")
    assert {n for n, _ in got} == {"x", "b", "d", "e", "z", "q", "p", "n"}
    assert ("z", "(z) { z(); }") in got and ("q", "(const q of r) q()") in got and ("p", "(p, n = 2) { return p; }") in got
    assert ("x", "(x = g(a, 2), { b, c: [d] }, ...e) => { a(b); }") in got


@pytest.mark.parametrize(
    "lang, code, want",
    [
        ("js", "h(v => v.a(1, 2), w);", {("v", "v => v.a(1, 2)")}),
        ("js", "function f(a: Foo<X>): Bar { a }", {("a", "(a: Foo<X>): Bar { a }")}),
        ("py", "def f(a: T, *b, c=d):\n    a\n    b\nrest\n", {(n, "(a: T, *b, c=d):\n    a\n    b\n") for n in "abc"}),
        ("py", "for i, j in x:\n    i\nk\n", {(n, "for i, j in x:\n    i\n") for n in "ij"}),
        ("rb", "x.each do |a, b|\n  a\nend\ny\n", {(n, "x.each do |a, b|\n  a\n") for n in "ab"}),
        ("php", "function f(A $a, $b = 1) { $a; } if ($c) { }", {("$a", "(A $a, $b = 1) { $a; }"), ("$b", "(A $a, $b = 1) { $a; }")}),
        ("go", "func f(a *T, b int) error {\n\ta\n}\n", {("a", "(a *T, b int) error {\n\ta\n}"), ("b", "(a *T, b int) error {\n\ta\n}")}),
    ],
)
def test_heads(lang, code, want):
    assert names(code, lang) == want


def test_innermost(spark):
    """Nested scopes, one over many buckets, and names that no head binds."""
    rows = [("f", 0, "scope", "a", None, 10, 90_000), ("f", 1, "scope", "a", None, 50_000, 50_100), ("f", 2, "scope", "b", None, 0, 20)]
    rows += [("f", 3, "call", "a", None, 5, None), ("f", 4, "call", "a.x", None, 49_000, None), ("f", 5, "call", "a", None, 50_050, None), ("f", 6, "alias", "c", "b.y", 12, None), ("f", 7, "call", "a", None, 90_000, None), ("g", 8, "call", "a", None, 50, None), ("f", 9, "import", "b", "a", 15, None)]
    got = scopes.resolved(spark.createDataFrame(rows, "file string, seq long, fact string, name string, target string, at long, upto long"))
    assert {r.seq: (r.name, r.target) for r in got.collect()} == {3: ("a", None), 4: ("a@10.x", None), 5: ("a@50000", None), 6: ("c", "b@0.y"), 7: ("a", None), 8: ("a", None), 9: ("b@0", "a")}
