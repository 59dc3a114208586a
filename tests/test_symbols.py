"""Names in texts: forms are sought where they can stand, and nothing is missed."""

import random
import re

from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vocabulary as V

FORMS = [r"(@[a-z0-9-]+/[a-z0-9._-]+)", r"(?<!\w)([a-z]+[A-Z][A-Za-z0-9]*)(?!\w)", r"(?<!\w)([A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)(?!\w)", r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+)\b", r"(?<!\w)([a-z][a-z0-9]*(?:_[a-z0-9]+)+)(?!\w)", r"`([^`\n]{2,80})`"]
ODD = [
    None, "", " ", ".", "@", "_", "`", "``", "plain words. And more.", "@acme/pkg", "@acme/", "a @b-c/d.e_f here", "fooBar", "fooBAR baz", "éfooBar", "fooBar_x", "FooBar", "F2B", "Foo2Bar and 2Bars", "aB", "abcD", "ABCD", "4Aces",
    "a.b", "a.bcd", "client.charges.create(", "$x.y$", "a$.b$.c$", "a.b$", "x$$a.bcd$$", "_a._b", "1a.b", "readme.md", "notes.md.old", "end.Next", "end. Next", "1.2.3", "v.2", "a..b", ".net.core", "снег.foo.bar", "é.foo",
    "snake_case", "Snake_case", "snake_case_", "__snake_case__", "a_b", "a1_b2_c3", "x_Y", "`quoted name`", "`  padded  `", "`one\ntwo`", "`12345`", "`timeout`", "`a", "a.b.c fooBar FooBar snake_case `fooBar` @a/bcd", "fooBar fooBar `fooBar`", "a$a$a$abc.d",
]


def _names(text):
    out = []
    for i, form in enumerate(FORMS):
        for s in re.findall(form, text or "", re.A):
            s = re.sub(r"\A +| +\Z", "", s)
            dropped = i == 3 and re.search(r"(?i)\.(md|json|yml|yaml|txt|com|org|io)\Z", s)
            if not dropped and 4 <= len(s) <= 80 and s.lower() not in V.STOP_WORDS and not re.search(r"^\d+\Z", s) and s not in out:
                out.append(s)
    return out


def test_names_of_odd_texts(spark):
    """Null, empty and repeated texts, texts with what a form needs and no name, and names of all forms, in order."""
    rows = [(i, t) for i, t in enumerate(ODD + ODD)] + [(None, "fooBar")]
    got = spark.createDataFrame(rows, "k long, s string").select("k", T.symbols("s").alias("names")).collect()
    assert [(r.k, r.names) for r in got] == [(k, _names(t)) for k, t in rows]
    assert sum(bool(r.names) for r in got) > 40


def test_forms_are_sought_where_they_can_stand(spark):
    frame = spark.createDataFrame([(1, "x")], "k long, s string").select(T.symbols("s").alias("names"))
    plan = re.sub(r"#\d+", "", frame._jdf.queryExecution().optimizedPlan().toString())
    for mark in ("Contains(coalesce(s, ), @)", "Contains(coalesce(s, ), _)", "Contains(coalesce(s, ), `)"):
        assert f"CASE WHEN {mark} THEN regexp_extract_all" in plan
    assert plan.count("CASE WHEN RLIKE(coalesce(s, )") == 2


def test_names_of_mixed_texts(spark):
    """Short parts of names in any order, against the plain patterns."""
    rng = random.Random(11)
    parts = ["a", "B", "7", "_", "$", ".", "-", "@", "/", "`", " ", "\n", "é", "ab", "Cd", "x1", "foo", "Bar", ".md", "a_b", "a.b"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(3, 24)))) for i in range(4000)]
    got = spark.createDataFrame(rows, "k long, s string").select("k", T.symbols("s").alias("names")).collect()
    assert [(r.k, r.names) for r in got] == [(k, _names(t)) for k, t in rows]


def test_words_are_read_once(spark):
    """Runs of a form are not given back, and where a dotted name begins is asked for on one side."""
    plan = spark.createDataFrame([(1, "x")], "k long, s string").select(T.symbols("s"))._jdf.queryExecution().optimizedPlan().toString()
    for pattern in ("[a-z]++[A-Z]", "[a-z0-9]++[A-Z]", "_[a-z0-9]++)+", "[\\w$]*+(?:"):
        assert pattern in plan
    assert T.ascii_bounds(r"\b") + "([A-Za-z_$]" not in plan
