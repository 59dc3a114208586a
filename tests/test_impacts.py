"""Symbols in lines: the sieve and the dealing of hot names change nothing."""

import re

from faultline.plans import impacts


def test_symbol_sites(spark):
    lines = [("f%d" % (i % 7), i, ["callMe(x)", "call me", "callMe.all other_name", "xcallMe", "a.b.c(callMe) other_name2", "pad only"][i % 6]) for i in range(120)]
    changes = [(1, "p", "t", "`callMe` and other_name", None), (2, "p", "t", "`callMe.all`", None), (3, "q", "t", "`callMe`", None), (4, "r", "t", "`callMe`", None), (5, "p", "nothing", None, None)]
    used = [("p", f"f{i}") for i in range(5)] + [("q", "f6"), ("q", "f6")]
    symbols = {1: ["callMe", "other_name"], 2: ["callMe", "callMe.all"], 3: ["callMe"], 4: ["callMe"]}
    want = sorted((i, s, f, n) for i, p, *_ in changes if i in symbols for s in symbols[i] for f, n, raw in lines if (p, f) in used and re.search(rf"(?<![\w$]){re.escape(s)}(?![\w$])", raw))
    frames = spark.createDataFrame(changes, "id long, provider string, title string, raw_excerpt string, migration_hint string"), spark.createDataFrame(used, "provider string, file string"), spark.createDataFrame(lines, "file string, line long, raw string")
    for hot in (1 << 20, 3):
        assert sorted((r.id, r.symbol, r.file, r.line) for r in impacts.symbol_sites(*frames, hot=hot).collect()) == want
    assert len(want) > 60


def test_sites_of_what_is_shown(spark):
    found = spark.createDataFrame([("p", "import", "f", 2, "s"), ("p", "import", "f", 1, "s"), ("q", "env-var", "g", 1, "s")], "provider string, kind string, file string, line long, snippet string")
    shown = spark.createDataFrame([(1, "p"), (2, "p")], "id long, provider string")
    assert [(r.id, [s.line for s in r.usage_sites]) for r in impacts.with_sites(shown, found).orderBy("id").collect()] == [(1, [1, 2]), (2, [1, 2])]


def test_at_most_a_hundred_sites_a_change(spark):
    lines = spark.createDataFrame([("f", i, "callMe()") for i in range(130)], "file string, line long, raw string")
    changes = spark.createDataFrame([(1, "p", "", "t", "breaking", None, "`callMe`", None)], "id long, provider string, source_repo string, title string, change_type string, effective_date string, raw_excerpt string, migration_hint string")
    found = spark.createDataFrame([("p", "import", "f", 1, "s")], "provider string, kind string, file string, line long, snippet string")
    r = impacts.impacts(changes, found, lines).first()
    assert [s.line for s in r.symbol_sites] == list(range(100)) and r.confidence == "high" and (r.files, r.sites) == (1, 1)
