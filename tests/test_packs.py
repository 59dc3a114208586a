"""Packs: each transform class on a positive and a look-alike, idempotence, and the flows around them."""

import pytest

from faultline.operators import packs as P
from faultline.plans import impacts as I
from faultline.plans import verdicts as Q
from faultline.streaming import ingest

CASES = [
    ("calls", P.rename_calls({"api.createCompletion": "api.completions.create"}), "api.createCompletion(x) // api.createCompletion(\n'api.createCompletion('", "api.completions.create(x) // api.createCompletion(\n'api.createCompletion('"),
    ("setters", P.fold_setters("Stripe", {"setApiVersion": "apiVersion", "setTimeout": "timeout"}), "const s = Stripe(key);\ns.setTimeout(5);\ns.setApiVersion('v');\nother.setTimeout(1);\n", "const s = Stripe(key, { apiVersion: 'v', timeout: 5 });\nother.setTimeout(1);\n"),
    ("unwrap", P.unwrap("invoices.send", r"\[0\]", ""), "const r = await c.invoices.send(1);\nuse(r[0].href, q[0]);\n", "const r = await c.invoices.send(1);\nuse(r.href, q[0]);\n"),
    ("names", P.rename_names({"Product": "Products"}), "f(Product.A); x.Product; 'Product'", "f(Products.A); x.Product; 'Product'"),
    ("paths", P.replace_literals({"/v1/edge-config": "/v1/global-config"}), "get('/v1/edge-config/1'); get('/v1/edge-configs')", "get('/v1/global-config/1'); get('/v1/edge-configs')"),
    ("fields", P.drop_fields(["iin"], r"card"), "a({\n  iin: 1,\n  last4: 2,\n});\nlog(card.iin);\nif (card.iin) {\n}\nlog(bank.iin);\n", "a({\n  last4: 2,\n});\nif (card.iin) {\n}\nlog(bank.iin);\n"),
    ("patterns", P.clean_patterns(["iin"]), "const { iin, brand } = card;\n", "const { brand } = card;\n"),
    ("null", P.guard_null("details.tax_id.value"), "x = details.tax_id.value;\n// details.tax_id.value", "x = details.tax_id?.value;\n// details.tax_id.value"),
    ("mirror", P.mirror_case("FULFILLED", "NOT_REQUIRED"), "switch (s) {\n  case 'FULFILLED':\n    f();\n}\nm = {\n  'FULFILLED': 1,\n}", "switch (s) {\n  case 'FULFILLED':\n  case 'NOT_REQUIRED':\n    f();\n}\nm = {\n  'FULFILLED': 1,\n  'NOT_REQUIRED': 1,\n}"),
    ("arguments", P.name_arguments(r"c\.get", ["account_id"]), "c.get(id, { per: 1 })", "c.get({ account_id: id }, { per: 1 })"),
    ("guards", P.drop_guards(["HEAD", "CONNECT"]), "if (l.method === 'HEAD' || l.method === 'CONNECT') { skip(); }\nif (l.method === 'GET') { go(); }\n", "if (l.method === 'GET') { go(); }\n"),
    ("compose", P.compose_call(r"v\.getConfig", lambda a: f"v.listConfigs().find((c) => c.id === {a[0]})" if len(a) == 1 else None), "x = v.getConfig(id); v.getConfig(1, 2)", "x = v.listConfigs().find((c) => c.id === id); v.getConfig(1, 2)"),
    ("types", P.type_tests("sdk", {"Rate": "RateError"}, "ErrorCode"), "import { ErrorCode } from 'sdk';\nif (e.code === ErrorCode.Rate) {}", "import { ErrorCode, RateError } from 'sdk';\nif (e instanceof RateError) {}"),
    ("selection", P.selection_removed("lastIncompleteCheckout"), "{\n  id\n  lastIncompleteCheckout { id }\n}", "{\n  id\n}"),
    ("context", P.Rule("x", "a", P.guarded("vendor", lambda t: t.replace("a", "b"))), "a", "a"),
]


@pytest.mark.parametrize("name,rule,text,want", CASES)
def test_rules(name, rule, text, want):
    assert rule.apply(text) == want
    assert rule.apply(want) == want


def test_rewrite(spark):
    pack = P.Pack("p", "acme", (CASES[0][1], P.replace_literals({"completions.create": "chat.create"})), moves=(("a.js", "b.js"), ("x.js", "y.js"), ("c.js", "a.js")))
    files = spark.createDataFrame([("a.js", "api.createCompletion(1)\n"), ("b.md", "api.createCompletion(1)"), ("c.js", "nothing"), ("d.ts", None)], "path string, text string")
    (r,) = P.rewrite(files, pack).collect()
    assert (r.path, r.after, r.rules_applied, r.syntax) == ("a.js", "api.chat.create(1)\n", ["rename calls", "replace literals"], "skipped")
    assert r.diff.startswith("--- a/a.js\n+++ b/a.js\n@@ -1,2 +1,2 @@\n-api.createCompletion(1)\n+api.chat.create(1)\n")
    again = files.where("path = 'a.js'").withColumn("text", P.F.lit(r.after))
    assert P.rewrite(again, pack).count() == 0
    assert [(m.from_path, m.to_path) for m in P.moves(files, pack).collect()] == [("a.js", "b.js")]
    checked = P.rewrite(files, pack, lambda path, text: "pass")
    assert tuple(P.report(checked).first()) == (1, 1, 0, 0, "ran")
    assert P.applicable([pack], {"acme"}, {"p"}) == ([], ["p"]) and P.applicable([pack], {"acme"}, {"p"}, True)[0] == [pack]
    assert [P.exit_code(1, []), P.exit_code(0, []), P.exit_code(0, ["p"])] == [0, 1, 3]


@pytest.fixture(scope="module")
def changes(spark):
    rows = [
        (1, "acme", "spec-diff:a-v1-to-v2", "POST /v1/x/{id} gone", "breaking", "spec-diff-v1", "2024-01-01", None, "u1", "`createThing` is removed", "2024-01-02 00:00:00"),
        (2, "acme", "spec-diff:a-v2-to-v3", "POST /v1/x/{any} gone", "breaking", "spec-diff-v1", "2024-03-01", None, "u2", None, "2024-03-02 00:00:00"),
        (3, "acme", "spec-diff:a-v3-to-v4", "GET /other/y gone", "breaking", "spec-diff-v1", "2024-04-01", None, "u3", None, "2024-04-02 00:00:00"),
        (4, "acme", "changelog:acme", "no anchor", "deprecation", "keyword-v3", None, None, "u4", None, "2024-05-02 00:00:00"),
        (5, "acme", "acme/sdk", "v2.0.0-rc.1", "breaking", "llm-v1", "", "use createThing", "u5", "token=abcdefgh12345", "2024-06-02 00:00:00"),
        (6, "other", "other/sdk", "fooBarBaz", "breaking", "keyword-v3", None, None, "u6", None, "2024-06-02 00:00:00"),
    ]
    return spark.createDataFrame(rows, "id long, provider string, source_repo string, title string, change_type string, classifier string, effective_date string, migration_hint string, source_url string, raw_excerpt string, fetched_at string")


def test_impacts(spark, changes):
    findings = spark.createDataFrame([("acme", "import", "acme", "f.js", 1, "s"), ("acme", "api-host", "h", "g.js", 2, "s")], "provider string, kind string, detail string, file string, line long, snippet string")
    lines = spark.createDataFrame([("f.js", "acme.createThing(1)", 7), ("f.js", "recreateThing(1)", 8), ("z.js", "createThing", 1)], "file string, raw string, line long")
    got = {r.id: r for r in I.impacts(changes, findings, lines).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1].matched_symbols == ["createThing"] and [(s.file, s.line) for s in got[1].symbol_sites] == [("f.js", 7)]
    assert {i: r.confidence for i, r in got.items()} == {1: "high", 2: "low", 3: "low", 4: "low", 5: "medium"} and got[5].prerelease and got[1].source_type == "spec-diff"
    found = I.impacts(changes, findings, lines)
    assert [r.id for r in found.orderBy(*I.ranked()).collect()] == [1, 5, 3, 2, 4]
    assert {r.id for r in I.summary(found, 1).collect()} == {1} and {r.id for r in I.summary(found).collect()} == {1, 5}
    sent = {r.id: r.payload for r in Q.upload(found).collect()}
    assert "snippet" not in sent[1] and '"file":"f.js"' in sent[1]
    after = Q.review(found, spark.createDataFrame([(5, "unlikely", "no", 1), (1, "unlikely", "no", 2), (5, "confirm", "", 0)], "change_id long, verdict string, rationale string, position int"))
    assert {r.id: r.confidence for r in after.collect()} == {1: "high", 2: "low", 3: "low", 4: "low", 5: "low"}
    assert [r.id for r in Q.pending(found, changes, spark.createDataFrame([], "id long"), findings=findings).collect()] == [5]


def test_sub_apis(spark):
    c = spark.createDataFrame([(1, "aws", "x", "client-s3 and client-ec2"), (2, "aws", "x", "client-ec2"), (3, "google", "drive: v3", None), (4, "google", "gmail: v1", None), (5, "acme", "y", None)], "id long, provider string, title string, raw_excerpt string")
    files = spark.createDataFrame([("aws", "f", "import '@aws-sdk/client-s3'"), ("google", "g", "google.drive({})")], "provider string, file string, text string")
    assert {r.id: r.sub_apis_matched for r in I.gate_sub_apis(c, files).collect()} == {1: ["s3"], 3: ["drive"], 5: None}


def test_audit(spark, changes):
    packs = spark.createDataFrame([("a", "acme", None), ("b", "acme", None), ("c", "acme", "2024-03-01"), ("d", "acme", None)], "pack string, provider string, revalidated_through string")
    covers = spark.createDataFrame([("a", 1), ("b", 99), ("c", 1)], "pack string, id long")
    got = {r.pack: r for r in Q.audit(packs, covers, changes).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "stale", "b": "covers-missing", "c": "fresh", "d": "no-covers"}
    assert [n.id for n in got["a"].newer] == [2] and got["a"].surfaces == ["POST /v1/x/{id}"] and got["a"].baseline == "2024-01-01"


def test_verdicts(spark, changes):
    v = spark.createDataFrame([(4, "additive", "why", 2), (4, "fix", "later", 3), (4, "odd", "x", 1), (5, "fix", "y", 1), (None, "fix", "z", 1)], "id long, change_type string, rationale string, position int")
    got = {r.id: (r.change_type, r.classifier, r.updated) for r in Q.reclassify(changes, v).collect()}
    assert got[4] == ("additive", "llm-v1", True) and got[5] == ("breaking", "llm-v1", False)
    assert Q.rejected(v, P.V.CHANGE_TYPES, "change_type", "rationale").count() == 2
    f = spark.createDataFrame([(1, "code-fixable", "r", 1)], "id long, fixability string, reason string, position int")
    once = Q.set_fixability(changes, f)
    assert {r.id: r.fixability for r in once.collect()}[1] == "code-fixable"
    assert not any(r.updated for r in Q.set_fixability(once.drop("updated"), f).collect()) and any(r.updated for r in Q.set_fixability(once.drop("updated"), f, again=True).collect())


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    feed = "<feed><entry><title>v{0}.0.0</title><updated>2024-0{0}-01</updated><link href=\"u{0}\"/><content>x</content></entry><entry><title>again</title><updated>2024-01-01</updated><link href=\"u1\"/><content>x</content></entry></feed>"
    (tmp_path / "in").mkdir()
    providers = spark.createDataFrame([("a", "acme", "r"), ("b", "acme", "r")], "source string, provider string, source_repo string")
    for name, k in (("a", 1), ("b", 2)):
        (tmp_path / "in" / f"{name}.xml").write_text(feed.format(k))
        ingest.start(ingest.landed(spark, f"file://{tmp_path}/in", "atom"), providers, f"file://{tmp_path}/t", f"file://{tmp_path}/c", "now").awaitTermination()
    assert sorted((r.source_url, r.title) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [("u1", "v1.0.0"), ("u2", "v2.0.0")]
    assert ingest.windowed(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).count() > 0
