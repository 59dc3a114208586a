"""The command line: results, files and exit codes."""

import json

from faultline.__main__ import main


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.js").write_text("import Stripe from 'stripe';\nconst s = new Stripe(k);\ns.createThing();\nordersController.ordersGet(1);\n")
    rows = [(1, "stripe", "r", "gone", "breaking", "c", "2024-01-01", "`createThing` goes", "u1", None, "2024-01-01 00:00:00"), (2, "stripe", "r", "other", "additive", "c", None, None, "u2", None, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "id long, provider string, source_repo string, title string, change_type string, classifier string, effective_date string, migration_hint string, source_url string, raw_excerpt string, fetched_at string").write.parquet(f"{tmp_path}/changes")
    repo, table = f"file://{tmp_path}/repo", ["--changes", f"{tmp_path}/changes"]

    def run(*argv):
        code = main([*argv], spark)
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    code, found = run("scan", "--repo", repo, *table)
    assert code == 0 and [(r["id"], r["confidence"]) for r in found] == [(1, "high")]
    code, found = run("scan", "--repo", repo, "--change-id", "2", *table)  # any type, if asked for
    assert code == 0 and [r["id"] for r in found] == [2]
    assert run("scan", "--repo", repo, "--provider", "plaid", *table) == (0, [])  # nothing found is done
    assert run("scan", "--repo", repo)[0] == run("scan", *table)[0] == run("scan", "./repo")[0] == run("nope")[0] == run("scan", "--repo", repo, "--change-id", "x", *table)[0] == 2
    code, found = run("deps", "--repo", repo, "--out", f"{tmp_path}/deps")
    assert code == 0 and found == [] and any(r.surface == "stripe client.createThing" for r in spark.read.json(f"{tmp_path}/deps").collect())
    fix = ("fix", "--repo", f"{tmp_path}/repo", "--migration", "paypal-server-sdk-v1-controller-renames")
    code, found = run(*fix)
    assert code == 0 and found[0]["path"] == "a.js" and "ordersGet" in (tmp_path / "repo" / "a.js").read_text()
    assert run(*fix, "--apply") == (0, [{"path": "a.js"}]) and "getOrder(1)" in (tmp_path / "repo" / "a.js").read_text()
    assert run(*fix)[0] == 1 and run("fix", "--repo", repo, "--migration", "zz")[0] == 2
    (tmp_path / "o.json").write_text('{"paths": {"/a": {"get": {}}}}')
    (tmp_path / "n.json").write_text('{"paths": {}}')
    assert [r["kind"] for r in run("specdiff", "--old", f"{tmp_path}/o.json", "--new", f"{tmp_path}/n.json")[1]] == ["path-removed"]
    (tmp_path / "v.json").write_text('[{"id": 2, "change_type": "fix", "rationale": "why"}]')
    assert {(r["id"], r["change_type"]) for r in run("reclassify", "--verdicts", f"{tmp_path}/v.json", *table)[1]} == {(1, "breaking"), (2, "fix")}


def test_reports_feeds_and_matches(spark, tmp_path, capsys):
    """deps --match, a report as the source of fixes and of a review, a stale pack, and feeds into a table."""
    from faultline.operators.catalogue import catalogue

    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.js").write_text("import Stripe from 'stripe';\nfetch('https://api.stripe.com/v1/things/1');\nordersController.ordersGet(1);\n")
    pack = next(p for p in catalogue() if p.name == "paypal-server-sdk-v1-controller-renames")
    covered = min(pack.covers)
    schema = "id long, provider string, source_repo string, title string, change_type string, classifier string, effective_date string, migration_hint string, source_url string, raw_excerpt string, fetched_at string"
    row = lambda i, p, title, date: (i, p, "r", title, "breaking", "c", date, None, f"u{i}", None, "2024-01-01 00:00:00")
    spark.createDataFrame([row(1, "stripe", "GET /v1/things/{id}", "2024-01-01"), row(covered, pack.provider, "t", "2024-01-01")], schema).write.parquet(f"{tmp_path}/changes")
    repo, table = f"{tmp_path}/repo", ["--changes", f"{tmp_path}/changes"]

    def run(*argv):
        code = main([*argv], spark)
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    code, found = run("deps", "--repo", f"file://{repo}", "--match", *table)
    assert code == 0 and [json.loads(r["item"])["change_id"] for r in found if r["part"] == "change"] == [1] and any(r["part"] == "inventory" for r in found)
    (tmp_path / "report.json").write_text(json.dumps({"id": covered, "confidence": "medium"}) + "\n" + json.dumps({"id": 1, "confidence": "high"}) + "\n")
    report = f"file://{tmp_path}/report.json"
    code, found = run("fix", "--repo", repo, "--from-report", report, *table)
    assert code == 0 and [(r["pack"], r["path"]) for r in found] == [(pack.name, "a.js")] and "ordersGet" in (tmp_path / "repo" / "a.js").read_text()
    (tmp_path / "other.json").write_text('{"id": 1}\n')
    assert run("fix", "--repo", repo, "--from-report", f"file://{tmp_path}/other.json", *table)[0] == 1
    (tmp_path / "v.json").write_text(json.dumps([{"change_id": covered, "verdict": "unlikely", "rationale": "no"}]))
    assert {(r["id"], r["confidence"]) for r in run("review", "--report", report, "--verdicts", f"{tmp_path}/v.json")[1]} == {(covered, "low"), (1, "high")}
    assert run("revalidate", *table)[0] == 0
    spark.createDataFrame([row(10**9, pack.provider, "t", "2099-01-01")], schema).write.mode("append").parquet(f"{tmp_path}/changes")
    assert run("revalidate", *table)[0] == 1  # a pack is stale
    assert run("fix", "--repo", repo, "--from-report", report, *table)[0] == 3 and run("fix", "--repo", repo, "--from-report", report, "--acknowledge", *table)[0] == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text('<feed><entry><title>v1</title><updated>2024-01-01</updated><link href="u"/><content>x</content></entry></feed>')
    (tmp_path / "p.json").write_text('[{"source": "a", "provider": "acme", "source_repo": "r"}]')
    sync = ("sync", "--feeds", f"file://{tmp_path}/in", "--table", f"file://{tmp_path}/t", "--checkpoint", f"file://{tmp_path}/c", "--providers", f"{tmp_path}/p.json")
    assert run(*sync)[0] == run(*sync)[0] == 0 and spark.read.parquet(f"{tmp_path}/t").count() == 1
    assert run(*sync, "--kind", "x")[0] == run("review")[0] == 2
