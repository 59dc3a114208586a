"""Commands end to end on a small tree, and the queries against their SQL."""

import json

import duckdb
import pytest

import __spark_entry__ as entry
from faultline import api
from faultline import queries as Q


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "a.js").write_text("import Stripe from 'stripe';\nconst s = new Stripe(k);\ns.createThing();\nfetch('https://api.stripe.com/v1/things/1');\nordersController.ordersGet(1);\n")
    rows = [(1, "stripe", "spec-diff:x-v1-to-v2", "GET /v1/things/{id}", "breaking", "c", "2024-01-01", "`createThing` goes", "u1", None, "2024-01-01 00:00:00"), (2, "stripe", "r", "other", "additive", "c", None, None, "u2", None, "2024-01-01 00:00:00")]
    changes = spark.createDataFrame(rows, "id long, provider string, source_repo string, title string, change_type string, classifier string, effective_date string, migration_hint string, source_url string, raw_excerpt string, fetched_at string")
    return api.Engine(spark, changes), f"file://{root}"


def test_commands(engine):
    e, repo = engine
    (impact,) = e.scan(repo).collect()
    assert (impact.id, impact.confidence, impact.matched_symbols) == (1, "high", ["createThing"])
    found, touched, packs = e.deps(repo, match=True)
    assert "stripe client.createThing" in {r.surface for r in found.collect()} and [r.change_id for r in touched.collect()] == [1] and packs.count() == 0
    rows, total = e.list_changes(limit=1)
    assert ([r.id for r in rows.collect()], total) == ([2], 2)
    assert {r.status for r in e.revalidate().collect()} == {"no-covers", "covers-missing"}
    changed, code = e.fix(repo, "paypal-server-sdk-v1-controller-renames")
    assert code == api.OK and "getOrder(1)" in changed.first().after
    assert e.statistics() == {"changes": 2, "providers": 1, "by_type": {"additive": 1, "breaking": 1}}
    assert [r.kind for r in e.specdiff('{"paths": {"/a": {"get": {}}}}', '{"paths": {}}').collect()] == ["path-removed"]


def test_rpc(engine):
    e, repo = engine
    ask = lambda **x: json.loads(api.respond(e, json.dumps({"jsonrpc": "2.0", "id": 1, **x})))
    assert {t["name"] for t in ask(method="tools/list")["result"]["tools"]} == {"scan", "deps", "fix", "revalidate", "changes"}
    assert ask(method="tools/call", params={"name": "changes", "arguments": {"limit": 5}})["result"]["content"][1] == 2
    assert ask(method="nope")["error"]["code"] == -32601 and json.loads(api.respond(e, "{"))["error"]["code"] == -32700
    assert ask(method="tools/call", params={"name": "fix", "arguments": {"repo": repo, "migration": "zz"}})["error"]["code"] == -32602
    assert api.respond(e, '{"method": "x"}') is None


def test_flags():
    assert api.flags(["--repo", "x", "--json"], {"repo", "json"}) == {"repo": "x", "json": True}
    with pytest.raises(api.UsageError):
        api.flags(["./repo"], {"repo"})


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _norm(v):
    return None if v is None or v != v else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, db, name):
    got = Q.QUERIES[name](spark, sf)
    result = db.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr(tuple(_norm(r[columns.index(c)]) for c in sorted(columns))) for r in result.fetchall())
    assert sorted(repr(tuple(_norm(r[c]) for c in sorted(columns))) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
