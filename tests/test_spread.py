"""Small tables whose rows stand for much work: one row group is many tasks."""

import pytest
from pyspark.sql import functions as F

from faultline import queries as Q
from faultline.plans import inventory
from faultline.sources import files, specs


class Caught(Exception):
    pass


@pytest.fixture(scope="module")
def one_group(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("one"))
    for table, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        spark.range(6000).withColumnRenamed("id", key).coalesce(1).write.parquet(f"{root}/{table}.parquet")
    return root


def _caught(monkeypatch, spark, root, query, place, name):
    def catch(rows, *_):
        raise Caught(rows)

    monkeypatch.setattr(place, name, catch)
    with pytest.raises(Caught) as e:
        Q.QUERIES[query](spark, root)
    return e.value.args[0]


@pytest.mark.parametrize("query, place, name", [("resolved_calls", inventory, "surfaces"), ("proven_calls", inventory, "surfaces"), ("usage_scan", files, "usage"), ("code_inventory", inventory, "surfaces"), ("spec_diff_openapi", specs, "facts"), ("spec_rules", specs, "facts"), ("code_masks", Q, "_dealt"), ("pack_catalogue", Q, "_dealt")])
def test_one_row_group_is_many_tasks(monkeypatch, spark, one_group, query, place, name):
    rows = _caught(monkeypatch, spark, one_group, query, place, name)
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


def test_only_packages_are_sent_whole(monkeypatch, spark):
    """Small tables, too, meet by key: a planner that sends what looks small on disk sends millions of rows through the driver."""
    from faultline import scratch

    plans = []
    keep = scratch.materialise

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return keep(df, *more)

    monkeypatch.setattr(scratch, "materialise", seen)
    texts = {"src/a.js": "const Stripe = require('stripe');\nconst pay = new Stripe(k);\nexports.pay = pay;\n", "src/use.js": "import { pay } from './a';\nitems.map((pay) => pay.gone.list());\nconst all = pay;\nall.charges.create();\n"}
    out = inventory.surfaces(spark.createDataFrame(list(texts.items()), "path string, text string"))
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert [(r.file, r.surface, r.line) for r in out.where("kind = 'sdk-call'").collect()] == [("src/use.js", "stripe client.charges.create", 4)]
    sent = [p for p in plans for _ in range(p.count("BroadcastHashJoin") + p.count("BroadcastNestedLoopJoin"))]
    assert len(sent) == 1 and "Scan ExistingRDD[provider" in sent[0]  # the packages of the signatures
    assert sum(p.count("SortMergeJoin") for p in plans) > 10


def test_exports_go_beyond_the_rows_of_a_recursive_query(spark):
    """A client that is given on from file to file, with fewer rows allowed to a recursive query than the ways have."""
    texts = {"src/a0.js": "const Stripe = require('stripe');\nconst pay = new Stripe(k);\nexports.pay = pay;\n"}
    texts |= {f"src/a{i}.js": f"export {{ pay }} from './a{i - 1}';\n" for i in range(1, 6)}
    texts["src/use.js"] = "import { pay } from './a5';\npay.charges.create();\n"
    made = spark.createDataFrame(list(texts.items()), "path string, text string")
    old = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 2)
    try:
        found = {(r.file, r.surface, r.line) for r in inventory.surfaces(made).where("kind = 'sdk-call'").collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", old)
    assert found == {("src/use.js", "stripe client.charges.create", 2)}


def test_a_matcher_holds_its_detail(spark):
    """What is tried is narrowed by text that a hit must hold; hosts hit in any case, and beyond ASCII as they did."""
    texts = ["fetch('https://API.Stripe.com/v1')", "fetch('https://apı.strıpe.com/v1')", "x = 1"]
    made = spark.createDataFrame([(f"f{i}.js", t) for i, t in enumerate(texts)], "path string, text string")
    hits = {(r.file, r.kind, r.detail) for r in files.usage(made).collect()}
    every = {(f"f{i}.js", kind, detail) for i, t in enumerate(texts) for _, kind, detail, lang, p in files.matchers() if lang in (None, "js") and p.search(t)}
    assert hits == every and ("f0.js", "api-host", "api.stripe.com") in hits


def test_facts_of_small_snapshots_are_sent_together(spark):
    """Batches hold facts of many snapshots, and a large one's facts are many batches; what comes out is the same."""
    large = '{"paths": {"/a": {"post": {"requestBody": {"content": {"j": {"schema": {"properties": {%s}}}}}}}}}' % ", ".join(f'"p{i}": {{}}' for i in range(3000))
    rows = [(str(i), '{"paths": {"/a": {"get": {}}}}') for i in range(500)] + [("large", large), ("none", "[]"), ("broken", "{"), ("null", None)]
    made = specs.facts(spark.createDataFrame(rows, "spec_id string, spec string").coalesce(1))
    sizes = made.mapInArrow(lambda bs: (type(b).from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert sum(r.n for r in sizes.collect()) == 500 + 2 + 4 * 3000
    assert made.where("spec_id = 'large'").groupBy("part").count().count() == 6
    assert made.where("spec_id <> 'large'").select("spec_id", "op", "part").distinct().count() == 500


def test_names_of_a_body_meet_by_joins(monkeypatch, spark):
    """The names of a body do not stand beside each of its properties: those would be their square."""
    from faultline import scratch
    from faultline.operators import specdiff

    plans = []
    keep = scratch.materialise

    def seen(df, *more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, *more)

    monkeypatch.setattr(scratch, "materialise", seen)
    prop = lambda names: '{"paths": {"/a": {"post": {"requestBody": {"content": {"j": {"schema": {"properties": {%s}}}}}}}}}' % ", ".join(f'"{n}": {{"type": "object", "properties": {{"x": {{}}}}}}' for n in names)
    old, new = (specs.facts(spark.createDataFrame([("s", prop(n))], "spec_id string, spec string")) for n in ("abc", "bcd"))
    out = specdiff.diff(old, new)
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert not any("collect_set" in p or "collect_list" in p for p in plans)
    removed, added = ({r.detail for r in out.where(f"kind = 'request-prop-{k}'").collect()} for k in ("removed", "added"))
    assert (removed, added) == ({"a", "a.x"}, {"d", "d.x"})


def test_masks_of_few_texts_at_a_time(spark, tmp_path):
    """More texts than go in one step, a null and an empty one among them."""
    texts = [None, "", *("a // b\n'c'" for _ in range(200))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in Q.QUERIES["lex_mask"](spark, str(tmp_path)).collect())
    assert got == [(i, None if t is None else len(t), None if t is None else t.count("\n")) for i, t in enumerate(texts)]
