"""Reports, patches and in-place rewrites: what is applied is what was shown."""

import json

import os

import pytest
from pyspark.sql import functions as F

from faultline.operators import packs as P
from faultline.operators import relational as R
from faultline.sources import files, sinks


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", 1.5), (1, 'a"', None)], "place int, name string, x double")
    one = sinks.report(rows, {"tool": "t", "files": 3}, "impacts")
    assert json.loads(one.first().value) == {"tool": "t", "files": 3, "impacts_found": 2, "impacts": [{"name": 'a"'}, {"name": "b", "x": 1.5}]}
    sinks.write_report(one, f"file://{tmp_path}/r/s")
    assert json.loads(spark.read.text(f"file://{tmp_path}/r/s").first().value)["impacts_found"] == 2
    assert json.loads(sinks.report(rows.limit(0), {}).first().value) == {"items_found": 0, "items": []}


def test_apply_is_what_the_patch_says(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.js").write_text("one();\nold.call(1);\n")
    (tmp_path / "src" / "b.js").write_text("// old.call(\n")
    pack = P.Pack("p", "x", (P.rename_calls({"old.call": "new.call"}),))
    changed = P.rewrite(files.tree(spark, f"file://{tmp_path}"), pack).cache()
    text = sinks.patch(changed).first().value
    assert "-old.call(1);\n+new.call(1);\n" in text and "b.js" not in text
    assert [r.path for r in sinks.apply(changed, str(tmp_path)).collect()] == ["src/a.js"]
    assert (tmp_path / "src" / "a.js").read_text() == "one();\nnew.call(1);\n"
    changed.unpersist()  # an equal plan would read what is cached
    assert P.rewrite(files.tree(spark, f"file://{tmp_path}"), pack).count() == 0


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names}


def test_a_failed_task_leaves_the_tree_untouched(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a").mkdir(parents=True)
    for i in range(6):
        (root / "a" / f"{i}.txt").write_text(f"old {i}")
    before = tree(root)
    rows = [(f"a/{i}.txt", f"new {i}") for i in range(6)]
    bad = spark.createDataFrame([*rows, ("a/none.txt", "x")], "path string, after string").repartition(4)
    with pytest.raises(Exception, match="none.txt"):
        sinks.apply(bad, str(root))
    assert tree(root) == before and os.listdir(tmp_path) == ["tree"]  # nothing staged is left
    with pytest.raises(Exception, match="outside"):
        sinks.apply(spark.createDataFrame([*rows, ("../x", "x")], "path string, after string").repartition(3), str(root))
    assert tree(root) == before
    good = spark.createDataFrame([*rows[:4], ("a/5.txt", "old 5")], "path string, after string").repartition(3)
    assert sorted(r.path for r in sinks.apply(good, str(root)).collect()) == [f"a/{i}.txt" for i in (0, 1, 2, 3, 5)]
    assert tree(root) == before | dict(rows[:4]) and os.listdir(tmp_path) == ["tree"]


def test_patch_in_parts(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i:03}", f"--- f{i:03}\n+{i}\n") for i in range(50)] + [("z", "")], "path string, diff string").repartition(5)
    sinks.write_patch(rows, f"file://{tmp_path}/p")
    parts = "".join(open(tmp_path / "p" / f).read() for f in sorted(os.listdir(tmp_path / "p")) if f.startswith("part"))
    assert [x for x in parts.split("\n") if x] == [x for i in range(50) for x in (f"--- f{i:03}", f"+{i}")]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    R.write_buckets(spark.range(200).select("id", F.lit("x").alias("v")), f"file://{path}", "id", 16)
    before = {f for f in tree_of(path)}
    verdicts = spark.createDataFrame([(3, "a", 2), (3, "b", 1), (7, "c", 1), (999, "d", 1)], "id long, v string, k int")
    done = R.upsert_buckets(spark, f"file://{path}", verdicts, "id", ["v"], [F.col("v.k")], F.col("b.id") != 7)
    assert [r.updated for r in done.collect()] == [1]
    assert {r.id: r.v for r in spark.read.parquet(f"file://{path}").collect()} == {i: "b" if i == 3 else "x" for i in range(200)}
    after = {f for f in tree_of(path)}
    assert len({os.path.dirname(f) for f in before ^ after}) == 1 and len(before & after) == len(before) - 1
    assert R.upsert_buckets(spark, f"file://{path}", verdicts.where("id = 7"), "id", ["v"], [F.col("v.k")], F.lit(False)).count() == 0 and {f for f in tree_of(path)} == after


def tree_of(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_numbers_by_ranges(spark):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "x long").repartition(6)
    assert sorted((r.x, r.id) for r in R.numbered(rows, [F.col("x")], 5).collect()) == [(i, i + 6) for i in range(101)]
    assert R.numbered(rows.limit(0), [F.col("x")]).count() == 0
