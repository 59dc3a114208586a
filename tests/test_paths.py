"""The join of paths by keys against the test of each pair."""

import random

from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.operators import paths, relational


def test_against_all_pairs(spark):
    rng = random.Random(4)
    seg = ["a", "b", "c", "{param}", "{id}", "{}", "x{y}"]
    made = [(k, "/" + "/".join(rng.choice(seg) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/"])) for k in "pq" for _ in range(70)] + [("p", None), ("p", "/"), ("p", "//a///b"), ("q", "")]
    rows = spark.createDataFrame(made, "provider string, path string")
    a, b = rows.withColumnRenamed("path", "x").withColumn("i", F.monotonically_increasing_id()), rows.withColumnRenamed("path", "y").withColumn("j", F.monotonically_increasing_id())
    for slot, test in ((paths.code_slot, T.paths_overlap), (paths.anchor_slot, T.anchors_overlap)):
        want = sorted(tuple(r) for r in a.join(b, "provider").where(test(F.col("x"), F.col("y"))).select("provider", "i", "j").collect())
        got = sorted(tuple(r) for r in paths.overlapping(a, b, ["provider"], "x", "y", slot).select("provider", "i", "j").collect())
        assert got == want and len(want) > 300


def test_stale_packs_by_anchor(spark):
    """Firehose changes need an overlapping anchor; others only where both sides have one."""
    changes = [
        (1, "p", "2024-01-01", "s", False, False, "/v1/a/{id}"), (2, "p", "2024-02-01", "s", False, False, "/v1/a/7"), (3, "p", "2024-02-01", "s", False, False, "/v1/b"), (4, "p", "2024-02-01", "s", False, False, None),
        (5, "p", "2024-02-01", "s", False, True, None), (6, "p", "2024-02-01", "s", False, True, "/v1/a"), (7, "p", "2024-02-01", "t", False, False, "/v1/a/7"), (8, "p", "2024-02-01", "s", True, False, "/v1/a/7"), (9, "p", "2023-12-01", "s", False, False, "/v1/a/7"), (10, "q", "2024-02-01", "s", False, False, "/v1/a/7"),
    ]
    rows = spark.createDataFrame(changes, "id long, provider string, chrono string, stream string, prerelease boolean, firehose boolean, anchor string")
    packs = spark.createDataFrame([("x", "p", None), ("y", "p", "2024-03-01")], "pack string, provider string, revalidated_through string")
    covers = spark.createDataFrame([("x", 1), ("y", 1)], "pack string, id long")
    assert sorted((r.pack, r.id) for r in relational.stale(packs, covers, rows).collect()) == [("x", 2), ("x", 4), ("x", 6)]
