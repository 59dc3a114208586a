"""Relational operators of change-impact analysis, generic over column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose sides both grow with the input: rows meet by key and are never sent whole. The planner takes the
    packed size of a file for that of its rows, and rows that are exploded for those they come from, so it would send tables through
    the driver that are many times as large as its limit."""
    return df.hint("merge")


def first_writer(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ingest(incoming: DataFrame, stored: DataFrame, key: str, order: list[Column], required: tuple[str, ...] = ()) -> DataFrame:
    """Rows that an insert-or-ignore would add: valid, not stored, first of their key."""
    valid = reduce(lambda d, c: d.where(F.col(c).isNotNull()), (key, *required), incoming)
    return first_writer(valid.join(stored.select(key).distinct(), key, "left_anti"), [key], order)


def upsert(base: DataFrame, verdicts: DataFrame, key: str, values: list[str], order: list[Column], applies: Column) -> DataFrame:
    """``base`` with ``values`` of the first verdict on its key that applies; ``applies`` may refer to ``b.`` and ``v.``."""
    joined = base.alias("b").join(verdicts.alias("v"), F.col(f"b.{key}") == F.col(f"v.{key}")).where(applies)
    chosen = first_writer(joined.select(F.col(f"b.{key}").alias(key), *(F.col(f"v.{c}").alias(f"_{c}") for c in values), *(o.alias(f"_o{i}") for i, o in enumerate(order))), [key], [F.col(f"_o{i}") for i in range(len(order))])
    chosen = chosen.select(key, *(f"_{c}" for c in values)).withColumn("_set", F.lit(True))
    out = base.join(chosen, key, "left")
    return out.select(*((F.when(F.col("_set"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)) for c in base.columns), F.coalesce("_set", F.lit(False)).alias("updated"))


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """``rows`` as a Parquet table in folders by a hash of the key; their number is part of the folders' name."""
    name = f"bucket_{buckets}"
    rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition(buckets, name).write.partitionBy(name).parquet(path)


def upsert_buckets(spark: SparkSession, path: str, verdicts: DataFrame, key: str, values: list[str], order: list[Column], applies: Column) -> DataFrame:
    """``upsert`` of a table of ``write_buckets`` in place. Only buckets in which a verdict applies are written again, from a copy
    made first; the others' files stay. Gives the number of rows updated by bucket."""
    table = spark.read.parquet(path)
    bucket = next(c for c in table.columns if c.startswith("bucket_"))
    n = int(bucket.removeprefix("bucket_"))
    asked = verdicts.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b")).distinct()
    near = table.where(F.col(bucket).isin([r.b for r in asked.collect()]))  # at most ``n``
    done = scratch.materialise(upsert(near, verdicts, key, values, order, applies), "upsert")
    touched = scratch.materialise(done.where("updated").groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("updated")), "touched")
    again = [r.bucket for r in touched.select("bucket").collect()]
    if again:
        rows = done.where(F.col(bucket).isin(again)).drop("updated").repartition(len(again), bucket)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)
    return touched


def numbered(rows: DataFrame, order: list[Column], after: int = 0, name: str = "id") -> DataFrame:
    """``rows`` with numbers from ``after`` + 1 on in an order over all of them, counted by ranges: no task numbers them all."""
    cut = scratch.materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = cut.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")  # a row for each range
    return out.withColumn(name, F.lit(after) + F.col("_before") + place).drop("_range", "_before")


def cap(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def position(value: Column, order: list[str]) -> Column:
    """Rank of a value in a list, from 0; -1 for others, which so come first."""
    return F.array_position(F.array(*map(F.lit, order)), value) - 1


def page(rows: DataFrame, order: list[Column], limit: int | None, default: int = 20, most: int = 200) -> DataFrame:
    """A page of at most ``most`` rows."""
    return rows.orderBy(*order).limit(max(1, min(most, default if limit is None else limit)))


def stale(packs: DataFrame, covers: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes newer than what each pack covers, on its streams.

    packs: pack, provider, revalidated_through; covers: pack, id; changes: id, provider, chrono, stream, prerelease,
    firehose, anchor. Firehose changes need an anchor that overlaps a covered one; others only if both sides have any.
    """
    from .paths import anchor_slot, pairs

    known = covers.join(changes.select("id", "chrono", "stream", "anchor"), "id")
    base = known.groupBy("pack").agg(F.max("chrono").alias("baseline"), F.count("anchor").alias("n_anchors"))
    followed = packs.join(base, "pack").join(known.select("pack", "stream").distinct(), "pack")
    newer = followed.join(changes, ["provider", "stream"]).join(covers, ["pack", "id"], "left_anti")
    newer = newer.where(F.col("chrono") > F.col("baseline")).where(~F.col("prerelease"))
    newer = newer.where(F.col("revalidated_through").isNull() | (F.col("chrono") > F.col("revalidated_through")))
    covered = known.where("anchor IS NOT NULL").select("pack", F.col("anchor").alias("covered")).distinct().join(packs.select("pack", "provider"), "pack")
    met = pairs(changes.select("provider", "anchor"), covered, ["provider"], "anchor", "covered", anchor_slot, anchor_slot)
    met = met.select("provider", F.col("path_a").alias("anchor"), F.col("path_b").alias("covered")).join(covered, ["provider", "covered"]).select("pack", "anchor", F.lit(True).alias("hit")).distinct()
    newer = newer.join(met, ["pack", "anchor"], "left")
    both = F.col("anchor").isNotNull() & (F.col("n_anchors") > 0)
    return newer.where(F.when(F.col("firehose") | both, both & F.col("hit").isNotNull()).otherwise(True)).select("pack", "id", "chrono", "baseline", "anchor")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """One row per difference of two snapshots: key, kind, field, before, after. Comparisons with null stay silent."""
    o, n = (d.select(key, F.lit(True).alias(f"_{s}"), *(F.col(c).cast("string").alias(f"{s}_{c}") for c in compared)) for d, s in ((old, "o"), (new, "n")))
    both = o.join(n, key, "full")
    kind = lambda test, k, f, a, b: F.when(test, F.struct(F.lit(k).alias("kind"), F.lit(f).cast("string").alias("field"), a.cast("string").alias("before"), b.cast("string").alias("after")))
    none = F.lit(None)
    cells = [kind(F.col("_n").isNull(), "removed", None, none, none), kind(F.col("_o").isNull(), "added", None, none, none)]
    cells += [kind(F.col(f"o_{c}") != F.col(f"n_{c}"), "changed", c, F.col(f"o_{c}"), F.col(f"n_{c}")) for c in compared]
    rows = both.select(key, F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("d"))
    return rows.select(key, "d.kind", "d.field", "d.before", "d.after")


def set_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Values each key lost and gained; keys on one side only stay silent."""
    sets = [d.where(F.col(value).isNotNull()).groupBy(key).agg(F.collect_set(value).alias(s)) for d, s in ((old, "o"), (new, "n"))]
    both = sets[0].join(sets[1], key)
    side = lambda a, b, k: F.transform(F.array_except(a, b), lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))
    return both.select(key, F.explode(F.concat(side("o", "n", "value-removed"), side("n", "o", "value-added"))).alias("d")).select(key, "d.kind", "d.value")


def bounds_diff(old: DataFrame, new: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Bounds that became tighter: a higher minimum, a lower maximum, both explicit."""
    both = old.select(key, F.col(low).alias("o_low"), F.col(high).alias("o_high")).join(new.select(key, F.col(low).alias("n_low"), F.col(high).alias("n_high")), key)
    one = lambda test, k, a, b: F.when(test, F.struct(F.lit(k).alias("kind"), F.col(a).alias("before"), F.col(b).alias("after")))
    cells = F.array(one(F.col("n_low") > F.col("o_low"), "min-increased", "o_low", "n_low"), one(F.col("n_high") < F.col("o_high"), "max-decreased", "o_high", "n_high"))
    return both.select(key, F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def closure(roots: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Names reached from ``roots`` (name, target) over ``edges`` (name, via) in at most ``hops`` steps; a name that is
    bound keeps its first target, and of two ways of equal length the least target. Each hop is written, so no hop is computed
    twice; ends early when nothing is new."""
    bound = fresh = roots.select("name", "target", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        found = edges.join(fresh.select(F.col("name").alias("via"), "target"), "via").groupBy("name").agg(F.min("target").alias("target"))
        fresh = found.join(bound.select("name"), "name", "left_anti").select("name", "target", F.lit(hop).alias("hop"))
        fresh = scratch.materialise(fresh, "closure")
        if fresh.isEmpty():
            break
        bound = bound.unionByName(fresh)
    return bound


def group_counts(rows: DataFrame, by: Column, name: str, unset: str = "(unset)") -> DataFrame:
    return rows.groupBy(F.coalesce(by, F.lit(unset)).alias(name)).agg(F.count("*").alias("n"))
