"""Operator 11: mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

A source's target comes from its weight: sources share ``share`` times all words by weight, none more than ``most`` times its
own words, and what a stopped source leaves is shared again. With sources ordered by the level at which each stops, the level
of the others is a running total (``targets``).

A schedule gives a source's weight over training time 0 to 1, linear between knots. Its integral, scaled to the target, is the
source's cumulative demand for words. Its documents lie end to end in an order drawn by hash, then once more; each begins
training where the demand reaches its first word: the inverse of the integral, a root of a quadratic in one segment. The
document at which the target is reached is cut, so the words taken equal the rounded target. Rows are sorted by that position
through ranges.

Equal rows (id, source and text) are one row with a number of copies until the end, so a group of any size meets no task.
Running totals go by ranges. A source of any size is split; the table of sources is joined, and sent whole only where small.

Cases: null or blank text has size 0 and takes nothing; null ``source`` is a source of its own, the last; null and repeated
ids are documents of their own; equal rows each take their own words; an empty table, or one without words, gives targets of 0;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranges, scratch

Knots = list[tuple[float, float]]
#: Sources of the first weight fade, those of the second stay level, those of the third rise.
SCHEDULES: tuple[Knots, ...] = ([(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.25), (0.5, 1.0), (1.0, 1.75)])
_CHUNK = 4096  # copies of one row that one task gives back


def integral(knots: Knots) -> list[float]:
    """Area under the schedule before each knot."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(t1 >= t2 for (t1, _), (t2, _) in zip(knots, knots[1:])) or any(v < 0 for _, v in knots):
        raise ValueError("a schedule needs rising times from 0 to 1 and weights of 0 or more")
    areas = [0.0]
    for (t1, v1), (t2, v2) in zip(knots, knots[1:]):
        areas.append(areas[-1] + (t2 - t1) * (v1 + v2) / 2)
    if not areas[-1]:
        raise ValueError("a schedule needs some weight")
    return areas


def time_of(share: Column, knots: Knots) -> Column:
    """When the schedule has given this share of its whole area."""
    areas = integral(knots)
    out = None
    for (t1, v1), (t2, v2), lo, hi in zip(knots, knots[1:], areas, areas[1:]):
        need = F.greatest(share * areas[-1] - lo, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(v1 * v1) + need * (2 * (v2 - v1) / (t2 - t1)), F.lit(0.0)))
        at = F.least(F.lit(t1) + F.coalesce(F.try_divide(need * 2, root + v1), F.lit(0.0)), F.lit(t2))
        inside = (share * areas[-1] < hi) & F.lit(hi > lo)
        out = F.when(inside, at) if out is None else out.when(inside, at)
    return out.otherwise(F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """For sources with ``source_size`` (long): slot (of weights and schedules), before (words of earlier sources), target."""
    if not 0 <= share <= most:
        raise ValueError("the share must not exceed what a source may give")
    by_name = [F.col("source").asc_nulls_last()]
    s = ranges.running(sizes.select("source", "source_size"), by_name, "by-name", rank=F.lit(1).cast("long"), before=F.col("source_size"))
    s = s.withColumn("slot", (F.col("rank") % len(weights)).cast("int"))
    s = s.withColumns({"weight": F.get(F.array(*map(F.lit, weights)), F.col("slot")), "most": F.col("source_size") * F.lit(float(most))})
    s = s.withColumn("stops_at", F.col("most") / F.col("weight"))
    s = ranges.running(s, [F.col("stops_at"), F.col("rank")], "by-stop", stopped=F.col("most"), stopped_weight=F.col("weight"))
    s = scratch.materialise(s, "levels")
    words, weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = F.greatest(F.lit(float(share) * words) - F.col("stopped"), F.lit(0.0)) / F.greatest(F.lit(weight) - F.col("stopped_weight"), F.lit(min(weights)))
    # All before a source have stopped where its own stop lies at or below this level; the first that has not sets it.
    last = s.select("stops_at", "rank", level.alias("level")).where("stops_at > level").agg(F.min_by("level", F.struct("stops_at", "rank"))).first()[0]
    target = F.col("most") if last is None else F.least(F.col("most"), F.lit(last) * F.col("weight"))
    return s.select("source", "source_size", "before", "slot", target.alias("target"))


def _copies(groups: DataFrame) -> DataFrame:
    """Each row of ``groups`` as often as ``copies`` says, with ``copy`` from 0. Many copies of one row go to many tasks."""
    upto = lambda lo, n: F.explode(F.sequence(lo, lo + n - 1))
    none, chunk = F.lit(0).cast("long"), F.lit(_CHUNK).cast("long")
    few = groups.where(F.col("copies") <= chunk).withColumn("copy", upto(none, F.col("copies")))
    many = groups.where(F.col("copies") > chunk).withColumn("_k", upto(none, F.ceil(F.col("copies") / chunk))).repartition("key", "doc_id", "_k")
    many = many.withColumn("copy", upto(F.col("_k") * chunk, F.least(chunk, F.col("copies") - F.col("_k") * chunk))).drop("_k")
    return few.unionByName(many)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, schedules: tuple[Knots, ...] = SCHEDULES, seed: int = 11) -> DataFrame:
    """One row a document, sorted by ``position``: doc_id, source, size, source_size, target, taken (words), first and second
    (words of its two passes), position and again (training times of both, null where a pass takes nothing), key."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("hash"))
    groups = scratch.materialise(rows.groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("copies")), "sized")
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    goal = scratch.materialise(targets(sizes, weights, share).withColumn("_s", _named("source")).drop("source"), "targets")

    groups = groups.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "hash"))
    order = [F.col("source").asc_nulls_last(), *map(F.col, ("key", "doc_id", "hash", "size"))]
    laid = ranges.running(groups, order, "laid", laid=F.col("size") * F.col("copies"))
    d = _copies(laid.withColumn("_s", _named("source")).join(goal, "_s"))
    d = d.withColumn("at", F.col("laid") - F.col("before") + F.col("copy") * F.col("size")).withColumn("demand", F.round("target").cast("long"))
    takes = lambda start: F.greatest(F.least(F.col("demand") - start, F.col("size")), F.lit(0).cast("long"))
    d = d.withColumns({"first": takes(F.col("at")), "second": takes(F.col("at") + F.col("source_size"))})

    def when(start: Column, words: Column) -> Column:
        shares = start / F.greatest(F.col("demand"), F.lit(1).cast("long"))
        each = reduce(lambda e, k: e.when(F.col("slot") == k, time_of(shares, schedules[k % len(schedules)])), range(1, len(weights)), F.when(F.col("slot") == 0, time_of(shares, schedules[0])))
        return F.when(words > 0, each)

    d = d.withColumns({"taken": F.col("first") + F.col("second"), "position": when(F.col("at"), F.col("first")), "again": when(F.col("at") + F.col("source_size"), F.col("second"))})
    d = d.select("doc_id", "source", "size", "source_size", "target", "taken", "first", "second", "position", "again", "key", "copy")
    order = [F.col("position").asc_nulls_last(), *map(F.col, ("key", "doc_id", "copy"))]
    return d.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy")


def curriculum(mixed: DataFrame) -> DataFrame:
    """The training order of what ``mix`` gives: doc_id, source, epoch (0 or 1), words, position, start (words trained before)."""
    part = lambda k, words, at: F.struct(F.lit(k).alias("epoch"), F.col(words).alias("words"), F.col(at).alias("position"))
    rows = mixed.select("doc_id", "source", "key", F.explode(F.array(part(0, "first", "position"), part(1, "second", "again"))).alias("p")).where("p.words > 0")
    rows = rows.select("doc_id", "source", "key", "p.*").withColumn("copies", F.lit(1)).groupBy("position", "key", "doc_id", "source", "epoch", "words").agg(F.sum("copies").alias("copies"))
    order = [F.col(c) for c in ("position", "key", "doc_id", "source", "epoch", "words")]
    out = _copies(ranges.running(rows, order, "curriculum", start=F.col("words") * F.col("copies")))
    out = out.withColumn("start", F.col("start") + F.col("copy") * F.col("words"))
    return out.select("doc_id", "source", "epoch", "words", "position", "start").repartitionByRange("start").sortWithinPartitions("start")


def _named(c: str) -> Column:
    """A name that is never null, the null source's apart from all others."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))
