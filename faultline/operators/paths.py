"""Templates of paths joined by keys, not pair by pair.

Two paths overlap if the segments of the shorter one fit those of the longer, where a slot fits anything, and the shorter has
two segments or both have as many. For a pair, only the places that are no slot on either side must be equal. So each path
takes, for every pattern of slots that the other side has at that length, a key of its segments with the places of both
patterns blanked; equal keys are overlaps. What is compared is what matches; patterns are few, however many paths there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Slot = Callable[[Column], Column]


def code_slot(segment: Column) -> Column:
    """A slot of an endpoint found in code."""
    return segment == "{param}"


def anchor_slot(segment: Column) -> Column:
    """A slot of an anchor: any name in braces."""
    return segment.rlike(r"^\{[^}]+\}\z")


def _prefixes(rows: DataFrame, on: list[str], path: str, slot: Slot, side: str) -> DataFrame:
    """Distinct paths, a row for each number n of leading segments that counts: its pattern of slots, whether it is the whole."""
    d = rows.select(*on, F.col(path).alias(f"path_{side}")).where(F.col(f"path_{side}").isNotNull()).distinct()
    d = d.withColumn("s", F.filter(F.split(f"path_{side}", "/"), lambda x: x != "")).where(F.size("s") > 0)
    size = F.size("s")
    d = d.withColumn("n", F.explode(F.when(size == 1, F.array(F.lit(1))).otherwise(F.sequence(F.lit(2), size))))
    d = d.withColumns({f"whole_{side}": F.col("n") == size, "s": F.slice("s", F.lit(1), F.col("n"))})
    return d.select(*on, f"path_{side}", "n", "s", f"whole_{side}", F.array_join(F.transform("s", lambda x: F.when(slot(x), "1").otherwise("0")), "").alias(f"slots_{side}"))


def _keyed(rows: DataFrame, other: DataFrame, on: list[str], side: str, against: str) -> DataFrame:
    """Rows with a key for each pattern of the other side."""
    patterns = other.select(*on, "n", f"slots_{against}").distinct()
    blank = lambda x, i: F.when((F.substring(f"slots_{side}", i + 1, F.lit(1)) == "1") | (F.substring(f"slots_{against}", i + 1, F.lit(1)) == "1"), "\0").otherwise(x)
    both = rows.join(patterns, [*on, "n"])
    return both.select(*on, "n", f"path_{side}", f"whole_{side}", "slots_a", "slots_b", F.array_join(F.transform("s", blank), "/").alias("key"))


def pairs(left: DataFrame, right: DataFrame, on: list[str], left_path: str, right_path: str, left_slot: Slot = code_slot, right_slot: Slot = anchor_slot) -> DataFrame:
    """``on``, path_a, path_b: distinct paths of both sides that overlap."""
    a, b = _prefixes(left, on, left_path, left_slot, "a"), _prefixes(right, on, right_path, right_slot, "b")
    ka, kb = _keyed(a, b, on, "a", "b"), _keyed(b, a, on, "b", "a")
    met = ka.join(kb, [*on, "n", "slots_a", "slots_b", "key"]).where(F.col("whole_a") | F.col("whole_b"))
    return met.where((F.col("n") >= 2) | (F.col("whole_a") & F.col("whole_b"))).select(*on, "path_a", "path_b")


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_path: str, right_path: str, left_slot: Slot = code_slot, right_slot: Slot = anchor_slot) -> DataFrame:
    """Rows of both sides, joined where their paths overlap. Besides ``on`` they share no column."""
    met = pairs(left, right, on, left_path, right_path, left_slot, right_slot)
    met = met.withColumnsRenamed({"path_a": left_path, "path_b": right_path})
    return met.join(left, [*on, left_path]).join(right, [*on, right_path])
