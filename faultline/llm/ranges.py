"""Running totals over a whole table in a global order: by ranges, never in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch


def running(df: DataFrame, order: list[Column], label: str, **sums: Column) -> DataFrame:
    """``df`` with each of ``sums`` (long or double) over all rows before, in an ``order`` that tells all rows apart.

    Rows are cut into ranges of the order, totalled within each range and over the ranges before; what meets in one task
    is one row a range. The cut is written, so that both passes see the same ranges."""
    cut = scratch.materialise(df.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), **{f"_{k}": c for k, c in sums.items()}}), label)
    whole = cut.groupBy("_range").agg(*(F.sum(f"_{k}").alias(f"_all_{k}") for k in sums))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select("_range", *(F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_base_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumns({k: F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums})
    rows = rows.join(F.broadcast(base), "_range")  # as many rows as ranges
    return rows.select(*df.columns, *((F.col(k) + F.col(f"_base_{k}")).alias(k) for k in sums))
