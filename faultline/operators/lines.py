"""Lines of texts and the matchers that find things in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_bounds, marks, somewhere


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1."""
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.posexplode(F.split(text, "\n", -1)).alias("_p", "raw")).withColumn("line", (F.col("_p") + 1).cast("long")).drop("_p")


def matched(rows: DataFrame, matchers: list[tuple[str, str, str]], column: str = "raw") -> DataFrame:
    """Rows by matcher (kind, detail, pattern) that hits. All patterns are tried in one pass over the rows, as an array of hits;
    nothing is joined. A pattern is tried only on rows with one of its marks, where it has any."""
    c = F.col(column)

    def hit(pattern: str) -> Column:
        found = c.rlike(somewhere(ascii_bounds(pattern)))
        held = [c.contains(m) for m in marks(pattern)]
        return reduce(lambda a, b: a | b, held) & found if held else found

    hits = [F.when(hit(p), F.struct(F.lit(k).alias("kind"), F.lit(d).alias("detail"))) for k, d, p in matchers]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return rows.select(*rows.columns, F.explode(found).alias("_m")).select(*rows.columns, "_m.kind", "_m.detail")
