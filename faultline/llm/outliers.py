"""Operator 3: quality rules by robust multivariate outliers, in DataFrame functions only.

Per document: counts, then two base rules, then a vector of transformed statistics. Per group (language and source; the
whole language, then all rows, where a group has fewer than ``min_rows`` rows) the minimum-covariance-determinant estimate is found
by concentration steps: keep the ``1 - trim`` rows nearest by Mahalanobis distance, estimate mean and covariance from them,
repeat. That is done from several starts at once (rows nearest to the medians by the sum and by the largest of their
coordinates in spreads, and rows drawn by a hash of their statistics); each group goes on with the start whose covariance has
the least determinant, and is reweighted once. A document whose distance exceeds the chi-square quantile of ``confidence`` is
rejected.

The statistics are rates with a spread that falls with document length, so each is centred at its group's median and
multiplied by sqrt(n * n0 / (n + n0)), n words: short documents vary more without being outliers, and long ones differ
by more than chance. Counts enter as square roots. A ridge keeps groups with constant statistics regular.

All statistics are partial aggregates over every row; no group is gathered in one task.

Cases: null text has no words and fails; null ``lang`` or ``source`` is a value of its own; a group of equal rows keeps
all of them; repeated rows count as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

_SPACE = r"[\x20\x09-\x0D]+"
#: Statistics of the vector and what is added to their variances.
RIDGE = {"x_words": 0.05, "x_length": 0.05, "x_symbols": 0.25, "x_upper": 0.25, "x_lines": 0.25, "x_repeats": 0.25}
STATS = list(RIDGE)
_GROUP = ["lvl", "g_lang", "g_source"]
_ACCURACY = 1000  # of quantile sketches: ranks are right to a thousandth


def chi_square(x: float, dof: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    terms, t = 0.0, 1.0
    for k in range(dof // 2):
        terms += t
        t *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * terms


def quantile(share: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dof) < share else (lo, mid)
    return lo


def consistency(share: float, dof: int) -> float:
    """What the covariance of the ``share`` nearest rows of a normal cloud is too small by."""
    return share / chi_square(quantile(share, dof), dof + 2)


def count_words(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper (long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumns({"_w": F.array_remove(F.split(text, _SPACE), ""), "_l": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    none = F.array().cast("array<bigint>")
    d = d.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
            "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"[A-Z]", ""))).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.when(F.size("_w") >= 5, F.transform(F.sequence(F.lit(1), F.size("_w") - 4), lambda i: F.xxhash64(F.slice("_w", i, 5)))).otherwise(none),
        }
    ).drop("_w", "_l", "text")
    # Windows that occur twice: neighbours in the sorted list. Each covers five words, fewer where the next one begins sooner.
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs)).drop("_h")
    same = lambda e, i: (F.get("_s", i - 1)["h"] == e["h"]) | (F.get("_s", i + 1)["h"] == e["h"])
    d = d.withColumn("_p", F.array_sort(F.transform(F.filter("_s", lambda e, i: F.coalesce(same(e, i), F.lit(False))), lambda e: e["i"]))).drop("_s")
    covers = F.transform("_p", lambda p, i: F.least(F.coalesce(F.get("_p", i + 1) - p, F.lit(5)), F.lit(5)).cast("long"))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_p")


def _rates() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))  # without words a base rule fails anyway
    root = lambda k, m: F.sqrt((k + 0.375) / m)
    return {
        "x_words": F.log(n),
        "x_length": F.log(F.col("word_chars") / n),
        "x_symbols": root(F.col("n_symbols"), n),
        "x_upper": root(F.col("n_upper"), n),
        "x_lines": root(F.col("n_dup_lines"), n),
        "x_repeats": root(F.col("n_repeat_words") / 5, n),
    }


def _keys(groups: DataFrame) -> list[str]:
    """A group's columns, and the start's where several are tried."""
    return [k for k in (*_GROUP, "trial") if k in groups.columns]


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, _keys(groups))


def _table(groups: DataFrame, label: str) -> DataFrame:
    """Groups as a table of few files, whose size is that of its rows, so that a small one is sent to the rows it is joined with."""
    return scratch.materialise(scratch.materialise(groups, label), label)


def _estimate(rows: DataFrame, within: Column, factor: float) -> DataFrame:
    """Mean, inverse Cholesky factor and log determinant of each group's covariance over the rows ``within``; one row per group
    and start."""
    p = len(STATS)
    cov = {f"a{i}_{j}": F.covar_pop(F.when(within, F.col(STATS[i])), F.when(within, F.col(STATS[j]))) for i in range(p) for j in range(i + 1)}
    out = rows.groupBy(*_keys(rows)).agg(*(F.avg(F.when(within, F.col(s))).alias(f"m_{s}") for s in STATS), *(c.alias(k) for k, c in cov.items()))
    out = scratch.materialise(out, "estimate")
    total = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0.0))
    for i in range(p):
        for j in range(i + 1):
            rest = F.coalesce(F.col(f"a{i}_{j}"), F.lit(0.0)) * factor - total(F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j))
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest + RIDGE[STATS[i]], F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}"))
    for i in range(p):
        for j in range(i + 1):
            out = out.withColumn(f"v{i}_{j}", 1 / F.col(f"l{i}_{i}") if i == j else -total(F.col(f"l{i}_{k}") * F.col(f"v{k}_{j}") for k in range(j, i)) / F.col(f"l{i}_{i}"))
    keep = [*(f"m_{s}" for s in STATS), *(f"v{i}_{j}" for i in range(p) for j in range(i + 1))]
    log_det = total(F.log(F.col(f"l{i}_{i}")) * 2 for i in range(p))
    return scratch.materialise(out.select(*_keys(out), *keep, log_det.alias("log_det")), "estimate")


def _distance() -> Column:
    d = [F.col(s) - F.col(f"m_{s}") for s in STATS]
    parts = [reduce(lambda a, b: a + b, (F.col(f"v{i}_{j}") * d[j] for j in range(i + 1))) for i in range(len(STATS))]
    return reduce(lambda a, b: a + b, (x * x for x in parts))


def _nearest(rows: DataFrame, distance: Column, share: float) -> DataFrame:
    """Rows with ``near``: whether they are among the group's ``share`` nearest."""
    rows = rows.withColumn("distance", distance)
    bound = rows.groupBy(*_keys(rows)).agg(F.percentile_approx("distance", share, _ACCURACY).alias("bound"))
    return _joined(rows, _table(bound, "bound")).withColumn("near", F.col("distance") <= F.col("bound")).drop("bound")


def judge(docs: DataFrame, trim: float = 0.25, steps: int = 3, confidence: float = 1 - 1e-6, n0: float = 1000.0, min_rows: int = 200) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the squared robust ``distance`` (null where a base rule failed)."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"))
    d = count_words(d).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    named = {k: F.coalesce(F.concat(F.lit("="), k), F.lit("")) for k in ("lang", "source")}
    d = scratch.materialise(d.withColumns(named), "counts")
    rows = d.where(~F.col("base_failed")).select("n_words", "lang", "source", *(c.alias(k) for k, c in _rates().items()))

    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    sizes = sizes.join(langs, "lang").withColumn("lvl", F.when(F.col("n") >= min_rows, 2).when(F.col("n_lang") >= min_rows, 1).otherwise(0))
    sizes = scratch.materialise(sizes.select("lang", "source", "lvl", F.when(F.col("lvl") > 0, F.col("lang")).otherwise("").alias("g_lang"), F.when(F.col("lvl") > 1, F.col("source")).otherwise("").alias("g_source")), "groups")
    # A row counts for its own group, and for its language and for all rows where some smaller group is judged by them.
    wide = sizes.groupBy("lang").agg(F.max((F.col("lvl") == 1).cast("int")).alias("by_lang"))
    by_all = sizes.agg(F.coalesce(F.min("lvl"), F.lit(2))).first()[0] == 0
    level = lambda k, lang, source: F.struct(F.lit(k).alias("lvl"), lang.alias("g_lang"), source.alias("g_source"))
    none = F.lit("")
    used = F.array(F.when(F.col("lvl") == 2, level(2, F.col("lang"), F.col("source"))), F.when(F.col("by_lang") == 1, level(1, F.col("lang"), none)), F.when(F.lit(by_all), level(0, none, none)))
    counted = scratch.materialise(sizes.join(wide, "lang").select("lang", "source", F.explode(F.array_compact(used)).alias("g")).select("lang", "source", "g.*"), "levels")
    rows = rows.join(counted, ["lang", "source"]).drop("lang", "source")

    # What is known of groups is written before it is joined: such a table's size is known, so a small one is sent to the
    # rows and they need not move, and the join with a large one can be split where a group has very many rows.
    median = _table(rows.groupBy("lvl", "g_lang", "g_source").agg(*(F.percentile_approx(s, 0.5, _ACCURACY).alias(f"c_{s}") for s in STATS)), "median")
    weight = F.sqrt(F.col("n_words") * n0 / (F.col("n_words") + n0))
    centred = {s: (F.col(s) - F.col(f"c_{s}")) * (F.lit(1.0) if s == "x_words" else weight) for s in STATS}
    rows = _joined(rows, median).withColumns(centred).drop(*(f"c_{s}" for s in STATS), "n_words")
    rows = scratch.materialise(rows, "vectors")

    spread = rows.groupBy("lvl", "g_lang", "g_source").agg(*(F.percentile_approx(F.abs(s), 0.5, _ACCURACY).alias(f"s_{s}") for s in STATS))
    scaled = [F.col(s) * F.col(s) / (F.pow(1.4826 * F.col(f"s_{s}"), 2) + RIDGE[s]) for s in STATS]
    starts = [reduce(lambda a, b: a + b, scaled), F.greatest(*scaled), F.xxhash64(*STATS).cast("double")]
    tried = _joined(rows, _table(spread, "spread")).select(*rows.columns, F.posexplode(F.array(*starts)).alias("trial", "start"))
    near = _nearest(tried, F.col("start"), 1 - trim).select(*rows.columns, "trial", "near")
    for _ in range(steps - 1):
        model = _estimate(near, F.col("near"), consistency(1 - trim, len(STATS)))
        near = _nearest(_joined(near.drop("near"), model), _distance(), 1 - trim).select(*rows.columns, "trial", "near")
    model = _estimate(near, F.col("near"), consistency(1 - trim, len(STATS)))
    # Of each group the start with the least determinant.
    model = model.groupBy(*_GROUP).agg(F.min_by(F.struct(*model.columns), F.struct("log_det", "trial")).alias("m")).select("m.*").drop("trial", "log_det")
    near = _joined(rows, _table(model, "best")).withColumn("distance", _distance())
    model = _estimate(near.withColumn("near", F.col("distance") <= quantile(0.975, len(STATS))).select(*rows.columns, "near"), F.col("near"), consistency(0.975, len(STATS))).drop("log_det")
    d = d.join(sizes, ["lang", "source"], "left")
    d = d.join(median, ["lvl", "g_lang", "g_source"], "left").join(model, ["lvl", "g_lang", "g_source"], "left")
    d = d.withColumns(_rates()).withColumns(centred).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return d.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= quantile(confidence, len(STATS)), F.lit(True))).alias("kept"), "distance")
