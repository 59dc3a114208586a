"""The flagship plan: change records against usage found in text, scored and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators.relational import cap, position


def usage(findings: DataFrame) -> DataFrame:
    """findings (provider, kind, file, line, snippet) by provider: usage_kinds, files, sites (numbers of both). The sites
    themselves stay where they are until something is shown: see ``with_sites``."""
    return findings.groupBy("provider").agg(F.array_sort(F.collect_set("kind")).alias("usage_kinds"), F.count_distinct("file").alias("files"), F.count("*").alias("sites"))


def with_sites(shown: DataFrame, findings: DataFrame) -> DataFrame:
    """Impacts that are shown, with ``usage_sites``: all places of use of their providers, in order. Only the shown providers'
    places are gathered."""
    wanted = findings.join(shown.select("provider").distinct(), "provider", "left_semi")
    sites = F.sort_array(F.collect_list(F.struct("file", "line", "kind", "snippet"))).alias("usage_sites")
    return shown.join(wanted.groupBy("provider").agg(sites), "provider")


_WORD = r"[\w$]+"
_SIEVE = 1 << 16
_HOT = 1 << 20  # lines with one name of one provider that one task joins


def _sieve(named: DataFrame) -> bytearray:
    """A byte for each slot of a hash, 1 where a first name of a symbol falls; of fixed size, whatever there is to name."""
    slots = named.select(F.pmod(F.xxhash64("word"), F.lit(_SIEVE)).alias("slot")).distinct()
    out = bytearray(_SIEVE)
    for r in slots.collect():  # at most as many rows as slots
        out[r.slot] = 1
    return out


def symbol_sites(changes: DataFrame, findings: DataFrame, lines: DataFrame, hot: int = _HOT) -> DataFrame:
    """Where each change's symbols stand in the files that use its provider, in raw lines: id, symbol, file, line.

    Lines and symbols meet by provider and the symbol's first name; the whole symbol is then sought in the line. A line's words
    go through a sieve of all first names before they become rows. A name that stands in more than ``hot`` lines of one provider is
    dealt to several tasks by line."""
    first = F.regexp_extract("symbol", _WORD, 0)
    named = changes.select("id", "provider", F.explode(T.symbols(F.concat_ws("\n", "title", "raw_excerpt", "migration_hint"))).alias("symbol")).withColumn("word", first)
    named = scratch.materialise(named, "named")
    held = bytes(_sieve(named))
    known = lambda w: F.substring(F.lit(held), (F.pmod(F.xxhash64(w), F.lit(_SIEVE)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")
    words = lines.withColumn("words", F.filter(F.array_distinct(F.regexp_extract_all("raw", F.lit(_WORD), F.lit(0))), known)).where(F.size("words") > 0)
    words = words.select("file", "line", "raw", F.explode("words").alias("word"))
    used = findings.select("provider", "file").distinct()
    words = scratch.materialise(words.join(used, "file"), "words")
    salts = F.ceil(F.col("n") / hot).cast("int")
    often = words.groupBy("provider", "word").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("provider", "word", salts.alias("salts"))
    often = scratch.materialise(often, "often")
    none = F.coalesce("salts", F.lit(1))
    words = words.join(often, ["provider", "word"], "left").withColumn("salt", F.pmod(F.xxhash64("file", "line"), none).cast("int")).drop("salts")
    named = named.join(often, ["provider", "word"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), none - 1))).drop("salts")
    met = words.join(named, ["provider", "word", "salt"]).where(T.names_symbol(F.col("raw"), F.col("symbol")))
    return met.select("id", "symbol", "file", "line", T.snippet("raw").alias("snippet"))


def impacts(changes: DataFrame, findings: DataFrame, lines: DataFrame, every_type: bool = False) -> DataFrame:
    """Changes of monitored types, or with ``every_type`` of all: changes (id, provider, source_repo, title, change_type, effective_date, raw_excerpt, migration_hint) that meet usage:
    id, provider, title, change_type, severity, source_type, confidence, prerelease, usage_kinds, files, sites, symbols_extracted,
    matched_symbols, symbol_sites (the first hundred)."""
    live = changes if every_type else changes.where(F.col("change_type").isin(V.MONITORED_TYPES))
    found = scratch.materialise(symbol_sites(live, findings, lines), "symbol-sites")
    names = found.groupBy("id").agg(F.array_sort(F.collect_set("symbol")).alias("matched_symbols"))
    sites = cap(found, ["id"], [F.col("file"), F.col("symbol"), F.col("line")], V.SYMBOL_SITES).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("file", "line", "symbol", "snippet"))).alias("symbol_sites"))
    out = live.join(usage(findings), "provider").join(names, "id", "left").join(sites, "id", "left")
    n_named = F.size(T.symbols(F.concat_ws("\n", "title", "raw_excerpt", "migration_hint")))
    none = F.array().cast("array<string>")
    out = out.withColumns({"symbols_extracted": n_named, "matched_symbols": F.coalesce("matched_symbols", none)})
    score = T.confidence(F.size("matched_symbols"), F.col("symbols_extracted"), F.col("usage_kinds"), "source_repo", "title")
    prerelease = T.prerelease_release(F.coalesce("title", F.lit(""))) & ~T.endpoint_level("source_repo")
    return out.select("id", "provider", "title", "change_type", T.severity("change_type").alias("severity"), "effective_date", T.source_type("source_repo").alias("source_type"), score.alias("confidence"), prerelease.alias("prerelease"), "usage_kinds", "files", "sites", "symbols_extracted", "matched_symbols", "symbol_sites")


def gate_sub_apis(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changes that name no sub-API, or one that the provider's files (provider, file, text) use; with what was used."""
    named = changes.withColumn("sub_apis", T.sub_apis("provider", "title", "raw_excerpt"))
    each = named.select("id", "provider", F.explode("sub_apis").alias("sub"))
    used = each.join(files, "provider").where(T.uses_sub_api("provider", F.col("text"), F.col("sub"))).groupBy("id").agg(F.array_sort(F.collect_set("sub")).alias("sub_apis_matched"))
    return named.join(used, "id", "left").where((F.size("sub_apis") == 0) | F.col("sub_apis_matched").isNotNull())


def ranked() -> list[Column]:
    """Order of impacts: severity, confidence, newest first, id."""
    return [position(F.col("severity"), V.SEVERITY_ORDER), position(F.col("confidence"), V.CONFIDENCE_ORDER), F.col("effective_date").desc_nulls_last(), F.col("id")]


def summary(found: DataFrame, budget: int = 25) -> DataFrame:
    """What a report shows: all impacts of high confidence, the first others up to the budget, none of low confidence."""
    high = F.col("confidence") == "high"
    shown = found.where("confidence <> 'low'")
    # The others are numbered in order from the number of high ones on: one total, broadcast, and a limit that needs no plan-time count.
    n_high = shown.agg(F.count_if(high).alias("n_high"))
    others = shown.where(~high).orderBy(*ranked()).limit(budget)
    place = F.row_number().over(Window.orderBy(*ranked()))  # of at most ``budget`` rows
    kept = others.withColumn("place", place).join(F.broadcast(n_high), F.col("place") <= F.lit(budget) - F.col("n_high"), "left_semi").drop("place")
    return shown.where(high).unionByName(kept)
