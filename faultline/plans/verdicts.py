"""Guarded updates of change records by verdict files, staleness audits, and what a report may upload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import relational as R
from .impacts import with_sites


def reclassify(changes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Change types by verdicts (id, change_type, rationale, position), where the type is one of the domain, a reason is given,
    and the record is not from a stronger classifier already."""
    ok = verdicts.where(F.col("change_type").isin(V.CHANGE_TYPES) & (F.trim(F.coalesce("rationale", F.lit(""))) != "") & F.col("id").isNotNull())
    ok = ok.select("id", "change_type", F.col("rationale").alias("class_rationale"), F.lit("llm-v1").alias("classifier"), "position")
    base = changes if "class_rationale" in changes.columns else changes.withColumn("class_rationale", F.lit(None).cast("string"))
    weaker = ~F.coalesce(F.col("b.classifier"), F.lit("")).isin("llm-v1", "human-v1")
    return R.upsert(base, ok, "id", ["change_type", "class_rationale", "classifier"], [F.col("v.position")], weaker)


def rejected(verdicts: DataFrame, domain: list[str], value: str, reason: str) -> DataFrame:
    """Verdict rows that are not valid."""
    return verdicts.where(F.col("id").isNull() | ~F.coalesce(F.col(value).isin(domain), F.lit(False)) | (F.trim(F.coalesce(reason, F.lit(""))) == ""))


def set_fixability(changes: DataFrame, verdicts: DataFrame, again: bool = False) -> DataFrame:
    """Fixability by verdicts (id, fixability, reason, position); a record that has one keeps it, unless it is audited again."""
    base = changes
    for c in ("fixability", "fixability_reason", "fixability_classifier"):
        base = base if c in base.columns else base.withColumn(c, F.lit(None).cast("string"))
    ok = verdicts.where(F.col("fixability").isin(V.FIXABILITY) & (F.trim(F.coalesce("reason", F.lit(""))) != "") & F.col("id").isNotNull())
    ok = ok.select("id", "fixability", F.col("reason").alias("fixability_reason"), F.lit("llm-v1").alias("fixability_classifier"), "position")
    return R.upsert(base, ok, "id", ["fixability", "fixability_reason", "fixability_classifier"], [F.col("v.position")], F.lit(again) | F.col("b.fixability").isNull())


def pending(impacts: DataFrame, changes: DataFrame, reviewed: DataFrame, most: int | None = None, findings: DataFrame | None = None) -> DataFrame:
    """Impacts of medium confidence that nobody has reviewed, with the change's text and the first five places of use: of
    ``findings``, which join only what is pending, where the impacts do not carry them."""
    rows = impacts.where("confidence = 'medium'").join(reviewed.select("id"), "id", "left_anti")
    rows = with_sites(rows, findings) if findings is not None else rows
    rows = rows.join(changes.select("id", "raw_excerpt", "migration_hint"), "id", "left").withColumn("evidence", F.slice("usage_sites", 1, 5)).orderBy("id")
    return rows if most is None else rows.limit(most)


def review(impacts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Confidence after review (change_id, verdict, rationale, position): confirm raises, unlikely lowers, keep leaves."""
    ok = verdicts.where(F.col("verdict").isin(V.REVIEW_VERDICTS) & (F.trim(F.coalesce("rationale", F.lit(""))) != ""))
    to = F.when(F.col("verdict") == "confirm", "high").when(F.col("verdict") == "unlikely", "low").otherwise("medium")
    ok = ok.select(F.col("change_id").alias("id"), to.alias("confidence"), "position")
    return R.upsert(impacts, ok, "id", ["confidence"], [F.col("v.position")], F.col("b.confidence") == "medium")


def draft_candidates(assets: DataFrame, covered: DataFrame, sites: DataFrame, files: DataFrame, size: int = V.DRAFT_BYTES, most: int = 3) -> DataFrame:
    """Changes a draft may be written for: id, files. assets (id, fixability) says that code can fix them, no pack covers them
    (covered: id), and some file that uses them (sites: id, path) can be read and is small enough (files: path, length); the
    first ``most`` files by path are listed."""
    wanted = assets.where(F.col("fixability") == "code-fixable").select("id").distinct().join(covered, "id", "left_anti")
    small = files.where(F.col("length") <= size).select("path")
    used = sites.select("id", "path").distinct().join(wanted, "id", "left_semi").join(small, "path")
    first = R.cap(used, ["id"], [F.col("path")], most)
    return first.groupBy("id").agg(F.sort_array(F.collect_list("path")).alias("files"))


def audit(packs: DataFrame, covers: DataFrame, changes: DataFrame) -> DataFrame:
    """Status of each pack (pack, provider, revalidated_through; covers: pack, id): no-covers, covers-missing, stale with the newer
    changes, or fresh; with its baseline, covered surfaces, and through when it may be called valid again."""
    live = changes.where(F.col("change_type").isin(V.MONITORED_TYPES)).select(
        "id", "provider", T.chronology("effective_date", "fetched_at").alias("chrono"), T.stream("source_repo").alias("stream"), T.prerelease_tag("title").alias("prerelease"),
        F.coalesce(F.col("source_repo").startswith("changelog:"), F.lit(False)).alias("firehose"), T.anchor_path("title", "source_url").alias("anchor"), T.anchor_surface("title", "source_url").alias("surface"), F.substring("title", 1, 120).alias("title"),
    )
    newer = R.stale(packs, covers, live).join(live.select("id", "title"), "id")
    newer = newer.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("chrono", "id", "title", "anchor"))).alias("newer"), F.max("chrono").alias("through"))
    said = covers.groupBy("pack").agg(F.count("*").alias("n_covers"))
    known = covers.join(live, "id").groupBy("pack").agg(F.max("chrono").alias("baseline"), F.array_sort(F.collect_set("surface")).alias("surfaces"))
    out = packs.join(said, "pack", "left").join(known, "pack", "left").join(newer, "pack", "left")
    status = F.when(F.col("n_covers").isNull(), "no-covers").when(F.col("baseline").isNull(), "covers-missing").when(F.col("newer").isNotNull(), "stale").otherwise("fresh")
    return out.select("pack", "provider", status.alias("status"), "baseline", "surfaces", "newer", F.col("through").alias("suggested_through"))


def upload(impacts: DataFrame) -> DataFrame:
    """What may leave: listed fields only, redacted, without any source line; rows that would still hold a secret raise."""
    sites = F.transform("symbol_sites", lambda s: F.struct(T.redact(T.basename(s["file"])).alias("file"), s["line"].alias("line"), T.redact(s["symbol"]).alias("symbol")))
    change = F.struct("id", T.redact(F.coalesce("provider", F.lit(""))).alias("provider"), T.redact(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("change_type", F.lit("")).alias("type"), F.coalesce("severity", F.lit("")).alias("severity"))
    body = F.to_json(F.struct(change.alias("change"), "confidence", "usage_kinds", "symbols_extracted", F.transform("matched_symbols", lambda s: T.redact(s)).alias("matched_symbols"), sites.alias("symbol_sites")))
    rows = impacts.select("id", body.alias("payload"))
    clean = T.is_redacted("payload")
    for key in V.FORBIDDEN_KEYS:
        clean = clean & ~F.col("payload").contains(f'"{key}":')
    return rows.select("id", F.when(clean, F.col("payload")).otherwise(F.raise_error(F.lit("payload is not safe to send"))).alias("payload"))
