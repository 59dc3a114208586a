"""Queries of the training-data operators: thin, whole-table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, language, licenses, mixing, neardup, outliers, packing, records, repair, scratch, separators, spans, whitening


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int):
    """crc32 of the id as text, modulo n: what is held out from learning."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; rows whose id has remainder 2 modulo 4 are held out from learning."""
    docs = _documents(spark, sf_dir)
    model = language.fit(docs.where(_remainder(4) != 2).select("doc_id", "text", "lang"))
    return language.predict(docs.select("doc_id", "text", (_remainder(4) == 2).alias("held_out")), model).drop("text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, a row for each piece."""
    pieces = packing.sequences(_documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and robust outliers of every document."""
    return outliers.judge(_documents(spark, sf_dir))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(_documents(spark, sf_dir))


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as framed records and read back."""
    path = scratch.scratch_path(spark, "records")
    records.write(_documents(spark, sf_dir), path)
    return records.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license found in every text, with its differences."""
    return licenses.scan(_documents(spark, sf_dir))


def op7_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found in flat token files by their separators."""
    path = scratch.scratch_path(spark, "tokens")
    separators.write(_documents(spark, sf_dir), path)
    return separators.counts(spark, path)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows, and the items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.judge(_documents(spark, sf_dir), benchmark).drop("spans", "items")


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text; rows whose id has remainder 2 modulo 7 are held out from learning."""
    return ctw.score(_documents(spark, sf_dir), _remainder(7) == 2)


def op10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch that repeats an earlier run of sentences."""
    return spans.report(_documents(spark, sf_dir), every=True)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of every document, and when training meets them."""
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position", "again")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading whitened components of every embedding."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every damaged conversation."""
    return repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    f.__name__: f
    for f in (op1_language, op2_packing, op3_outliers, op4_neardup, op5_records, op6_licenses, op7_separators, op8_decontaminate, op9_ctw, op10_spans, op11_mixing, op12_whitening, op13_repair)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
o AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM o, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
