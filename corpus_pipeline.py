"""The corpus pipeline: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of documents. The last gives one row per packed piece.

Cases: nulls, empty and very long texts, repeated rows and empty tables are handled as each operator's docstring says;
columns beyond those of documents pass through the filtering stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import decontaminate, language, neardup, packing, scratch, spans
from faultline.ship import shipped


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in no recognised language go. The classifier learns from the labelled rows of ``docs``."""
    return language.accept(docs, language.fit(docs))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each class of near-duplicates the document with the least id stays."""
    return neardup.first(docs, one_per_id=False)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: sentences of runs that occur earlier in the corpus are cut from the texts."""
    return spans.clean(docs, every=True)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents with a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of token ids in sequences of at most 4096."""
    return packing.sequences(docs)


STAGES = [
    ("language ID", shipped(keep_languages)),
    ("near-dedup", shipped(keep_first_copies)),
    ("substring dedup", shipped(cut_repeated_spans)),
    ("decontamination", shipped(drop_benchmark_leaks)),
    ("packing", shipped(pack_sequences)),
]

#: None of the stages but decontamination can be stated in SQL. Tests compare the operators of all stages with brute-force
#: versions (the classifier by held-out accuracy) and run the stages over planted cases.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch.dropping():  # what a stage leaves behind goes once its result is written
            docs = scratch.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
