"""Scratch tables, and what every operator reads of a documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import drop_scratch, dropping, materialise, scratch_path, shared_dir

__all__ = ["beside", "documents", "drop_scratch", "dropping", "materialise", "named", "scratch_path", "shared_dir"]


def documents(df: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string) of a documents table, whatever else it holds."""
    return df.select(df["doc_id"].cast(T.LongType()).alias("doc_id"), df["text"].cast(T.StringType()).alias("text"))


def named(column: str) -> Column:
    """The column of exactly this name, dots and quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def beside(df: DataFrame, **more: Column) -> DataFrame:
    """``row`` (all columns of ``df``, in a struct), ``doc_id``, ``text`` and ``more``: no name that an operator adds can
    clash with one of its input's. ``select("row.*")`` gives the input's columns back."""
    return df.select(F.struct(*map(named, df.columns)).alias("row"), df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"), *(c.alias(k) for k, c in more.items()))
