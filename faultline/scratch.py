"""Shared scratch space: every intermediate table lives where all executors see it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one process: a folder of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(root)
    elif not (root := sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="faultline-")
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends at durable files. Inside ``dropping``
    the table goes with the block, or, with ``keep``, with the block around that one."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    if len(_open) > keep:
        _open[-1 - keep].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropping() -> Iterator[None]:
    """Delete the scratch tables made inside the block when it ends."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            drop_scratch(spark, path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later read needs."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
