"""The package on the executors: sent as a zip archive, once per Spark context, wherever workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers."""
    sc = spark.sparkContext
    if getattr(sc, "_faultline_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if here.endswith(".zip/faultline"):  # it came this way itself
        return
    path = os.path.join(tempfile.mkdtemp(prefix="faultline-"), "faultline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith((".py", ".txt")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("faultline", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._faultline_shipped = True


def shipped(f: Callable) -> Callable:
    """``f``, whose first argument is a session, with the package on the executors before it runs."""

    @wraps(f)
    def run(spark: SparkSession, *args, **more):
        ship(spark)
        return f(spark, *args, **more)

    return run
