"""Where results go: JSON reports, patch files, and rewritten files in place."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import scratch


def report(rows: DataFrame, header: dict[str, str | int], name: str = "items") -> DataFrame:
    """One row with one JSON document: the header, the number of rows, and the rows in the order of their ``place``."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("place", F.to_json(F.struct(*(c for c in rows.columns if c != "place"))).alias("j")))), lambda x: x["j"])
    head = ", ".join(f"{json.dumps(k)}: {json.dumps(v)}" for k, v in header.items())
    text = F.concat(F.lit("{" + head + (", " if head else "") + f'"{name}_found": '), F.size("b"), F.lit(f', "{name}": ['), F.array_join("b", ", "), F.lit("]}"))
    return rows.agg(body.alias("b")).select(text.alias("value"))


def write_report(one: DataFrame, path: str) -> None:
    """A report as a single text file in the folder ``path``; the folder is made."""
    one.coalesce(1).write.mode("overwrite").text(path)


def patch(changed: DataFrame) -> DataFrame:
    """All diffs of rewritten files as one patch, by path; renames of moved files come last."""
    return changed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "diff"))), lambda x: x["diff"]), "").alias("value"))


def write_patch(changed: DataFrame, path: str) -> None:
    """All diffs as text files in the folder ``path`` that, put together by name, are the patch; no task holds all of it."""
    rows = changed.where("diff <> ''").select("path", "diff").repartitionByRange("path").sortWithinPartitions("path")
    rows.select(F.col("diff").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


class TreeSink(DataSource):
    """A sink for rewritten files (path, after) of a tree: all of them, or none. Tasks write beside the tree, under a name of the
    job's and the task's own; only when all have ended are the files moved into place, and if one fails for good all are dropped.
    A file that is the same already is left alone. A task that runs again writes anew, and only what its last run wrote counts."""

    @classmethod
    def name(cls) -> str:
        return "faultline-tree"

    def schema(self) -> str:
        return "path string, after string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        writer = TreeWriter(os.path.realpath(self.options["root"]), self.options["job"])
        os.makedirs(writer.stage, exist_ok=True)
        return writer


@dataclass
class Written(WriterCommitMessage):
    staged: str
    files: int


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.stage = root, os.path.join(os.path.dirname(root), f".{os.path.basename(root)}-{job}")

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        context, files = TaskContext.get(), 0
        mine = os.path.join(self.stage, f"{context.partitionId()}-{context.taskAttemptId()}")
        os.mkdir(mine)  # not where the job has been dropped meanwhile
        for row in rows:
            full = os.path.realpath(os.path.join(self.root, row.path))
            if os.path.commonpath([full, self.root]) != self.root:
                raise ValueError(f"{row.path} is outside of the tree")
            with open(full, encoding="utf-8", newline="") as f:
                same = f.read() == row.after
            if same:
                continue
            to = os.path.join(mine, os.path.relpath(full, self.root))
            folder = mine
            for part in os.path.dirname(os.path.relpath(full, self.root)).split(os.sep):
                folder = os.path.join(folder, part)
                if part and not os.path.isdir(folder):
                    os.mkdir(folder)
            with open(to, "w", encoding="utf-8", newline="") as f:
                f.write(row.after)
            shutil.copymode(full, to)
            files += 1
        return Written(mine, files)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for folder, _, names in os.walk(m.staged) if m else ():
                for name in names:
                    at = os.path.join(folder, name)
                    os.replace(at, os.path.join(self.root, os.path.relpath(at, m.staged)))
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        os.rename(self.stage, self.stage + "-dropped")  # tasks that still run find no folder to write to
        shutil.rmtree(self.stage + "-dropped", ignore_errors=True)


def apply(changed: DataFrame, root: str) -> DataFrame:
    """Write rewritten files (path, after) back under the shared folder ``root`` (a path, not a URL), all or none, and say which."""
    spark = changed.sparkSession
    rows = scratch.materialise(changed.select("path", "after"), "rewritten")
    spark.dataSource.register(TreeSink)
    rows.write.format(TreeSink.name()).mode("append").option("root", root).option("job", uuid.uuid4().hex).save()
    return rows.select("path")
