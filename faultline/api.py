"""The command surface: one function for each command, and the same commands as JSON-RPC tools.

Commands take flags only; an argument that is no flag is an error, since ignoring it could read the wrong tree. Results are
DataFrames, or plain values where a command reports a status.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .functions import vocabulary as V
from .operators import lines as L
from .operators import packs as P
from .operators import relational as R
from .operators import specdiff
from .operators.catalogue import catalogue
from .plans import impacts as I
from .plans import inventory, verdicts
from .sources import files, specs

USAGE, NOTHING, STALE, OK = 2, 1, 3, 0


class UsageError(ValueError):
    """A call that names no known flag or leaves out a required one."""


def flags(argv: list[str], known: set[str]) -> dict[str, str | bool]:
    """Flags of a command line; anything else raises."""
    out: dict[str, str | bool] = {}
    i = 0
    while i < len(argv):
        a = argv[i]
        if not a.startswith("--") or a[2:] not in known:
            raise UsageError(f"unexpected argument: {a}")
        value = argv[i + 1] if i + 1 < len(argv) and not argv[i + 1].startswith("--") else None
        out[a[2:]] = True if value is None else value
        i += 1 if value is None else 2
    return out


class Engine:
    """Commands over a change table (Parquet) and source trees."""

    def __init__(self, spark: SparkSession, changes: DataFrame | str | None = None):
        self.spark = spark
        self._changes = changes

    @property
    def changes(self) -> DataFrame:
        if self._changes is None:
            raise UsageError("no change table: run an ingest first")
        return self.spark.read.parquet(self._changes) if isinstance(self._changes, str) else self._changes

    def scan(self, repo: str, provider: str | None = None, change_id: int | None = None) -> DataFrame:
        """Ranked impacts of monitored changes, or of one change of any type, on a tree."""
        tree = files.tree(self.spark, repo)
        found = scratch.materialise(files.usage(tree), "usage")
        rows = self.changes
        rows = rows.where(F.col("provider") == provider) if provider else rows
        rows = rows.where(F.col("id") == int(change_id)) if change_id is not None else rows
        texts = found.select("provider", F.col("file").alias("path")).distinct().join(tree, "path").select("provider", "text")
        rows = I.gate_sub_apis(rows, texts).select(*rows.columns)
        lines = L.lines(tree.select(F.col("path").alias("file"), "text"))
        return I.with_sites(I.impacts(rows, found, lines, every_type=change_id is not None), found).orderBy(*I.ranked())

    def deps(self, repo: str, match: bool = False) -> DataFrame | tuple[DataFrame, DataFrame, DataFrame]:
        """The inventory of a tree; with ``match`` also the changes and the packs that touch it."""
        found = inventory.inventory(inventory.surfaces(files.tree(self.spark, repo)))
        if not match:
            return found
        listed = self.spark.createDataFrame([(p.name, p.provider, list(p.surfaces), list(p.chains), [(c, a, list(m)) for c, a, m in p.controllers]) for p in catalogue()], "pack string, provider string, surfaces array<string>, chains array<string>, controllers array<struct<ctor:string,anchor:string,methods:array<string>>>")
        return found, inventory.touched(found, self.changes), inventory.packs_touched(found, listed)

    def list_changes(self, provider: str | None = None, change_type: str | None = None, limit: int | None = None) -> tuple[DataFrame, int]:
        """The newest changes, and how many there are."""
        rows = self.changes
        for c, v in (("provider", provider), ("change_type", change_type)):
            rows = rows.where(F.col(c) == v) if v else rows
        return R.page(rows, [F.col("id").desc()], limit), rows.count()

    def revalidate(self) -> DataFrame:
        """The status of every pack against the change table."""
        packs = catalogue()
        listed = self.spark.createDataFrame([(p.name, p.provider, p.revalidated_through) for p in packs], "pack string, provider string, revalidated_through string")
        covers = self.spark.createDataFrame([(p.name, i) for p in packs for i in p.covers], "pack string, id long")
        return verdicts.audit(listed, covers, self.changes)

    def fix(self, repo: str, migration: str, acknowledge: bool = False, check: P.Checker | None = None) -> tuple[DataFrame | None, int]:
        """What a pack changes in a tree, and the exit code; nothing is written."""
        pack = next((p for p in catalogue() if p.name == migration), None)
        if pack is None:
            raise UsageError(f"no such migration: {migration}")
        if not acknowledge and self._changes is not None and not self.revalidate().where((F.col("pack") == migration) & (F.col("status") == "stale")).isEmpty():
            return None, STALE
        out = P.rewrite(files.tree(self.spark, repo, V.REWRITTEN), pack, check)
        return out, P.exit_code(out.count(), [])

    def specdiff(self, old: str, new: str) -> DataFrame:
        """Differences of two snapshots given as JSON text, in order."""
        sides = [specs.facts(self.spark.createDataFrame([("", s)], "spec_id string, spec string")) for s in (old, new)]
        return specdiff.ordered(specdiff.diff(*sides)).drop("spec_id")

    def statistics(self) -> dict[str, Any]:
        """Counts of the change table: in all, providers, by type."""
        one = self.changes.agg(F.count("*").alias("n"), F.count_distinct("provider").alias("p")).first()
        types = self.changes.groupBy("change_type").count().orderBy(F.desc("count"), "change_type").collect()
        return {"changes": one["n"], "providers": one["p"], "by_type": {r["change_type"]: r["count"] for r in types}}


#: Tools: the method of the engine, and its arguments with their types.
TOOLS: dict[str, tuple[str, dict[str, str]]] = {
    "scan": ("scan", {"repo": "string", "provider": "string", "change_id": "integer"}),
    "deps": ("deps", {"repo": "string"}),
    "fix": ("fix", {"repo": "string", "migration": "string", "acknowledge": "boolean"}),
    "revalidate": ("revalidate", {}),
    "changes": ("list_changes", {"provider": "string", "change_type": "string", "limit": "integer"}),
}
PARSE_ERROR, NO_METHOD, INTERNAL, BAD_PARAMS = -32700, -32601, -32603, -32602


def _plain(result: Any) -> Any:
    if isinstance(result, DataFrame):
        return [json.loads(x) for x in result.toJSON().collect()]
    if isinstance(result, tuple):
        return [_plain(x) for x in result]
    return result


def respond(engine: Engine, line: str) -> str | None:
    """The answer to one line of JSON-RPC; none to a notification."""
    try:
        request = json.loads(line)
    except ValueError:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "not JSON"}})
    ident, method = request.get("id"), request.get("method")
    answer = lambda **x: json.dumps({"jsonrpc": "2.0", "id": ident, **x})
    if ident is None:
        return None
    if method == "initialize":
        return answer(result={"capabilities": {"tools": {}}, "serverInfo": {"name": "faultline"}})
    if method == "tools/list":
        return answer(result={"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in args.items()}}} for n, (_, args) in TOOLS.items()]})
    if method != "tools/call":
        return answer(error={"code": NO_METHOD, "message": f"no such method: {method}"})
    params = request.get("params") or {}
    name, arguments = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS or set(arguments) - set(TOOLS[name][1]):
        return answer(error={"code": BAD_PARAMS, "message": f"unknown tool or argument: {name} {sorted(arguments)}"})
    try:
        return answer(result={"content": _plain(getattr(engine, TOOLS[name][0])(**arguments))})
    except UsageError as e:
        return answer(error={"code": BAD_PARAMS, "message": str(e)})
    except Exception as e:
        return answer(error={"code": INTERNAL, "message": str(e).split("\n")[0][:300]})
