"""The command line: ``python -m faultline COMMAND --flag value``. Results are JSON lines, on standard output or, with
``--out``, as files in a folder. Exit codes: 0 found or done, 1 nothing to do or a pack is stale, 2 wrong usage, 3 refused as
stale. A scan or an inventory that finds nothing is done all the same."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, scratch
from .operators.catalogue import catalogue
from .plans import verdicts
from .ship import ship
from .sources import sinks
from .streaming import ingest

Flags = dict[str, str | bool]


def _need(given: Flags, *names: str) -> list[str]:
    for n in names:
        if not isinstance(given.get(n), str):
            raise api.UsageError(f"--{n} needs a value")
    return [str(given[n]) for n in names]


def _id(given: Flags) -> int | None:
    value = given.get("change-id")
    if value is not None and not str(value).isdigit():
        raise api.UsageError(f"--change-id is no number: {value}")
    return None if value is None else int(str(value))


def _scan(e: api.Engine, given: Flags) -> DataFrame:
    return e.scan(*_need(given, "repo"), provider=given.get("provider"), change_id=_id(given))


def _deps(e: api.Engine, given: Flags) -> DataFrame:
    """The inventory; with ``--match`` also the changes and packs that touch it, each row under the name of its part."""
    repo = _need(given, "repo")
    if not given.get("match"):
        return e.deps(*repo)
    parts = zip(("inventory", "change", "pack"), e.deps(*repo, match=True))
    rows = [p.select(F.lit(name).alias("part"), F.to_json(F.struct(*p.columns)).alias("item")) for name, p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _from_report(e: api.Engine, given: Flags) -> DataFrame | int:
    """Every pack that covers a change of a scan's report (JSON lines), on one tree: each on what the one before left."""
    repo, report = _need(given, "repo", "from-report")
    ids = {r.id for r in e.spark.read.json(report).select("id").distinct().join(_covered(e.spark), "id", "left_semi").collect()}
    done, refused = None, False
    for pack in catalogue():
        if ids.isdisjoint(pack.covers):
            continue
        changed, code = e.fix(repo if "://" in repo else f"file://{Path(repo).resolve()}", pack.name, acknowledge=bool(given.get("acknowledge")))
        refused |= code == api.STALE
        if code == api.OK:
            rows = sinks.apply(changed, repo.removeprefix("file://")).withColumn("diff", F.lit(None).cast("string")) if given.get("apply") else changed.select("path", "diff")
            rows = rows.select(F.lit(pack.name).alias("pack"), "path", "diff")
            done = rows if done is None else done.unionByName(rows)
    return api.STALE if refused else api.NOTHING if done is None else done


def _covered(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i,) for p in catalogue() for i in p.covers], "id long").distinct()


def _review(e: api.Engine, given: Flags) -> DataFrame:
    """A scan's report after verdicts on its impacts of medium confidence; without verdicts, what is left to review."""
    impacts = e.spark.read.json(*_need(given, "report"))
    if "verdicts" not in given:
        return verdicts.pending(impacts, e.changes, e.spark.createDataFrame([], "id long"))
    rows = json.loads(Path(*_need(given, "verdicts")).read_text())
    listed = [(r.get("change_id"), r.get("verdict"), r.get("rationale"), i) for i, r in enumerate(rows)]
    return verdicts.review(impacts, e.spark.createDataFrame(listed, "change_id long, verdict string, rationale string, position int"))


def _sync(e: api.Engine, given: Flags) -> int:
    """Landed feeds into a change table, by a stream that ends with what there is. Providers: a JSON list of source, provider
    and source_repo."""
    feeds, table, checkpoint, providers = _need(given, "feeds", "table", "checkpoint", "providers")
    listed = e.spark.createDataFrame([(p["source"], p["provider"], p["source_repo"]) for p in json.loads(Path(providers).read_text())], "source string, provider string, source_repo string")
    kind = str(given.get("kind", "atom"))
    if kind not in ("atom", "rss"):
        raise api.UsageError(f"--kind is atom or rss, not {kind}")
    ingest.start(ingest.landed(e.spark, feeds, kind), listed, table, checkpoint, datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")).awaitTermination()
    return api.OK


def _fix(e: api.Engine, given: Flags) -> DataFrame | int:
    """Shows what would change; only ``--apply`` writes, into a tree given as a path."""
    if "from-report" in given:
        return _from_report(e, given)
    repo, migration = _need(given, "repo", "migration")
    changed, code = e.fix(repo if "://" in repo else f"file://{Path(repo).resolve()}", migration, acknowledge=bool(given.get("acknowledge")))
    if changed is None or code != api.OK:
        return code
    return sinks.apply(changed, repo.removeprefix("file://")) if given.get("apply") else changed.select("path", "rules_applied", "diff", "syntax")


def _verdicts(which: Callable) -> Callable[[api.Engine, Flags], DataFrame]:
    def run(e: api.Engine, given: Flags) -> DataFrame:
        (path,) = _need(given, "verdicts")
        rows = json.loads(Path(path).read_text())
        fields = list(dict.fromkeys(k for r in rows for k in r))
        listed = e.spark.createDataFrame([(*(r.get(k) for k in fields), i) for i, r in enumerate(rows)], ", ".join(f"{k} {'long' if k == 'id' else 'string'}" for k in fields) + ", position long")
        return which(e.changes, listed)

    return run


def _specdiff(e: api.Engine, given: Flags) -> DataFrame:
    return e.specdiff(*(Path(p).read_text() for p in _need(given, "old", "new")))


#: Command: its flags besides --changes and --out, and what it does.
COMMANDS: dict[str, tuple[set[str], Callable[[api.Engine, Flags], DataFrame | int]]] = {
    "scan": ({"repo", "provider", "change-id"}, _scan),
    "deps": ({"repo", "match"}, _deps),
    "changes": ({"provider", "type", "limit"}, lambda e, given: e.list_changes(given.get("provider"), given.get("type"), int(str(given["limit"])) if "limit" in given else None)[0]),
    "fix": ({"repo", "migration", "from-report", "acknowledge", "apply"}, _fix),
    "review": ({"report", "verdicts"}, _review),
    "sync": ({"feeds", "kind", "providers", "table", "checkpoint"}, _sync),
    "revalidate": (set(), lambda e, given: e.revalidate()),
    "specdiff": ({"old", "new"}, _specdiff),
    "reclassify": ({"verdicts"}, _verdicts(verdicts.reclassify)),
    "fixability": ({"verdicts"}, _verdicts(verdicts.set_fixability)),
}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        if not argv or argv[0] not in COMMANDS:
            raise api.UsageError(f"one of these commands is needed: {', '.join(COMMANDS)}")
        known, run = COMMANDS[argv[0]]
        given = api.flags(argv[1:], known | {"changes", "out"})
        spark = spark or SparkSession.builder.appName("faultline").getOrCreate()
        ship(spark)
        found = run(api.Engine(spark, given.get("changes")), given)
        if isinstance(found, int):
            return found
        if argv[0] == "revalidate":
            found = scratch.materialise(found, "status")
            ends = (api.NOTHING, api.OK) if not found.where("status = 'stale'").isEmpty() else (api.OK, api.OK)
        else:
            ends = (api.OK, api.OK if argv[0] in ("scan", "deps", "review") else api.NOTHING)
        if isinstance(given.get("out"), str):
            found.write.mode("overwrite").json(str(given["out"]))
            return ends[spark.read.text(str(given["out"])).isEmpty()]
        lines = found.toJSON().toLocalIterator()
        n = 0
        for n, line in enumerate(lines, 1):
            print(line)
        return ends[not n]
    except api.UsageError as e:
        print(e, file=sys.stderr)
        return api.USAGE


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
