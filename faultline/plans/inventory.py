"""The inventory of a source tree: which surfaces of which provider are used where, and what changes touch them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import bindings as B
from ..operators import paths, scopes
from ..operators.relational import cap
from ..sources import files as S


def _packages(spark, signatures: dict[str, dict]) -> DataFrame:
    kinds = ("modules", "python", "ruby", "go", "php")
    return spark.createDataFrame([(p, m) for p, s in signatures.items() for k in kinds for m in s.get(k, ())], "provider string, module string").distinct()


def surfaces(files: DataFrame, signatures: dict[str, dict] = V.SIGNATURES) -> DataFrame:
    """provider, kind (module, env, api-host, endpoint, sdk-call, controller-call), surface, file, line, snippet. Endpoints are those
    behind the provider's own hosts in the whole line, however long; a snippet is for show."""
    found = S.usage(files, signatures, whole=True)
    ends = F.lit(None).cast("array<string>")
    for p, s in signatures.items():
        if s.get("hosts"):
            ends = F.when(F.col("provider") == p, T.endpoints("raw", s["hosts"])).otherwise(ends)
    found = scratch.materialise(found.withColumn("ends", ends).drop("raw"), "usage")
    kind = F.when(F.col("kind") == "import", "module").when(F.col("kind") == "env-var", "env").otherwise("api-host")
    base = found.select("provider", kind.alias("kind"), F.col("detail").alias("surface"), "file", "line", "snippet")
    ends = found.where("kind = 'api-host'").select("provider", F.lit("endpoint").alias("kind"), F.explode("ends").alias("surface"), "file", "line", "snippet")
    read = scratch.materialise(B.code_facts(files), "facts")
    facts = scratch.materialise(scopes.resolved(read), "scoped")
    roots = scratch.materialise(B.client_roots(facts, _packages(files.sparkSession, signatures)), "roots")
    away = B.exported_roots(facts, roots, files)
    calls = B.surfaces(facts, roots.select(*away.columns).unionByName(away))
    return base.unionByName(ends).unionByName(calls).distinct()


def inventory(rows: DataFrame, most: int = 50) -> DataFrame:
    """Each surface once, with its first sites, as people sort them."""
    kept = cap(rows, ["provider", "kind", "surface"], [F.col("file"), F.col("line")], most)
    out = kept.groupBy("provider", "kind", "surface").agg(F.sort_array(F.collect_list(F.struct("file", "line", "snippet"))).alias("sites"))
    return out.orderBy(F.collate("provider", "UNICODE"), "kind", F.collate("surface", "UNICODE"))


def touched(found: DataFrame, changes: DataFrame) -> DataFrame:
    """Monitored changes whose anchor overlaps an endpoint in use: change_id, provider, change_type, anchor, endpoint, evidence."""
    live = changes.where(F.col("change_type").isin(V.MONITORED_TYPES)).withColumn("anchor", T.anchor_path("title", "source_url")).where("anchor IS NOT NULL")
    ends = found.where("kind = 'endpoint'").select("provider", F.col("surface").alias("endpoint"), F.slice("sites", 1, 3).alias("evidence"))
    return paths.overlapping(ends, live, ["provider"], "endpoint", "anchor").select(F.col("id").alias("change_id"), "provider", "change_type", "anchor", "endpoint", "evidence")


def packs_touched(found: DataFrame, packs: DataFrame) -> DataFrame:
    """packs (pack, provider, surfaces, chains, controllers: ctor, anchor, methods) that meet the inventory, by any of the three."""
    ends = found.where("kind = 'endpoint'").select("provider", F.col("surface").alias("used"), F.slice("sites", 1, 3).alias("evidence"))
    by_path = packs.select("pack", "provider", F.explode("surfaces").alias("pack_surface")).withColumn("anchor", T.anchor_path("pack_surface", F.lit(None).cast("string")))
    by_path = paths.overlapping(ends, by_path, ["provider"], "used", "anchor").select("pack", "provider", F.lit("endpoint").alias("kind"), F.col("pack_surface").alias("declared"), "used", "evidence")
    sdk = found.where("kind = 'sdk-call'").select("provider", F.col("surface").alias("used"), F.slice("sites", 1, 3).alias("evidence"), F.explode(T.chain_suffixes(F.regexp_extract("surface", r"(\S+)\z", 1))).alias("declared"))
    by_chain = packs.select("pack", "provider", F.explode("chains").alias("declared")).join(sdk, ["provider", "declared"]).select("pack", "provider", F.lit("sdk-call").alias("kind"), "declared", "used", "evidence")
    part = F.split("surface", " ")
    ctrl = found.where("kind = 'controller-call'").select("provider", F.col("surface").alias("used"), F.slice("sites", 1, 3).alias("evidence"), F.get(part, F.lit(1)).alias("ctor"), F.split(F.get(part, F.lit(2)), r"\.").alias("segs"))
    ctrl = ctrl.where(F.size("segs") == 2).withColumns({"anchor": F.get("segs", 0), "method": F.get("segs", 1)})
    each = packs.select("pack", "provider", F.explode("controllers").alias("c")).select("pack", "provider", "c.ctor", "c.anchor", F.explode("c.methods").alias("method"))
    by_ctrl = each.join(ctrl, ["provider", "ctor", "anchor", "method"]).select("pack", "provider", F.lit("controller-call").alias("kind"), F.concat_ws(".", "anchor", "method").alias("declared"), "used", "evidence")
    return by_path.unionByName(by_chain).unionByName(by_ctrl)
