"""All queries of the engine proper, each with the SQL that checks it where SQL can.

The operators are generic; a query binds one to the test tables: documents are files and their source is the provider,
orders and events are change records, customers and parts are what changes are about.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cases
from .functions import text as T
from .functions import vocabulary as V
from .operators import lines as L
from .operators import relational as R
from .plans import impacts as I

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "scan_impacts"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(keys: DataFrame, each: int) -> DataFrame:
    """Keys of a small table of whose rows much is made, dealt so that a task has about ``each``: a table of a few MB is one row group and
    would be one task, whatever its rows."""
    n, cores = keys.count(), keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(max(1, -(-n // each), min(cores, n // 64)), *keys.columns)


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of listed rows, numbered from 0 as ``i``."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS w({columns})"


def _dealt(keys: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """Each row of ``keys`` (k) with the worked case that its key, modulo their number, names."""
    spark = keys.sparkSession
    listed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {columns}")
    return keys.join(F.broadcast(listed), F.pmod(F.col("k"), F.lit(len(rows))) == F.col("i")).drop("i")  # a fixed list


#: Matchers over documents: kind, detail, pattern. Without look-around, so that both engines read them alike.
MATCHERS = [
    ("api-host", "ipv4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("import", "licence", r"(Licensed under|Released under|licensed under)"),
    ("env-var", "credential", r"(password|token|secret|api_key) *[:=]"),
    ("env-var", "hex", r"\b[A-Fa-f0-9]{40,}\b"),
    ("api-host", "e-mail", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}"),
]
_MATCHER_SQL = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{d}' AS detail, '{p}' AS pattern" for k, d, p in MATCHERS)
_LINES_SQL = r"""
m AS (%s),
l AS (SELECT doc_id, source, i AS line, s[i] AS raw FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS t(i)),
f AS (SELECT doc_id, source, line, raw, kind, detail FROM l, m WHERE regexp_matches(raw, pattern))""" % _MATCHER_SQL


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.lines(_t(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return L.matched(rows, MATCHERS)


@query(f"WITH {_LINES_SQL} SELECT doc_id, source, line, kind, detail FROM f")
def line_scan(spark, sf_dir):
    """SRC-1, TX-13, TX-15, J-4: lines by matcher."""
    return _findings(spark, sf_dir).select("doc_id", "source", "line", "kind", "detail")


@query(
    f"""WITH {_LINES_SQL},
u AS (SELECT source AS provider, count(DISTINCT kind) AS n_kinds, bool_or(kind = 'import') AS imported, bool_or(kind = 'api-host') AS hosted, count(DISTINCT doc_id) AS files, count(*) AS sites FROM f GROUP BY source),
c AS (SELECT event_id AS id, 'src' || (user_id % 20) AS provider, CASE event_type WHEN 'purchase' THEN 'breaking' WHEN 'click' THEN 'deprecation' WHEN 'signup' THEN 'unknown' ELSE 'additive' END AS change_type,
  CASE user_id % 3 WHEN 0 THEN 'changelog:' WHEN 1 THEN 'spec-diff:' ELSE '' END AS source_repo, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS extracted FROM events),
s AS (SELECT id, c.provider, change_type, CASE change_type WHEN 'breaking' THEN 'high' WHEN 'deprecation' THEN 'medium' WHEN 'unknown' THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN extracted > 0 AND (imported OR (source_repo <> '' AND hosted)) THEN 'medium' ELSE 'low' END AS confidence, n_kinds, files, sites
  FROM c JOIN u USING (provider) WHERE change_type IN ('breaking', 'deprecation'))
SELECT id, provider, change_type, severity, confidence, n_kinds::BIGINT AS n_kinds, files, sites FROM s"""
)
def scan_impacts(spark, sf_dir):
    """J-1, P-1, P-7, P-9, PRJ-4, A-5, A-6, W-2: change records against usage, scored by the library's plan. Records of a value of
    50 or more name a symbol that no line has."""
    from . import scratch

    found = scratch.materialise(_findings(spark, sf_dir), "findings").withColumn("doc_id", F.col("doc_id").cast("string"))
    found = found.select(F.col("source").alias("provider"), "kind", F.col("doc_id").alias("file"), "line", F.lit("").alias("snippet"))
    kind = F.when(F.col("event_type") == "purchase", "breaking").when(F.col("event_type") == "click", "deprecation").when(F.col("event_type") == "signup", "unknown").otherwise("additive")
    repo = F.when(F.col("user_id") % 3 == 0, "changelog:").when(F.col("user_id") % 3 == 1, "spec-diff:").otherwise("")
    none = F.lit(None).cast("string")
    changes = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("src"), F.col("user_id") % 20).alias("provider"), F.lit("t").alias("title"), kind.alias("change_type"), repo.alias("source_repo"), none.alias("effective_date"), F.when(F.col("value") >= 50, "`no_such_symbol_here`").alias("raw_excerpt"), none.alias("migration_hint"))
    lines = L.lines(_t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"))
    out = I.impacts(changes, found, lines)
    return out.select("id", "provider", "change_type", "severity", "confidence", F.size("usage_kinds").cast("long").alias("n_kinds"), "files", "sites")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END, o_orderpriority, o_orderdate DESC, o_orderkey")
def rank_impacts(spark, sf_dir):
    """S-2: severity, then confidence, then newest first, ties by id; all of them."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return rows.orderBy(R.position(F.col("o_orderstatus"), ["F", "O", "P"]), "o_orderpriority", F.col("o_orderdate").desc(), "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC NULLS LAST, o_orderkey")
def filter_in_ordered(spark, sf_dir):
    """P-1, S-1."""
    rows = _t(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P"))
    return rows.orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT event_id, event_type, value, (SELECT count(*) FROM events WHERE event_type = 'click' AND user_id % 2 = 0) AS total FROM events WHERE event_type = 'click' AND user_id % 2 = 0 ORDER BY event_id DESC LIMIT 20")
def point_and_page(spark, sf_dir):
    """P-2, S-3, A-1: newest first, a clamped page, and the total."""
    rows = _t(spark, sf_dir, "events").where("event_type = 'click' AND user_id % 2 = 0")
    total = rows.agg(F.count("*").alias("total"))
    return R.page(rows, [F.col("event_id").desc()], None).join(F.broadcast(total)).select("event_id", "event_type", "value", "total")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 17")
def point_lookup(spark, sf_dir):
    """P-3."""
    return _t(spark, sf_dir, "customer").where("c_custkey = 17").select("c_custkey", "c_name")


@query("SELECT coalesce(nullif(event_type, 'view'), '(unset)') AS event_type, count(*) AS n FROM events GROUP BY 1")
def group_count_types(spark, sf_dir):
    """A-3, A-4: counts by type, null counted as (unset)."""
    return R.group_counts(_t(spark, sf_dir, "events"), F.nullif(F.col("event_type"), F.lit("view")), "event_type")


@query("SELECT count(*) AS n, count(DISTINCT source) AS providers, count(DISTINCT lang) AS langs, max(doc_id) AS latest FROM documents")
def table_counters(spark, sf_dir):
    """A-1, A-2, A-7, A-11."""
    return _t(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_distinct("source").alias("providers"), F.count_distinct("lang").alias("langs"), F.max("doc_id").alias("latest"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_usage(spark, sf_dir):
    """P-7, J-12: providers that are used."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


@query(
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events e
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = e.user_id AND c_mktsegment = 'BUILDING')) WHERE k = 1"""
)
def anti_ingest(spark, sf_dir):
    """J-7, W-5, SNK-1: what an insert-or-ignore would add."""
    e = _t(spark, sf_dir, "events")
    stored = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    fresh = e.join(stored, "user_id", "left_anti")
    return R.first_writer(fresh, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query(
    """WITH v AS (SELECT doc_id, first(quality ORDER BY toxic, quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN v.doc_id IS NOT NULL AND d.lang <> 'en' THEN CASE v.q WHEN 1 THEN 'good' ELSE 'bad' END ELSE d.lang END AS lang, v.doc_id IS NOT NULL AND d.lang <> 'en' AS updated
FROM documents d LEFT JOIN v USING (doc_id)"""
)
def upsert_verdict(spark, sf_dir):
    """J-8, P-11, P-12, SNK-2: a guarded update by the first verdict that applies."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    v = _t(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("lang"), "toxic", "quality")
    return R.upsert(d, v, "doc_id", ["lang"], [F.col("v.toxic"), F.col("v.quality")], F.col("b.lang") != "en")


@query(
    """WITH v AS (SELECT doc_id, first(quality ORDER BY toxic, quality) AS q FROM labels WHERE quality IS NOT NULL AND doc_id % 5 = 0 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN v.doc_id IS NOT NULL AND d.lang <> 'en' THEN CASE v.q WHEN 1 THEN 'good' ELSE 'bad' END ELSE d.lang END AS lang FROM documents d LEFT JOIN v USING (doc_id)"""
)
def upsert_table(spark, sf_dir):
    """J-8, SNK-2: verdicts written into a table by buckets of its key; what no verdict touches is not written again."""
    from . import scratch

    d = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    path = scratch.scratch_path(spark, "documents")
    R.write_buckets(d, path, "doc_id")
    v = _t(spark, sf_dir, "labels").where("quality IS NOT NULL AND doc_id % 5 = 0").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("lang"), "toxic", "quality")
    R.upsert_buckets(spark, path, v, "doc_id", ["lang"], [F.col("v.toxic"), F.col("v.quality")], F.col("b.lang") != "en")
    return spark.read.parquet(path).select("doc_id", "lang")


@query("SELECT event_id, 1000 + row_number() OVER (ORDER BY event_type, ts, event_id) AS id FROM events")
def numbered_records(spark, sf_dir):
    """SNK-1, S-6: ids in order of arrival, behind those that are given, counted by ranges."""
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return R.numbered(e, [F.col("event_type"), F.col("ts"), F.col("event_id")], 1000).select("event_id", "id")


@query(
    """WITH base AS (SELECT o_custkey, max(o_orderdate) AS baseline FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o.o_custkey, o.o_orderkey FROM orders o JOIN base USING (o_custkey) WHERE o.o_orderstatus <> 'F' AND o.o_orderdate > baseline"""
)
def pack_staleness(spark, sf_dir):
    """J-9, J-17, A-7: records newer than the newest covered one of their stream."""
    o = _t(spark, sf_dir, "orders")
    covered = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("pack"), F.col("o_orderkey").alias("id"))
    chrono = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    changes = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("provider"), chrono.alias("chrono"), F.lit("s").alias("stream"), F.lit(False).alias("prerelease"), F.lit(False).alias("firehose"), F.lit(None).cast("string").alias("anchor"))
    packs = covered.select("pack").distinct().select("pack", F.col("pack").alias("provider"), F.lit(None).cast("string").alias("revalidated_through"))
    return R.stale(packs, covered, changes).select(F.col("pack").alias("o_custkey"), F.col("id").alias("o_orderkey"))


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) l ON l_orderkey = o_orderkey")
def lookup_left(spark, sf_dir):
    """J-13."""
    o, l = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem").where("l_quantity > 45")  # noqa: E741
    return o.join(l, o.o_orderkey == l.l_orderkey, "left").select("o_orderkey", "l_linenumber", "l_quantity")


_CHAINS = ["BUILDING.3", "MACHINERY.1", "7", "AUTOMOBILE.12"]


@query(f"""WITH p AS (SELECT c_custkey, ['client', 'v1', c_mktsegment, c_nationkey::VARCHAR] AS w FROM customer),
s AS (SELECT c_custkey, array_to_string(w[i : len(w)], '.') AS suffix FROM p, unnest(range(2, len(w) + 1)) AS t(i))
SELECT c_custkey, suffix FROM s WHERE suffix IN ({_list(_CHAINS)})""")
def suffix_join(spark, sf_dir):
    """J-10: call chains by any tail, as an equi-join."""
    chain = F.concat_ws(".", F.lit("client"), F.lit("v1"), "c_mktsegment", F.col("c_nationkey").cast("string"))
    chains = _t(spark, sf_dir, "customer").select("c_custkey", F.explode(T.chain_suffixes(chain)).alias("suffix"))
    return chains.join(spark.createDataFrame([(x,) for x in _CHAINS], "suffix string"), "suffix").select("c_custkey", "suffix")


@query("SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders JOIN (VALUES ('F', '1-URGENT', 1), ('O', '5-LOW', 1), ('P', '2-HIGH', 1)) t(s, p, one) ON o_orderstatus = s AND o_orderpriority = p")
def triple_join(spark, sf_dir):
    """J-11: controller calls by constructor, anchor and method."""
    want = spark.createDataFrame([("F", "1-URGENT"), ("O", "5-LOW"), ("P", "2-HIGH")], "o_orderstatus string, o_orderpriority string")
    return _t(spark, sf_dir, "orders").join(F.broadcast(want), ["o_orderstatus", "o_orderpriority"]).select("o_orderpriority", "o_orderstatus", "o_orderkey")


@query("SELECT doc_id, quality FROM labels l WHERE quality = 1 AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'de')")
def draft_candidates(spark, sf_dir):
    """J-14, P-13: fixable, known, and not covered yet."""
    d, assets = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").where("quality = 1")
    return assets.join(d, "doc_id", "left_semi").join(d.where("lang = 'de'"), "doc_id", "left_anti").select("doc_id", "quality")


@query(
    """WITH f AS (SELECT p_partkey, p_partkey::VARCHAR AS path FROM part WHERE p_size * 2000 <= 65536),
u AS (SELECT DISTINCT l_orderkey AS id, path FROM lineitem JOIN f ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path) AS k FROM u)
SELECT id, string_agg(path, ',' ORDER BY path) AS files FROM r WHERE k <= 3 GROUP BY id"""
)
def draft_files(spark, sf_dir):
    """P-13: changes to draft, with the first three of their files that are small enough."""
    from .plans import verdicts

    o = _t(spark, sf_dir, "orders")
    assets = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "code-fixable").otherwise("needs-review").alias("fixability"))
    covered = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    sites = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("path"))
    files = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_size") * 2000).alias("length"))
    return verdicts.draft_candidates(assets, covered, sites, files).select("id", F.array_join("files", ",").alias("files"))


@query(
    """WITH s AS (SELECT o_orderkey AS k, 'C' || o_orderstatus AS ctor, 'a' || o_custkey % 7 AS anchor, 'm' || o_orderkey % 5 AS method FROM orders)
SELECT 'one' AS pack, 'controller-call' AS kind, anchor || '.' || method AS declared, k AS file FROM s WHERE ctor = 'CF' AND anchor = 'a1' AND method IN ('m0', 'm3')
UNION ALL SELECT 'two', 'controller-call', anchor || '.' || method, k FROM s WHERE ctor = 'CO' AND anchor = 'a2' AND method = 'm1'
UNION ALL SELECT 'two', 'sdk-call', method, k FROM s WHERE method = 'm2' UNION ALL SELECT 'one', 'sdk-call', anchor || '.' || method, k FROM s WHERE anchor || '.' || method = 'a6.m4'
UNION ALL SELECT 'two', 'endpoint', 'GET /v1/a3/{x}', k FROM s WHERE anchor = 'a3'"""
)
def packs_touched(spark, sf_dir):
    """J-9, J-10, J-11: packs that meet an inventory by endpoint, by call chain, or by constructor, anchor and method."""
    from .plans import inventory

    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("C"), "o_orderstatus").alias("ctor"), F.concat(F.lit("a"), F.col("o_custkey") % 7).alias("anchor"), F.concat(F.lit("m"), F.col("o_orderkey") % 5).alias("method"))
    sites = F.array(F.struct(F.col("o_orderkey").cast("string").alias("file"), F.lit(1).cast("long").alias("line"), F.lit("").alias("snippet")))
    called = F.concat_ws(".", "anchor", "method")
    forms = [("controller-call", F.concat_ws(" ", F.lit("pkg"), "ctor", called)), ("sdk-call", F.concat(F.lit("pkg client."), called)), ("endpoint", F.concat(F.lit("/v1/"), "anchor", F.lit("/{param}")))]
    found = o.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("surface"), sites.alias("sites")) for k, x in forms))).alias("x"))
    found = found.select(F.lit("acme").alias("provider"), "x.*")
    packs = spark.createDataFrame(
        [("one", "acme", [], ["a6.m4"], [("CF", "a1", ["m0", "m3"])]), ("two", "acme", ["GET /v1/a3/{x}"], ["m2"], [("CO", "a2", ["m1"])]), ("far", "other", ["GET /v1/a3/{x}"], ["m2"], [("CF", "a1", ["m0"])])],
        "pack string, provider string, surfaces array<string>, chains array<string>, controllers array<struct<ctor:string,anchor:string,methods:array<string>>>",
    )
    out = inventory.packs_touched(found, packs)
    return out.select("pack", "kind", "declared", F.element_at("evidence", 1)["file"].cast("long").alias("file"))


TEMPLATES = ["/p/{id}", "/page/{id}", "/article/{slug}/{id}", "/a/b", "/item/{id}", "/post/{id}", "/news/{id}", "/docs/{id}", "/{any}/{id}"]
_PATH_SQL = """
p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
t AS (SELECT unnest([%s]) AS template),
x AS (SELECT page_id, path, template, list_filter(string_split(path, '/'), lambda s: s <> '') AS a, list_filter(string_split(template, '/'), lambda s: s <> '') AS b FROM p, t),
y AS (SELECT *, least(len(a), len(b)) AS n, greatest(len(a), len(b)) AS m FROM x)""" % _list(TEMPLATES)


@query(f"WITH {_PATH_SQL} SELECT page_id, template FROM y WHERE n > 0 AND (n >= 2 OR n = m) AND len(list_filter(range(1, n + 1), lambda i: NOT (a[i] = b[i] OR a[i] = '{{param}}' OR regexp_matches(b[i], '^\\{{[^}}]+\\}}$')))) = 0")
def path_overlap(spark, sf_dir):
    """J-5: endpoints in code against anchors of changes, joined by keys of their segments."""
    from .operators.paths import code_slot

    return _paths(spark, sf_dir, code_slot)


@query(f"WITH {_PATH_SQL} SELECT page_id, template FROM y WHERE n > 0 AND (n >= 2 OR n = m) AND len(list_filter(range(1, n + 1), lambda i: NOT (a[i] = b[i] OR regexp_matches(a[i], '^\\{{[^}}]+\\}}$') OR regexp_matches(b[i], '^\\{{[^}}]+\\}}$')))) = 0")
def path_overlap_anchors(spark, sf_dir):
    """J-6: anchors against anchors, slots on both sides."""
    from .operators.paths import anchor_slot

    return _paths(spark, sf_dir, anchor_slot)


def _paths(spark, sf_dir, slot):
    from .operators.paths import overlapping

    pages = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    return overlapping(pages, spark.createDataFrame([(t,) for t in TEMPLATES], "template string"), [], "path", "template", slot).select("page_id", "template")


@query(
    """WITH e AS (SELECT DISTINCT '/v1/' || c_mktsegment || '/' || CASE WHEN c_custkey % 3 = 0 THEN '{param}' ELSE 'n' || c_nationkey END || CASE WHEN c_custkey % 2 = 0 THEN '/items' ELSE '' END AS endpoint FROM customer),
c AS (SELECT o_orderkey AS id, '/v1/' || CASE o_orderstatus WHEN 'F' THEN 'BUILDING' WHEN 'O' THEN 'MACHINERY' ELSE '{kind}' END || '/' || CASE WHEN o_custkey % 4 = 0 THEN '{id}' ELSE 'n' || o_custkey % 25 END || CASE WHEN o_orderkey % 5 = 0 THEN '/items/{item}' ELSE '' END AS anchor FROM orders),
d AS (SELECT DISTINCT anchor FROM c), x AS (SELECT anchor, endpoint, list_filter(string_split(endpoint, '/'), lambda s: s <> '') AS a, list_filter(string_split(anchor, '/'), lambda s: s <> '') AS b FROM d, e),
y AS (SELECT *, least(len(a), len(b)) AS n FROM x), z AS (SELECT anchor, endpoint FROM y WHERE len(list_filter(range(1, n + 1), lambda i: NOT (a[i] = b[i] OR a[i] = '{param}' OR regexp_matches(b[i], '^\\{[^}]+\\}$')))) = 0)
SELECT id, anchor, endpoint FROM c JOIN z USING (anchor)"""
)
def changes_touched(spark, sf_dir):
    """J-5, J-11, P-1: monitored changes whose anchors overlap endpoints in use, through the library's own plan."""
    from .plans import inventory

    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    third = F.when(F.col("c_custkey") % 3 == 0, "{param}").otherwise(F.concat(F.lit("n"), "c_nationkey"))
    used = F.concat(F.lit("/v1/"), "c_mktsegment", F.lit("/"), third, F.when(F.col("c_custkey") % 2 == 0, "/items").otherwise(""))
    found = c.select(F.lit("acme").alias("provider"), F.lit("endpoint").alias("kind"), used.alias("surface")).distinct().withColumn("sites", F.array(F.struct(F.lit("f").alias("file"), F.lit(1).cast("long").alias("line"), F.lit("").alias("snippet"))))
    second = F.when(F.col("o_orderstatus") == "F", "BUILDING").when(F.col("o_orderstatus") == "O", "MACHINERY").otherwise("{kind}")
    anchor = F.concat(F.lit("GET /v1/"), second, F.lit("/"), F.when(F.col("o_custkey") % 4 == 0, "{id}").otherwise(F.concat(F.lit("n"), F.col("o_custkey") % 25)), F.when(F.col("o_orderkey") % 5 == 0, "/items/{item}").otherwise(""))
    changes = o.select(F.col("o_orderkey").alias("id"), F.lit("acme").alias("provider"), F.lit("breaking").alias("change_type"), anchor.alias("title"), F.lit("u").alias("source_url"))
    return inventory.touched(found, changes).select(F.col("change_id").alias("id"), "anchor", "endpoint")


@query(f"WITH {_LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY doc_id, line, detail) AS k FROM f) SELECT source, kind, doc_id, line, detail FROM r WHERE k <= 3")
def cap_sites(spark, sf_dir):
    """W-1 to W-4, A-10: the first sites of each surface."""
    return R.cap(_findings(spark, sf_dir), ["source", "kind"], [F.col("doc_id"), F.col("line"), F.col("detail")], 3).select("source", "kind", "doc_id", "line", "detail")


@query(f"WITH {_LINES_SQL} SELECT source AS provider, kind, detail AS surface, count(*) AS sites, count(DISTINCT doc_id) AS files FROM f GROUP BY ALL")
def surface_inventory(spark, sf_dir):
    """A-10, A-11: distinct surfaces with their evidence."""
    return _findings(spark, sf_dir).groupBy(F.col("source").alias("provider"), "kind", F.col("detail").alias("surface")).agg(F.count("*").alias("sites"), F.count_distinct("doc_id").alias("files"))


@query(
    r"""WITH t AS (SELECT doc_id, array_distinct(list_filter(list_transform(regexp_extract_all(text, '([A-Z][a-z]+ [a-z]{6,}[.,])', 1), lambda s: trim(s)), lambda s: length(s) BETWEEN 4 AND 80)) AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n_symbols, array_to_string(list_sort(s), '|') AS symbols FROM t"""
)
def symbol_extract(spark, sf_dir):
    """PRJ-15's shape on prose: all matches of a name pattern, trimmed, of bounded length, distinct."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+ [a-z]{6,}[.,])"), F.lit(1)), F.trim)
    s = F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 4) & (F.length(x) <= 80)))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_symbols"), F.array_join(F.array_sort(s), "|").alias("symbols"))


@query(
    rf"""WITH t AS (SELECT doc_id, list_transform(list_concat(regexp_extract_all(text, '(@[a-z0-9-]+/[a-z0-9._-]+)', 1), regexp_extract_all(text, '\b([a-z]+[A-Z][A-Za-z0-9]*)\b', 1),
regexp_extract_all(text, '\b([A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)\b', 1), list_filter(regexp_extract_all(text, '\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+)\b', 1), lambda s: NOT regexp_matches(s, '(?i)\.(md|json|yml|yaml|txt|com|org|io)$')),
regexp_extract_all(text, '\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b', 1), regexp_extract_all(text, '`([^`\n]{{2,80}})`', 1)), lambda s: trim(s)) AS s FROM documents),
k AS (SELECT doc_id, list_distinct(list_filter(s, lambda s: length(s) BETWEEN 4 AND 80 AND NOT list_contains([{_list(V.STOP_WORDS)}], lower(s)) AND NOT regexp_matches(s, '^[0-9]+$'))) AS s FROM t)
SELECT doc_id, len(s)::BIGINT AS n_symbols, array_to_string(list_sort(s), '|') AS symbols FROM k"""
)
def symbols_named(spark, sf_dir):
    """PRJ-15: the names that whole texts mention."""
    s = T.symbols("text")
    return _t(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_symbols"), F.array_join(F.array_sort("s"), "|").alias("symbols"))


#: Change titles that reach every branch of the classifier.
TITLES = [
    "Breaking: drops support for v1", "Removed the legacy endpoint", "Remove unused workflow. Renamed ci job", "Deprecated the charges API", "This field will be removed",
    "Add new endpoint for refunds", "Fixes a crash", "Bumped lodash dependency", "Update readme", "@acme/types@3.0.0", "v6.4.0", "8.1.2", "43.0.0: Merge request", "v2.0.0-rc.1",
    "Full Changelog: v1.2.0...v1.2.1", "nothing to see", "See the changelog for more details.", "sunset of the old API", "end-of-life notice", "removed internal-only helper; renamed param x",
    "7.2.0-beta.3", "v15.4.0a4", "introducing batches", "patch a bug in retries", "1.0.0 ", "must migrate to tokens",
]


def _sql_flag(p: str) -> str:
    return "(?i)" + p.replace("'", "''")


_STRIPPED = "t"
for _p in V.BOILERPLATE:
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_sql_flag(_p)}', ' ', 'g')"
_SAYS = lambda p, c="x": f"regexp_matches({c}, '{_sql_flag(p)}')"
_TAIL, _HEAD = r"(?:^|[@\sv])(\d+)\.(\d+)\.(\d+)(-[0-9A-Za-z.-]+)?\s*$", r"^v?(\d+)\.(\d+)\.(\d+)(-[0-9A-Za-z.-]+)?\s*[:\s]"
_VERSION_SQL = " ".join(
    f"WHEN regexp_matches(t, '{p}') THEN CASE WHEN regexp_extract(t, '{p}', 4) <> '' THEN NULL WHEN regexp_extract(t, '{p}', 2) = '0' AND regexp_extract(t, '{p}', 3) = '0' THEN 'breaking' WHEN regexp_extract(t, '{p}', 3) = '0' THEN 'additive' ELSE 'fix' END"
    for p in (_TAIL, _HEAD)
)
_TITLE_SQL = f"(SELECT event_id, w.t FROM events JOIN {_values('i, t', list(enumerate(TITLES)))} ON event_id % {len(TITLES)} = i)"
_CLASS_SQL = f"""CASE WHEN {_SAYS(V.STRONG_BREAK)} THEN 'breaking'
WHEN len(list_filter(regexp_split_to_array(x, '[\\n.;]'), lambda s: {_SAYS(V.REMOVAL, 's')} AND NOT {_SAYS(V.TOOLING, 's')})) > 0 THEN 'breaking'
WHEN {_SAYS(V.DEPRECATION)} THEN 'deprecation' WHEN {_SAYS(V.ADDITIVE)} THEN 'additive' WHEN {_SAYS(V.FIX)} THEN 'fix' WHEN {_SAYS(V.DOCS)} THEN 'docs-only'
ELSE coalesce(CASE {_VERSION_SQL} END, 'unknown') END"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change records: a title for each."""
    keys = _t(spark, sf_dir, "events").select(F.col("event_id").alias("k"))
    return _dealt(keys, [(t,) for t in TITLES], "title string").withColumnRenamed("k", "event_id")


@query(f"SELECT event_id, t AS title, {_CLASS_SQL} AS change_type FROM (SELECT event_id, t, {_STRIPPED} AS x FROM {_TITLE_SQL})")
def classify_cascade(spark, sf_dir):
    """PRJ-10, PRJ-11, PRJ-12."""
    return _titles(spark, sf_dir).select("event_id", "title", T.classify("title", "title").alias("change_type"))


@query(f"SELECT doc_id, {_CLASS_SQL} AS change_type FROM (SELECT doc_id, text AS t, {_STRIPPED.replace('(t,', '(text,')} AS x FROM documents)")
def classify_documents(spark, sf_dir):
    """PRJ-11 over whole texts."""
    return _t(spark, sf_dir, "documents").select("doc_id", T.classify("text", "text").alias("change_type"))


@query(
    f"""SELECT event_id, t AS title, CASE {_VERSION_SQL} END AS version_class,
regexp_matches(t, '(?i)\\d+\\.\\d+\\.\\d+\\s*(-[0-9A-Za-z.]*(alpha|beta|rc|canary|next|dev|preview|pre)|(a|b|rc)\\d+)\\b') AS prerelease_release,
regexp_matches(t, '(?i)[-.](alpha|beta|rc)[-.]?\\d*\\b') AS prerelease_tag FROM {_TITLE_SQL}"""
)
def semver_class(spark, sf_dir):
    """PRJ-9, PRJ-13, PRJ-14."""
    return _titles(spark, sf_dir).select("event_id", "title", T.version_class("title").alias("version_class"), T.prerelease_release("title").alias("prerelease_release"), T.prerelease_tag("title").alias("prerelease_tag"))


@query(
    r"""SELECT page_id, regexp_extract(regexp_replace(url, '[\\/]+$', ''), '([^\\/]*)$', 1) AS name, regexp_replace(url, '-v?\d[\w.]*-to-v?\d[\w.]*$', '') AS stream,
regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[A-Za-z0-9_./${}\-]*)', 1), '\{[^}]*\}', '{param}', 'g'), '/+$', '') AS endpoint FROM pages"""
)
def endpoint_extract(spark, sf_dir):
    """PRJ-7, PRJ-17, PRJ-19."""
    p = _t(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    found = T.endpoints(F.replace("url", host, F.lit("api.host")), ["api.host"])
    return p.select("page_id", T.basename("url").alias("name"), T.stream("url").alias("stream"), F.coalesce(F.get(found, 0), F.lit("")).alias("endpoint"))


_ANCHORS = ["path-removed: GET /v1/charges/{id} gone", "POST   /v2/a/b: changed", "nothing", "see (DELETE /x/y) now", "PATCH /one"]


@query(
    rf"""SELECT id, t AS title, nullif(regexp_extract(t, '\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/[^\s:)]+)', 1), '') AS path,
CASE WHEN regexp_matches(t, '\b(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/[^\s:)]+)') THEN regexp_extract(t, '\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/[^\s:)]+)', 1) || ' ' || regexp_extract(t, '\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/[^\s:)]+)', 2) END AS surface
FROM (SELECT o_orderkey AS id, replace(w.t, '/', '/o' || o_custkey || '/') AS t FROM orders JOIN {_values('i, t', list(enumerate(_ANCHORS)))} ON o_orderkey % {len(_ANCHORS)} = i)"""
)
def anchor_extract(spark, sf_dir):
    """PRJ-18: verbs and paths in titles of orders as change records."""
    keys = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    rows = _dealt(keys, [(t,) for t in _ANCHORS], "title string").withColumn("title", F.replace("title", F.lit("/"), F.concat(F.lit("/o"), F.col("o_custkey"), F.lit("/"))))
    none = F.lit(None).cast("string")
    return rows.select(F.col("k").alias("id"), "title", T.anchor_path("title", none).alias("path"), T.anchor_surface("title", none).alias("surface"))


@query(
    r"""SELECT page_id, substr(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), 1, 2000) AS content FROM pages"""
)
def feed_parse(spark, sf_dir):
    """SRC-3, SRC-4, SRC-5: entities, tags, white space, and the cut of an entry's content."""
    return _t(spark, sf_dir, "pages").select("page_id", T.plain_text(T.decode_entities("html")).alias("content"))


_REDACTED_SQL = "text"
for _p, _r in V.SECRETS:
    _REDACTED_SQL = f"regexp_replace({_REDACTED_SQL}, '{_p.replace(chr(39), chr(39) * 2)}', '{_r.replace('$1', chr(92) + '1')}', 'g')"


@query(f"SELECT doc_id, sha256({_REDACTED_SQL}) AS redacted, {_REDACTED_SQL} <> text AS had_secret FROM documents")
def redact(spark, sf_dir):
    """PRJ-21."""
    clean = T.redact("text")
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(clean, 256).alias("redacted"), (clean != F.col("text")).alias("had_secret"))


@query(f"WITH r AS (SELECT doc_id, {_REDACTED_SQL} AS text FROM documents) SELECT doc_id, {_REDACTED_SQL} = text AS safe FROM r")
def payload_safety(spark, sf_dir):
    """P-14: redacted payloads hold nothing more to redact."""
    return _t(spark, sf_dir, "documents").select("doc_id", T.redact("text").alias("text")).select("doc_id", T.is_redacted("text").alias("safe"))


@query("SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(n_chars, 0)::BIGINT AS n_chars FROM documents")
def payload(spark, sf_dir):
    """PRJ-1: a whitelist with defaults; the text stays out."""
    d = _t(spark, sf_dir, "documents")
    body = F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))
    back = d.select("doc_id", F.from_json(F.to_json(body), "lang string, source string, n_chars long").alias("p"))
    return back.select("doc_id", "p.lang", "p.source", "p.n_chars")


_SNAPS = "o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 5 <> 0)"


@query(
    f"""WITH {_SNAPS}, b AS (SELECT coalesce(o.k, n.k) AS k, o.k AS ok, n.k AS nk, o.s AS os, n.s AS ns, o.p AS op, n.p AS np FROM o FULL JOIN n ON o.k = n.k)
SELECT k, 'removed' AS kind, NULL AS field, NULL AS before, NULL AS after FROM b WHERE nk IS NULL UNION ALL SELECT k, 'added', NULL, NULL, NULL FROM b WHERE ok IS NULL
UNION ALL SELECT k, 'changed', 's', os, ns FROM b WHERE os <> ns UNION ALL SELECT k, 'changed', 'p', op, np FROM b WHERE op <> np"""
)
def snapshot_diff(spark, sf_dir):
    """J-15, SD-1 to SD-4, SD-20: two snapshots, one full outer join, all rules in one pass."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    new = o.where("k % 5 <> 0").select("k", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("s")).alias("s"), F.when(F.col("k") % 13 != 0, F.col("p")).alias("p"))
    return R.snapshot_diff(o.where("k % 7 <> 0"), new, "k", ["s", "p"])


@query(
    """WITH o AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 2 = 1),
b AS (SELECT k FROM o INTERSECT SELECT k FROM n)
SELECT k, 'value-removed' AS kind, v AS value FROM (SELECT * FROM o EXCEPT SELECT * FROM n) WHERE k IN (SELECT k FROM b)
UNION ALL SELECT k, 'value-added', v FROM (SELECT * FROM n EXCEPT SELECT * FROM o) WHERE k IN (SELECT k FROM b)"""
)
def enum_diff(spark, sf_dir):
    """SD-11, SD-30, SD-31, SO-2: values lost and gained."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), "o_orderkey")
    return R.set_diff(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "k", "v")


@query(
    """WITH o AS (SELECT l_partkey AS k, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), n AS (SELECT l_partkey AS k, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
SELECT k, 'min-increased' AS kind, o.lo AS before, n.lo AS after FROM o JOIN n USING (k) WHERE n.lo > o.lo UNION ALL SELECT k, 'max-decreased', o.hi, n.hi FROM o JOIN n USING (k) WHERE n.hi < o.hi"""
)
def bounds_diff(spark, sf_dir):
    """SD-9, SD-10, SD-27 to SD-29."""
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    side = lambda test: l.where(test).groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return R.bounds_diff(side("l_linenumber <= 2"), side("l_linenumber > 2"), "k", "lo", "hi")


@query("SELECT o_orderkey, sha1(o_orderstatus || '|' || o_orderpriority || '|' || o_orderkey) AS address FROM orders")
def content_address(spark, sf_dir):
    """PRJ-3."""
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.content_address("o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("address"))


@query(
    """WITH r AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS breaking, 'kind-' || o_orderstatus AS kind, '/v1/' || o_custkey AS anchor, o_orderpriority AS detail FROM orders)
SELECT id, substr(kind || ': ' || anchor || ' ' || detail, 1, 300) AS title, CASE WHEN breaking THEN 'breaking' ELSE 'additive' END AS change_type, 'specdiff://p/l#' || sha1(kind || '|' || anchor || '|' || detail) AS source_url FROM r"""
)
def record_to_change(spark, sf_dir):
    """PRJ-2, PRJ-3, P-16: difference records as change rows."""
    from .operators.specdiff import to_changes

    r = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("breaking"), F.concat(F.lit("kind-"), "o_orderstatus").alias("kind"), F.concat(F.lit("/v1/"), "o_custkey").alias("anchor"), F.col("o_orderpriority").alias("detail"))
    return to_changes(r, "p", "l", None).select("id", "title", "change_type", "source_url")


@query(
    """WITH RECURSIVE e AS (SELECT 'n' || c_custkey AS name, 'n' || (c_custkey // 3) AS via FROM customer WHERE c_custkey > 0),
c AS (SELECT 'n0' AS name, 'root' AS target, 0 AS hop UNION ALL SELECT e.name, c.target, c.hop + 1 FROM c JOIN e ON e.via = c.name WHERE c.hop < 5)
SELECT name, target, min(hop)::INT AS hop FROM c GROUP BY name, target"""
)
def alias_closure(spark, sf_dir):
    """BR-15, BR-16, MG-4: bounded closure over links of customers; a bound name keeps its target."""
    c = _t(spark, sf_dir, "customer").where("c_custkey > 0").select(F.concat(F.lit("n"), "c_custkey").alias("name"), F.concat(F.lit("n"), F.expr("c_custkey div 3")).alias("via"))
    return R.closure(spark.createDataFrame([("n0", "root")], "name string, target string"), c, 5)


@query("SELECT c_custkey, i AS id FROM customer, unnest(range(c_custkey, c_custkey + 12)) AS t(i) WHERE i % 7 <> 3 AND i NOT IN (105, 200, 333, 900, 1701)")
def range_minus(spark, sf_dir):
    """SO-7, SO-6: for each customer a range of ids without some."""
    k = F.col("c_custkey")
    window = F.sequence(k, k + 11)
    gone = F.array_union(F.filter(window, lambda i: i % 7 == 3), F.array(*(F.lit(i).cast("long") for i in (105, 200, 333, 900, 1701))))
    return _t(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array_except(window, gone)).alias("id"))


@query("SELECT DISTINCT source AS provider FROM documents UNION SELECT 'src' || user_id % 20 FROM events")
def provider_union(spark, sf_dir):
    """SO-1, SO-4."""
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("provider"))
    return d.unionByName(_t(spark, sf_dir, "events").select(F.concat(F.lit("src"), F.col("user_id") % 20).alias("provider"))).distinct()


@query(
    """WITH r AS (SELECT o_custkey AS k, o_orderstatus AS kind, o_orderpriority AS detail, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS pass FROM orders)
SELECT k, kind, detail, min(pass)::INT AS pass FROM r GROUP BY ALL"""
)
def record_dedup(spark, sf_dir):
    """SO-5: one record of several passes, of the earliest pass."""
    r = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("detail"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2).alias("pass"))
    return r.groupBy("k", "kind", "detail").agg(F.min("pass").alias("pass"))


@query(
    """SELECT o_custkey, sum(o_totalprice) AS total, bool_or(o_orderstatus = 'F') AS ran, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'ran' ELSE min_by(o_orderpriority, o_orderkey) END AS status,
bool_and(o_totalprice > 1000) AS all_large, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM orders GROUP BY 1"""
)
def verification_fold(spark, sf_dir):
    """A-8, A-9, A-12: sums, any, every, and the first reason."""
    ran = F.bool_or(F.col("o_orderstatus") == "F")
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), ran.alias("ran"), F.when(ran, "ran").otherwise(F.min_by("o_orderpriority", "o_orderkey")).alias("status"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))


@query(
    """WITH i AS (SELECT event_id, user_id FROM events WHERE event_type = 'click'), s AS (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0), u AS (SELECT DISTINCT user_id FROM i WHERE user_id NOT IN (SELECT c_custkey FROM s))
SELECT (SELECT count(*) FROM i) AS seen, (SELECT count(*) FROM u) AS inserted, (SELECT count(*) FROM i) - (SELECT count(*) FROM u) AS duplicates"""
)
def ingest_accounting(spark, sf_dir):
    """A-13."""
    i = _t(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id")
    stored = _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    added = R.ingest(i, stored, "user_id", [F.col("event_id")]).agg(F.count("*").alias("inserted"))
    return i.agg(F.count("*").alias("seen")).join(F.broadcast(added)).select("seen", "inserted", (F.col("seen") - F.col("inserted")).alias("duplicates"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 30")
def feed_cap(spark, sf_dir):
    """SRC-6: the first thirty entries of each feed."""
    return R.cap(_t(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], V.FEED_ENTRIES)


@query("SELECT doc_id, substr(trim(split_part(text, chr(10), 1), ' '), 1, 200) AS snippet FROM documents")
def snippets(spark, sf_dir):
    """PRJ-8."""
    return _t(spark, sf_dir, "documents").select("doc_id", T.snippet(F.split_part("text", F.lit("\n"), F.lit(1))).alias("snippet"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d') END, ''), substr(strftime(ts, '%Y-%m-%d %H:%M:%S'), 1, 10)) AS chrono FROM events")
def chronology(spark, sf_dir):
    """PRJ-20: an empty date counts as none."""
    date = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd"))
    return _t(spark, sf_dir, "events").select("event_id", T.chronology(date, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("chrono"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """STREAM: daily windows of the change log, by the function that streams use."""
    from .streaming.ingest import windowed

    return windowed(_t(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query(
    """SELECT c_nationkey::VARCHAR AS spec_id, CASE WHEN c_custkey % 3 = 0 THEN 'request-prop-removed' ELSE 'request-prop-type-changed' END AS kind, true AS breaking, 'POST /things/{id}' AS anchor,
'p' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ': string -> integer' END AS detail FROM customer"""
)
def spec_diff_openapi(spark, sf_dir):
    """SX-1 to SX-9, SD-1 to SD-41, SRC-9, SRC-10: snapshot pairs made of the customer table: one document for each
    nation, whose second version lost, gained and changed fields."""
    from .operators import specdiff
    from .sources import specs

    c = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("spec_id")).agg(F.sort_array(F.collect_list("c_custkey")).alias("ids"))
    c = _spread(c, 1)

    def document(text: str):
        prop = F.transform("ids", lambda i: F.format_string('"p%d": {"type": "' + text + '", "maxLength": %d}', i, 900 - i % 7))
        return F.concat(F.lit('{"paths": {"/things/{id}": {"post": {"requestBody": {"content": {"application/json": {"schema": {"type": "object", "properties": {'), F.array_join(prop, ", "), F.lit("}}}}}}}}}"))

    old = c.select("spec_id", document("string").alias("spec"))
    new = c.withColumn("ids", F.filter("ids", lambda i: i % 3 != 0)).select("spec_id", document("integer").alias("spec"))
    return specdiff.diff(specs.facts(old), specs.facts(new)).select("spec_id", "kind", "breaking", "anchor", "detail")


# --- Code: sources made of table rows, so that SQL can state what must come out. ---


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each customer: by key, one of four shapes."""
    c = _spread(_t(spark, sf_dir, "customer").select("c_custkey"), 4000)
    k = F.col("c_custkey").cast("string")
    shapes = [
        F.concat(F.lit("import Stripe from 'stripe';\nconst pay"), k, F.lit(" = new Stripe(process.env.STRIPE_KEY);\npay"), k, F.lit(".charges.create({});\n")),
        F.concat(F.lit("// import Stripe from 'stripe';\nconst s = \"import x\";\npay"), k, F.lit(".charges.create({});\n")),
        F.concat(F.lit("fetch(`https://api.stripe.com/v1/charges/${id}/refund`);\nordersController.ordersCreate(b"), k, F.lit(");\n")),
        F.concat(F.lit("import Stripe from 'stripe';\nlet c = new Stripe(k"), k, F.lit(");\nc = other;\nc.charges.create({});\n")),
    ]
    text = F.element_at(F.array(*shapes), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select(F.concat(F.lit("src/f"), k, F.lit(".js")).alias("path"), text.alias("text"))


@query("SELECT doc_id, length(text) AS n, length(text) - length(replace(text, chr(10), '')) AS n_lines FROM documents")
def lex_mask(spark, sf_dir):
    """TX-1 to TX-4: masks keep length and line breaks, whatever the text."""
    from .functions import lexer

    def masked(batches):
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            for lo in range(0, batch.num_rows, 64):  # few texts at a time, since a batch's masks stand beside it
                out = [t if t is None else lexer.mask_code(lexer.mask_prose(t, "js"), "js") for t in text.slice(lo, 64).to_pylist()]
                yield pa.record_batch([ids.slice(lo, 64), pa.array(out, pa.string())], ["doc_id", "m"])

    m = _t(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(masked, "doc_id long, m string")
    return m.select("doc_id", F.length("m").cast("long").alias("n"), (F.length("m") - F.length(F.replace("m", F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"))


@query(
    """WITH f AS (SELECT c_custkey AS k, c_custkey % 4 AS s FROM customer)
SELECT 'stripe' AS provider, 'import' AS kind, 'src/f' || k || '.js' AS file, 1::BIGINT AS line FROM f WHERE s IN (0, 3)
UNION ALL SELECT 'stripe', 'env-var', 'src/f' || k || '.js', 2 FROM f WHERE s = 0 UNION ALL SELECT 'stripe', 'api-host', 'src/f' || k || '.js', 1 FROM f WHERE s = 2"""
)
def usage_scan(spark, sf_dir):
    """TX-14, TX-15, J-4, P-4 to P-6: usage by masked line; comments do not count."""
    from .sources import files

    return files.usage(_files(spark, sf_dir)).select("provider", "kind", "file", "line")


@query(
    """WITH f AS (SELECT c_custkey % 4 AS s FROM customer)
SELECT 'module' AS kind, 'stripe' AS surface, count(*) AS sites FROM f WHERE s IN (0, 3) UNION ALL SELECT 'env', 'STRIPE_', count(*) FROM f WHERE s = 0
UNION ALL SELECT 'api-host', 'api.stripe.com', count(*) FROM f WHERE s = 2 UNION ALL SELECT 'endpoint', '/v1/charges/{param}/refund', count(*) FROM f WHERE s = 2
UNION ALL SELECT 'sdk-call', 'stripe client.charges.create', count(*) FROM f WHERE s = 0"""
)
def code_inventory(spark, sf_dir):
    """BR-1 to BR-17, MG-1 to MG-10, A-10, A-11: surfaces with proven roots; what is bound twice is dropped."""
    from .plans import inventory

    rows = inventory.surfaces(_files(spark, sf_dir))
    return rows.groupBy("kind", "surface").agg(F.count("*").alias("sites"))


@query(
    """WITH f AS (SELECT c_custkey % 4 AS s FROM customer)
SELECT 'module' AS fact, 'stripe' AS what, count(*) AS n FROM f WHERE s IN (0, 3) UNION ALL SELECT 'client', 'Stripe', count(*) FROM f WHERE s IN (0, 3)
UNION ALL SELECT 'call', 'charges.create', count(*) FROM f WHERE s <> 2 UNION ALL SELECT 'call', 'ordersCreate', count(*) FROM f WHERE s = 2
UNION ALL SELECT 'endpoint', '/v1/charges/{param}/refund', count(*) FROM f WHERE s = 2"""
)
def code_facts_sql(spark, sf_dir):
    """UF-5: facts of files by a table function, and slots of paths by a SQL function, in one SQL text."""
    from .functions.sql import register

    register(spark)
    return spark.sql(
        """WITH facts AS (SELECT f.* FROM {files} AS t, LATERAL code_facts(t.path, t.text) AS f)
SELECT fact, coalesce(nullif(chain, ''), target) AS what, count(*) AS n FROM facts WHERE fact IN ('module', 'client', 'call') GROUP BY ALL
UNION ALL SELECT 'endpoint', path_slots(regexp_replace(regexp_extract(text, 'api[.]stripe[.]com(/[^`]*)', 1), '[$]', '')) AS what, count(*) FROM {files} WHERE contains(text, 'api.stripe.com') GROUP BY ALL""",
        files=_files(spark, sf_dir),
    )


_STRIPE_JS = "const Stripe = require('stripe');\n"
#: Files by key: name and text with % for the key, and the calls (surface, line) that are proven in them.
_TREES = [
    [("shadow", _STRIPE_JS + "const pay% = new Stripe(k);\nlist.forEach((x = make(), pay%) => pay%.refunds.create());\ntry { go(); } catch (pay%) { pay%.plans.list(); }\npay%.charges.create();\n", [("charges.create", 5)])],
    [("box", _STRIPE_JS + "const box% = { sc: new Stripe(k) };\nconst { sc } = box%;\nsc.payouts.list();\nconst same = box%;\nsame.sc.topups.create();\n", [("payouts.list", 4), ("topups.create", 6)])],
    [("crate", _STRIPE_JS + "let box% = {};\nbox%.sc = new Stripe(k);\nbox% = other();\nbox%.sc.topups.create();\n", [])],
    [
        ("lib", _STRIPE_JS + "const pay% = new Stripe(k);\nexports.pay% = pay%;\n", []),
        ("slot", "exports.slot = require('./lib%').pay%.terminal;\nexports.all = require('./lib%');\n", []),
        ("use", "const { slot } = require('./slot%');\nconst { all } = require('./slot%');\nslot.readers.list();\nall.pay%.quotes.list();\n", [("terminal.readers.list", 3), ("quotes.list", 4)]),
    ],
    [("cache", _STRIPE_JS + "globalThis._c% ??= new Stripe(k);\nglobalThis._c%.events.list();\n", [("events.list", 3)])],
    [("class", _STRIPE_JS + "class A {\n  #l; #r;\n  go() { if (!this.#l) { log(); this.#r = new Stripe(k); }\n  return this.#r.events.list(); }\n}\n", [])],
]


@query(" UNION ALL ".join(f"SELECT 'src/{name}' || c_custkey || '.js' AS file, 'stripe client.{call}' AS surface, {line}::BIGINT AS line FROM customer WHERE c_custkey % {len(_TREES)} = {k}" for k, tree in enumerate(_TREES) for name, _, want in tree for call, line in want))
def resolved_calls(spark, sf_dir):
    """BR-9, BR-14, MG-2, MG-5, MG-6, MG-9 and the guards of roots and operands: calls by the scope of their names, by what objects
    hold, and through slots of modules; a tree of files for each customer."""
    from .plans import inventory

    c = _spread(_t(spark, sf_dir, "customer").select("c_custkey"), 2000)
    made = F.array(*(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")) for name, text, _ in tree)) for tree in _TREES))
    each = c.select("c_custkey", F.explode(F.get(made, (F.col("c_custkey") % len(_TREES)).cast("int"))).alias("f"))
    key = F.col("c_custkey").cast("string")
    files = each.select(F.concat(F.lit("src/"), "f.name", key, F.lit(".js")).alias("path"), F.replace("f.text", F.lit("%"), key).alias("text"))
    return inventory.surfaces(files).where("kind = 'sdk-call'").select("file", "surface", "line")


@query(
    """SELECT 'src/f' || c_custkey || '.js' AS path, 'fetch(`https://api.stripe.com/v1/charges/${id}/refund`);' || chr(10) || 'ordersController.createOrder(b' || c_custkey || ');' || chr(10) AS after,
2::BIGINT AS changed_lines FROM customer WHERE c_custkey % 4 = 2"""
)
def pack_rewrite(spark, sf_dir):
    """FX-1 to FX-47, UF-1, SNK-4, FV-1: one pack of the catalogue over a tree, with its diff."""
    from .operators.catalogue import catalogue
    from .operators.packs import rewrite

    pack = next(p for p in catalogue() if p.name == "paypal-server-sdk-v1-controller-renames")
    out = rewrite(_files(spark, sf_dir), pack)
    return out.select("path", "after", F.size(F.filter(F.split("diff", "\n"), lambda x: x.rlike(r"^[-+](?![-+])"))).cast("long").alias("changed_lines"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) SELECT doc_id, len(list_filter(s, lambda x: contains(x, 'e, ')))::BIGINT AS deleted, 0::BIGINT AS inserted FROM l")
def lcs_diff(spark, sf_dir):
    """TX-12: the edit script of a text and what is left of it without some lines has just their deletions."""
    from .functions.rewrite import edit_script

    @F.pandas_udf("array<bigint>")
    def script(old: pd.Series, new: pd.Series) -> pd.Series:
        return old.combine(new, lambda a, b: [sum(op == x for op, _ in edit_script(a.split("\n"), b.split("\n") if b is not None else [])) for x in "-+"])

    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    left = F.filter(F.split("text", "\n", -1), lambda x: ~x.contains("e, "))
    d = d.withColumn("left", F.when(F.size(left) > 0, F.array_join(left, "\n"))).withColumn("s", script("text", "left"))
    return d.select("doc_id", d["s"][0].alias("deleted"), d["s"][1].alias("inserted"))


@query("SELECT page_id, 'Page ' || page_id || ' & more' AS title, url, '2024-03-01' AS updated FROM pages")
def feed_entries(spark, sf_dir):
    """SRC-3 to SRC-7: entries of landed feeds, one feed for each page."""
    from .sources import feeds

    p = _t(spark, sf_dir, "pages")
    xml = F.concat(F.lit("<feed><entry><title>Page "), "page_id", F.lit(' &amp; more</title><updated>2024-03-01T00:00:00Z</updated><link href="'), "url", F.lit('"/><content>x</content></entry></feed>'))
    rows = feeds.entries(p.select(F.col("page_id").cast("string").alias("source"), F.lit("atom").alias("kind"), xml.alias("xml")))
    return rows.select(F.col("source").cast("long").alias("page_id"), "title", "url", F.substring("updated", 1, 10).alias("updated"))


_NAMES = ["Licensed", "Released", "Public", "reserved"]


@query(
    f"""WITH l AS (SELECT doc_id, source, i AS line, s[i] AS raw FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS t(i)), n AS (SELECT unnest([{_list(_NAMES)}]) AS symbol)
SELECT source AS id, doc_id AS file, line, symbol FROM l, n WHERE source IS NOT NULL AND regexp_matches(raw, '(^|[^\\w$])' || symbol || '($|[^\\w$])')"""
)
def symbol_sites(spark, sf_dir):
    """J-2, PRJ-15, W-2: names in backticks are the symbols of a change of each source; whole names in raw lines."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("provider"), "text")
    said = ", ".join(f"`{n}`" for n in _NAMES)
    changes = d.select("provider").distinct().where("provider IS NOT NULL").select(F.col("provider").alias("id"), "provider", F.lit("t").alias("title"), F.lit(said).alias("raw_excerpt"), F.lit(None).cast("string").alias("migration_hint"))
    lines = L.lines(d.select("file", "text"))
    return I.symbol_sites(changes, d.select("provider", "file"), lines).select("id", "file", "line", "symbol")


@query(
    """WITH c AS (SELECT c_custkey AS id, 'client-' || lower(c_mktsegment) AS named FROM customer), u AS (SELECT DISTINCT 'client-' || lower(c_mktsegment) AS used FROM customer WHERE c_nationkey < 2)
SELECT id FROM c WHERE named IN (SELECT used FROM u)"""
)
def sub_api_gate(spark, sf_dir):
    """PRJ-16, J-3, P-8: changes of sub-APIs that nobody uses are dropped."""
    c = _t(spark, sf_dir, "customer")
    named = F.concat(F.lit("client-"), F.lower("c_mktsegment"))
    changes = c.select(F.col("c_custkey").alias("id"), F.lit("aws").alias("provider"), F.lit("t").alias("title"), named.alias("raw_excerpt"))
    files = c.where("c_nationkey < 2").select(F.lit("aws").alias("provider"), F.concat(F.lit("import '@aws-sdk/"), named, F.lit("'")).alias("text")).distinct()
    return I.gate_sub_apis(changes, files).select("id")


@query(
    """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'llm-v1' ELSE 'keyword-v3' END AS classifier FROM orders),
v AS (SELECT l_orderkey AS id, arg_min(CASE WHEN l_linenumber % 2 = 0 THEN 'fix' ELSE 'additive' END, l_linenumber) AS t FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1)
SELECT c.id, CASE WHEN v.id IS NOT NULL AND classifier <> 'llm-v1' THEN v.t ELSE 'unknown' END AS change_type, v.id IS NOT NULL AND classifier <> 'llm-v1' AS updated FROM c LEFT JOIN v USING (id)"""
)
def reclassify(spark, sf_dir):
    """J-8, P-11, P-12: verdicts in order, valid ones first, never over a stronger classifier."""
    from .plans import verdicts

    c = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("unknown").alias("change_type"), F.when(F.col("o_orderstatus") == "F", "llm-v1").otherwise("keyword-v3").alias("classifier"))
    kind = F.when(F.col("l_linenumber") == 1, "no such type").when(F.col("l_linenumber") % 2 == 0, "fix").otherwise("additive")
    v = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), kind.alias("change_type"), F.when(F.col("l_linenumber") == 2, "").otherwise("why").alias("rationale"), F.col("l_linenumber").alias("position"))
    return verdicts.reclassify(c, v).select("id", "change_type", "updated")


@query(
    """WITH i AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS confidence FROM orders)
SELECT id, confidence FROM i WHERE confidence = 'medium' AND id % 3 <> 0"""
)
def pending_review(spark, sf_dir):
    """P-10, J-13, W-4, S-8: medium impacts that nobody has reviewed."""
    from .plans import verdicts

    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low").alias("confidence"))
    impacts = o.withColumn("usage_sites", F.array(F.col("id")))
    texts = o.select("id", F.lit("x").alias("raw_excerpt"), F.lit(None).cast("string").alias("migration_hint"))
    return verdicts.pending(impacts, texts, o.where("id % 3 = 0")).select("id", "confidence")


@query(
    """WITH s AS (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS confidence FROM events),
h AS (SELECT count(*) AS n FROM s WHERE confidence = 'high'), r AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM s WHERE confidence = 'medium')
SELECT id, 'high' AS confidence FROM s WHERE confidence = 'high' UNION ALL SELECT id, 'medium' FROM r, h WHERE k <= greatest(3000 - n, 0)"""
)
def report_view(spark, sf_dir):
    """SNK-7, W-6: all of high confidence, others up to a budget, none of low."""
    e = _t(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.lit("high").alias("severity"), F.when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "click", "medium").otherwise("low").alias("confidence"), F.lit(None).cast("string").alias("effective_date"))
    return I.summary(rows, 3000).select("id", "confidence")


@query(
    """WITH r AS (SELECT nation.n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT '{"tool": "t", "nations_found": ' || count(*) || ', "nations": [' || string_agg('{"name":"' || name || '","n":' || n || '}', ', ' ORDER BY name) || ']}' AS value FROM r"""
)
def report_json(spark, sf_dir):
    """SNK-3: a report as one JSON document."""
    from pyspark.sql import Window

    from .sources import sinks

    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"))
    return sinks.report(rows.withColumn("place", F.row_number().over(Window.orderBy("name"))), {"tool": "t"}, "nations")


@query(
    """WITH p AS (SELECT o_orderkey AS k, list_aggregate(list_transform(range(1, 2 + o_orderkey % 4), lambda i: 'f' || i || CASE WHEN (o_orderkey + i) % 3 = 0 THEN '[]' ELSE '' END), 'string_agg', '.') AS path FROM orders)
SELECT k, path, CASE WHEN contains(path, '.') THEN regexp_replace(regexp_replace(path, '\\.[^.]*$', ''), '\\[\\]$', '') ELSE '' END AS parent FROM p"""
)
def parent_paths(spark, sf_dir):
    """PRJ-23: the parent of a property path."""
    k = F.col("o_orderkey")
    step = lambda i: F.concat(F.lit("f"), i, F.when((k + i) % 3 == 0, "[]").otherwise(""))
    path = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), 1 + k % 4), step), ".")
    return _t(spark, sf_dir, "orders").select(k.alias("k"), path.alias("path")).withColumn("parent", T.parent_path("path"))


@query(
    """WITH c AS (SELECT o_orderkey AS id, o_custkey AS pack, strftime(o_orderdate, '%Y-%m-%d') AS chrono, o_orderstatus AS s FROM orders),
k AS (SELECT DISTINCT c_custkey AS pack FROM customer), v AS (SELECT pack, count(*) AS n, max(CASE WHEN s <> 'P' THEN chrono END) AS baseline FROM c WHERE s = 'F' OR id % 50 = 0 GROUP BY 1),
w AS (SELECT c.pack, count(*) AS newer FROM c JOIN v USING (pack) WHERE s = 'O' AND id % 50 <> 0 AND chrono > baseline GROUP BY 1)
SELECT k.pack, CASE WHEN v.n IS NULL THEN 'no-covers' WHEN baseline IS NULL THEN 'covers-missing' WHEN newer IS NOT NULL THEN 'stale' ELSE 'fresh' END AS status, baseline, coalesce(newer, 0)::BIGINT AS newer
FROM k LEFT JOIN v USING (pack) LEFT JOIN w USING (pack)"""
)
def audit_packs(spark, sf_dir):
    """J-9, J-17, A-7, PRJ-14, PRJ-18 to PRJ-20: the staleness audit; orders are changes, customers are packs."""
    from .plans import verdicts

    o = _t(spark, sf_dir, "orders")
    changes = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("provider"), F.lit("spec-diff:x-v1-to-v2").alias("source_repo"), F.lit("no anchor").alias("title"), F.when(F.col("o_orderstatus") == "P", "additive").otherwise("breaking").alias("change_type"),
        F.lit("").alias("effective_date"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), F.lit("u").alias("source_url"),
    )
    packs = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pack"), F.col("c_custkey").alias("provider"), F.lit(None).cast("string").alias("revalidated_through"))
    covers = o.where("o_orderstatus = 'F' OR o_orderkey % 50 = 0").select(F.col("o_custkey").alias("pack"), F.col("o_orderkey").alias("id"))
    return verdicts.audit(packs, covers, changes).select("pack", "status", "baseline", F.coalesce(F.size("newer"), F.lit(0)).cast("long").alias("newer")).withColumn("newer", F.greatest("newer", F.lit(0)))


@query(
    """SELECT event_id AS id, '{"change":{"id":' || event_id || ',"provider":"p","title":"key [REDACTED] used","type":"breaking","severity":"high"},"confidence":"high","usage_kinds":["import"],"symbols_extracted":1,"matched_symbols":["sym"],"symbol_sites":[{"file":"f' || user_id || '.js","line":' || event_id || ',"symbol":"sym"}]}' AS payload
FROM events WHERE event_type = 'purchase'"""
)
def upload_payload(spark, sf_dir):
    """PRJ-1, PRJ-7, PRJ-21, P-14: what may leave; titles are redacted, paths cut to names, snippets left out."""
    from .plans import verdicts

    e = _t(spark, sf_dir, "events").where("event_type = 'purchase'")
    site = F.struct(F.concat(F.lit("src/dir/f"), "user_id", F.lit(".js")).alias("file"), F.col("event_id").alias("line"), F.lit("sym").alias("symbol"), F.lit("secret code").alias("snippet"))
    impacts = e.select(
        F.col("event_id").alias("id"), F.lit("p").alias("provider"), F.lit("key sk_live_abcdefghij0123 used").alias("title"), F.lit("breaking").alias("change_type"), F.lit("high").alias("severity"), F.lit("high").alias("confidence"),
        F.array(F.lit("import")).alias("usage_kinds"), F.lit(1).alias("symbols_extracted"), F.array(F.lit("sym")).alias("matched_symbols"), F.array(site).alias("symbol_sites"),
    )
    return verdicts.upload(impacts)


# --- Worked cases: dealt to rows of a table by key, with what must come out of each listed in the SQL. ---

_SPEC_SQL = _values("i, kind, breaking, anchor, detail", [(i, *r) for i, (_, _, _, want) in enumerate(cases.SPECS) for r in want])


@query(f"SELECT c_custkey::VARCHAR AS spec_id, kind, breaking, replace(anchor, '/a', '/a' || c_custkey) AS anchor, detail FROM customer JOIN {_SPEC_SQL} ON c_custkey % {len(cases.SPECS)} = i")
def spec_rules(spark, sf_dir):
    """SX-1 to SX-9, SD-1 to SD-41: for each customer a pair of snapshots with a path of its own, by key one of those that make a
    rule speak or keep silent."""
    from .operators import specdiff
    from .sources import specs

    keys = _spread(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), 4000)
    rows = _dealt(keys, [(json.dumps(c[1]), json.dumps(c[2])) for c in cases.SPECS], "old string, new string")
    own = lambda c: F.regexp_replace(c, F.lit('"/a(?=[/"])'), F.concat(F.lit('"/a'), F.col("k")))
    old, new = (rows.select(F.col("k").cast("string").alias("spec_id"), own(F.col(c)).alias("spec")) for c in ("old", "new"))
    return specdiff.diff(specs.facts(old), specs.facts(new)).select("spec_id", "kind", "breaking", "anchor", "detail")


@query(f"SELECT c_custkey, lang, prose || '  ' AS prose_mask, code || '  ' AS code_mask FROM customer JOIN {_values('i, lang, prose, code', [(i, lang, prose, code) for i, (lang, _, prose, code) in enumerate(cases.MASKS)])} ON c_custkey % {len(cases.MASKS)} = i")
def code_masks(spark, sf_dir):
    """TX-1 to TX-4: masked texts, character by character; a text for each customer."""
    from .functions import lexer

    @F.pandas_udf("string")
    def prose(lang: pd.Series, text: pd.Series) -> pd.Series:
        return lang.combine(text, lambda a, t: lexer.mask_prose(t, a))

    @F.pandas_udf("string")
    def code(lang: pd.Series, text: pd.Series) -> pd.Series:
        return lang.combine(text, lambda a, t: lexer.mask_code(t, a))

    keys = _spread(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), 4000)
    rows = _dealt(keys, [(lang, text + "  ") for lang, text, *_ in cases.MASKS], "lang string, text string")
    return rows.select(F.col("k").alias("c_custkey"), "lang", prose("lang", "text").alias("prose_mask"), code("lang", "text").alias("code_mask"))


@query(f"SELECT c_custkey, pack, before, after FROM customer JOIN {_values('i, pack, before, after', [(i, *c[:3]) for i, c in enumerate(cases.PACKS) if c[1] != c[2]])} ON c_custkey % {len(cases.PACKS)} = i")
def pack_catalogue(spark, sf_dir):
    """FX-1 to FX-47: what every pack makes of a text of its rules, one for each customer; a second run changes nothing more."""
    from .operators import packs as P
    from .operators.catalogue import catalogue

    known = catalogue({"aiGateway.logs.get": ["gateway_id"]})

    @F.pandas_udf("string")
    def rewritten(name: pd.Series, text: pd.Series) -> pd.Series:
        by_name = {p.name: p for p in known}
        return name.combine(text, lambda n, t: P.applied(by_name[n], t)[0])

    keys = _spread(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), 4000)
    rows = _dealt(keys, [c[:2] for c in cases.PACKS], "pack string, before string")
    once = rows.withColumn("after", rewritten("pack", "before")).withColumn("again", rewritten("pack", "after"))
    return once.where("after = again AND before <> after").select(F.col("k").alias("c_custkey"), "pack", "before", "after")


@query(f"SELECT 't' || s_suppkey || '/' || file AS file, surface, line::BIGINT AS line FROM supplier, {_values('file, surface, line', [(file, surface, line) for file, _, want in cases.CALLS for surface, line in want])}")
def proven_calls(spark, sf_dir):
    """BR-1 to BR-17, MG-1 to MG-10 and their guards, by language: only calls whose roots are proven; a tree for each supplier."""
    from .plans import inventory

    listed = F.explode(F.array(*(F.struct(F.lit(c[0]).alias("path"), F.lit(c[1]).alias("text")) for c in cases.CALLS)))
    files = _spread(_t(spark, sf_dir, "supplier").select("s_suppkey"), 100).select("s_suppkey", listed.alias("f"))
    files = files.select(F.concat(F.lit("t"), "s_suppkey", F.lit("/"), "f.path").alias("path"), "f.text")
    return inventory.surfaces(files).where("kind = 'sdk-call'").select("file", "surface", "line")
