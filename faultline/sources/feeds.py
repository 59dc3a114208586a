"""Release feeds as change records. Feeds are landed as files first; a broken one has no entries and is listed by ``failures``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import relational


def _tag(block: Column, tag: str) -> Column:
    return F.trim(F.regexp_extract(block, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))


def entries(feeds: DataFrame, most: int | None = V.FEED_ENTRIES) -> DataFrame:
    """feeds (source, kind: atom or rss, xml): source, position, title, updated (day), url, content; the first ``most``."""
    blocks = F.when(F.col("kind") == "atom", F.split("xml", "<entry>")).otherwise(F.split("xml", "<item>"))
    rows = feeds.select("source", "kind", F.posexplode(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("position", "b"))
    b, atom = F.col("b"), F.col("kind") == "atom"
    body = F.when(atom, _tag(b, "content")).otherwise(F.coalesce(F.nullif(_tag(b, "description"), F.lit("")), _tag(b, "content:encoded")))
    day = F.date_format(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(T.decode_entities(_tag(b, "pubDate")), r"^[A-Za-z]{3},\s*", ""), r"\bGMT\b|\bUTC\b", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")), "yyyy-MM-dd")
    out = rows.select(
        "source", "position", T.decode_entities(_tag(b, "title")).alias("title"), F.when(atom, _tag(b, "updated")).otherwise(F.coalesce(day, F.lit(""))).alias("updated"),
        F.when(atom, F.regexp_extract(b, r'<link[^>]*href="([^"]+)"', 1)).otherwise(T.decode_entities(_tag(b, "link"))).alias("url"), T.plain_text(T.decode_entities(body)).alias("content"),
    )
    return out if most is None else out.where(F.col("position") < most)


def failures(feeds: DataFrame) -> DataFrame:
    """source and error of each feed that is empty, is no feed, is cut off, or has no entry; the others go on without it."""
    xml = F.trim(F.coalesce("xml", F.lit("")))
    root = F.when(F.col("kind") == "atom", "feed").otherwise(F.regexp_extract(xml, r"<(rss|rdf:RDF)\b", 1))
    entry = F.when(F.col("kind") == "atom", "<entry").otherwise("<item")
    error = F.when(xml == "", "empty").when((root == "") | ~xml.contains(F.concat(F.lit("<"), root)), "not a feed").when(~xml.contains(F.concat(F.lit("</"), root)), "cut off").when(~xml.contains(entry), "no entries")
    return feeds.select("source", error.alias("error")).where("error IS NOT NULL")


def changes(found: DataFrame, providers: DataFrame, now: str) -> DataFrame:
    """Entries as change rows: providers is (source, provider, source_repo). Entries without title or url are no rows."""
    rows = found.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")).join(providers, "source")
    kind = T.classify(F.concat_ws("\n", "title", "content"), "title")
    return rows.select("provider", "source_repo", "title", kind.alias("change_type"), F.lit("keyword-v3").alias("classifier"), F.nullif(F.substring("updated", 1, 10), F.lit("")).alias("effective_date"), F.col("url").alias("source_url"), F.col("content").alias("raw_excerpt"), F.lit(now).alias("fetched_at"), "position")


def arrival() -> list[Column]:
    """Order in which records of one run arrive."""
    return [F.col("source_repo"), F.col("position")]


def numbered(rows: DataFrame, after: int) -> DataFrame:
    """Ids behind ``after``, by provider and arrival."""
    return relational.numbered(rows, [F.col("provider"), *arrival()], after)
