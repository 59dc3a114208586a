"""Streamed ingest: restarts, repeats, late entries, an older table, broken feeds, and a batch that fails half way."""

import pytest

from faultline.sources import feeds
from faultline.streaming import ingest


def feed(*entries):
    one = '<entry><title>{}</title><updated>2024-01-01</updated><link href="{}"/><content>x</content></entry>'
    return "<feed>" + "".join(one.format(*e) for e in entries) + "</feed>"


@pytest.fixture
def run(spark, tmp_path):
    (tmp_path / "in").mkdir()
    providers = spark.createDataFrame([(s, "acme", "r" + s) for s in "abcz"], "source string, provider string, source_repo string")

    def go(stored=None, **files):
        for name, text in files.items():
            (tmp_path / "in" / f"{name}.xml").write_text(text)
        q = ingest.start(ingest.landed(spark, f"file://{tmp_path}/in", "atom"), providers, f"file://{tmp_path}/t", f"file://{tmp_path}/c", "now", stored)
        q.awaitTermination()
        return sorted((r.source_url, r.title, r.source_repo) for r in spark.read.parquet(f"file://{tmp_path}/t").collect())

    return go


def test_restarts_with_repeats_and_late_entries(run):
    assert run(b=feed(("B one", "u1"), ("B two", "u2")), a=feed(("A one", "u1"), ("A again", "u1"))) == [("u1", "A one", "ra"), ("u2", "B two", "rb")]
    # a new run of the query: what was seen is still known, and entries that come late are added
    assert run(c=feed(("C one", "u1"), ("C old", "u0"), ("", "u9"), ("C three", "u3"))) == [("u0", "C old", "rc"), ("u1", "A one", "ra"), ("u2", "B two", "rb"), ("u3", "C three", "rc")]
    assert len(run()) == 4  # nothing landed, nothing added


def test_an_older_table_is_known(spark, run):
    stored = spark.createDataFrame([("u1", "x"), ("u1", "y")], "source_url string, title string")
    assert run(stored, a=feed(("A", "u1"), ("B", "u2"))) == [("u2", "B", "ra")]
    assert run(stored, b=feed(("C", "u1"), ("D", "u2"), ("E", "u3"))) == [("u2", "B", "ra"), ("u3", "E", "rb")]


def test_broken_feeds_are_listed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a", feed(("A", "u1"))), ("b", "  "), ("c", "<html>"), ("d", "<feed><entry>"), ("e", "<feed></feed>")):
        (tmp_path / "in" / f"{name}.xml").write_text(text)
    for _ in range(2):
        ingest.broken(ingest.landed(spark, f"file://{tmp_path}/in", "atom"), f"file://{tmp_path}/t", f"file://{tmp_path}/c").awaitTermination()
    rows = spark.read.parquet(f"file://{tmp_path}/t").collect()
    assert sorted((r.source, r.error) for r in rows) == [("b", "empty"), ("c", "not a feed"), ("d", "cut off"), ("e", "no entries")]


def test_a_batch_that_failed_is_run_again(spark, tmp_path):
    """A batch dies in its tasks; the next start of the same query adds its rows, once."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(feed(("A", "u1"), ("B", "u2")))
    providers = spark.createDataFrame([("a", "acme", "ra")], "source string, provider string, source_repo string")
    mark = str(tmp_path / "mend")

    def query():
        from pyspark.sql import functions as F

        @F.udf("string")
        def fragile(title):
            import os

            if title == "B" and not os.path.exists(mark):
                raise RuntimeError("lost")
            return title

        found = feeds.changes(feeds.entries(ingest.landed(spark, f"file://{tmp_path}/in", "atom")), providers, "now")
        rows = ingest.fresh(found).withColumn("title", fragile("title"))
        return rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/t").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost"):
        query().awaitTermination()
    open(mark, "w").close()
    query().awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == ["A", "B"]
