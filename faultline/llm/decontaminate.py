"""Operator 8: benchmark decontamination by a prefix-filtered set join.

Benchmark items become windows of ``window`` consecutive words (an item with fewer words is one window). A window
that lies in a document has all of its shingles (``shingle`` consecutive words) there, so at containment 1 the
necessary prefix of its shingles, ordered by rarity in the corpus, is the rarest one alone. The corpus is read once: of
each text the shingles that some window may have are kept, with their places and the words around them. Their counts
order the shingles of every window, the rarest are joined with the corpus's by hash, windows that would leave the
document are dropped by length and position, and the rest are compared word by word.

Both sides of the join may be of any size. What is sent to the executors is a sieve of the benchmark's shingles, of at
most ``sieve_bits`` bits: a benchmark too large for it lets more shingles through, and changes no result.

Cases: null or empty texts and items have no words; items with equal ids or equal texts each count under their id, an
id once per document; null item ids are ignored; repeated documents are each judged; an empty benchmark leaves all
documents clean; an empty table gives no rows; further columns are ignored (``clean`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, tokens, words

_CHUNK = 4 << 20
_HITS = "doc_id long, row long, n_words long, k int, h long, p long, before int, around string"


def windows(benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, size, k, words, shingles) and the items that have them (wid, item_id)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                w = words.Words(data, np.array([0, len(data)]), words.ALNUM)
                n = len(w.start)
                size = min(window, n)
                k = min(shingle, size)
                if n:
                    h = words.shingles(w.hashes(), k).view(np.int64)
                    at = range(n - size + 1)
                    cols = [[item_id] * len(at), [size] * len(at), [k] * len(at), [w.text(a, a + size).decode() for a in at], [h[a : a + size - k + 1] for a in at]]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())))], ["item_id", "size", "k", "words", "shingles"])

    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    cuts = scratch.materialise(items.mapInArrow(cut, "item_id long, size int, k int, words string, shingles array<long>"), "windows")
    known = cuts.groupBy("size", "words").agg(F.first("k").alias("k"), F.first("shingles").alias("shingles"))
    known = scratch.materialise(known.withColumn("wid", F.monotonically_increasing_id()), "distinct-windows")
    return known, scratch.materialise(cuts.join(known.select("wid", "size", "words"), ["size", "words"]).select("wid", "item_id").distinct(), "owners")


def _sieve(shingles: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """Bits that stand for all shingles (column h), two for each, and the mask of a bit's number."""
    n = shingles.count()
    bits = min(most, 1 << max(10, (64 * n).bit_length()))
    places = shingles.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("b")).select(F.col("b").bitwiseAND(F.lit(bits - 1)).alias("b")).distinct()
    filled = places.groupBy(F.shiftright("b", 5).alias("at")).agg(F.sum(F.pow(F.lit(2.0), F.col("b").bitwiseAND(F.lit(31)))).cast("long").alias("value")).toArrow()
    out = np.zeros(bits >> 5, np.uint32)
    out[filled.column("at").to_numpy()] = filled.column("value").to_numpy()
    return out, bits - 1


def _passes(h: np.ndarray, sieve: np.ndarray, mask: int) -> np.ndarray:
    at = np.arange(len(h))
    for part in (h, h >> np.uint64(32)):
        b = (part[at] & np.uint64(mask)).astype(np.int64)
        at = at[(sieve[b >> 5] >> (b & 31).astype(np.uint32)) & 1 == 1]
    return at


def _hits(docs: DataFrame, sieve, sizes: list[int], window: int) -> DataFrame:
    """A row for each document (k is null), and one for each shingle that may be a window's, with the words around it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = sieve.value
        tokens.forget()
        for batch in batches:
            data, off = words.buffers(batch.column("text"))
            for lo, hi in words.spans(off, _CHUNK):
                w = words.Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words.ALNUM)
                h = w.hashes() if sizes else None
                doc, place, size, value, before, around = [np.arange(hi - lo)], [], [], [], [], []
                for k in sizes:
                    s = words.shingles(h, k)
                    at = _passes(s, bits, mask)
                    d = np.searchsorted(w.first, at, "right") - 1
                    ok = at + k <= w.first[d + 1]
                    at, d = at[ok], d[ok]
                    reach = window - k if k == max(sizes) else 0  # only windows of that shingle size are longer than it
                    a, b = np.maximum(at - reach, w.first[d]), np.minimum(at + k + reach, w.first[d + 1])
                    doc.append(d)
                    place.append(at - w.first[d])
                    size.append(np.full(len(at), k))
                    value.append(s[at].view(np.int64))
                    before.append(at - a)
                    around += [w.text(x, y) for x, y in zip(a.tolist(), b.tolist())]
                doc = np.concatenate(doc)
                own = pa.array(doc)
                rest = [pa.concat_arrays([pa.nulls(hi - lo, t), pa.array(np.concatenate([np.zeros(0, np.int64), *x])).cast(t)]) for x, t in ((size, pa.int32()), (value, pa.int64()), (place, pa.int64()), (before, pa.int32()))]
                texts = pa.concat_arrays([pa.nulls(hi - lo, pa.string()), pa.array(around, pa.binary()).cast(pa.string())])
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo).take(own), batch.column("row").slice(lo, hi - lo).take(own), pa.array(w.count[doc].astype(np.int64)), *rest, texts], ["doc_id", "row", "n_words", "k", "h", "p", "before", "around"])

    return docs.select("doc_id", "row", "text").mapInArrow(find, _HITS)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, sieve_bits: int = 1 << 28) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, row, n_words), occurrences of windows in them (doc_id, row, wid, start, length), and owners (wid,
    item_id). ``row`` is a hash of id and text: rows equal in both have the same occurrences."""
    spark = docs.sparkSession
    known, owners = windows(benchmark, window, shingle)
    shingles = scratch.materialise(known.select("wid", "k", F.posexplode("shingles").alias("offset", "h")), "shingles")
    sizes = sorted(r["k"] for r in known.select("k").distinct().collect())  # ``shingle`` values at most
    sieve = spark.sparkContext.broadcast(_sieve(shingles.select("h").distinct(), sieve_bits))
    docs = scratch.documents(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    table = scratch.materialise(_hits(docs, sieve, sizes, window), "hits")
    hits = table.where("k IS NOT NULL")
    often = scratch.materialise(hits.groupBy("k", "h").agg(F.count("*").alias("n")), "frequencies")
    ranked = shingles.join(often, ["k", "h"], "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "k", "h")).alias("rarest"))
    prefix = ranked.select("wid", "rarest.*").where("n > 0").join(known.select("wid", "size", "words"), "wid")
    prefix = scratch.materialise(prefix.select("wid", "k", "h", "offset", "size", "words"), "prefixes")
    near = hits.join(prefix, ["k", "h"]).where("p >= offset AND p - offset + size <= n_words")
    same = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("size")), " ") == F.col("words")
    found = near.where(same).select("doc_id", "row", "wid", (F.col("p") - F.col("offset")).alias("start"), F.col("size").cast("long").alias("length"))
    return table.where("k IS NULL").select("doc_id", "row", "n_words"), scratch.materialise(found, "occurrences"), owners


def judge(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (start, length), items (item ids as sorted strings)."""
    rows, found, owners = occurrences(docs, benchmark, **options)
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate(
        "spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["length"]).alias("end"), (a["n"] + F.greatest(s["start"] + s["length"] - F.greatest(a["end"], s["start"]), F.lit(0).cast("long"))).alias("n"))
    )["n"]
    spans = found.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    items = found.select("doc_id", "row", "wid").distinct().join(owners, "wid").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    keys = lambda side: rows["doc_id"].eqNullSafe(side["doc_id"]) & (rows["row"] == side["row"])
    spans, items = scratch.materialise(spans, "spans"), scratch.materialise(items, "items")
    told = rows.join(spans, keys(spans), "left").join(items, keys(items), "left").select(rows["doc_id"], rows["n_words"], "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    told = told.withColumns({"n_hit": F.coalesce(hit, F.lit(0).cast("long")), "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
    return told.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans", "items")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs."""
    _, found, _ = occurrences(docs, benchmark, **options)
    dirty = scratch.materialise(found.select(F.col("doc_id").alias("of"), F.col("row").alias("k")).distinct(), "contaminated")
    rows = scratch.beside(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    return rows.join(dirty, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("of")), "left_anti").select("row.*")
