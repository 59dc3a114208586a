"""Operator 10: substring dedup by sliding sentence spans.

A sentence ends after a word that ends in ``.``, ``!`` or ``?``, or where a line ends. From every sentence the shortest
run of at least ``min_sentences`` sentences and ``min_words`` words is hashed (words split at white space, ASCII lower
case). With ``every``, as the queries have it, fewer sentences of ``long_words`` words are a run too, and the shortest
run that ends with each sentence is hashed as well: those of both kinds that repeat cover what all repeated runs cover,
where without it the last short sentences of a passage stay. Hashes are joined over all documents; the first occurrence, by document id and then position, stays, and every
sentence covered by another occurrence goes. What separates the remaining sentences is left as it was.

``min_words`` is where a repeat begins to count: it keeps short sentences that come up in any text ("Yes. Thank you.").

Runs are partially aggregated before they move, so a passage in a third of the documents is one row from each task; the
join back to its occurrences may be split. Nothing is gathered but the ranges of one document. Runs are told apart by
two independent 64-bit hashes.

Cases: null and empty texts have no sentences and stay; a text shorter than a run stays; a repeat inside one row goes;
rows equal in id and text count as one document, all others as documents of their own; of rows with one ``doc_id`` any
may be the first; a null ``doc_id`` comes after all others, in the order of a hash of the text; an empty table gives no
rows; ``clean`` keeps all columns, sets ``n_chars`` where there is one, and drops documents of which no sentence is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, tokens, words

_CHUNK = 4 << 20
_BASES = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)
_LAST = 1 << 62  # where null ids are put


class Sentences:
    """Sentences of a run of texts: first word of each, and the first sentence of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = words.Words(data, offsets, words.NON_SPACE)
        n = len(w.start)
        closes = np.isin(w.low[w.end - 1], np.frombuffer(b".!?", np.uint8))
        lines = np.searchsorted(np.flatnonzero(data == 10), w.start)
        first = np.zeros(n, bool)
        if n:
            first[1:] = closes[:-1] | (lines[1:] > lines[:-1])
            first[w.first[:-1][w.count > 0]] = True
        self.at = np.flatnonzero(first)
        self.first = np.searchsorted(self.at, w.first)

    def runs(self, min_sentences: int, min_words: int, every: bool, long_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last-plus-one word of each run that lies in one text, and two hashes of it."""
        at, n = self.at, len(self.words.start)
        ends, k = np.append(at, n), np.arange(len(at))  # where a sentence can end
        stop = np.maximum(np.searchsorted(ends, at + min_words), k + min_sentences)
        if every:
            stop = np.minimum(stop, np.searchsorted(ends, at + long_words))
        ok = stop <= np.repeat(self.first[1:], np.diff(self.first))
        a, b = at[ok], ends[stop[ok]]
        if every:
            start = np.minimum(np.searchsorted(at, ends[1:] - min_words, "right"), k + 2 - min_sentences) - 1
            start = np.maximum(start, np.searchsorted(at, ends[1:] - long_words, "right") - 1)
            back = start >= np.repeat(self.first[:-1], np.diff(self.first))
            back[back] &= stop[start[back]] != k[back] + 1  # the others begin there as well
            a, b = np.concatenate((a, at[start[back]])), np.concatenate((b, ends[k[back] + 1]))
        h, out = self.words.hashes(), []
        for k, base in enumerate(_BASES):
            p = np.full(n + 1, base, np.uint64)
            q = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
            p[:1] = q[:1] = 1
            p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((h if k == 0 else words.mix(h + np.uint64(k))) * p[:n])))
            out.append(words.mix((total[b] - total[a]) * q[a] + (b - a).astype(np.uint64)))
        return a, b, *out


def runs(docs: DataFrame, min_sentences: int, min_words: int, every: bool, long_words: int) -> DataFrame:
    """h, g (hashes), doc_id, row (hash of id and text), start, stop (words), later (whether the row had the run before); one row per run."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            data, off = words.buffers(batch.column("text"))
            for lo, hi in words.spans(off, _CHUNK):
                s = Sentences(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                a, b, h, g = s.runs(min_sentences, min_words, every, long_words)
                doc = np.searchsorted(s.words.first, a, "right") - 1
                order = np.lexsort((a, g, h, doc))
                again = np.zeros(len(a), bool)
                again[order[1:]] = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (h, g, doc)])
                base = s.words.first[doc]
                yield pa.record_batch(
                    [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), batch.column("doc_id").slice(lo, hi - lo).take(pa.array(doc)), batch.column("row").slice(lo, hi - lo).take(pa.array(doc)), pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32)), pa.array(again)], ["h", "g", "doc_id", "row", "start", "stop", "later"]
                )

    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    return docs.mapInArrow(hashed, "h long, g long, doc_id long, row long, start int, stop int, later boolean")


def repeated(docs: DataFrame, min_sentences: int = 2, min_words: int = 16, every: bool = False, long_words: int = 50) -> DataFrame:
    """Per row with something to remove: doc_id, row and ``cuts``, sorted array of (start, stop, first_doc_id), in words."""
    table = scratch.materialise(runs(scratch.documents(docs), min_sentences, min_words, every, long_words), "runs")
    place = F.coalesce(F.col("doc_id"), F.col("row").bitwiseAND(F.lit(_LAST - 1)) + F.lit(_LAST))
    once = table.where("NOT later").withColumn("place", place)
    known = once.groupBy("h", "g").agg(F.count("*").alias("n"), F.min_by("doc_id", "place").alias("first_doc_id"), F.min_by("row", "place").alias("first_row")).where("n > 1")
    # A table of its own: a join of two exchanges can be split where a run is in very many documents.
    known = scratch.materialise(known.select("h", "g", "first_doc_id", "first_row"), "repeats")
    found = once.join(known, ["h", "g"]).where("row <> first_row")
    again = table.where("later").withColumn("first_doc_id", F.col("doc_id"))
    found = found.select("doc_id", "row", "start", "stop", "first_doc_id").unionByName(again.select("doc_id", "row", "start", "stop", "first_doc_id"))
    return found.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "first_doc_id"))).alias("cuts"))


def _merged(cuts: list[dict]) -> list[list]:
    out: list[list] = []
    for c in cuts:
        if out and c["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], c["stop"])
        else:
            out.append([c["start"], c["stop"], c["first_doc_id"]])
    return out


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per removed stretch: doc_id, first_doc_id (which keeps it, or its beginning), start, n_words."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, f, a, b - a) for d, cuts in zip(batch.column("doc_id").to_pylist(), batch.column("cuts").to_pylist()) for a, b, f in _merged(cuts)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "first_doc_id", "start", "n_words"])

    return repeated(docs, **options).mapInArrow(stretches, "doc_id long, first_doc_id long, start long, n_words long")


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the sentences of non-first repeated runs."""
    cuts = repeated(docs, **options).select(F.col("doc_id").alias("of"), F.col("row").alias("k"), F.transform("cuts", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"))).alias("cuts"))
    rows = scratch.beside(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = rows.join(cuts, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").select("row", "cuts")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for whole in batches:
            _, off = words.buffers(whole.column("row").field("text"))
            for lo, hi in words.spans(off, _CHUNK):  # so that what is held besides a batch is bounded
                batch = whole.slice(lo, hi - lo)
                old = batch.column("row").field("text")
                text = old.to_pylist()
                gone = np.zeros(len(text), bool)
                for i, cuts in enumerate(batch.column("cuts").to_pylist()):
                    if not cuts:
                        continue
                    data = np.frombuffer(text[i].encode(), np.uint8)
                    w = words.Words(data, np.array([0, len(data)]), words.NON_SPACE)
                    begin = np.append(w.start, len(data))
                    kept, at, left = [], 0, len(w.start)
                    for a, b, _ in _merged([c | {"first_doc_id": None} for c in cuts]):
                        kept.append(data[at : begin[a]])
                        at, left = int(begin[b]), left - (b - a)
                    kept.append(data[at:])
                    text[i] = b"".join(k.tobytes() for k in kept).decode()
                    gone[i] = not left
                out = pa.record_batch([batch.column("row"), pa.array(text, old.type)], ["row", "text"])
                yield out.filter(pa.array(~gone)) if gone.any() else out

    schema = rows.select("row", F.col("row.text").alias("text")).schema
    own = lambda c: F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("row").getField(c)
    return rows.mapInArrow(rewrite, schema).select(*(own(c).alias(c) for c in docs.columns))
