"""Operator 4: near-duplicate classes by consistent weighted sampling.

Texts become weighted sets of word shingles: weight (1 + ln tf) times 1 + ``spread`` * idf, where idf falls from 1 to 0 as
the logarithm of the share of documents that have the shingle rises, and is 1 for all shingles below a floor. Document
frequencies are exact at and above the floor: counts in a table of slots are upper bounds, so only shingles in slots at
or above it are counted one by one. The floor is ``_SHARE`` of the documents, or more where more than ``_MOST`` shingles could lie
above it; so the table that is sent to executors is bounded, and weights behave alike at every size. Improved consistent weighted sampling
draws ``bands * rows`` samples from each set; two sets draw the same one with the probability of their weighted Jaccard
similarity. Texts that agree on all samples of a band meet in a bucket, and pairs from buckets are verified on their
whole shingle sets; those of ``threshold`` similarity or more are links, and classes are the links' components.

Equal texts are one node from the start, by partial aggregation. Then buckets are settled in two steps. First each text
is compared with one hub, the most central text of its largest bucket, which joins most groups of copies at one
pair for each text. Then, in every bucket that still holds several components, all pairs of different components are
decided: in buckets of up to ``few`` texts as rows. In larger ones each text's distance to the bucket's hub bounds, by the
triangle inequality, how far linked texts can be apart, so strangers leave first; what is left is compared inside tasks, blocks
of ``block`` texts outside the largest component against all others, through an inverted index, which returns no more links
than there are texts. So no link between texts that meet is lost, and no table ever holds the pairs of a large group.

Cases: texts with fewer words than a shingle are one shingle of all their words; texts without words, null among them,
are alike only if equal (null equals empty); classes are classes of texts, so rows that share a ``doc_id``, or have none,
share a class only through their texts; a class has the least id of its rows, where null ranks first, so classes may have
the same id; of exact repeats ``first`` keeps one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, scratch, tokens, words

_CHUNK, _ROWS = 1 << 19, 4096
_DOC, _HASH = np.uint64(52), np.uint64((1 << 52) - 1)
_SLOTS, _PIECES = 1 << 20, 64
_SHARE, _MOST = 1 / 4096, 1 << 17  # floor of document frequencies as a share; shingles above the floor at most
_POOL = 1 << 16
_NONE = -(1 << 63)


def shingle_keys(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of up to 4096 texts as sorted keys (text number in twelve bits, hash in 52), and their counts."""
    w = words.Words(data, offsets, words.ALNUM)
    h = w.hashes()
    s = words.shingles(h, n) >> np.uint64(12)
    many = np.maximum(w.count - n + 1, 0)
    doc = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(doc)) + np.repeat(w.first[:-1] - (np.cumsum(many) - many), many)
    keys = [doc.astype(np.uint64) << _DOC | s[at]]
    brief = np.flatnonzero((w.count > 0) & (w.count < n))
    for size in range(1, n):
        d = brief[w.count[brief] == size]
        if len(d):
            keys.append(d.astype(np.uint64) << _DOC | words.shingles(h, size)[w.first[d]] >> np.uint64(12))
    keys = np.sort(np.concatenate(keys))
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(_SLOTS - 1)).astype(np.int64)


class Idf:
    """1 + ``spread`` * idf of shingles by hash, from their document frequencies at or above a floor."""

    def __init__(self, hashes: np.ndarray, frequency: np.ndarray, n_docs: int, floor: int, spread: float):
        order = np.argsort(hashes)
        self.hashes, self.rest = hashes[order], np.float32(1 + spread)
        least = math.log((n_docs + 1) / (floor + 1)) if n_docs > floor else 1.0
        self.value = (1 + spread * np.clip(np.log((n_docs + 1) / (frequency[order] + 1)) / least, 0, 1)).astype(np.float32)
        self.small = words.sieve(self.hashes)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        h = keys & _HASH
        out = np.full(len(h), self.rest)
        at = words.member(h, self.hashes, self.small)
        out[at] = self.value[np.searchsorted(self.hashes, h[at])]
        return out


#: Every shingle weighs the same.
FLAT = Idf(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 1, 0.0)


def weights(keys: np.ndarray, counts: np.ndarray, idf: Idf) -> np.ndarray:
    return (1 + np.log(counts)) * idf(keys)


def _slot_counts(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Documents by slot, summed over the shingles in it, and how many documents there are; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens.forget()
        total, rows = np.zeros(_SLOTS, np.int64), 0
        for batch in batches:
            data, off = words.buffers(batch.column("text"))
            rows += len(batch)
            for lo, hi in words.spans(off, _CHUNK, _ROWS):
                keys, _ = shingle_keys(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                total += np.bincount(_slot(keys), minlength=_SLOTS)
        if rows:
            parts = [p.tobytes() for p in np.split(total, _PIECES)]
            k = np.arange(_PIECES, dtype=np.int32)
            yield pa.record_batch([pa.array(k), pa.array(np.full(_PIECES, TaskContext.get().partitionId(), np.int32)), pa.array(np.where(k == 0, rows, 0)), pa.array(parts, pa.binary())], ["piece", "part", "n", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in table.column("counts"))
        return pa.table({"piece": table.column("piece")[:1], "part": pa.array([0], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())]), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "piece int, part int, n long, counts binary"
    rows = docs.select("text").mapInArrow(count, schema)
    salts = max(1, int(docs.select("text").rdd.getNumPartitions() ** 0.5))
    rows = rows.withColumn("part", F.pmod("part", F.lit(salts))).groupBy("piece", "part").applyInArrow(add, schema)
    rows = rows.groupBy("piece").applyInArrow(add, schema).toArrow().sort_by("piece")
    if not rows.num_rows:
        return np.zeros(_SLOTS, np.int64), 0
    return np.concatenate([np.frombuffer(c.as_py(), np.int64) for c in rows.column("counts")]), sum(rows.column("n").to_pylist())


def idf_table(docs: DataFrame, n: int, spread: float) -> Idf:
    """Weights by exact document frequency of the shingles that at least the floor's share of documents has."""
    if not spread:
        return FLAT
    slots, n_docs = _slot_counts(docs, n)
    floor = max(1, math.ceil(n_docs * _SHARE), math.ceil(int(slots.sum()) / _MOST))
    high = docs.sparkSession.sparkContext.broadcast(slots >= floor)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            h, which = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(which, np.concatenate([c for _, c in held]), len(h)).astype(np.int64)

        for batch in batches:
            data, off = words.buffers(batch.column("text"))
            for lo, hi in words.spans(off, _CHUNK, _ROWS):
                keys, _ = shingle_keys(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                held.append(np.unique(keys[high.value[_slot(keys)]] & _HASH, return_counts=True))
                if sum(len(h) for h, _ in held) > 1 << 20:
                    held[:] = [added()]
                    if len(held[0][0]) > 1 << 19:  # mostly distinct: the shuffle adds them up
                        yield pa.record_batch([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["h", "n"])
                        held.clear()
        if held:
            h, c = added()
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(c)], ["h", "n"])

    got = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).toArrow()
    return Idf(got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy(), n_docs, floor, spread)


class Sampler:
    """Improved consistent weighted sampling. A shingle's random numbers come from a pool, by a hash for each sample."""

    def __init__(self, samples: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1 << 63, size=samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        r, c = rng.gamma(2, 1, _POOL), rng.gamma(2, 1, _POOL)
        self.beta = rng.random(_POOL).astype(np.float32)
        self.r, self.inverse = r.astype(np.float32), (1 / r).astype(np.float32)
        self.rest = (np.log(c) + r * self.beta - r).astype(np.float32)

    def draw(self, keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts that have shingles (numbers, ascending), and a 64-bit sample for each of them and each draw."""
        doc = (keys >> _DOC).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
        out = np.empty((len(first), len(self.odd)), np.uint64)
        h, log = keys & _HASH, np.log(weight).astype(np.float32)
        place = np.arange(len(keys), dtype=np.int64)
        for k, odd in enumerate(self.odd if len(keys) else ()):
            i = (h * odd) >> np.uint64(48)
            t = np.floor(log * self.inverse[i] + self.beta[i])
            a = (self.rest[i] - self.r[i] * t).view(np.int32)
            a ^= (a >> 31) & np.int32(0x7FFFFFFF)  # ordered as the floats are
            best = np.minimum.reduceat((a.astype(np.int64) << 32) | place, first) & 0xFFFFFFFF
            out[:, k] = words.mix((h[best] * odd) ^ (t[best].astype(np.int64).view(np.uint64) + np.uint64(k << 32)))
        return doc[first], out


def signatures(docs: DataFrame, idf, sampler, bands: int, n: int) -> DataFrame:
    """doc_id, node (of the text), buckets (one 64-bit hash per band)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, draws = idf.value, sampler.value
        tokens.forget()
        for batch in batches:
            data, off = words.buffers(batch.column("text"))
            for lo, hi in words.spans(off, _CHUNK, _ROWS):
                part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                keys, counts = shingle_keys(part, at, n)
                doc, s = draws.draw(keys, weights(keys, counts, table))
                per = s.shape[1] // bands
                b = np.zeros((len(doc), bands), np.uint64)
                for j in range(per):
                    b = words.mix(b * np.uint64(31) + s[:, j::per] + np.arange(bands, dtype=np.uint64))
                buckets = [None] * (hi - lo)
                for i, d in enumerate(doc.tolist()):
                    buckets[d] = b[i].view(np.int64)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), batch.column("node").slice(lo, hi - lo), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "node", "buckets"])

    return docs.mapInArrow(sign, "doc_id long, node long, buckets array<long>")


def similar(pairs: DataFrame, texts: DataFrame, idf, threshold: float, n: int) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have ``threshold`` weighted Jaccard similarity or more, with it."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            left, right = words.buffers(batch.column("ta")), words.buffers(batch.column("tb"))
            for lo, hi in words.spans(left[1] + right[1], 4 * _CHUNK, _ROWS):
                sides = []
                for data, off in (left, right):
                    keys, counts = shingle_keys(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                    sides.append((keys, weights(keys, counts, table)))
                (ka, wa), (kb, wb) = sides
                both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                row = lambda k: (k >> _DOC).astype(np.int64)
                low = np.bincount(row(both), np.minimum(wa[ia], wb[ib]), hi - lo)
                total = np.bincount(row(ka), wa, hi - lo) + np.bincount(row(kb), wb, hi - lo)
                j = low / np.maximum(total - low, 1e-12)
                ok = pa.array(j >= threshold - 1e-9)
                yield pa.record_batch([batch.column("a").slice(lo, hi - lo).filter(ok), batch.column("b").slice(lo, hi - lo).filter(ok), pa.array(j).filter(ok)], ["a", "b", "similarity"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long, similarity double")


def _apart(rows: DataFrame, hubs: DataFrame, texts: DataFrame, idf, threshold: float, n: int) -> DataFrame:
    """Rows (bucket, node, label, rank) in cells of their distance to the bucket's hub, a cell as wide as the distance of a link.
    One minus weighted Jaccard similarity is a metric, so texts that are linked lie in one cell or in neighbours: each text is
    compared with the hub once, and is then in groups (bucket, c) of cells c and c + 1. A stranger to the hub leaves the group of
    its copies."""
    with_hub = rows.join(hubs, "bucket").withColumns({"a": F.least("node", "hub"), "b": F.greatest("node", "hub")})
    pairs = scratch.materialise(with_hub.where("node <> hub").select("a", "b").distinct(), "hub-pairs")
    near = scratch.materialise(similar(pairs, texts, idf, -1.0, n), "hub-similarity")
    width = 1 - threshold + 1e-6
    d = with_hub.join(near, ["a", "b"], "left").withColumn("cell", F.floor((1 - F.coalesce("similarity", F.lit(1.0))) / width).cast("int"))
    return d.select("bucket", "node", "label", "rank", "cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"))).alias("c")).where("c >= 0")


def _parted(rows: DataFrame, block: int) -> DataFrame:
    """Of groups (bucket, c) with several components, a row for each text and pair (i, j) of blocks in which it is needed. Texts
    of the largest component are not compared with each other: only blocks of others meet it. A text of the largest is sent
    once for each ``block`` of others, so what is sent grows with the group as long as others are few."""
    by_label = rows.groupBy("bucket", "c", "label").agg(F.count("*").alias("n"))
    groups = by_label.groupBy("bucket", "c").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("m"), F.count("*").alias("k")).where("k > 1")
    rows = rows.join(scratch.materialise(groups, "groups"), ["bucket", "c"])
    others, main = (F.greatest(F.ceil(x / block), F.lit(1)).cast("int") for x in (F.col("m") - F.col("n_main"), F.col("n_main")))
    rows = rows.withColumns({"others": others, "blocks": others + main, "is_main": F.col("label") == F.col("main")})
    rows = rows.withColumn("part", F.when(F.col("is_main"), F.col("others") + F.pmod(F.shiftright("rank", 8), F.col("blocks") - F.col("others"))).otherwise(F.pmod(F.shiftright("rank", 8), F.col("others"))).cast("int"))
    against = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("others")).otherwise(F.col("blocks")) - 1)
    pair = F.transform(against, lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    return rows.select("bucket", "c", "cell", "node", "label", "part", F.explode(pair).alias("p")).select("bucket", "c", "cell", "node", "label", "part", "p.i", "p.j")


def _settled(rows: DataFrame, texts: DataFrame, idf, threshold: float, n: int) -> DataFrame:
    """Links (a, b) that join the different components of each group: rows are those of ``_parted``."""

    def settle(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "part"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        upper = table.column("cell").to_numpy() > table.column("c")[0].as_py()
        data, off = words.buffers(table.column("text"))
        hs, ws, total = [], [], np.zeros(len(node))
        for lo, hi in words.spans(off, 4 * _CHUNK, _ROWS):
            keys, counts = shingle_keys(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
            w = weights(keys, counts, idf.value)
            row = (keys >> _DOC).astype(np.int64)
            total[lo:hi] = np.bincount(row, w, hi - lo)
            cut = np.searchsorted(row, np.arange(hi - lo + 1))
            hs += [keys[a:b] & _HASH for a, b in zip(cut[:-1], cut[1:])]
            ws += [w[a:b] for a, b in zip(cut[:-1], cut[1:])]
        # Inverted index over the shingles: sorted hashes with owner and weight.
        flat, owner, weight = np.concatenate(hs), np.repeat(np.arange(len(hs)), [len(h) for h in hs]), np.concatenate(ws)
        order = np.argsort(flat, kind="stable")
        flat, owner, weight = flat[order], owner[order], weight[order]
        group: dict[int, list[int]] = {}
        for x, at in enumerate(label.tolist()):
            group.setdefault(at, []).append(x)
        kind = np.unique(label, return_inverse=True)[1]
        main = max(group, key=lambda g: len(group[g]))
        links = []
        for x in np.flatnonzero(label != main).tolist():  # a pair of two components has a text outside the main one
            lo, hi = np.searchsorted(flat, hs[x], "left"), np.searchsorted(flat, hs[x], "right")
            many = hi - lo
            at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            low = np.bincount(owner[at], np.minimum(weight[at], np.repeat(ws[x], many)), len(node))
            similar_ = low >= (threshold - 1e-9) * np.maximum(total + total[x] - low, 1e-12)
            similar_ &= kind != kind[x]
            if upper[x]:
                similar_ &= ~upper  # these meet in the next cell, too
            if i != j:
                similar_ &= side != side[x]
            for y in np.flatnonzero(similar_).tolist():
                if kind[y] != kind[x]:
                    links.append((int(node[x]), int(node[y])))
                    kind[kind == kind[y]] = kind[x]  # one link joins two components
        return pa.table({"a": pa.array([min(p) for p in links], pa.int64()), "b": pa.array([max(p) for p in links], pa.int64())})

    rows = rows.join(texts, "node").select("bucket", "c", "cell", "i", "j", "node", "label", "part", "text")
    return rows.groupBy("bucket", "c", "i", "j").applyInArrow(settle, "a long, b long")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id`` (the id, _NONE for null) and ``_text`` (hash of the text, null as empty)."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)), "_text": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


def _clear(c: str):
    return F.when(F.col(c) != _NONE, F.col(c)).alias(c)


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id and class_id (the least id of its class) of every row."""
    with scratch.dropping():
        member, told, _ = _classes(docs, **options)
        least = scratch.materialise(told.groupBy("label").agg(F.min("doc_id").alias("class_id")), "least")
        named = scratch.materialise(told.join(least, "label").select("node", "class_id"), "named", keep=True)
    return member.join(named, "node").select(_clear("doc_id"), _clear("class_id"))


def _classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, bands: int = 16, rows: int = 4, spread: float = 1.0, few: int = 6, block: int = 512) -> tuple[DataFrame, DataFrame, bool]:
    """doc_id and node (text) of every row; node, its least doc_id and label (of its class) of every text; whether ids repeat.
    All scratch tables but the first result's are of the block around the call."""
    spark = docs.sparkSession
    docs = scratch.documents(docs)
    idf = spark.sparkContext.broadcast(idf_table(docs, n, spread))
    sampler = spark.sparkContext.broadcast(Sampler(bands * rows))
    docs = _keyed(docs).select(F.col("_id").alias("doc_id"), F.col("_text").alias("node"), "text")
    signed = scratch.materialise(signatures(docs, idf, sampler, bands, n), "signatures", keep=True)
    repeats = _repeats(signed, "doc_id")

    # Aggregates become tables before they are joined to what they were made of: such joins can be split at hot keys.
    same = scratch.materialise(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "same")
    nodes = signed.join(same, ["node", "doc_id"], "left_semi").where("buckets IS NOT NULL").select("node", "buckets")
    if repeats:
        nodes = nodes.distinct()
    held = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = scratch.materialise(held.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    bucket = scratch.materialise(held.join(sizes, "bucket").withColumn("rank", F.xxhash64("node")), "buckets")
    # A central text shares large buckets with many: the most central of a bucket is its hub.
    central = scratch.materialise(bucket.groupBy("node").agg(F.sum("m").alias("central")), "central")
    texts = docs.join(same.join(central.select("node"), "node", "left_semi"), ["node", "doc_id"], "left_semi").select("node", "text")
    texts = scratch.materialise(texts.dropDuplicates(["node"]) if repeats else texts, "texts")

    hubs = scratch.materialise(bucket.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("central", "rank")).alias("hub")), "hubs")
    first = bucket.join(hubs, "bucket").where("node <> hub").groupBy("node").agg(F.max_by("hub", F.struct("m", "hub")).alias("hub"))
    pairs = first.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = similar(scratch.materialise(pairs, "pairs"), texts, idf, threshold, n).select("a", "b")
    label = graph.components(links)

    now = scratch.materialise(bucket.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    mixed = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    now = scratch.materialise(now.join(scratch.materialise(mixed, "mixed"), "bucket"), "open")
    apart = scratch.materialise(_apart(now.where(F.col("m") > few), hubs, texts, idf, threshold, n), "apart")
    small = now.where(F.col("m") <= few)
    other = small.select("bucket", F.col("node").alias("hub"), F.col("label").alias("of"))
    pairs = small.join(other, "bucket").where("node < hub AND label <> of").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = similar(scratch.materialise(pairs, "pairs"), texts, idf, threshold, n).select("a", "b")
    links = scratch.materialise(links.unionByName(_settled(_parted(apart, block), texts, idf, threshold, n)), "links")
    if not links.isEmpty():
        label = graph.components(links.unionByName(label.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    told = same.join(label, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    return signed.select("doc_id", "node"), scratch.materialise(told, "told"), repeats


def _repeats(rows: DataFrame, key: str) -> bool:
    return bool(rows.groupBy(key).count().where("count > 1").limit(1).count())


def first(docs: DataFrame, one_per_id: bool = True, **options) -> DataFrame:
    """One row of ``docs`` for each class: that of the least id; with ``one_per_id`` only one of the rows that share an id or have none."""
    with scratch.dropping():
        _, told, repeats = _classes(docs, **options)
        heads = told.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("h")).select(F.col("h.doc_id").alias("_id"), F.col("h.node").alias("_text"))
        heads = scratch.materialise(heads, "heads", keep=True)
    kept = _keyed(scratch.beside(docs)).select("row", "_id", "_text").join(heads, ["_id", "_text"], "left_semi")
    if repeats:
        key = ["_id"] if one_per_id else ["_id", "_text"]
        kept = kept.groupBy(*key).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*")
