"""Operator 1: language identification by string kernels.

The kernel of two texts is the number of byte n-grams (n from 1 to ``max_n``) present in both, over the root of the
product of how many each has: a blended-spectrum presence kernel. Texts are lowered in ASCII; other ASCII characters
than letters count as spaces. Landmarks drawn from the labelled rows give a Nyström map K(x, Z) K(Z, Z)^(-1/2), in which
one ridge regression per language, against the rest, is solved. Presence is counted over the n-grams that some
landmark has, so a batch of texts is scored as matrix products: presence x landmarks x languages.

``fit`` learns from at most ``per_language`` rows of each language, whatever the size of the table, chosen by a hash of
their ids; landmarks are the first of those, of long ones a piece of at most ``landmark_bytes`` characters. Predicting reads the whole text alone.

Cases: null text, or text without a letter, is ``und`` with score 0, and so is every text where nothing was learned;
rows without a language teach nothing; repeated rows get equal answers; texts of any length are read in segments; an
empty table gives no rows; ``accept`` keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, tokens, words

_SEGMENT, _ROWS, _SLOTS = 1 << 19, 128, 1 << 19
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _codes(data: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each n, the n-gram that begins at each byte, as a number; those that run over the end are left out."""
    folded = _FOLD[data]
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max_n + 1):
        m = len(data) - n + 1
        if m < 1:
            return
        code = (code[:m] << np.uint32(8)) | folded[n - 1 :]
        yield n, code


def _slot(code: np.ndarray, n: int) -> np.ndarray:
    return ((code + np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(13)


@dataclass
class Features:
    """n-grams of the landmarks (presence over them is the feature space) and the landmarks in it."""

    max_n: int
    code: np.ndarray
    size: np.ndarray
    slots: np.ndarray  # first n-gram of each slot, or -1
    after: np.ndarray  # the next n-gram in the slot of each, or -1
    landmarks: np.ndarray  # n-grams x landmarks, columns of norm 1

    @staticmethod
    def of(texts: list[bytes], max_n: int) -> Features:
        found = [{(n, c) for n, codes in _codes(np.frombuffer(t, np.uint8), max_n) for c in np.unique(codes).tolist()} for t in texts]
        grams: list[tuple[int, int]] = []
        slots = np.full(_SLOTS, -1, np.int32)
        after: list[int] = []
        for n, c in sorted(set().union(*found)):
            s = int(_slot(np.array([c], np.uint32), n)[0])
            after.append(int(slots[s]))
            slots[s] = len(grams)
            grams.append((n, c))
        row = {g: i for i, g in enumerate(grams)}
        marks = np.zeros((len(grams), len(texts)), np.float32)
        for j, gs in enumerate(found):
            marks[[row[g] for g in gs], j] = 1
        marks /= np.sqrt(np.maximum(marks.sum(0), 1))
        return Features(max_n, np.array([c for _, c in grams], np.uint32), np.array([n for n, _ in grams], np.int32), slots, np.array(after, np.int32), marks)

    def kernel(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts x landmarks."""
        rows, width = len(offsets) - 1, len(self.code)
        present = np.zeros(rows * width, np.float32)
        for lo in range(0, len(data), _SEGMENT):
            hi = min(len(data), lo + _SEGMENT + self.max_n - 1)
            first, last = np.searchsorted(offsets, [lo, hi - 1], "right") - 1
            cuts = np.clip(offsets[first : last + 2], lo, hi) - lo
            row = np.repeat(np.arange(first, last + 1), np.diff(cuts))
            for n, code in _codes(data[lo:hi], self.max_n):
                f = self.slots[_slot(code, n)]
                at = np.flatnonzero(f >= 0)
                f = f[at]
                while len(at):
                    same = (self.code[f] == code[at]) & (self.size[f] == n)
                    ok, g = at[same], f[same]
                    inside = row[ok] == row[ok + n - 1]
                    present[row[ok[inside]] * width + g[inside]] = 1
                    other = np.flatnonzero(~same)
                    other = other[self.after[f[other]] >= 0]
                    at, f = at[other], self.after[f[other]]
        present = present.reshape(rows, width)
        return (present @ self.landmarks) / np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    features: Features | None
    weights: np.ndarray | None  # landmarks x languages


def solve(features: Features, gram: np.ndarray, kernel: np.ndarray, labels: list[str], ridge: float) -> Model:
    """One-versus-rest ridge regression in the Nyström map; every language weighs the same."""
    languages = sorted(set(labels))
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel.astype(np.float64) @ root
    y = np.array([[float(a == b) for b in languages] for a in labels])
    w = (y / y.sum(0)).sum(1)[:, None]
    a = phi.T @ (phi * w) + ridge * np.eye(phi.shape[1])
    return Model(languages, features, (root @ np.linalg.solve(a, phi.T @ (y * w))).astype(np.float32))


def _batches(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = words.buffers(text)
    for lo in range(0, len(text), _ROWS):
        hi = min(len(text), lo + _ROWS)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def fit(train: DataFrame, per_language: int = 600, landmarks: int = 128, landmark_bytes: int = 1 << 16, max_n: int = 4, ridge: float = 1e-4) -> Model:
    """Learn from doc_id, text and lang of ``train``."""
    spark = train.sparkSession
    rows = train.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model([], None, None)
    # A share of each language by hash, then exactly the first of those: no more than about twice the bound is ever sorted.
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 2 * per_language / c))) for k, c in n.items()))
    rows = rows.where(F.pmod("h", F.lit(1 << 40)) < share * (1 << 40)).where(F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    rows = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    rows = scratch.materialise(rows, "sample")  # at most per_language rows a language, read twice
    each = max(4, landmarks // len(n))
    brief = F.octet_length("text") <= landmark_bytes
    marks = rows.withColumn("j", F.row_number().over(Window.partitionBy("lang").orderBy(~brief, "h", "text"))).where(F.col("j") <= each)
    texts = [t.encode() for t in sorted(marks.select(F.substring("text", 1, landmark_bytes).alias("text")).toArrow().column("text").to_pylist())]
    if not texts:
        return Model([], None, None)
    features = Features.of(texts, max_n)
    shared = spark.sparkContext.broadcast(features)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            for lo, hi, data, off in _batches(batch.column("text")):
                k = shared.value.kernel(data, off)
                yield pa.record_batch([batch.column("lang").slice(lo, hi - lo), pa.array(list(k), pa.list_(pa.float32()))], ["lang", "k"])

    got = rows.select("lang", "text").mapInArrow(kernels, "lang string, k array<float>").toArrow()
    order_ = sorted(zip(got.column("lang").to_pylist(), got.column("k").to_pylist()))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    gram = features.kernel(joined, np.cumsum([0, *(len(t) for t in texts)]))
    return solve(features, (gram + gram.T) / 2, np.array([k for _, k in order_], np.float32), [a for a, _ in order_], ridge)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, from ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = _lettered(docs.select(*map(scratch.named, kept)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = np.array([*m.languages, "und"], object)
        tokens.forget()
        for batch in batches:
            best, value = _judge(m, batch)
            for lo in range(0, len(batch), 1024):
                yield pa.record_batch([batch.column("row").slice(lo, 1024), pa.array(names[best[lo : lo + 1024]].tolist(), pa.string()), pa.array(value[lo : lo + 1024], pa.float64())], ["row", "lang_pred", "score"])

    return rows.mapInArrow(score, rows.select("row").schema.add("lang_pred", "string").add("score", "double")).select("row.*", "lang_pred", "score")


def _lettered(docs: DataFrame) -> DataFrame:
    """``row`` (all columns) and ``letter`` (whether the text has one)."""
    return docs.select(F.struct(*map(scratch.named, docs.columns)).alias("row"), F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)).alias("letter"))


def _judge(m: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its language (that of ``und`` comes last) and its score."""
    best, value = np.full(len(batch), len(m.languages)), np.zeros(len(batch))
    for lo, hi, data, off in _batches(batch.column("row").field("text")) if m.languages else ():
        s = m.features.kernel(data, off) @ m.weights
        ok = batch.column("letter").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
        best[lo:hi] = np.where(ok, s.argmax(1), len(m.languages))
        value[lo:hi] = np.where(ok, np.clip(s.max(1), 0, 1), 0.0)
    return best, value


def accept(docs: DataFrame, model: Model, least: float = 0.1) -> DataFrame:
    """The rows of ``docs`` whose language was recognised: not ``und``, and scored ``least`` at least. A model that has
    learned no language rejects only texts without a letter."""
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = _lettered(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        tokens.forget()
        for batch in batches:
            best, value = _judge(m, batch)
            yield batch.select(["row"]).filter(pa.array((best < len(m.languages)) & (value >= least)))

    return rows.mapInArrow(keep, rows.select("row").schema).select("row.*")
