"""Operator 9: language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the last ``DEPTH`` = 5 bytes. A node's
estimate is Krichevsky-Trofimov over its counts; a node's weighted probability is half that and half the product of its
children's; so all depths are mixed by how well each has coded the training texts. Counts do not depend on order, so the
tree over the whole training corpus follows from counts of byte 6-grams, and after training the probability of a byte
depends on its 6-gram alone.

How the corpus flows: texts lie in blocks of about ``block_bytes``, and there are about as many buckets, which hold whole
subtrees (by a hash of the last three context bytes). A block has each of its distinct 6-grams and words once, with its
training count. It sends them in at most ``fan`` blobs: where there are more buckets than that, the blobs go to relays, which
add up what ``fan`` blocks have for a range of buckets and send that on in ``fan`` blobs, and so on; so the blobs are at
most ``fan`` for a block and a step, whatever the number of blocks, and the number of steps is its logarithm. Buckets add
up and build levels 3 to 5; levels 0 to 2, at most 2^24 nodes whatever the corpus, are aggregations of level 3. Answers
go back the same way, each blob's in its own order, and the block's texts are scored. Blobs grow with the distinct keys
of blocks, so with the corpus; nothing is broadcast or collected but totals.

A text starts after five zero bytes and ends with one, which is scored; so the empty text has a probability too.
6-grams that only held-out texts have are nodes without counts, which changes no estimate.

Cases: null text is the empty text; null ``doc_id`` is never held out; repeated rows train and are scored once each;
with nothing to learn from, every byte has probability 1/256 and the base is log10(1 / (N + V + 1)) for each token with
N = V = 0; a text of any length is scored in steps; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, words

DEPTH, TOP = 5, 3  # levels TOP..DEPTH are built in buckets
_STEP = 1 << 16  # positions in a sort; 6-gram and position fill 64 bits
_CHUNK = 1 << 19
_KEPT = 1 << 20  # keys that are held before equal ones are added up
_HALF = math.log(0.5)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 6-gram that ends at each byte and at each text's end, and the number of its text."""
    n, rows = len(data), len(offsets) - 1
    doc = np.repeat(np.arange(rows), np.diff(offsets) + 1)
    padded = np.zeros(n + rows * (DEPTH + 1), np.uint8)
    place = np.arange(n + rows) + DEPTH * (doc + 1)
    byte = np.ones(n + rows, bool)
    byte[offsets[1:] + np.arange(rows)] = False
    padded[place[byte]] = data
    code = np.zeros(len(place), np.uint64)
    for back in range(DEPTH, -1, -1):
        code = code << np.uint64(8) | padded[place - back]
    return code, doc


def _first(values: np.ndarray) -> np.ndarray:
    """Where a sorted array has a new value."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def _distinct(values: np.ndarray, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs where ``learns``; a value may come twice, once without a count."""
    order = np.sort(values[learns])
    first, other = _first(order), np.unique(values[~learns])
    return np.concatenate((order[first], other)), np.concatenate((np.diff(np.append(first, len(order))), np.zeros(len(other), np.int64)))


def _added(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, with the sums of their counts."""
    v = np.concatenate([np.zeros(0, np.uint64), *values])
    c = np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    first = _first(v)
    return v[first], np.add.reduceat(c, first) if len(first) else c


def _blob(values: np.ndarray) -> bytes:
    """Eight-byte numbers, bytes of equal weight together, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(raw).tobytes(), codec="zstd", asbytes=True)


def _unblob(data: bytes, n: int, kind: str) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view(kind).reshape(-1)


def _keys(keys: np.ndarray) -> bytes:
    return _blob(np.diff(keys, prepend=np.uint64(0)))


def _unkeys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unblob(data, n, np.uint64), dtype=np.uint64)


def _bucket(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    part = (keys >> np.uint64(8)) & np.uint64((1 << 8 * TOP) - 1) if kind == 0 else keys
    return (words.mix(part + np.uint64(kind)) % np.uint64(buckets)).astype(np.int64)


def _steps(text: pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a column with their bytes; very long texts are a run of their own."""
    at = 0
    for chunk in text.chunks:
        data, off = words.buffers(chunk)
        for lo, hi in words.spans(off, _CHUNK):
            yield at + lo, at + hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        at += len(chunk)


ASKED = "src long, dst long, kind int, size long, keys binary, counts binary"
TOLD = "src long, kind int, size long, keys binary, vals binary"


class Route:
    """Steps from blocks to buckets. After ``step`` steps a node is a group of fan**step blocks and a range of buckets."""

    def __init__(self, blocks: int, fan: int):
        self.steps = 1
        while fan**self.steps < blocks:
            self.steps += 1
        self.fan = 1
        while self.fan**self.steps < blocks:
            self.fan += 1
        self.buckets = self.fan**self.steps

    def split(self, node: int, step: int, got: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        """What a node sends to the nodes of the next step, a row for each of them and each kind."""
        group = node // self.fan**step // self.fan
        ranges, width = self.fan ** (step + 1), self.fan ** (self.steps - step - 1)
        rows = []
        for kind, (v, c) in enumerate(got):
            b = _bucket(kind, v, self.buckets) // width
            order = np.argsort(b, kind="stable")
            first = _first(b[order])
            for part in np.split(order, first[1:]) if len(order) else ():
                rows.append((node, group * ranges + int(b[part[0]]), kind, len(part), _keys(v[part]), _blob(c[part])))
        cols = list(zip(*rows)) if rows else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("src", "dst", "kind", "size", "keys", "counts"), cols, types)})

    def relay(self, step: int):
        return lambda table: self.split(table.column("dst")[0].as_py(), step, _gathered(table))


def _ask(route: Route):
    def asked(table: pa.Table) -> pa.Table:
        """What a block has: its distinct 6-grams (kind 0) and word hashes (kind 1)."""
        held = table.column("held_out").to_numpy()
        got: list[tuple[list, list]] = [([], []), ([], [])]
        for lo, hi, data, off in _steps(table.column("text")):
            code, doc = ngrams(data, off)
            w = words.Words(data, off, words.NON_SPACE)
            for kind, (v, learns) in enumerate(((code, ~held[lo + doc]), (w.hashes(), ~held[np.repeat(np.arange(lo, hi), w.count)]))):
                for side, x in zip(got[kind], _distinct(v, learns)):
                    side.append(x)
                if len(got[kind][0]) > 1 and sum(map(len, got[kind][0])) > _KEPT:
                    for side, x in zip(got[kind], _added(*got[kind])):
                        side[:] = [x]
        return route.split(table.column("block")[0].as_py(), 0, [_added(*g) for g in got])

    return asked


def _gathered(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and global counts of a bucket, by kind."""
    got: list[tuple[list, list]] = [([], []), ([], [])]
    for kind, n, keys, counts in zip(*(table.column(c).to_pylist() for c in ("kind", "size", "keys", "counts"))):
        got[kind][0].append(_unkeys(keys, n))
        got[kind][1].append(_unblob(counts, n, np.int64))
        if len(got[kind][0]) > 1 and sum(map(len, got[kind][0])) > _KEPT:
            for side, x in zip(got[kind], _added(*got[kind])):
                side[:] = [x]
    return [_added(*g) for g in got]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8.0
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


def _kt(n: np.ndarray, n1: np.ndarray) -> np.ndarray:
    a, b = n1 + 0.5, n - n1 + 0.5
    return _log_gamma(a) + _log_gamma(b) - _log_gamma(a + b) - math.log(math.pi)


def _decision(grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The node at full depth of a gram's k-th decision (context, then the decision's prefix), and its outcome."""
    byte = grams & np.uint64(255)
    return (grams >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << k) | (byte >> np.uint64(8 - k)), (byte >> np.uint64(7 - k)) & np.uint64(1)


def _up(keys: np.ndarray, depth: int) -> np.ndarray:
    """Nodes at ``depth`` above nodes."""
    return ((keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8) | (keys & np.uint64(255))


def subtrees(grams: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """Levels TOP..DEPTH over grams with counts: keys, n, n1, log of the weighted probability, own estimate, stop weight."""
    found = [_decision(grams, k) for k in range(8)]
    keys, which = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    n = np.bincount(which, np.tile(counts, 8), len(keys))
    n1 = np.bincount(which, np.concatenate([f[1] * counts.astype(np.float64) for f in found]), len(keys))
    out, deeper = {}, None
    for depth in range(DEPTH, TOP - 1, -1):
        kt = _kt(n, n1)
        weighted = kt if deeper is None else np.logaddexp(kt, deeper) + _HALF
        out[depth] = (keys, n, n1, weighted, (n1 + 0.5) / (n + 1), np.minimum(np.exp(kt + _HALF - weighted), 1))
        if depth > TOP:
            keys, which = np.unique(_up(keys, depth - 1), return_inverse=True)
            n, n1, deeper = (np.bincount(which, x, len(keys)) for x in (n, n1, weighted))
    return out


def _roots(table: pa.Table) -> pa.Table:
    """Level TOP of a bucket."""
    (grams, counts), _ = _gathered(table)
    keys, n, n1, weighted, _, _ = subtrees(grams, counts)[TOP] if len(grams) else [np.zeros(0, np.uint64), *[np.zeros(0)] * 5]
    return pa.table({"key": keys.view(np.int64), "bucket": np.full(len(keys), table.column("dst")[0].as_py(), np.int64), "n": n, "n1": n1, "weighted": weighted})


def _totals(table: pa.Table) -> pa.Table:
    """Training tokens and distinct ones of a bucket."""
    _, (_, counts) = _gathered(table)
    return pa.table({"n": [int(counts.sum())], "kinds": [int((counts > 0).sum())]})


def _answer(table: pa.Table, above: pa.Table) -> pa.Table:
    """To each block: log10 of a 6-gram's probability, or a word's count, in the order of its keys.

    ``above`` has, by node of level TOP, what the levels over it give a one (``fixed``) and how much they leave to it."""
    (grams, counts), (tokens, often) = _gathered(table)
    lp = np.zeros(len(grams))
    if len(grams):
        tree = subtrees(grams, counts)
        order = np.argsort(above.column("key").to_numpy().view(np.uint64))
        top = above.column("key").to_numpy().view(np.uint64)[order]
        fixed, left = (above.column(c).to_numpy()[order] for c in ("fixed", "left"))
        for k in range(8):
            node, bit = _decision(grams, k)
            p = None
            for depth in range(DEPTH, TOP - 1, -1):
                keys, _, _, _, own, stop = tree[depth]
                at = np.searchsorted(keys, _up(node, depth))
                p = own[at] if p is None else stop[at] * own[at] + (1 - stop[at]) * p
            at = np.searchsorted(top, _up(node, TOP))
            p = fixed[at] + left[at] * p
            lp += np.log10(np.where(bit == 1, p, 1 - p))
    return _replies(table, [(grams, lp), (tokens, often.astype(np.float64))])


def _replies(asked: pa.Table, known: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """To each blob that a node was sent, the values of its keys in its order."""
    rows = []
    for src, kind, n, data in zip(*(asked.column(c).to_pylist() for c in ("src", "kind", "size", "keys"))):
        keys, values = known[kind]
        rows.append((src, kind, n, data, _blob(values[np.searchsorted(keys, _unkeys(data, n))])))
    cols = list(zip(*rows)) if rows else [[]] * 5
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("src", "kind", "size", "keys", "vals"), cols, types)})


def _heard(told: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys, ascending, and values of all answers to a node, by kind."""
    out = []
    kinds, sizes, keys, vals = (told.column(c).to_pylist() for c in ("kind", "size", "keys", "vals"))
    for k in (0, 1):
        key = np.concatenate([np.zeros(0, np.uint64), *(_unkeys(a, n) for kind, n, a in zip(kinds, sizes, keys) if kind == k)])
        value = np.concatenate([np.zeros(0), *(_unblob(a, n, np.float64) for kind, n, a in zip(kinds, sizes, vals) if kind == k)])
        order = np.argsort(key)
        out.append((key[order], value[order]))
    return out


def log_gamma(x: Column) -> Column:
    """ln gamma of x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return series - F.log(product)


def above(roots: DataFrame) -> DataFrame:
    """For nodes (key, bucket, n, n1, weighted) of level TOP: key, bucket, fixed, left, from levels 0 to TOP - 1."""
    up = lambda c, depth: F.shiftleft(F.shiftright(c, 8).bitwiseAND(F.lit((1 << 8 * depth) - 1)), 8).bitwiseOR(F.col(c).bitwiseAND(F.lit(255)))
    levels: list[DataFrame] = []
    level = roots
    for depth in range(TOP - 1, -1, -1):
        level = level.groupBy(up("key", depth).alias("key")).agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum("weighted").alias("deeper"))
        a, b = F.col("n1") + 0.5, F.col("n") - F.col("n1") + 0.5
        level = level.withColumn("kt", log_gamma(a) + log_gamma(b) - log_gamma(a + b) - math.log(math.pi))
        top = F.greatest("kt", "deeper")
        level = level.withColumn("weighted", top + F.log(F.exp(F.col("kt") - top) + F.exp(F.col("deeper") - top)) + _HALF)
        level = level.select("key", "n", "n1", "weighted", ((F.col("n1") + 0.5) / (F.col("n") + 1.0)).alias("own"), F.least(F.exp(F.col("kt") + _HALF - F.col("weighted")), F.lit(1.0)).alias("stop"))
        level = scratch.materialise(level, "level")
        levels.insert(0, level)
    seen = levels[0].select("key", (F.col("stop") * F.col("own")).alias("fixed"), (1 - F.col("stop")).alias("left"))
    for depth, level in [*list(enumerate(levels))[1:], (TOP, roots)]:
        below = level.withColumn("up", up("key", depth - 1)).join(seen.withColumnRenamed("key", "up"), "up")
        if depth == TOP:
            return below.select("key", "bucket", "fixed", "left")
        seen = below.select("key", (F.col("fixed") + F.col("left") * F.col("stop") * F.col("own")).alias("fixed"), (F.col("left") * (1 - F.col("stop"))).alias("left"))
    raise AssertionError


def exchange(docs: DataFrame, route: Route) -> list[DataFrame]:
    """What blocks (block, text, held_out) send, step by step; the last are the rows that the buckets get."""
    asks = [scratch.materialise(docs.groupBy("block").applyInArrow(_ask(route), ASKED), "asked")]
    for step in range(1, route.steps):
        asks.append(scratch.materialise(asks[-1].groupBy("dst").applyInArrow(route.relay(step), ASKED), "asked"))
    return asks


def score(docs: DataFrame, held_out: Column, block_bytes: int = 16 << 20, fan: int = 64) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; learns where not ``held_out``."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    n_bytes, n_train = docs.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(8)), F.lit(0)), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))).first()
    blocks = max(1, -(-int(n_bytes) // block_bytes))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    with scratch.dropping():
        asks = exchange(docs, Route(blocks, fan))
        roots = scratch.materialise(asks[-1].where("kind = 0").groupBy("dst").applyInArrow(_roots, "key long, bucket long, n double, n1 double, weighted double"), "roots")
        n_words, n_kinds = asks[-1].where("kind = 1").groupBy("dst").applyInArrow(_totals, "n long, kinds long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
        told = asks[-1].groupBy("dst").cogroup(above(roots).groupBy("bucket")).applyInArrow(_answer, TOLD)
        for asked in reversed(asks[:-1]):
            told = scratch.materialise(told, "told")
            told = asked.groupBy("dst").cogroup(told.groupBy("src")).applyInArrow(lambda a, b: _replies(a, _heard(b)), TOLD)
        told = scratch.materialise(told, "told", keep=True)
    total, distinct = int(n_words) + int(n_train), int(n_kinds) + (int(n_train) > 0)
    floor = math.log10(total + distinct + 1)

    def one_block(rows: pa.Table, got: pa.Table) -> pa.Table:
        (grams, chance), (tokens, count) = _heard(got)
        n = rows.num_rows
        out = {"n_tokens": np.ones(n, np.int64), "n_known": np.zeros(n, np.int64), "base_score": np.zeros(n), "score": np.zeros(n), "n_bytes": np.zeros(n, np.int64)}
        for lo, hi, data, off in _steps(rows.column("text")):
            code, doc = ngrams(data, off)
            for a in range(0, len(code), _STEP):
                part = code[a : a + _STEP]
                both = np.sort(part << np.uint64(16) | np.arange(len(part), dtype=np.uint64))
                c, place = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
                first = _first(c)
                lp = np.repeat(chance[np.searchsorted(grams, c[first])], np.diff(np.append(first, len(c))))
                d = doc[a : a + _STEP]
                out["score"][lo + d[0] : lo + d[-1] + 1] += np.bincount(d[place] - d[0], lp, d[-1] - d[0] + 1)
            w = words.Words(data, off, words.NON_SPACE)
            c = count[np.searchsorted(tokens, w.hashes())] if len(w.start) else np.zeros(0)
            doc = np.repeat(np.arange(hi - lo), w.count)
            out["n_tokens"][lo:hi] += w.count
            out["n_known"][lo:hi] = np.bincount(doc, c > 0, hi - lo)
            out["base_score"][lo:hi] = np.bincount(doc, np.log10(c + 1) - floor, hi - lo)
            out["n_bytes"][lo:hi] = np.diff(off)
        out["n_known"] += int(n_train > 0)
        out["base_score"] += math.log10(n_train + 1) - floor
        return pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), **{k: pa.array(v) for k, v in out.items()}})

    done = docs.groupBy("block").cogroup(told.groupBy("src")).applyInArrow(one_block, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = (-F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits)
