"""Context-tree scores against a recursive version, and the base against plain counting."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import ctw

D = ctw.DEPTH


def grams(text):
    b = bytes(D) + text.encode() + b"\0"
    return [b[i - D : i + 1] for i in range(D, len(b))]


class Tree:
    """Weighted probabilities by the recursive definition, over all training decisions."""

    def __init__(self, texts):
        self.n = Counter()
        for t in texts:
            for g in grams(t):
                for node, bit in self.path(g):
                    for d in range(D + 1):
                        self.n[g[D - d : D], node, bit] += 1
        self.memo = {}

    @staticmethod
    def path(g):
        node = 1
        for k in range(8):
            bit = g[-1] >> (7 - k) & 1
            yield node, bit
            node = 2 * node + bit

    def kt(self, c, node):
        a, b = self.n[c, node, 0] + 0.5, self.n[c, node, 1] + 0.5
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b) - math.log(math.pi)

    def weighted(self, c, node):
        if (c, node) not in self.memo:
            own = self.kt(c, node)
            if len(c) < D and self.n[c, node, 0] + self.n[c, node, 1]:
                below = sum(self.weighted(bytes([x]) + c, node) for x in range(256) if self.n[bytes([x]) + c, node, 0] + self.n[bytes([x]) + c, node, 1])
                own = np.logaddexp(own, below) + math.log(0.5)
            self.memo[c, node] = own
        return self.memo[c, node]

    def chance(self, context, node, bit, d=0):
        c = context[D - d :]
        n = self.n[c, node, 0] + self.n[c, node, 1]
        own = (self.n[c, node, bit] + 0.5) / (n + 1)
        if d == D:
            return own
        stop = min(1.0, math.exp(self.kt(c, node) + math.log(0.5) - self.weighted(c, node))) if n else 1.0
        return stop * own + (1 - stop) * self.chance(context, node, bit, d + 1)

    def score(self, text):
        return sum(math.log10(self.chance(g[:D], node, bit)) for g in grams(text) for node, bit in self.path(g))


TEXTS = ["the cat sat on the mat", "the dog sat on the log", None, "", "A cat. The END", "\x00 odd \x01", "äöü äöü äöü", "the cat sat on the mat", "zzz unseen 123"]


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(i, t, 0.5, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, score double, block string")
    return {r.doc_id: r for r in ctw.score(docs, F.col("doc_id") % 4 == 3, block_bytes=40).collect()}


def test_scores_are_the_recursive_ones(scored):
    tree = Tree([t or "" for i, t in enumerate(TEXTS) if i % 4 != 3])
    for i, t in enumerate(TEXTS):
        assert abs(scored[i].score - tree.score(t or "")) < 1e-6, i


@pytest.mark.parametrize("fan", [2, 3])
def test_relays_change_nothing(spark, scored, fan):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert ctw.Route(9, fan).steps > 1
    for r in ctw.score(docs, F.col("doc_id") % 4 == 3, block_bytes=20, fan=fan).collect():
        assert all(abs(a - b) < 1e-9 if isinstance(a, float) else a == b for a, b in zip(r, scored[r.doc_id]))


def test_blobs_grow_with_the_corpus(spark):
    """Sixteen times the blocks take twice the steps, and so at most 32 times the blobs; without relays it would be 256 times."""
    sent = {}
    for blocks in (16, 256):
        docs = spark.range(blocks * 3).select((F.col("id") % blocks).alias("block"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(" a b c")).alias("text"), F.lit(False).alias("held_out"))
        route = ctw.Route(blocks, 4)
        asks = ctw.exchange(docs, route)
        sent[blocks] = sum(a.count() for a in asks)
        assert len(asks) == route.steps and all(a.groupBy("src", "kind").count().agg(F.max("count")).first()[0] <= route.fan for a in asks)
        assert sent[blocks] <= 2 * route.fan * route.steps * blocks
    assert sent[256] <= 32 * 1.05 * sent[16]


def test_base_is_plain_counting(scored):
    tokens = lambda t: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter(w for i, t in enumerate(TEXTS) if i % 4 != 3 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(TEXTS):
        r = scored[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 4 == 3, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) < 1e-9


def test_probabilities_add_up(spark):
    texts = ["abracadabra", "abc"]
    tree = Tree(texts)
    for context in (b"\0\0abr", b"zzzzz"):
        total = 0.0
        for byte in range(256):
            g = context + bytes([byte])
            total += math.exp(sum(math.log(tree.chance(context, node, bit)) for node, bit in Tree.path(g)))
        assert abs(total - 1) < 1e-9


def test_long_repeated_and_nothing(spark):
    docs = spark.createDataFrame([(1, "ab " * 100_000), (1, "ab " * 100_000), (None, "q")], "doc_id long, text string")
    rows = ctw.score(docs, F.col("doc_id") == 7).collect()
    long = [r.score for r in rows if r.doc_id == 1]
    assert len(rows) == 3 and abs(long[0] - long[1]) < 1e-6 and long[0] > -300
    assert ctw.score(docs.limit(0), F.lit(False)).count() == 0
    alone = ctw.score(docs.where("doc_id IS NULL"), F.lit(True)).collect()[0]
    assert abs(alone.score - 2 * math.log10(1 / 256)) < 1e-9 and abs(alone.base_score) < 1e-12
