"""Near-dedup, span dedup and decontamination against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import decontaminate, graph, neardup, spans

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(900)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, k = [], 0
    for g in range(25):
        base = prose(rng.randint(30, 120))
        for c in range(rng.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k, "a b"), (k + 1, "A  b!"), (k + 2, None), (k + 3, ""), (k + 4, "..."), (k + 5, "..."), (k + 6, " ".join(prose(60_000)))]
    return rows


def sets(text):
    w = ALNUM.findall(lower(text))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    f = lambda c: 1 + np.log(c) if c else 0
    low = sum(min(f(a[s]), f(b[s])) for s in a.keys() & b.keys())
    high = sum(max(f(a[s]), f(b[s])) for s in a.keys() | b.keys())
    return low / high if high else 0.0


def roots(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        at[y] = x
    return [find(x) for x in range(n)]


def test_classes_are_brute_force(spark, corpus):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in corpus], "doc_id long, text string, node int, bucket string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs, spread=0.0, few=2, block=4).collect()}
    shingled = [sets(t) for _, t in corpus]
    text = [t or "" for _, t in corpus]
    links = [(i, j) for i, j in itertools.combinations(range(len(corpus)), 2) if text[i] == text[j] or jaccard(shingled[i], shingled[j]) >= 0.8]
    near = [(i, j) for i, j in links if text[i] != text[j]]
    assert len(near) > 30
    want = roots(len(corpus), links)
    assert sum(got[i] == want[i] for i in range(len(corpus))) >= len(corpus) - 1  # sampling may lose a pair at the threshold
    kept = neardup.first(docs, spread=0.0)
    assert kept.columns == docs.columns and kept.count() == len(set(neardup_class(got)))


def test_classes_with_production_weights(spark, corpus):
    """The query's own relation: weights by document frequency, and its bands, blocks and threshold."""
    rng = random.Random(8)
    menu = "home about contact terms of use privacy policy all rights reserved by the owners of this page".split()
    texts = [t for _, t in corpus] + [" ".join(menu[: rng.randint(5, 17)] + (t or "").split()) for _, t in corpus]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    shingled, n = [sets(t) for t in texts], len(texts)
    df = Counter(s for c in shingled for s in c)
    floor = max(1, -(-n // 4096), -(-sum(df.values()) // (1 << 17)))
    idf = {s: 1 + 1.0 * min(1, max(0, np.log((n + 1) / (max(c, floor) + 1)) / np.log((n + 1) / (floor + 1)))) for s, c in df.items()}
    weighted = [{s: (1 + np.log(c)) * idf[s] for s, c in x.items()} for x in shingled]

    def similarity(a, b):
        low = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
        return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0

    links = [(i, j) for i, j in itertools.combinations(range(n), 2) if (texts[i] or "") == (texts[j] or "") or similarity(weighted[i], weighted[j]) >= 0.8]
    want = roots(n, links)
    assert len(links) > 100 and sum(got[i] == want[i] for i in range(n)) >= n - 1


def neardup_class(got):
    return got.values()


def test_samples_agree_as_often_as_similarity():
    a, b = " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(40, 240))
    data, off = neardup.words.buffers(pa.array([a, b]))
    keys, counts = neardup.shingle_keys(data, off, 5)
    _, s = neardup.Sampler(2000, 3).draw(keys, neardup.weights(keys, counts, neardup.FLAT))
    want = jaccard(sets(a), sets(b))
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_shared_ids_nulls_and_nothing(spark):
    rows = [(None, "p q r s t u"), (None, "other words are here now"), (1, "one two three four five"), (1, "six seven eight nine ten"), (2, "six seven eight nine ten"), (5, "x y"), (5, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id or -1) for r in neardup.classes(docs).collect())
    assert got == [(-1, -1), (-1, -1), (1, 1), (1, 1), (2, 1), (5, 5), (5, 5)]
    assert neardup.first(docs).count() == 3
    assert neardup.classes(docs.limit(0)).count() == 0


def test_every_text_of_shared_ids_stays(spark):
    say = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    near = lambda k: say(k) + " tail"
    rows = [(None, say(1)), (None, say(2)), (None, say(2)), (9, say(1)), (1, say(3)), (1, say(4)), (2, near(4)), (3, near(5)), (4, say(5)), (3, say(6)), (None, near(6)), (1, say(3)), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    kept = neardup.first(docs, one_per_id=False)
    got = sorted((r.doc_id is not None, r.doc_id, r.text or "") for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == sorted((i is not None, i, t or "") for i, t in [(None, say(1)), (None, say(2)), (1, say(3)), (1, say(4)), (3, near(5)), (None, near(6)), (None, "")])
    assert sorted((str(r.doc_id), str(r.class_id)) for r in neardup.classes(docs).collect()) == sorted([("None", "None")] * 5 + [("9", "None"), ("1", "1"), ("1", "1"), ("1", "1"), ("2", "1"), ("3", "3"), ("4", "3"), ("3", "None"), ("8", "None")])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 520)] + [(600, i) for i in range(601, 700)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(800, edges)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: want[x] for x in touched}
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def sentences(text):
    out, start = [], 0
    w = [(m.group(), m.end()) for m in re.finditer("[^\x20\x09-\x0d]+", text or "")]
    for k, (word, end) in enumerate(w):
        if k + 1 == len(w) or word[-1] in ".!?" or "\n" in text[end : w[k + 1][1] - len(w[k + 1][0])]:
            out.append((start, k + 1))
            start = k + 1
    return [lower(x) for x, _ in w], out


def brute_spans(rows, k=2, n=16):
    first, cuts = {}, {}
    for doc, text in sorted(rows):
        w, s = sentences(text)
        for i in range(len(s)):
            e = next((e for e in range(i + k, len(s) + 1) if s[e - 1][1] - s[i][0] >= n), None)
            if e is not None:
                run = tuple(w[s[i][0] : s[e - 1][1]])
                if first.setdefault(run, (doc, i)) != (doc, i):
                    cuts.setdefault(doc, set()).update(range(s[i][0], s[e - 1][1]))
    return cuts


def test_spans_are_brute_force(spark):
    rng = random.Random(2)
    say = lambda: " ".join(rng.choices("red blue green one two three four".split(), k=rng.randint(1, 9))).capitalize() + rng.choice([".", "!", "?", ".\n"])
    shared = [[say() for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [say() for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.7:
            at = rng.randint(0, len(parts))
            parts[at:at] = rng.choice(shared)[rng.randint(0, 2) :]
        rows.append((i, " ".join(parts)))
    rows += [(60, None), (61, ""), (62, "nothing. " * 3), (63, "again and again it goes on for ever. " * 50)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in rows], "doc_id long, text string, n_chars long, start string")
    want = brute_spans(rows)
    got = {}
    for r in spans.report(docs).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert got == want and len(want) > 20
    clean = {r.doc_id: r for r in spans.clean(docs).collect()}
    for i, t in rows:
        words = (t or "").split()
        left = [w for k, w in enumerate(words) if k not in want.get(i, ())]
        if words and not left:
            assert i not in clean
        else:
            assert (clean[i].text or "").split() == left
            assert clean[i].n_chars == len(clean[i].text or "") or i not in want
            assert i in want or clean[i].text == t


def all_runs(rows, k=2, n=16, long=50):
    first, cuts = {}, {}
    for doc, text in sorted(rows):
        w, s = sentences(text)
        for i, j in itertools.combinations(range(len(s) + 1), 2):
            a, b = s[i][0], s[j - 1][1]
            if (j - i >= k and b - a >= n or b - a >= long) and first.setdefault(tuple(w[a:b]), (doc, a)) != (doc, a):
                cuts.setdefault(doc, set()).update(range(a, b))
    return cuts


def test_spans_cover_all_runs(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choices("abcdefghijklmnop", k=n)) + "."
    one, few = say(55), [say(n) for n in (20, 20, 5, 5)]
    shared = [[say(rng.choice([1, 2, 5, 9, 20])) for _ in range(7)] for _ in range(5)] + [few, [one]]
    rows = [(i, " ".join([say(3), *rng.choice(shared)[rng.randint(0, 1) :], say(4)])) for i in range(60)]
    rows += [(100 + i, " ".join([say(3), *few, say(3)])) for i in range(2)] + [(102 + i, " ".join([say(3), one, say(3)])) for i in range(2)]
    got = {}
    for r in spans.report(spark.createDataFrame(rows, "doc_id long, text string"), every=True).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert got == all_runs(rows)
    assert got[101] == set(range(3, 53)) and got[103] == set(range(3, 58))


def test_spans_of_shared_ids_and_nothing(spark):
    p = "This passage has a good many words in it. It also has more than one sentence, so that it counts."
    rows = [(1, p), (1, p), (None, p), (None, "x. " + p), (2, p + " Own words.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.first_doc_id) for r in spans.report(docs).collect()) == [(0, 1), (0, 1), (2, 1)] or sorted((r.doc_id or 0) for r in spans.report(docs).collect()) == [0, 2]
    assert sorted(r.text for r in spans.clean(docs).collect() if r.doc_id == 2) == ["Own words."]
    assert spans.report(docs.limit(0)).count() == 0 and spans.clean(docs.limit(0)).count() == 0


def brute_windows(docs, items, n=10):
    words = lambda t: ALNUM.findall(lower(t))
    windows = {}
    for item, t in items:
        w = words(t)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[x]
        ids = sorted(map(str, found))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("sieve_bits", [1 << 28, 1 << 10])
def test_windows_are_brute_force(spark, sieve_bits):
    rng = random.Random(9)
    say = lambda n: [rng.choice("ab bc cd de Ef fg gh hi ü é 7 z_z".split()) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 3, 6, 10, 14, 25])))) for i in range(12)] + [(3, "ab bc"), (100, None), (101, "!!"), (None, "ab"), (102, items_text := "one two three four five six seven eight nine ten eleven"), (103, items_text)]
    docs = []
    for i in range(50):
        w = say(rng.randint(0, 30))
        if rng.random() < 0.5:
            w[2:2] = (rng.choice(items)[1] or "").split()
        docs.append((i, ", ".join(w)))
    docs += [(50, None), (51, ""), (52, "Two one TWO three four five six seven eight nine ten eleven"), (52, "ab"), (None, "ab " * 30_000)]
    d = spark.createDataFrame([(i, t, 3, "k") for i, t in docs], "doc_id long, text string, n_words int, spans string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.judge(d, b, sieve_bits=sieve_bits).drop("spans", "items").collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r)) == brute_windows(docs, items)


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "q", "y"), (3, None, "z")], "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(2, "q", "y"), (3, None, "z")]
    assert decontaminate.judge(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.judge(docs.limit(0), bench).count() == 0


def test_texts_of_a_large_bucket_are_sent_in_proportion(spark):
    """One bucket of m texts with forty outside its largest component: twice the texts, twice the copies sent."""
    sent = {}
    for m in (3000, 6000):
        rows = spark.range(m).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node"), F.when(F.col("id") % (m // 40) == 0, F.col("id")).otherwise(1).alias("label"), F.xxhash64("id").alias("rank"), F.lit(0).alias("cell"), F.lit(0).alias("c"))
        sent[m] = neardup._parted(rows, 64).count()
        assert sent[m] <= 1.2 * m + 41 * m / 64
    assert sent[6000] < 2.2 * sent[3000]


def test_strangers_leave_before_texts_are_compared(spark):
    """A bucket of two groups of copies and some strangers, told apart by their distance to the hub."""
    say = lambda k, n: " ".join(f"g{k}w{i}" for i in range(n))
    texts = [(i, say(1, 60) + f" x{i}") for i in range(30)] + [(100 + i, say(2, 60) + f" y{i}") for i in range(20)] + [(200 + i, say(3 + i, 60)) for i in range(5)]
    frame = spark.createDataFrame(texts, "node long, text string")
    rows = frame.select(F.lit(7).cast("long").alias("bucket"), "node", F.when(F.col("node") < 100, 0).when(F.col("node") < 200, 100).otherwise(F.col("node")).cast("long").alias("label"), F.xxhash64("node").alias("rank"))
    hubs = spark.createDataFrame([(7, 0)], "bucket long, hub long")
    idf = spark.sparkContext.broadcast(neardup.FLAT)
    got = neardup._apart(rows, hubs, frame, idf, 0.8, 5).collect()
    assert {r.cell for r in got if r.node < 100} == {0} and {r.cell for r in got if r.node >= 100} == {4}
    split = neardup._parted(spark.createDataFrame(got, "bucket long, node long, label long, rank long, cell int, c int"), 512).collect()
    assert split and not any(r.node < 100 for r in split)
