"""The mix against plain Python: sizes, targets, words taken, times and the training order."""

import re
from collections import defaultdict

import pytest

from faultline.llm import mixing, queries

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, size string, taken int"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Rounds: share what is left by weight; who would exceed stops; again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, live, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while live:
        level = left / sum(weight[s] for s in live)
        over = {s for s in live if level * weight[s] > most * sizes[s]}
        if not over:
            for s in live:
                target[s] = level * weight[s]
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        live -= over
    return target


def sizes_of(rows):
    out = defaultdict(int)
    for _, text, source, *_ in rows:
        out[source] += len(WORD.findall(text or ""))
    return out


ROWS = [(i, " ".join(f"w{i}" for _ in range(3 + i * 7 % 50)), ["b", "a", "é", "Z", None, "zz"][i % 6 if i % 4 else 0], "x", 1) for i in range(240)]
ROWS += [(500, None, "b", "x", 1), (501, " \n", "a", "x", 1), (None, "no id", None, "x", 1), (7, "again", "a", "x", 1), (600, "", "empty", "x", 1)] + [(700, "same text here", "zz", "x", 1)] * 9


def check(rows, got):
    sizes, goal = sizes_of(rows), plain_targets(sizes_of(rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in got) == sorted((-1 if i is None else i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.first + r.second and (r.position is None) == (r.first == 0) and (r.again is None) == (r.second == 0)
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source], rel=1e-12)
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - goal[s]) <= 0.5
    # laid end to end: in each source the takes follow the key, first passes before second ones
    for s in sizes:
        ordered = sorted((r for r in got if r.source == s and r.size), key=lambda r: (r.key, -1 if r.doc_id is None else r.doc_id, -r.first, -r.second))
        budget = round(goal[s])
        for attr in ("first", "second"):
            for r in ordered:
                assert getattr(r, attr) == min(budget, r.size)
                budget -= getattr(r, attr)


def test_mix(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = mixing.mix(docs).collect()
    check(ROWS, got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.coalesce(1)).collect()))  # reruns agree, whatever the layout
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(r.position is None for r in got[len(at) :])


def test_training_order(spark):
    """Words of a source up to a time are what the integral of its schedule asks for, within one document."""
    mixed = mixing.mix(spark.createDataFrame(ROWS, SCHEMA))
    order = mixing.curriculum(mixed).collect()
    start = 0
    for r in order:
        assert r.start == start
        start += r.words
    assert [r.position for r in order] == sorted(r.position for r in order) and start == mixed.agg({"taken": "sum"}).first()[0]
    goal, largest = plain_targets(sizes_of(ROWS)), max(len(WORD.findall(t or "")) for _, t, *_ in ROWS)
    names = [*sorted((s for s in goal if s is not None), key=str.encode), None]
    for i, s in enumerate(names):
        knots = mixing.SCHEDULES[i % 3]
        for t in (0.1, 0.35, 0.5, 0.8, 1.0):
            area, whole = 0.0, mixing.integral(knots)[-1]
            for (t1, v1), (t2, v2) in zip(knots, knots[1:]):
                hi = min(t, t2)
                if hi > t1:
                    area += (hi - t1) * (v1 + v1 + (v2 - v1) * (hi - t1) / (t2 - t1)) / 2
            assert abs(sum(r.words for r in order if r.source == s and r.position <= t) - goal[s] * area / whole) <= largest + 1


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_CHUNK", 7)
    rows = [(1, "one two three", "a", "x", 1)] * 50 + [(2, "four five", "b", "x", 1)]
    check_rows = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(check_rows) == 51 and sum(r.taken for r in check_rows if r.source == "a") == round(plain_targets(sizes_of(rows))["a"])


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, "x", 1), (2, " ", "a", "x", 1)], SCHEMA)).collect()
    assert all((r.size, r.taken, r.target, r.source_size) == (0, 0, 0.0, 0) for r in got) and len(got) == 2
    with pytest.raises(ValueError):
        mixing.integral([(0.0, 0.0), (1.0, 0.0)])


def test_query(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got, source = queries.op11_mixing(spark, sf).collect(), {r[0]: r[2] for r in rows}
    goal, taken = plain_targets(sizes_of(rows)), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert r.target == pytest.approx(goal[source[r.doc_id]], rel=1e-12) and r.taken <= 2 * r.size
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)
