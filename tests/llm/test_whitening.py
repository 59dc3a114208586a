"""Whitening against exact fractions, on both ways of reaching the models."""

import math
from fractions import Fraction

import numpy as np
import pytest

from faultline.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component string"


def check(rows, got, top=16):
    live = [(i, v) for i, v, *_ in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    grid = {}
    for i, v in live:
        grid.setdefault(len(v), []).append((i, tuple(math.floor(64 * e) + 1_000_000 for e in v)))
    assert len(got) == sum(min(top, d) * len(x) for d, x in grid.items())
    for d, items in grid.items():
        fit = sorted({x for _, x in items})
        n, s = len(fit), [sum(x[j] for x in fit) for j in range(d)]
        cov = [[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit) for j in range(d)] for i in range(d)]  # n^3 times V
        e, u = np.linalg.eigh(np.array([[float(Fraction(v, n**3)) for v in r] for r in cov]))
        e, u = e[::-1], u[:, ::-1]
        rank = int((e > max(1e-12 * e[0], 0)).sum())
        mine = [r for r in got if r.dim == d]
        expected = {}
        for i, x in items:
            centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
            for k in range(min(top, d)):
                w = None if k >= rank else centred @ u[:, k] / math.sqrt(e[k])
                expected.setdefault((i, k + 1), []).append((sum((n * a - b) ** 2 for a, b in zip(x, s)), w))
        signs = {}
        for r in mine:
            options = expected[r.vec_id, r.component]
            best = min(options, key=lambda o: (o[0] != int(r.deviation_digits), 0 if o[1] is None else abs(abs(o[1]) - abs(r.whitened))))
            assert int(r.deviation_digits) == best[0] and r.deviation == (best[0] if best[0] < 1 << 63 else None) and r.n == n
            if best[1] is None:
                assert r.whitened is None and r.explained == 0
            else:
                gap = min([e[r.component - 1] - e[r.component]] if r.component < d else [1.0]) if d > 1 else 1.0
                assert abs(r.whitened) == pytest.approx(abs(best[1]), rel=1e-7, abs=1e-7) or gap < 1e-6 * e[0]
                if abs(best[1]) > 1e-3:
                    signs.setdefault(r.component, set()).add(np.sign(r.whitened * best[1]))
                assert r.explained == pytest.approx(e[r.component - 1] / sum(e), rel=1e-9)
            assert r.identity_error < 1e-9
        assert all(len(v) == 1 for v in signs.values())


def cases():
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.3, (60, 5)) @ rng.normal(0, 1, (5, 5))
    rows = [(i, [float(np.float32(e)) for e in v], "x", "y") for i, v in enumerate(base)]
    rows += rows[:7] + [(70 + i, rows[3][1], "x", "y") for i in range(20)]  # repeated rows, equal vectors
    rows += [(100, None, "x", "y"), (101, [1.0, None, 0.0, 0.0, 0.0], "x", "y"), (102, [float("nan")] * 5, "x", "y"), (103, [float("inf")] * 5, "x", "y"), (104, [], "x", "y")]
    rows += [(200 + i, [float(e) for e in rng.normal(0, 1, 3)], "x", "y") for i in range(9)] + [(None, [0.5, 0.25, 0.125], "x", "y")]
    rows += [(300 + i, [0.5 * i, 1.0, 0.25 * i * i, -1.0 * i, 0.0, 7.0, 1.0 * i], "x", "y") for i in range(6)]  # constant and dependent dimensions
    return rows + [(400, [2.0] * 18, "x", "y")]  # one vector: no spread


@pytest.mark.parametrize("sent", [1 << 21, 0])
def test_whitening(spark, sent):
    rows = cases()
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), sent=sent).collect()
    check(rows, got)


def test_large_entries(spark):
    """Deviations beyond a long, sums beyond two limbs."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(e) for e in rng.normal(0, 1, 2) * 2.0**34], "x", "y") for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, got)
    assert any(r.deviation is None for r in got)


def test_products_are_exact():
    rng = np.random.default_rng(7)
    for most in (10, 1 << 15, 1 << 20, 1 << 40):
        y = rng.integers(-most, most, (300, 4))
        want = np.array([[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(4)] for i in range(4)], object)
        assert (whitening.products(y) == want).all()


def test_empty(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "x", "y")], SCHEMA)).count() == 0


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(120).collect()]
    assert queries.op12_whitening(spark, sf).count() == 16 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
    got = whitening.whiten(spark.createDataFrame([(i, [float(e) for e in v], "", "") for i, v in rows], SCHEMA)).collect()
    check(rows, got)
