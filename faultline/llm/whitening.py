"""Operator 12: embedding whitening from an exact integer scatter.

Entries become integers x. The fit list is each distinct vector once. A task subtracts a shift, splits what is left into limbs
of 16 bits and multiplies limb by limb, so that every partial product is an integer below 2^53 and a float matrix product gives
it exactly; the sums and cross-products go on as integers of any size, row by row of the matrix, and are added up by length of
vector and row. Only n X'X - SS', the scatter times n, formed without any rounding, is turned to floats and decomposed by eigh.

Vectors of one length have a fit, a mean and components of their own. The identity error is measured, not derived: the
covariance of the whitened fit list, centred in each block before it is multiplied, blocks merged by their means.

A component whose eigenvalue is not above rounding (``_RANK`` times the largest) has no direction of its own: its rows are
returned with ``whitened`` null and ``explained`` 0, and the identity error is that of the others.

Cases: a row whose vector is null, or holds a null, NaN or infinite entry, is dropped; empty vectors have no component and so
no rows; repeated rows are returned each and count once in the fit; null ids are carried; an entry beyond ±2^46 is taken at
that bound; ``deviation`` is null where it exceeds a long and ``deviation_digits`` has it in full; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SCALE, OFFSET = 64, 1_000_000
_LARGEST = 1 << 46  # so that sums over a block stay within a long
_ROWS = 1 << 14  # of a block: 2^14 products of two 16-bit limbs stay below 2^53
_RANK = 1e-12
_SALTS = 32
_SENT = 1 << 21  # numbers of all models that are sent to the tasks; beyond that, models are joined


def integers(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """vec_id, dim, x (array of long) of each row whose vector is whole; ``row`` tells all rows apart."""
    c = F.col(f"`{column}`").cast("array<double>")
    v = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), c.alias("v"))
    whole = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    grid = lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(float(_LARGEST))), F.lit(-float(_LARGEST)))).cast("long") + OFFSET
    return v.where(F.col("v").isNotNull() & whole & (F.size("v") > 0)).select("vec_id", F.size("v").alias("dim"), F.transform("v", grid).alias("x"), F.monotonically_increasing_id().alias("row"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows of the batch, their x minus the shift) for each length, in blocks."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    x = batch.column("x")
    flat, off = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        for lo in range(0, len(rows), _ROWS):
            part = rows[lo : lo + _ROWS]
            yield dim, part, flat[off[part][:, None] + np.arange(dim)] - OFFSET


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y = sum of limbs * 2^(16 k), as float matrices; all but the last lie in 0 to 2^16."""
    out = []
    while True:
        if y.size == 0 or max(int(y.max()), -int(y.min())) < 1 << 16:
            return [*out, y.astype(np.float64)]
        out.append((y & 0xFFFF).astype(np.float64))
        y = y >> 16


def products(y: np.ndarray) -> np.ndarray:
    """y'y in integers of any size."""
    parts = limbs(y)
    total = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total += (a.T @ b).astype(np.int64).astype(object) << (16 * (i + j))
    return total


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and cross-products of a task's vectors: for each length one row for each row of the matrix, and part, the task."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() % _SALTS
    found: dict[int, list] = {}
    for batch in batches:
        for dim, _, y in _matrices(batch):
            n, s, p = found.get(dim, (0, 0, 0))
            found[dim] = (n + len(y), s + y.sum(0).astype(object), p + products(y))
    for dim, (n, s, p) in found.items():
        for i in range(dim):
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([str(n)]), pa.array([str(s[i])]), pa.array([[str(v) for v in p[i]]])], ["dim", "i", "part", "n", "s", "p"])


_SCATTER = "dim int, i int, part int, n string, s string, p array<string>"


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    first = frame.iloc[0]
    p = [0] * int(first.dim)
    for row in frame.p:
        p = [a + int(b) for a, b in zip(p, row)]
    return pd.DataFrame({"dim": [first.dim], "i": [first.i], "part": [0], "n": [str(sum(map(int, frame.n)))], "s": [str(sum(map(int, frame.s)))], "p": [[str(v) for v in p]]})


def _model(top: int):
    def decompose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        n, s = int(frame.n.iloc[0]), [int(v) for v in frame.s]
        # n * cross-products - product of sums: exact, and the same whatever was subtracted
        exact = [[n * int(v) - si * sj for v, sj in zip(row, s)] for si, row in zip(s, frame.p)]
        e, u = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in exact], np.float64))
        e, u = e[::-1][:top], u[:, ::-1][:, :top]
        trace = sum(exact[i][i] for i in range(len(s))) / (n * n)
        return pd.DataFrame({"dim": [len(s)], "n": [n], "s": [[str(v) for v in s]], "e": [e.tolist()], "trace": [trace], "u": [u.T.ravel().tolist()]})

    return decompose


_MODEL = "dim int, n long, s array<string>, e array<double>, trace double, u array<double>"


class Model:
    """What a task needs of one length's fit."""

    def __init__(self, row):
        self.n, self.s = int(row["n"]), np.array([int(v) for v in row["s"]], object)
        e, self.trace = np.array(row["e"]), float(row["trace"])
        self.rank = int((e > max(_RANK * e[0], 0.0)).sum())
        self.e, self.u = e, np.array(row["u"]).reshape(len(e), -1)
        self.wide = max([abs(int(v)) for v in self.s], default=0) >= 1 << 62

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n y - S, exact: long where that cannot overflow, else of any size."""
        most = max(int(y.max()), -int(y.min())) if y.size else 0
        if self.wide or self.n * most >= 1 << 62:
            return self.n * y.astype(object) - self.s
        return self.n * y - self.s.astype(np.int64)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Components that have a direction, over the root of their eigenvalues."""
        return (centred / self.n).astype(np.float64) @ self.u[: self.rank].T / np.sqrt(self.e[: self.rank])


def _moments(dim: int, models: dict[int, Model], y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    w = models[dim].whitened(models[dim].centred(y))
    mean = w.mean(0)
    return len(w), mean, (w - mean).T @ (w - mean)


def merged(a, b):
    """Number, mean and centred products of two blocks together."""
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


_ERROR = "dim int, part int, n long, mean array<double>, m2 array<double>"


def _error_row(dim: int, part: int, m) -> pd.DataFrame:
    return pd.DataFrame({"dim": [dim], "part": [part], "n": [m[0]], "mean": [m[1].tolist()], "m2": [m[2].ravel().tolist()]})


def _merged_rows(frame: pd.DataFrame) -> pd.DataFrame:
    total = None
    for r in frame.itertuples():
        total = merged(total, (int(r.n), np.array(r.mean), np.array(r.m2).reshape((len(r.mean),) * 2)))
    return _error_row(int(frame.dim.iloc[0]), 0, total)


def _identity(frame: pd.DataFrame) -> pd.DataFrame:
    r = _merged_rows(frame).iloc[0]
    k = len(r["mean"])
    off = np.array(r.m2).reshape(k, k) / r.n - np.eye(k)
    return pd.DataFrame({"dim": [r.dim], "identity_error": [float(abs(off).max()) if k else 0.0]})


_OUT = "vec_id long, component int, n long, deviation long, deviation_digits string, whitened double, explained double, dim int"
_NAMES = ["vec_id", "component", "n", "deviation", "deviation_digits", "whitened", "explained", "dim"]


def _rows_out(dim: int, ids: pa.Array, y: np.ndarray, model: Model) -> pa.RecordBatch:
    c, k = model.centred(y), len(model.e)
    if c.dtype != object and c.size and int(abs(c).max()) ** 2 * dim >= 1 << 62:
        c = c.astype(object)
    deviation = (c * c).sum(1).tolist()
    w = np.full((len(y), k), np.nan)
    w[:, : model.rank] = model.whitened(c)
    known = np.arange(k) < model.rank
    explained = np.where(known, model.e / model.trace if model.trace else 0.0, 0.0)
    rows = np.repeat(np.arange(len(y)), k)
    columns = [
        ids.take(pa.array(rows)),
        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
        pa.array(np.full(len(rows), model.n, np.int64)),
        pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()).take(pa.array(rows)),
        pa.array([str(v) for v in deviation]).take(pa.array(rows)),
        pa.array(w.ravel(), mask=~np.tile(known, len(y))),
        pa.array(np.tile(explained, len(y))),
        pa.array(np.full(len(rows), dim, np.int32)),
    ]
    return pa.record_batch(columns, _NAMES)


def fit(rows: DataFrame, top: int = 16) -> tuple[DataFrame, DataFrame]:
    """The fit list (dim, x; written) of what ``integers`` gives, and one row a length: its mean and components."""
    distinct = scratch.materialise(rows.select("dim", "x").distinct(), "fit-list")
    partial = distinct.mapInArrow(_scatter, _SCATTER).groupBy("dim", "i", "part").applyInPandas(_added, _SCATTER)
    summed = partial.groupBy("dim", "i").applyInPandas(_added, _SCATTER)
    return distinct, scratch.materialise(summed.groupBy("dim").applyInPandas(_model(top), _MODEL), "models")


def whiten(vectors: DataFrame, top: int = 16, column: str = "embedding", id_column: str = "vec_id", sent: int = _SENT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits, dim: a row for each whole vector
    and component. Models are sent to the tasks where all of them hold at most ``sent`` numbers; else each goes by a join to
    the blocks of rows of its length."""
    rows = scratch.materialise(integers(vectors, column, id_column), "integers")
    fit_list, models = fit(rows, top)
    numbers = models.agg(F.sum(F.size("s") * (F.size("e") + 1))).first()[0] or 0
    if numbers <= sent:
        known = {r["dim"]: Model(r) for r in models.collect()}  # at most ``sent`` numbers

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, found = TaskContext.get().partitionId() % _SALTS, {}
            for batch in batches:
                for dim, _, y in _matrices(batch):
                    found[dim] = merged(found.get(dim), _moments(dim, known, y))
            for dim, m in found.items():
                r = _error_row(dim, part, m).iloc[0]
                yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([m[0]], pa.int64()), pa.array([r["mean"]], pa.list_(pa.float64())), pa.array([r.m2], pa.list_(pa.float64()))], ["dim", "part", "n", "mean", "m2"])

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, at, y in _matrices(batch):
                    yield _rows_out(dim, batch.column("vec_id").take(pa.array(at)), y, known[dim])

        errors, out = fit_list.mapInArrow(moments, _ERROR), rows.mapInArrow(project, _OUT)
    else:
        sizes = scratch.materialise(rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / _ROWS)).cast("long").alias("blocks")), "blocks")
        blocks = lambda df, key: df.join(sizes, "dim").withColumn("block", F.pmod(key, "blocks")).drop("blocks")
        copies = models.join(sizes.toDF("dim", "copies"), "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))

        def moments_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty:
                return pd.DataFrame(columns=["dim", "part", "n", "mean", "m2"])
            dim = int(left.dim.iloc[0])
            return _error_row(dim, int(left.block.iloc[0]) % _SALTS, _moments(dim, {dim: Model(right.iloc[0])}, np.stack(left.x) - OFFSET))

        def project_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty:
                return pd.DataFrame(columns=_NAMES)
            ids = pa.array(left.vec_id.astype("Int64"), pa.int64())
            return _rows_out(int(left.dim.iloc[0]), ids, np.stack(left.x) - OFFSET, Model(right.iloc[0])).to_pandas(integer_object_nulls=True)

        by_block = copies.groupBy("dim", "block")
        errors = blocks(fit_list, F.xxhash64("x")).groupBy("dim", "block").cogroup(by_block).applyInPandas(moments_of, _ERROR)
        out = blocks(rows, F.xxhash64("row")).groupBy("dim", "block").cogroup(by_block).applyInPandas(project_of, _OUT)
    errors = errors.groupBy("dim", "part").applyInPandas(_merged_rows, _ERROR).groupBy("dim").applyInPandas(_identity, "dim int, identity_error double")
    out = out.join(scratch.materialise(errors, "errors"), "dim")
    return out.select(*_NAMES[:4], "whitened", "explained", "identity_error", "deviation_digits", "dim")
