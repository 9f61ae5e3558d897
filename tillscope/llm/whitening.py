"""Embedding whitening by a distributed covariance and mixed-precision
eigenvectors.

1. Sums of the integer entries ``x = floor(1024 * c) + 100000`` are added up in
   tasks and by Spark; a second pass adds up the products of entries less their
   rounded mean. Both are whole numbers without rounding, so the covariance is
   that of all rows whatever their order.
2. Eigenvectors start in single precision and are corrected by Ogita-Aishima
   iterations (matrix products only) in double, then in extended precision.
   Eigenvalues closer than the iteration can tell apart form a cluster; a small
   eigenproblem of the shifted matrix inside each cluster separates them.
3. Every row is centred exactly, projected and divided by the eigenvalue's
   root; the covariance of what comes out is measured over all rows.

Vectors are whitened among those of their own length, each length with its own
fit list; what travels per task and reaches the driver is a matrix of a length
by itself, never rows.

Nulls and ties: a vector that is null, is empty, or holds a null or non-finite
entry is dropped, and so is one with an entry whose x is outside +-2**62.
Repeated rows and null ids count and are returned each. A vector of fewer than
``k`` entries has that many components. A component without variance (its
eigenvalue is not above rounding) has whitened null and explained 0, or null
if there is no variance at all, and is left out of the identity error. Where a
deviation is over a long, ``deviation`` is null and ``deviation_exact`` (a
decimal) has it up to 38 digits. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import land

#: Fixed values of the entries' transform.
SCALE, SHIFT = 1024, 100_000
#: Largest magnitude of x, and of sums that numpy may hold in 64 bits.
LARGEST, SAFE = 2.0**62, 2.0**62
#: Whole numbers below this are exact in a double, sums in a matrix product too.
EXACT = 2.0**53
ROWS = 4096


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and the entries as doubles, without the rows to drop."""
    e = F.col("embedding")
    ok = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < LARGEST / SCALE))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(
        e.isNotNull() & (F.size(e) > 0) & ok
    )


def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, x as int64) of the rows of each length, in pieces."""
    col = batch.column(batch.schema.get_field_index("embedding"))
    size = np.diff(col.offsets.to_numpy())
    flat, start = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()[:-1]
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        for at in range(0, len(rows), step := max(1, ROWS * 64 // int(d))):
            some = rows[at : at + step]
            c = flat[start[some][:, None] + np.arange(d)]
            yield int(d), some, np.floor(SCALE * c).astype(np.int64) + SHIFT


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums by column, as Python numbers."""
    wide = float(np.abs(x).max(initial=0)) * len(x) >= SAFE
    return (x.astype(object) if wide else x).sum(0).astype(object)


def products(y: np.ndarray) -> np.ndarray:
    """y' y as Python numbers, exact: in doubles as far as they hold all sums."""
    top = float(np.abs(y).max(initial=0)) ** 2
    if top >= EXACT:
        y = y.astype(object)
        return y.T @ y
    step = max(1, int(EXACT / max(top, 1.0)) - 1)
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), step):
        f = y[at : at + step].astype(np.float64)
        out = out + (f.T @ f).astype(np.int64).astype(object)
    return out


SUMS = "d int, i int, n long, row array<string>"
ROW = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("row", pa.list_(pa.string()))])


def _rows_of(table: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One row for each length and matrix row; whole numbers of any size as text."""
    for d, (n, m) in table.items():
        for i, row in enumerate(m):
            yield pa.RecordBatch.from_pylist([{"d": d, "i": i, "n": n, "row": [str(v) for v in row]}], ROW)


def _added(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Per length the number of vectors and the matrix of exact totals."""
    whole = lambda r: np.array([int(v) for v in r["row"]], object)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                old = sums.setdefault((r["d"], r["i"]), [0, 0])
                old[0] += r["n"]
                old[1] = old[1] + whole(r)
        for (d, i), (n, v) in sums.items():
            yield pa.RecordBatch.from_pylist([{"d": d, "i": i, "n": n, "row": [str(t) for t in v]}], ROW)

    out: dict[int, tuple[int, dict]] = {}
    for r in rows.repartition("d", "i").mapInArrow(add, SUMS).collect():  # a row per length and dimension
        out.setdefault(r["d"], (r["n"], {}))[1][r["i"]] = whole(r)
    return {d: (n, np.array([m[i] for i in sorted(m)], object)) for d, (n, m) in out.items()}


def sums_of(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Per length: n and S."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, rows, x in parts(batch):
                n, s = table.get(d, (0, 0))
                table[d] = (n + len(rows), s + column_sums(x)[None, :])
        yield from _rows_of(table)

    return {d: (n, m[0]) for d, (n, m) in _added(vectors.select("embedding").mapInArrow(run, SUMS)).items()}


def covariances(vectors: DataFrame, sums: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Per length the matrix n * sum(y y') - s s' of whole numbers, n * n times
    the covariance; y are entries less the rounded mean, s their sums."""
    middle = {d: np.array([(2 * int(v) + n) // (2 * n) for v in s], np.int64) for d, (n, s) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, rows, x in parts(batch):
                n, m = table.get(d, (0, 0))
                table[d] = (n + len(rows), m + products(x - middle[d]))
        yield from _rows_of(table)

    out = {}
    for d, (n, m) in _added(vectors.select("embedding").mapInArrow(run, SUMS)).items():
        s = sums[d][1] - n * middle[d].astype(object)
        out[d] = n * m - np.outer(s, s)
    return out


def extended(whole: np.ndarray, divisor: int) -> np.ndarray:
    """whole / divisor in extended precision (two doubles added up)."""
    flat = []
    for v in whole.ravel():
        q = Fraction(int(v), divisor)
        high = float(q)
        flat.append(np.longdouble(high) + np.longdouble(float(q - Fraction(high))))
    return np.array(flat, np.longdouble).reshape(whole.shape)


def clusters(value: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of positions whose sorted values follow within ``gap``, of two or more."""
    order = np.argsort(value, kind="stable")
    cut = np.flatnonzero(np.diff(value[order]) > gap) + 1
    return [run for run in np.split(order, cut) if len(run) > 1]


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Ogita-Aishima iterations on approximate eigenvectors ``x`` of ``a``, in
    the precision of ``a``; (values, vectors). Columns whose values the current
    error can't tell apart are only made orthonormal by the iteration; a
    sub-solve of a - mu within each such cluster then turns them."""
    kind = a.dtype
    eps = float(np.finfo(kind).eps)
    norm = float(np.abs(a).sum(1).max())
    x = x.astype(kind)
    eye = np.eye(len(a), dtype=kind)
    value = np.zeros(len(a), kind)
    if norm == 0:
        return value, eye
    last = np.inf
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        value = np.diag(s) / (1 - np.diag(r))
        off = float(np.linalg.norm((s - np.diag(value)).astype(np.float64), 2))
        delta = 2 * (off + norm * float(np.linalg.norm(r.astype(np.float64), 2)))
        apart = value[None, :] - value[:, None]
        e = np.where(np.abs(apart) > delta, (s + r * value[None, :]) / np.where(apart == 0, 1, apart), r / 2)
        x = x + x @ e
        step = float(np.abs(e).max())
        turned = False
        for group in clusters(value, delta):
            mu = value[group].mean()
            some = x[:, group]
            inner = some.T @ (a @ some - mu * some)
            size = float(np.abs(inner).max())
            if size > 8 * eps * norm * len(a) ** 0.5:  # else one value as far as the precision goes
                turn = np.linalg.eigh(((inner + inner.T) / 2 / size).astype(np.float64))[1].astype(kind)
                x[:, group] = some @ turn
                turned = True
        if not turned and (step < 4 * eps or step >= last / 2 and step < 64 * eps * len(a)):
            break
        last = step
    x = x + x @ ((eye - x.T @ x) / 2)
    s = x.T @ (a @ x)
    return np.diag(s) / np.diag(x.T @ x), x


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; the entry largest
    in size is positive) of a symmetric matrix in extended precision."""
    top = float(np.abs(a).max(initial=0))
    scaled = a / np.longdouble(top) if top else a
    x = np.linalg.eigh(scaled.astype(np.float32))[1]
    value, x = refine(scaled.astype(np.float64), x)
    value, x = refine(scaled, x, rounds=4)
    order = np.argsort(-value, kind="stable")
    value, x = value[order] * np.longdouble(top or 1), x[:, order]
    x = x / np.sqrt((x * x).sum(0))
    return value, x * np.where(x[np.abs(x).argmax(0), np.arange(len(a))] < 0, -1, 1)


class Whitening:
    """Of one length: n, S, the unit components with their roots, and shares."""

    def __init__(self, n: int, s: np.ndarray, whole: np.ndarray, k: int):
        v = extended(whole, n * n)
        value, x = eigen(v)
        trace = np.trace(v)
        self.n, self.s, self.k = n, s, min(k, len(s))
        self.wide = max(abs(int(t)) for t in s) >= SAFE
        self.sums = s if self.wide else s.astype(np.int64)
        real = value[: self.k] > trace * len(s) * np.longdouble(2.0**-50)
        self.real = real.astype(bool)
        root = np.sqrt(np.where(real, value[: self.k], 1))
        self.project = (x[:, : self.k] / root).astype(np.float64)
        self.explained = [float(max(t, 0) / trace) if r else 0.0 for t, r in zip(value, real)] if trace > 0 else [None] * self.k

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(rows, k) whitened entries and the exact deviations."""
        if self.wide or float(np.abs(x).max(initial=0)) * self.n + float(np.abs(self.sums).max()) >= SAFE:
            q = x.astype(object) * self.n - self.s
        else:
            q = x * self.n - self.sums
        far = float(np.abs(q).max(initial=0)) ** 2 * x.shape[1] >= SAFE
        exact = q.astype(object) if far else q
        centred = (q / self.n).astype(np.float64)
        return centred @ self.project, [int(t) for t in (exact * exact).sum(1)]


def fit(vectors: DataFrame, k: int) -> dict[int, Whitening]:
    """One model a length, from all rows of ``vectors``."""
    sums = sums_of(vectors)
    return {d: Whitening(sums[d][0], sums[d][1], whole, k) for d, whole in covariances(vectors, sums).items()} if sums else {}


def identity_errors(rows: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Per length the largest absolute entry of the covariance of ``w`` less
    the identity: means first, then products of centred entries, over all rows."""
    k = max((m.k for m in models.values()), default=0)
    means = rows.groupBy("d").agg(F.array(*(F.avg(F.get("w", F.lit(i))) for i in range(k))).alias("mean"))
    centred = rows.join(F.broadcast(means), "d").select(  # a row per length
        "d", *((F.get("w", F.lit(i)) - F.get("mean", F.lit(i))).alias(f"w{i}") for i in range(k))
    )
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = centred.groupBy("d").agg(*(F.avg(F.col(f"w{i}") * F.col(f"w{j}")).alias(f"c{i}_{j}") for i, j in pairs)) if k else None
    out = {}
    for row in found.collect() if k else []:
        off = [abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs if row[f"c{i}_{j}"] is not None]
        out[row["d"]] = max(off, default=None)
    return out


def whiten(spark: SparkSession, embeddings: DataFrame, k: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error,
    deviation_exact: a row for each usable vector and component up to ``k``."""
    vectors = usable(embeddings)
    models = fit(vectors, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for d, rows, x in parts(batch):
                m = models[d]
                w, deviation = m(x)
                flat = pa.array(w.ravel(), mask=np.tile(~m.real, len(w)))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)),
                     pa.array([str(t) if t < 10**38 else None for t in deviation], pa.string()),
                     pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), flat)],
                    names=["vec_id", "d", "deviation", "w"],
                )

    rows = land(spark, vectors.mapInArrow(run, "vec_id long, d int, deviation string, w array<double>"), "whitened")
    error = identity_errors(rows, models)
    facts = [(d, m.n, j + 1, m.explained[j], error.get(d)) for d, m in models.items() for j in range(m.k)]
    facts = spark.createDataFrame(facts, "d int, n long, component int, explained double, identity_error double")
    out = rows.select("vec_id", "d", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    exact = F.col("deviation").cast("decimal(38,0)")
    return out.join(F.broadcast(facts), ["d", "component"]).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation as long)").alias("deviation"), "whitened", "explained", "identity_error",
        exact.alias("deviation_exact"),
    )
