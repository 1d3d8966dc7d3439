"""Operator 13: whitening of embeddings from a compensated covariance.

Each component becomes a whole number x. The fit list holds every x vector once; with its number n and its sums S, n*x - S is the
centred vector times n, exactly. Outer products of centred vectors are accumulated in double-double: each product and each sum is split
into its double and the exact error of it (error-free transformations), in a fixed tree of pairs within a batch. A task gives
a row for each row of the matrix, with its high and low parts; the parts of all tasks are merged in the same arithmetic, row by row of
the matrix, so that no task holds more than one row of each. The matrix that results has the size of the dimensions alone. Its
eigenvectors come from LAPACK's syevd on the driver: reduction to a tridiagonal matrix, then divide and conquer.

The covariance of the whitened fit list is accumulated in the same way, centred by its own means, and compared with the identity.

Rows whose vector is null or holds null or non-finite entries take no part. Vectors of another length than the commonest one (of
several, the longest) can't share a covariance and take no part either. Repeated rows, rows of one vec_id and rows without vec_id each keep their own result rows; the fit
list has equal vectors once. Components without variance (an eigenvalue below RANK of the largest) can't be whitened and are
left out, so vectors that are all alike, one vector alone, and an empty table give no rows. A deviation beyond a long is null. Components beyond a long are cut to its
limits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_groups
from .vectors import finite, matrix, whole

FACTOR, SHIFT = 64, 1_000_000
COMPONENTS = 16
RANK = 1e-13  # of the largest eigenvalue
CELLS = 1 << 17  # products that a batch accumulates at once, about
_SPLIT = float((1 << 27) + 1)
PART = "i int, task long, high binary, low binary"

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b as its double and the exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> Pair:
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b as its double and the exact error."""
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(terms: Pair) -> Pair:
    """The sum over the first axis, in a tree of pairs."""
    high, low = terms
    while len(high) > 1:
        half = len(high) // 2
        h, e = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = (h, e) if len(high) % 2 == 0 else (np.concatenate([h, high[-1:]]), np.concatenate([e, low[-1:]]))
    return high[0], low[0]


def outer(high: np.ndarray, low: np.ndarray) -> Pair:
    """The sum of the rows' outer products, as its upper triangle; rows are double-doubles."""
    d = high.shape[1]
    i, j = np.triu_indices(d)
    now = (np.zeros(len(i)), np.zeros(len(i)))
    step = max(1, CELLS // max(1, len(i)))
    for at in range(0, len(high), step):
        h, e = high[at : at + step], low[at : at + step]
        p, error = two_product(h[:, i], h[:, j])
        if e.any():
            error = error + (h[:, i] * e[:, j] + e[:, i] * h[:, j])
        now = add(now, total((p, error)))
    return now


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _products(centre: Callable, dims: int) -> Callable:
    """A task's rows: for each row of the matrix its part of the sum of outer products, from the diagonal on."""

    def run(batches):
        now = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                if (part := batch.slice(at, 1024)).num_rows:
                    own = outer(*centre(part))
                    now = own if now is None else add(now, own)
        if now is None:
            return
        at = 0
        for i in range(dims):
            own = [x[at : at + dims - i].astype("<f8").tobytes() for x in now]
            at += dims - i
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_task()], pa.int64()), pa.array([own[0]], pa.binary()), pa.array([own[1]], pa.binary())], names=["i", "task", "high", "low"])

    return run


def _merge(batches):
    """Parts of the matrix's rows, sorted by row and task: their sums."""
    now, row = None, None

    def out():
        return pa.RecordBatch.from_pylist([{"i": row, "task": 0, "high": now[0].tobytes(), "low": now[1].tobytes()}], schema=pa.schema([("i", pa.int32()), ("task", pa.int64()), ("high", pa.binary()), ("low", pa.binary())]))

    for batch in batches:
        for i, high, low in zip(*(batch.column(c).to_pylist() for c in ("i", "high", "low")), strict=True):
            own = (np.frombuffer(high, "<f8"), np.frombuffer(low, "<f8"))
            if i != row:
                if row is not None:
                    yield out()
                row, now = i, own
            else:
                now = add(now, own)
    if row is not None:
        yield out()


def compensated(rows: DataFrame, centre: Callable, dims: int) -> Pair:
    """The sum of outer products of the centred vectors that centre makes of Arrow batches of rows, high and low parts."""
    parts = rows.mapInArrow(_products(centre, dims), PART)
    merged = parts.repartition("i").sortWithinPartitions("i", "task").mapInArrow(_merge, PART)
    high, low = np.zeros((dims, dims)), np.zeros((dims, dims))
    for r in merged.collect():  # a row for each dimension
        for whole_matrix, raw in ((high, r.high), (low, r.low)):
            own = np.frombuffer(raw, "<f8")
            whole_matrix[r.i, r.i :] = whole_matrix[r.i :, r.i] = own
    return high, low


def divided(sums: Pair, by: int, times: int) -> np.ndarray:
    """The double-double sums over a whole number, times times, rounded once at the end."""
    high, low = sums
    for _ in range(times):
        q = high / by
        p, e = two_product(q, np.full_like(q, float(by)))
        high, low = two_sum(q, ((high - p) - e + low) / by)
    return high + low


def eigen(covariance: np.ndarray) -> Pair:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest entry positive."""
    values, vectors = np.linalg.eigh(covariance)  # syevd: tridiagonal form, divide and conquer
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _centred(n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """n * x - S of whole vectors: exact in longs, or in Python's integers where longs don't suffice."""
    big = [n * int(s) for s in sums]  # only to tell sizes

    def centred(x: np.ndarray) -> np.ndarray:
        if x.size and max(abs(int(x.min())), abs(int(x.max()))) * n < 1 << 62 and max(map(abs, big), default=0) < n << 62:
            return x * np.int64(n) - np.array([int(s) for s in sums], np.int64)
        return x.astype(object) * n - np.array([int(s) for s in sums], object)

    return centred


def _pair(z: np.ndarray) -> Pair:
    """Whole numbers as double-doubles."""
    high = z.astype(np.float64)
    if not z.size or np.abs(high).max() < 2.0**53:
        return high, np.zeros_like(high)
    return high, (z.astype(object) - np.array([[int(h) for h in row] for row in high], object).reshape(z.shape)).astype(np.float64)


def _deviations(z: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exact; null beyond a long."""
    if z.dtype != object and (not z.size or float(np.abs(z).max()) ** 2 * z.shape[1] < 2.0**62):
        return (z * z).sum(axis=1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in z]
    return [s if s < 1 << 63 else None for s in sums]


def _sums(dims: int) -> Callable:
    """A task's number of rows and sums, as rows (d, n, s); d -1 counts. Sums go through halves that can't overflow."""

    def run(batches):
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            n += len(x)
            high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([n, *high.tolist()], pa.int64()), pa.array([0, *low.tolist()], pa.int64())], names=["d", "high", "low"])

    return run


def _projected(x: np.ndarray, n: int, centred: Callable, scaled: np.ndarray) -> Pair:
    """Centred whole vectors and their whitened components."""
    z = centred(x)
    return z, (z.astype(np.float64) / n) @ scaled


def whitened(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", factor: int = FACTOR, shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that takes part and every component."""
    spark, column = vectors.sparkSession, F.col(vector)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows: DataFrame = vectors.where(finite(column)).select(F.col(vec_id).cast("long").alias("vec_id"), whole(column, factor, shift).alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None or length.d == 0:
        return spark.createDataFrame([], out)
    dims = length.d
    rows = rows.where(F.size("x") == dims)
    fit = stored(rows.select("x").distinct(), "fit")
    counted = {r.d: r for r in fit.mapInArrow(_sums(dims), "d int, high long, low long").groupBy("d").agg(F.sum(wide("high")).alias("high"), F.sum(wide("low")).alias("low")).collect()}
    n = int(counted[-1].high)
    sums = np.array([(int(counted[d].high) << 32) + int(counted[d].low) for d in range(dims)], object)
    centred = _centred(n, sums)
    covariance = divided(compensated(fit, lambda batch: _pair(centred(matrix(batch.column("x"), dims))), dims), n, 3)
    values, axes = eigen(covariance)
    kept = min(components, int((values > RANK * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    if not kept:
        return spark.createDataFrame([], out)
    scaled, explained = axes[:, :kept] / np.sqrt(values[:kept]), (values[:kept] / values.sum()).tolist()

    # the covariance of the whitened fit list, centred by its own means
    def means(batches):
        now = (np.zeros(kept), np.zeros(kept))
        for batch in batches:
            if batch.num_rows:
                w = _projected(matrix(batch.column("x"), dims), n, centred, scaled)[1]
                now = add(now, total((w, np.zeros_like(w))))
        yield pa.RecordBatch.from_arrays([pa.array(range(kept), pa.int32()), pa.array(now[0]), pa.array(now[1])], names=["c", "high", "low"])

    mean = np.zeros(kept)
    for r in fit.mapInArrow(means, "c int, high double, low double").groupBy("c").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        mean[r.c] = (r.high + r.low) / n

    def about_mean(batch) -> Pair:
        w = _projected(matrix(batch.column("x"), dims), n, centred, scaled)[1]
        return two_sum(w, -mean)

    error = float(np.abs(divided(compensated(fit, about_mean, kept), n, 1) - np.eye(kept)).max())

    def result(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                z, w = _projected(matrix(part.column("x"), dims), n, centred, scaled)
                of = np.repeat(np.arange(len(z)), kept)
                columns = [part.column("vec_id").take(pa.array(of)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(z))), pa.array(np.full(len(of), n)), pa.array(_deviations(z), pa.int64()).take(pa.array(of))]
                columns += [pa.array(w.reshape(-1)), pa.array(explained * len(z), pa.float64()), pa.array(np.full(len(of), error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(result, out)


def wide(name: str) -> Column:
    return F.col(name).cast("decimal(38,0)")
