"""Helpers of the operators on embeddings: whole-number vectors, blocks of them as bytes, exact products, best scores.

Components are whole numbers of 64 bits, and scores are sums of their products modulo 2**64: exact wherever the score
fits a long, whatever happens in between. Components beyond a long are cut to its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import if_few, stored

EXACT = 2.0**53  # below it every whole number is a double


def whole(vector: Column, factor: int, add: int = 0) -> Column:
    """floor(factor * component) + add, as array<long>."""
    return F.transform(vector, lambda e: (F.floor(e.cast("double") * F.lit(float(factor))) + F.lit(add)).cast("long"))


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def first_of_each(df: DataFrame, key: str) -> DataFrame:
    """df with one row of those that share key: the smallest by all other columns, in their order. Rows of other keys aren't shuffled."""
    shared = stored(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "shared")
    if shared.isEmpty():
        return df
    rest = [c for c in df.columns if c != key]
    few = if_few(shared)
    once = df.join(few, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))
    return df.join(few, key, "left_anti").unionByName(once)


def ranked(found: DataFrame, keys: list[str], most: int, score: str, tie: str) -> DataFrame:
    """The first rows of each key, higher scores first, with their rank. Spark cuts each task's rows before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def to_bytes(values: np.ndarray) -> bytes:
    """Whole numbers in 4 bytes each if all fit, else in 8."""
    small = not values.size or (values.min() >= -(1 << 31) and values.max() < 1 << 31)
    return np.ascontiguousarray(values, "<i4" if small else "<i8").tobytes()


def from_bytes(raw: bytes, rows: int, columns: int) -> np.ndarray:
    wide = len(raw) > 4 * rows * columns
    return np.frombuffer(raw, "<i8" if wide else "<i4").reshape(rows, columns).astype(np.int64)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers. Doubles are used where no sum can leave the range in which they are exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a.astype(np.float64)).max() * np.abs(b.astype(np.float64)).max() * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, fit: np.ndarray, most: int) -> np.ndarray:
    """Of the places fit, those of the highest scores, ties to smaller ids."""
    if len(fit) > most:
        own = scores[fit]
        fit = fit[own >= np.partition(own, len(own) - most)[len(own) - most]]
    return fit[np.lexsort((ids[fit], ~scores[fit]))[:most]]


def by_key(batches, *keys: str) -> Iterator[tuple[tuple, dict]]:
    """Rows one after another, each with its key. A batch holds about four megabytes, or one row."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        for at, key in enumerate(zip(*columns, strict=True)):
            yield key, {name: batch.column(c)[at].as_py() for c, name in enumerate(batch.schema.names) if name not in keys}


def parts_for(df: DataFrame, units: int, each: int) -> int:
    """Partitions for so many units of work, each of them a few megabytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-units // each)))
