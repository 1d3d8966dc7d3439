"""Helpers shared by the operators: inputs, the shared folder, words, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of lower-cased text: ASCII letters and digits, and every code point from U+0080 on.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
KEYS = 2_000_000  # rows of 8 or 16 bytes that are broadcast at most
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TABLE = {ord(c): c.lower() for c in _UPPER}


#: What workers remember between tasks: vocabularies and the like. A worker goes on to other operators' tasks.
_remembered: list[dict] = []


def remembered(cache: dict) -> dict:
    _remembered.append(cache)
    return cache


def give_back(keep: dict | None = None) -> None:
    """Empties what other operators left in this worker, if anything, and returns the memory."""
    others = [c for c in _remembered if c is not keep and c]
    for c in others:
        c.clear()
    if others:
        gc.collect()
        _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local tests a new one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            current = spark.sparkContext.getCheckpointDir()
        path = current
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_few(keys: DataFrame, most: int = KEYS) -> DataFrame:
    """keys (a stored table) marked for a broadcast if they are counted to be few; else left to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= most else keys


def one_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """df with one row of those that share all keys; rows with a null key stay. Rows that share none are not shuffled."""
    known = df.where(" and ".join(f"{k} is not null" for k in keys))
    shared = stored(known.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys), "shared")
    if shared.isEmpty():
        return df
    few = if_few(shared)
    once = df.join(few, list(keys), "left_semi").dropDuplicates(list(keys))
    return df.join(few, list(keys), "left_anti").select(*df.columns).unionByName(once.select(*df.columns))


def lower_ascii_col(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. lower() is the same, and faster, on pure ASCII."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def lower_ascii(text: str | None) -> str:
    if not text:
        return ""
    # of bytes, lower() changes A-Z alone, which no longer character holds; a translation would look each character up
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(text: str | None) -> list[str]:
    return _WORD.findall(lower_ascii(text))


def slices(batches, rows: int = 512, *, column: int | None = None, size: int = 2 << 20):
    """Arrow batches cut to few rows, and to about size bytes of a column of texts (or one text, if it is longer),
    so that a worker holds little as Python objects at once, however long the texts are."""
    for batch in batches:
        if column is None:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(total, before + size, side="right"))))
            yield batch.slice(at, end - at)
            at = end
    _trim()  # a worker goes on to other stages


def verdicts(texts: pa.Array, judge) -> pa.Array:
    """judge's booleans for texts, which it gets a slice at a time."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    found = [pa.array(judge(own.column(0).to_pylist()), pa.bool_()) for own in slices([batch], column=0)]
    return pa.concat_arrays(found) if found else pa.array([], pa.bool_())


def whole_groups(batches, *keys: str):
    """Tables of all rows that share keys, one after another; the rows come sorted by them, and each group is small."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        table = pa.Table.from_batches([batch])
        for s, e in zip(starts, starts[1:], strict=False):
            part = table.slice(s, e - s)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)
    _trim()
