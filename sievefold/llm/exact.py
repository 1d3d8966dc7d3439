"""Operator 5: exact duplicates through an extendible-hash index on shared files; DataFrame functions only.

A text's key is the 64-bit hash of its normalised form. The directory addresses buckets by leading bits of the key:
while a bucket holds more than CAPACITY distinct keys, the directory doubles and the bucket splits, as deep as it
takes. Every row finds its bucket in the directory. Owner tasks each hold a range of buckets and keys: they sort
the texts of a key, compare them byte by byte, and chain those that differ as entries of their own. A row then reads
its bucket's chain and takes the entry of its text; no other way leads to an entry.

Only keys that several rows share have texts to compare: they alone have entries, and their texts alone are shuffled. How many
rows the entries stand for is known from the keys, and an index that lost some is an error, not a document kept. Copies are
pre-aggregated where they are read: a text that a third of the rows hold reaches the shuffle once per task.

Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest
doc_id stays; a null doc_id is smaller than any. Of rows equal in id and text one stays, the others
are copies like any other. Very long texts are compared whole. An empty table gives an empty result. Columns other
than id and text, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEYS, if_few, lower_ascii_col, one_of_each, stored

CAPACITY = 1 << 17  # keys of a bucket, some 10 MB of entries
OWNERS = 4096  # owner tasks at most; each then holds more buckets
BUCKETS = 1 << 19  # about so many at most; beyond it they hold more keys, so that the directory stays small
TOGETHER = 1 << 16  # copies of one text under one id that are written out by one task


def split(counts: dict[int, int], bits: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Buckets (depth, leading bits at that depth) in the order of their keys; counts: leading bits -> keys.

    A bucket that bits bits can't split further stays overfull.
    """
    levels: list[dict[int, int]] = [defaultdict(int) for _ in range(bits)] + [counts]
    for d in range(bits, 0, -1):
        for p, n in levels[d].items():
            levels[d - 1][p >> 1] += n
    out, todo = [], [(0, 0)]
    while todo:
        d, p = todo.pop()
        if d < bits and levels[d].get(p, 0) > capacity:
            todo += [(d + 1, 2 * p + 1), (d + 1, 2 * p)]
        else:
            out.append((d, p))
    return out


@dataclass
class Directory:
    """2**depth slots, each the address of a bucket; a bucket of less depth has several slots."""

    depth: int
    slots: DataFrame  # slot, bucket, local_depth

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (with key) and the bucket that each key belongs to."""
        slot = F.shiftrightunsigned("key", 64 - self.depth) if self.depth else F.lit(0).cast("long")
        few = 1 << self.depth <= KEYS
        return rows.withColumn("slot", slot).join(F.broadcast(self.slots) if few else self.slots, "slot").drop("slot")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> Directory:
    """From a table of distinct keys. The driver gets the counts of about twice as many prefixes as there are buckets."""
    n = keys.count()
    capacity = max(capacity, n // BUCKETS)
    bits = max(1, math.ceil(math.log2(max(1, n / capacity))) + 1)
    while True:
        lead = F.shiftrightunsigned("key", 64 - bits)
        counts = {r["lead"]: r["n"] for r in keys.groupBy(lead.alias("lead")).agg(F.count("*").alias("n")).collect()}
        buckets = split(counts, bits, capacity)
        # keys are hashes: a few more bits split any bucket but one of keys that are the same in all bits
        if bits >= 62 or not any(d == bits and counts.get(p, 0) > capacity for d, p in buckets):
            break
        bits += 1
    depth = max(d for d, _ in buckets)
    rows = [(k, d, p << (depth - d), ((p + 1) << (depth - d)) - 1) for k, (d, p) in enumerate(buckets)]
    slots = keys.sparkSession.createDataFrame(rows, "bucket int, local_depth int, low long, high long")
    return Directory(depth, slots.select(F.explode(F.sequence("low", "high")).alias("slot"), "bucket", "local_depth"))


@dataclass
class Index:
    directory: Directory
    entries: DataFrame  # bucket, local_depth, key, nth (place in the key's chain), sha, keep_id, n
    shared: int  # rows that the entries stand for
    hottest: int  # rows of the most frequent key


def build_index(docs: DataFrame, *, capacity: int = CAPACITY, few: int = KEYS) -> Index:
    """An entry per distinct text, on shared files. docs: doc_id, text."""
    norm = docs.select("doc_id", lower_ascii_col(F.col("text")).alias("body")).select("doc_id", F.xxhash64("body").alias("key"), "body")
    keys = stored(norm.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")), "keys")
    known = directory(keys, capacity)
    owners = max(1, min(known.slots.select("bucket").distinct().count(), OWNERS))
    # all texts of keys that several rows share, one row per distinct text
    several = stored(keys.where("n > 1").select("key"), "several")
    grouped = lambda rows: rows.groupBy("key", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    # too many keys for a broadcast: copies are pre-aggregated before the join, so that a hot text is one row there
    texts = grouped(norm.join(F.broadcast(several), "key")) if several.count() <= few else grouped(norm).join(several, "key")
    owned = known.placed(texts).repartitionByRange(owners, "bucket", "key")
    chain = Window.partitionBy("bucket", "key").orderBy("body")  # by owner tasks: nothing is shuffled again
    chained = owned.withColumn("nth", F.dense_rank().over(chain) - 1)
    cols = ["bucket", "local_depth", "key", "nth", "sha", "keep_id", "n"]
    entries = chained.withColumn("sha", F.sha2("body", 256)).select(cols)
    total = keys.agg(F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("shared"), F.max("n").alias("hottest")).first()
    return Index(known, stored(entries.sortWithinPartitions("bucket", "key", "nth"), "index"), total.shared or 0, total.hottest or 0)


def look_up(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (doc_id, text), by the entries of its bucket."""
    held = index.entries.agg(F.sum("n")).first()[0] or 0
    if held != index.shared:
        raise RuntimeError(f"the index has entries for {held} of {index.shared} rows")
    rows = docs.select("doc_id", lower_ascii_col(F.col("text")).alias("body")).select("doc_id", F.xxhash64("body").alias("key"), F.sha2("body", 256).alias("sha"))
    # copies of one text under one id go as one row with their number: all but one are dropped. The join
    # is left with nothing above it that needs a key's rows together, so that Spark may split a hot text
    rows = index.directory.placed(rows.groupBy("doc_id", "key", "sha").agg(F.count("*").alias("copies")))
    rows = rows.join(index.entries.select("bucket", "key", "sha", "keep_id", "n"), ["bucket", "key", "sha"], "left")
    if index.hottest > TOGETHER:  # copies under one id may be very many: they are written out in pieces, by several tasks
        pieces = F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / TOGETHER))
        rows = rows.withColumn("piece", F.explode(pieces)).repartition("doc_id", "sha", "piece")
        rows = rows.withColumn("copies", F.least(F.lit(TOGETHER), F.col("copies") - F.col("piece") * TOGETHER))
    else:
        rows = rows.withColumn("piece", F.lit(0))
    first = F.when(F.col("piece") == 0, 1).otherwise(2)  # the first copy of the first piece may be the one that stays
    rows = rows.withColumn("nth", F.explode(F.sequence(first, F.col("copies").cast("int") + first - 1)))
    keep = F.when(F.col("n").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return look_up(own, build_index(own, capacity=capacity))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates drops; all columns stay."""
    id_, sha = F.col("doc_id").cast("long"), F.sha2(lower_ascii_col(F.col("text")), 256)
    other = exact_duplicates(docs).where("not kept and not (doc_id <=> keep_id)")
    # a name of 16 bytes for each row to drop; rows that share id and text share it
    names = [F.xxhash64(id_, sha).alias("_own"), F.xxhash64(sha, id_).alias("_own2")]
    gone = stored(other.select(F.xxhash64("doc_id", "text_sha256").alias("_own"), F.xxhash64("text_sha256", "doc_id").alias("_own2")).distinct(), "gone")
    left = docs.withColumns({"_own": names[0], "_own2": names[1]}).join(if_few(gone), ["_own", "_own2"], "left_anti")
    return one_of_each(left, "_own", "_own2").select(*docs.columns)
