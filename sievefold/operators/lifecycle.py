"""Runs over time: baselines of incremental runs, history to keep, devices, batches of uids and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import greedy_batches, running_counts

MARGIN_SECONDS = 3600
FULL_EVERY = 7


def signature(*parts: Column) -> Column:
    """32 hexadecimal digits over the parts, nulls and order told apart."""
    return F.substring(F.sha2(F.to_json(F.struct(*(p.alias(f"c{k}") for k, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256), 1, 32)


def baselines(runs: DataFrame, *, every: int = FULL_EVERY) -> DataFrame:
    """For each run: where its incremental scan may start, and whether it has to be full.

    runs: schedule, seq, started, signature, ok (without errors and complete), full. The base is the start of the
    last good run of the same signature, less a margin; after every runs without a full one, a full one is due.
    """
    order = Window.partitionBy("schedule").orderBy("seq")
    same = Window.partitionBy("schedule", "signature").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when(F.col("ok"), F.col("started")), ignorenulls=True).over(same)
    last_full = F.last(F.when(F.col("full") & F.col("ok"), F.col("seq")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    due = last_full.isNull() | (F.col("seq") - last_full >= every)
    return runs.select("schedule", "seq", (base - F.make_dt_interval(secs=F.lit(MARGIN_SECONDS))).alias("base"), due.alias("due_full"))


def prunable(runs: DataFrame, *, keep: int) -> DataFrame:
    """Reports that may go: not among the last keep good ones, nor the last full one, of their schedule."""
    good = F.col("ok")
    nth = F.row_number().over(Window.partitionBy("schedule", "ok").orderBy(F.desc("seq")))
    nth_full = F.row_number().over(Window.partitionBy("schedule", F.col("ok") & F.col("full")).orderBy(F.desc("seq")))
    kept = (good & (nth <= keep)) | (good & F.col("full") & (nth_full == 1))
    return runs.withColumn("_kept", kept).where("not _kept").drop("_kept")


def last_rows(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return df.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def missed(planned: DataFrame, *, grace_seconds: int = 300) -> DataFrame:
    """State of each planned run: done, running over (skipped) or missed. planned: schedule, at, begun, ended_before (when the run before ended)."""
    late = F.col("begun").isNull() | (F.unix_timestamp("begun") - F.unix_timestamp("at") > grace_seconds)
    busy = F.coalesce(F.col("ended_before") > F.col("at"), F.lit(False))
    return planned.withColumn("state", F.when(busy, "skipped").when(late, "missed").otherwise("done"))


#: Systems whose devices are listed unless others are named.
SYSTEMS = ("iOS", "iPadOS")


def devices(landed: DataFrame, systems: tuple[str, ...] = SYSTEMS) -> DataFrame:
    """Devices of the named systems, in any case; all of them if none is named. landed: os."""
    return landed.where(F.lower(F.coalesce("os", F.lit(""))).isin(*(s.lower() for s in systems))) if systems else landed


def device_states(devices: DataFrame, now: Column, *, hours: int = 24) -> DataFrame:
    """stale: never synchronised, or longer ago than hours. devices: last_sync."""
    return devices.withColumn("stale", F.col("last_sync").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_sync") > hours * 3600))


def uid_ranges(uids: DataFrame, group: str, uid: str) -> DataFrame:
    """Runs of consecutive numbers as a:b, comma-joined."""
    own = uids.select(group, uid).distinct()
    island = running_counts(own, [group], [F.col(uid).asc()], {"_before": F.lit(True)}).withColumn("_g", F.col(uid) - F.col("_before"))
    runs = island.groupBy(group, "_g").agg(F.min(uid).alias("a"), F.max(uid).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ",").alias("ranges"))


def batches(messages: DataFrame, group: str, *, most: int = 50, most_bytes: int = 32 << 20, parts: int | None = None) -> DataFrame:
    """id and batch number: greedily filled, in order, by number and size. messages: group, id, size."""
    return greedy_batches(messages, group, "id", "size", most=most, most_size=most_bytes, parts=parts).select(group, "id", "batch")
