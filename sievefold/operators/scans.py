"""Running values over an order, in two levels: rows are dealt into ranges of the order, each range is summed up, and only
the sums of the ranges meet in one place. A group that holds most of all rows runs in as many tasks as it has ranges.

The ranges are stored before they are used twice, so that all steps see the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import BROADCAST, stored

PART = "_part"


def ranged(df: DataFrame, keys: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """df as a stored table with its range number: ranges follow one another in the order of keys, then order."""
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return stored(dealt.withColumn(PART, F.spark_partition_id()), "ranges")


def joined(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the values of their range; sums has a row for each key and range, which are broadcast if they are few."""
    held = stored(sums, "sums")
    right = held.select(*(F.col(c).alias(f"_r_{c}") if c in (*keys, PART) else F.col(c) for c in held.columns))
    same = [rows[c].eqNullSafe(F.col(f"_r_{c}")) for c in (*keys, PART)]
    small = held.count() <= BROADCAST
    out = rows.join(F.broadcast(right) if small else right, same)
    return out.drop(*(f"_r_{c}" for c in (*keys, PART)))


def earlier(keys: list[str]) -> Window:
    """Ranges of a key before the present one."""
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def running_counts(df: DataFrame, keys: list[str], order: list[Column], counts: dict[str, Column], *, parts: int | None = None) -> DataFrame:
    """df with, for each condition, how many earlier rows of the same keys meet it."""
    rows = ranged(df, keys, order, parts)
    within = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, PART).agg(*(F.count_if(c).alias(f"_c_{n}") for n, c in counts.items()))
    starts = sums.select(*keys, PART, *(F.coalesce(F.sum(f"_c_{n}").over(earlier(keys)), F.lit(0)).alias(f"_s_{n}") for n in counts))
    out = joined(rows, starts, keys)
    return out.withColumns({n: F.col(f"_s_{n}") + F.coalesce(F.count_if(c).over(within), F.lit(0)) for n, c in counts.items()}).drop(PART, *(f"_s_{n}" for n in counts))


def streak_before(df: DataFrame, keys: list[str], order: list[Column], failed: Column, most: int, name: str, *, parts: int | None = None) -> DataFrame:
    """df with name: whether most failures in a row came before the row, among rows of the same keys.

    A range is summed up by its failures after the last success and by whether it holds a success: that gives the
    streak that each range starts with.
    """
    rows = ranged(df.withColumn("_f", F.coalesce(failed, F.lit(False))), keys, order, parts)
    inside = Window.partitionBy(*keys, PART).orderBy(*order)
    block = F.sum((~F.col("_f")).cast("int")).over(inside)
    rows = rows.withColumn("_block", block)
    rows = stored(rows.withColumn("_last", F.max("_block").over(Window.partitionBy(*keys, PART))), "blocks")
    tails = rows.where("_block = _last").groupBy(*keys, PART, "_last").agg(F.count_if("_f").alias("_tail")).withColumn("_any", (F.col("_last") > 0).cast("int"))
    # a streak goes on over ranges without a success: those with the same number of successful ranges up to them
    marked = tails.withColumn("_upto", F.sum("_any").over(Window.partitionBy(*keys).orderBy(PART)))
    chained = marked.withColumn("_chain", F.sum("_tail").over(Window.partitionBy(*keys, "_upto").orderBy(PART)))
    carried = chained.select(*keys, PART, F.coalesce(F.lag("_chain").over(Window.partitionBy(*keys).orderBy(PART)), F.lit(0)).alias("_carry"))
    rows = joined(rows, carried, keys)
    streak = F.sum(F.col("_f").cast("int")).over(Window.partitionBy(*keys, PART, "_block").orderBy(*order)) + F.when(F.col("_block") == 0, F.col("_carry")).otherwise(0)
    rows = stored(rows.withColumn("_full", (streak >= most).cast("int")), "streaks")
    full = rows.groupBy(*keys, PART).agg(F.max("_full").alias("_any_full"))
    before = full.select(*keys, PART, F.coalesce(F.max("_any_full").over(earlier(keys)), F.lit(0)).alias("_full_before"))
    out = joined(rows, before, keys)
    here = F.coalesce(F.max("_full").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn(name, F.greatest(here, F.col("_full_before")) == 1).drop("_f", "_block", "_last", "_carry", "_full", "_full_before", PART)


def greedy_batches(df: DataFrame, key: str, order: str, size: str, *, most: int, most_size: int, parts: int | None = None) -> DataFrame:
    """key, order, size and batch (from 0): rows of a key, in order, fill batches of at most most rows and most_size in all; a larger row is a batch of its own.

    Where a batch starts depends on all before it. But a batch holds at most most rows, so on entering a range the running batch began at one of
    so many places before it. Each range is followed from each of these places, which gives for each the place that the next range is entered
    with, and the batches that start in it: a small table, by which the ranges are chained. Then each range numbers its rows.
    """
    if most < 1:
        raise ValueError("a batch holds a row at least")
    by = [F.col(order).asc_nulls_first(), F.col(size).asc_nulls_first()]
    rows = ranged(df.select(key, order, size), [key], by, parts)
    kind = dict(rows.dtypes)
    grouped = lambda d: d.repartition(key, PART).sortWithinPartitions(key, PART, *by)
    # sizes of the last rows before each range
    nth = F.row_number().over(Window.partitionBy(key, PART).orderBy(F.col(order).desc_nulls_last(), F.col(size).desc_nulls_last()))
    ends = rows.select(key, PART, F.col(size).alias("_z"), nth.alias("_nth")).where(F.col("_nth") <= max(1, most - 1)).groupBy(key, PART).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_nth")).alias("k"), "_z"))), lambda x: x["_z"]).alias("_end"))
    back = Window.partitionBy(key).orderBy(PART).rowsBetween(-max(1, most - 1), -1)
    before = ends.select(key, PART, F.flatten(F.collect_list("_end").over(back)).alias("_before"))
    short = F.slice(F.reverse("_before"), 1, max(1, most - 1))
    tails = before.select(key, PART, F.reverse(short).alias("_before") if most > 1 else F.expr("cast(array() as array<bigint>)").alias("_before"))

    placed = grouped(joined(rows, tails, [key]))

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(frames, key):
            held = _sizes(pdf["_before"].iloc[0])
            starts, ends_at = _following(np.concatenate([held, pdf[size].fillna(0).to_numpy(np.int64)]), most, most_size, len(held))
            yield pd.DataFrame({key: [pdf[key].iloc[0]], PART: [pdf[PART].iloc[0]], "_exit": [ends_at.tolist()], "_starts": [starts.tolist()]})

    maps = placed.mapInPandas(follow, f"`{key}` {kind[key]}, {PART} int, _exit array<long>, _starts array<long>")
    chained = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(PART, "_exit", "_starts"))).alias("_maps"))  # a row of most numbers for each range
    state = F.struct(F.lit(0).cast("long").alias("enter"), F.lit(0).cast("long").alias("number"), F.expr(f"cast(array() as array<struct<{PART}:int,enter:bigint,number:bigint>>)").alias("out"))
    step = lambda acc, m: F.struct(F.get(m["_exit"], acc["enter"].cast("int")).alias("enter"), (acc["number"] + F.get(m["_starts"], acc["enter"].cast("int"))).alias("number"), F.concat(acc["out"], F.array(F.struct(m[PART].alias(PART), acc["enter"].alias("enter"), acc["number"].alias("number")))).alias("out"))
    entered = chained.select(key, F.explode(F.aggregate("_maps", state, step, lambda acc: acc["out"])).alias("_e")).select(key, F.col(f"_e.{PART}").alias(PART), F.col("_e.enter").alias("_enter"), F.col("_e.number").alias("_number"))
    everything = grouped(joined(joined(rows, tails, [key]), entered, [key]))

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole(frames, key):
            back, sizes = int(pdf["_enter"].iloc[0]), pdf[size].fillna(0).to_numpy(np.int64)
            held = _sizes(pdf["_before"].iloc[0])
            jump = _next_start(np.concatenate([held, sizes]), most, most_size)
            fresh = np.zeros(len(held) + len(sizes) + 1, np.int64)
            at = len(held) - back
            if back == 0:
                fresh[at] = 1  # a batch starts with the range
            while (at := int(jump[at])) < len(jump):
                fresh[at] = 1
            numbers = int(pdf["_number"].iloc[0]) - 1 + np.cumsum(fresh[len(held) : -1])
            yield pdf.drop(columns=["_before", "_enter", "_number", PART]).assign(batch=numbers)

    columns = [c for c in rows.columns if c != PART]
    return everything.select(*columns, PART, "_before", "_enter", "_number").mapInPandas(number, ", ".join(f"`{c}` {kind[c]}" for c in columns) + ", batch long")


def _sizes(raw) -> np.ndarray:
    return np.array([0 if v is None else v for v in ([] if raw is None else raw)], np.int64)


def _next_start(sizes: np.ndarray, most: int, most_size: int) -> np.ndarray:
    """For each row the start of the batch after the one that starts there."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    by_size = np.searchsorted(total, total[:-1] + most_size, side="right") - 1
    k = np.arange(len(sizes))
    return np.maximum(k + 1, np.minimum(k + most, by_size))


def _following(sizes: np.ndarray, most: int, most_size: int, held: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of rows that the running batch already holds on entering: how many batches start in the range, and how many rows the running one holds at its end.

    0 stands for none: a batch starts with the range. Numbers beyond the rows before stay 0."""
    n = len(sizes)
    jump = _next_start(sizes, most, most_size)
    starts, left = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for k in range(n - 1, -1, -1):  # batches from a start to the end, and where the last one starts
        if jump[k] >= n:
            starts[k], left[k] = 1, (n - k) % most  # a batch of most rows is full: the next row starts another
        else:
            starts[k], left[k] = starts[jump[k]] + 1, left[jump[k]]
    out_starts, out_left = np.zeros(most, np.int64), np.zeros(most, np.int64)
    for back in range(min(most - 1, held) + 1):
        at = held - back
        out_starts[back], out_left[back] = starts[at] - (1 if back else 0), left[at]
    return out_starts, out_left


def _whole(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """All rows of a key and range, which come one after another."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        for _, own in pdf.groupby([key, PART], sort=False, dropna=False):
            if held and (held[0][PART].iloc[0] != own[PART].iloc[0] or not _same(held[0][key].iloc[0], own[key].iloc[0])):
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(own)
    if held:
        yield pd.concat(held, ignore_index=True)


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))
