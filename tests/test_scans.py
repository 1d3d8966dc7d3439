"""Values over an order in two levels, cut into many ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sievefold.operators import deletions, lifecycle
from sievefold.sources import sinks


def attempts(n, groups=2, seed=1):
    g = random.Random(seed)
    rows, state = [], "ok"
    for k in range(n):
        state = state if g.random() < 0.75 else g.choice(["ok", "failed"])
        rows.append((k, None if g.random() < 0.05 else g.randrange(groups), g.choice("ab"), state))
    return rows


def plain_breakers(rows, run, folder_run):
    out, streak, stopped = {}, {}, set()
    for k, batch, folder, outcome in rows:
        keys = ((batch,), (batch, folder))
        out[k] = tuple(key in stopped for key in keys)
        for key, most in zip(keys, (run, folder_run), strict=True):
            streak[key] = streak.get(key, 0) + 1 if outcome != "ok" else 0
            if streak[key] >= most:
                stopped.add(key)
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
@pytest.mark.parametrize("groups", [1, 3])
def test_breakers_and_slots(spark, parts, groups):
    rows = attempts(300, groups, parts)
    df = spark.createDataFrame(rows, "seq long, batch long, folder string, outcome string").repartition(3)
    got = {r.seq: (r.stopped, r.skipped) for r in deletions.breakers(df, run=6, folder_run=4, parts=parts).collect()}
    assert got == plain_breakers(rows, 6, 4)
    seen, want = {}, {}
    for k, batch, _, outcome in rows:
        ok, failed = seen.get((batch, "ok"), 0), seen.get((batch, "failed"), 0)
        want[k] = ok < 30 and failed < 30
        seen[batch, outcome] = seen.get((batch, outcome), 0) + 1
    assert {r.seq: r.acted for r in deletions.slots(df, 30, group="batch", order="seq", parts=parts).collect()} == want


@pytest.mark.parametrize("parts", [1, 9, 60])
@pytest.mark.parametrize("most", [1, 5, 50])
def test_batches(spark, parts, most):
    g = random.Random(parts * 100 + most)
    rows = [(g.choice(["hot", "hot", "hot", "cold"]), k, g.choice([0, 1, 3, 10, 70, 120])) for k in range(400)]
    want, state = {}, {}
    for box, k, size in rows:
        n, total, number = state.get(box, (0, 0, 0))
        if n and (n >= most or total + size > 100):
            n, total, number = 0, 0, number + 1
        state[box] = (n + 1, total + size, number)
        want[k] = number
    df = spark.createDataFrame(rows, "mailbox string, id long, size long").repartition(4)
    got = lifecycle.batches(df, "mailbox", most=most, most_bytes=100, parts=parts)
    assert {r.id: r.batch for r in got.collect()} == want
    assert lifecycle.batches(df.where("id < 0"), "mailbox").collect() == []


def test_sheet_numbers_with_coalesced_partitions(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 3001).alias("k")).repartition(13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        got = {r.k: (r.sheet, r.row) for r in sinks.sheet_numbers(df, [F.desc("k")], max_rows=101).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    for nth, k in enumerate(sorted(got, reverse=True)):
        assert got[k] == (nth // 100, nth % 100 + 1)
