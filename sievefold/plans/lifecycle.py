"""Queries on runs over time: baselines, history, missed runs, uid ranges, batches, streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as lc
from ..streaming import incremental
from .catalog import query
from .views import table, view

_RUNS = "SELECT user_id % 20 AS schedule, event_id AS seq, ts AS started, concat('s', event_id % 3) AS signature, event_type <> 'error' AND event_id % 4 <> 0 AS ok, event_id % 5 = 0 AS full FROM {}"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RUNS.replace("{}", "{events}").replace(" AS full", " AS `full`"), events=table(spark, sf_dir, "events"))


_SQL_RUNS = _RUNS.format("events").replace(" AS full", ' AS "full"')


@query(
    f"""WITH r AS ({_SQL_RUNS}), w AS (SELECT *, last_value(CASE WHEN ok THEN started END IGNORE NULLS) OVER (PARTITION BY schedule, signature ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
    last_value(CASE WHEN ok AND "full" THEN seq END IGNORE NULLS) OVER (PARTITION BY schedule ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf FROM r)
    SELECT schedule, seq, strftime(b - interval '1' hour, '%Y-%m-%d %H:%M:%S') AS base, lf IS NULL OR seq - lf >= 7 AS due_full FROM w"""
)
def st1_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.baselines(runs(spark, sf_dir)).withColumn("base", F.date_format("base", "yyyy-MM-dd HH:mm:ss"))


@query(
    f"""WITH r AS ({_SQL_RUNS}), w AS (SELECT *, row_number() OVER (PARTITION BY schedule, ok ORDER BY seq DESC) AS n, row_number() OVER (PARTITION BY schedule, ok AND "full" ORDER BY seq DESC) AS nf FROM r)
    SELECT schedule, seq FROM w WHERE NOT ((ok AND n <= 3) OR (ok AND "full" AND nf = 1))"""
)
def st2_prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.prunable(runs(spark, sf_dir), keep=3).select("schedule", "seq")


@query(
    """WITH p AS (SELECT event_id, ts AS at, CASE WHEN event_id % 6 <> 0 THEN event_id % 600 END AS late, CASE WHEN event_id % 11 = 0 THEN 1 ELSE -1 END AS over FROM events)
    SELECT CASE WHEN over = 1 THEN 'skipped' WHEN late IS NULL OR late > 300 THEN 'missed' ELSE 'done' END AS state, count(*) AS n FROM p GROUP BY 1"""
)
def st3_missed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.timestamp_seconds(F.unix_timestamp("ts") + s)
    planned = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("schedule"), F.timestamp_seconds(F.unix_timestamp("ts")).alias("at"), F.when(F.col("event_id") % 6 != 0, at(F.col("event_id") % 600)).alias("begun"), at(F.when(F.col("event_id") % 11 == 0, 1).otherwise(-1)).alias("ended_before")
    )
    return lc.missed(planned).groupBy("state").agg(F.count("*").alias("n"))


@query(
    """WITH u AS (SELECT DISTINCT conv_id % 7 AS box, conv_id AS uid FROM conversations WHERE conv_id % 10 < 8 UNION SELECT conv_id % 7, conv_id + 7 FROM conversations WHERE conv_id % 3 = 0),
    d AS (SELECT DISTINCT box, uid // 7 AS uid FROM u), g AS (SELECT *, uid - row_number() OVER (PARTITION BY box ORDER BY uid) AS g FROM d), r AS (SELECT box, min(uid) AS a, max(uid) AS b FROM g GROUP BY box, g)
    SELECT box, string_agg(CASE WHEN a = b THEN a::varchar ELSE concat(a, ':', b) END, ',' ORDER BY a) AS ranges FROM r GROUP BY box"""
)
def x41_uid_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    box = (F.col("conv_id") % 7).alias("box")
    u = c.where("conv_id % 10 < 8").select(box, F.col("conv_id").alias("uid")).union(c.where("conv_id % 3 = 0").select(box, F.col("conv_id") + 7))
    return lc.uid_ranges(u.select("box", F.floor(F.col("uid") / 7).alias("uid")), "box", "uid")


@query(
    """WITH RECURSIVE o AS (SELECT mailbox, id, length(text) AS size, row_number() OVER (PARTITION BY mailbox ORDER BY id) AS nth FROM messages),
    r AS (SELECT mailbox, id, nth, 0 AS batch, 1 AS n, size AS bytes FROM o WHERE nth = 1
      UNION ALL SELECT o.mailbox, o.id, o.nth, CASE WHEN r.n >= 50 OR r.bytes + o.size > 4000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 50 OR r.bytes + o.size > 4000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 50 OR r.bytes + o.size > 4000 THEN o.size ELSE r.bytes + o.size END FROM r JOIN o ON o.mailbox = r.mailbox AND o.nth = r.nth + 1)
    SELECT mailbox, id, cast(batch AS bigint) AS batch FROM r"""
)
def x42_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy batches restart their sums: SQL follows row after row, a task one mailbox."""
    return lc.batches(view(spark, sf_dir, "messages").select("mailbox", "id", F.length("text").cast("long").alias("size")), "mailbox", most=50, most_bytes=4000)


@query("SELECT count(*) AS devices, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS ok, count(*) FILTER (WHERE s_suppkey % 3 = 1) AS failed, count(*) FILTER (WHERE s_suppkey % 3 = 2) AS skipped FROM supplier")
def a22_reboot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("s_suppkey") % 3
    return table(spark, sf_dir, "supplier").agg(F.count("*").alias("devices"), F.count_if(status == 0).alias("ok"), F.count_if(status == 1).alias("failed"), F.count_if(status == 2).alias("skipped"))


def _folders(spark: SparkSession) -> tuple[str, str]:
    """New folders for a stream's table and its checkpoint, in the shared folder that the session names."""
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/stream-{uuid.uuid4().hex}", f"{root}/checkpoint-{uuid.uuid4().hex}"


@query("SELECT event_id AS id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def st4_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a stream that stops when it has read what is there, each once."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = incremental.changes(spark, f"{sf_dir}/events.parque[t]", schema)
    sink, checkpoint = _folders(spark)
    incremental.run_available(incremental.once_each(stream, "event_id", at="ts"), sink, checkpoint)
    return spark.read.parquet(sink).select(F.col("event_id").alias("id"), "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1, 2")
def st5_running_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    counts = incremental.monthly(incremental.changes(spark, f"{sf_dir}/events.parque[t]", schema), "event_type", at="ts")
    sink, checkpoint = _folders(spark)
    incremental.merge_available(counts, checkpoint, lambda batch, k: batch.write.mode("overwrite").parquet(sink), mode="complete")
    return spark.read.parquet(sink)


@query("SELECT event_type, count(*) AS n FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1")
def st6_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed: every day but the last."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    counts = incremental.windowed(incremental.changes(spark, f"{sf_dir}/events.parque[t]", source.schema), "1 day", "event_type", at="ts")
    sink, checkpoint = _folders(spark)
    incremental.run_available(counts, sink, checkpoint)
    last = source.agg(F.date_trunc("day", F.max("ts")).alias("d"))
    return spark.read.parquet(sink).join(F.broadcast(last), F.col("start") < F.col("d")).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 5 IN (0, 1, 4)")
def s10_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telephones and tablets of two systems out of all devices, their names in any case."""
    os = F.get(F.array(*map(F.lit, ("iOS", "IPADOS", "Android", "Windows", "ipados"))), (F.col("s_suppkey") % 5).cast("int"))
    return lc.devices(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), os.alias("os"))).select("id")
