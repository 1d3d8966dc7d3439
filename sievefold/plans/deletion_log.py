"""Queries on the deletion log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import deletions as d
from .catalog import query
from .views import view

KEY = "CASE WHEN item % 10 = 0 THEN concat('#', seq) ELSE concat(scan, ':', item) END"
_LOG = f"""WITH k AS (SELECT *, {KEY} AS key FROM deletions),
    u AS (SELECT *, status = 'deleted' AND NOT coalesce(bool_or(status = 'deleted') OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS uniq FROM k)"""
_STATS = """count(*) AS attempts, count(*) FILTER (WHERE status = 'deleted') AS deleted, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE uniq) AS unique_deleted, cast(coalesce(sum(size) FILTER (WHERE uniq), 0) AS bigint) AS bytes_deleted"""


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.when(F.col("item") % 10 != 0, F.col("item"))
    return view(spark, sf_dir, "deletions").withColumn("key", d.item_key(F.col("scan"), record, F.col("seq")))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.with_uniqueness(keyed(spark, sf_dir), "key")


@query(_LOG + f" SELECT {_STATS} FROM u")
def a14_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.log_summary(marked(spark, sf_dir))


@query(_LOG + f" SELECT strftime(done_at, '%Y-%m-%d') AS day, {_STATS} FROM u GROUP BY 1")
def a14_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.log_summary(marked(spark, sf_dir), dates.local_day(F.col("done_at")).alias("day"))


@query(_LOG + f" SELECT policy, {_STATS} FROM u GROUP BY 1")
def a14_by_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.log_summary(marked(spark, sf_dir), "policy")


@query(_LOG + f" SELECT repository, kind, {_STATS} FROM u GROUP BY 1, 2")
def a14_by_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.log_summary(marked(spark, sf_dir), "repository", "kind")


@query(_LOG + " SELECT strftime(min(done_at), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(done_at), '%Y-%m-%d %H:%M:%S') AS last, count(*) FILTER (WHERE uniq AND size IS NULL) AS bytes_unknown FROM u")
def a14_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return marked(spark, sf_dir).agg(text(F.min("done_at")).alias("first"), text(F.max("done_at")).alias("last"), F.count_if(F.col("unique") & F.col("size").isNull()).alias("bytes_unknown"))


@query("SELECT count(*) FILTER (WHERE status = 'deleted') AS deleted, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'failed') AS failed FROM deletions")
def a13_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.reports import status_totals

    return status_totals(view(spark, sf_dir, "deletions"), d.STATUSES)


_FINAL = "f AS (SELECT key, arg_max(status, CASE WHEN status = 'deleted' THEN 1000000000000 - seq ELSE seq END) AS status, arg_max(seq, CASE WHEN status = 'deleted' THEN 1000000000000 - seq ELSE seq END) AS seq FROM k GROUP BY key)"


@query(f"WITH k AS (SELECT *, {KEY} AS key FROM deletions), {_FINAL} SELECT key, status, seq FROM f")
def j1_final_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.final_states(keyed(spark, sf_dir).select("key", "status", "seq"), "key")


@query(
    f"""WITH k AS (SELECT *, {KEY} AS key FROM deletions), {_FINAL}, s AS (SELECT DISTINCT key FROM k WHERE status = 'failed' AND mode = 'retention')
    SELECT count(*) AS unique_items, count(*) FILTER (WHERE status = 'missing') AS unique_missing, count(*) FILTER (WHERE status IN ('failed', 'changed')) AS unique_pending FROM f SEMI JOIN s USING (key)"""
)
def j10_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = keyed(spark, sf_dir)
    return d.pending(log.where("status = 'failed' AND mode = 'retention'"), log, "key")


@query("SELECT repository, count(*) AS events, arg_max(policy, seq) AS latest_policy FROM deletions WHERE repository IS NOT NULL GROUP BY repository")
def a15_filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("policy").isNotNull(), F.col("seq"))
    return view(spark, sf_dir, "deletions").where("repository is not null").groupBy("repository").agg(F.count("*").alias("events"), F.max_by("policy", named).alias("latest_policy"))


@query("SELECT count(DISTINCT " + KEY + ") AS items FROM deletions")
def a16_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).agg(F.countDistinct("key").alias("items"))


@query("SELECT cast(sum(size) AS bigint) AS freed FROM deletions WHERE status = 'deleted'")
def a23_freed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "deletions").agg(F.sum(F.when(F.col("status") == "deleted", F.col("size"))).alias("freed"))


@query(
    """SELECT CASE WHEN status IN ('deleted', 'missing') THEN 'removed' WHEN status = 'changed' THEN 'changed' WHEN kind = 'mail' THEN 'not-allowed' WHEN repository IS NULL THEN 'excluded' WHEN item % 7 = 0 THEN 'protected' ELSE 'ready' END AS reason, kind, count(*) AS n FROM deletions GROUP BY 1, 2"""
)
def a20_bulk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = (
        F.when(F.col("status").isin("deleted", "missing"), "removed").when(F.col("status") == "changed", "changed").when(F.col("kind") == "mail", "not-allowed")
        .when(F.col("repository").isNull(), "excluded").when(F.col("item") % 7 == 0, "protected").otherwise("ready")
    )
    return view(spark, sf_dir, "deletions").groupBy(reason.alias("reason"), "kind").agg(F.count("*").alias("n"))


_OUTCOME = "WITH a AS (SELECT seq, scan AS batch, repository AS folder, CASE WHEN status = 'deleted' THEN 'ok' ELSE 'failed' END AS outcome FROM deletions)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "deletions").select("seq", F.col("scan").alias("batch"), F.col("repository").alias("folder"), F.when(F.col("status") == "deleted", "ok").otherwise("failed").alias("outcome"))


@query(
    _OUTCOME
    + """, b AS (SELECT *, count(*) FILTER (WHERE outcome = 'ok') OVER w AS o, count(*) FILTER (WHERE outcome = 'failed') OVER w AS f FROM a WINDOW w AS (PARTITION BY batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT seq, o < 100 AND f < 100 AS acted FROM b"""
)
def w2_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.slots(attempts(spark, sf_dir), 100, group="batch", order="seq").select("seq", "acted")


@query(
    _OUTCOME
    + """, g AS (SELECT *, sum((outcome = 'ok')::int) OVER (PARTITION BY batch ORDER BY seq) AS g1, sum((outcome = 'ok')::int) OVER (PARTITION BY batch, folder ORDER BY seq) AS g2 FROM a),
    s AS (SELECT *, sum((outcome <> 'ok')::int) OVER (PARTITION BY batch, g1 ORDER BY seq) AS s1, sum((outcome <> 'ok')::int) OVER (PARTITION BY batch, folder, g2 ORDER BY seq) AS s2 FROM g)
    SELECT seq, coalesce(bool_or(s1 >= 7) OVER (PARTITION BY batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped,
    coalesce(bool_or(s2 >= 3) OVER (PARTITION BY batch, folder ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM s"""
)
def w3_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.breakers(attempts(spark, sf_dir), run=7, folder_run=3).select("seq", "stopped", "skipped")


# an item of each shape; scans that are known, of each kind, and rows with and without a recorded target
_RAW = """SELECT event_id AS seq,
      CASE event_id % 9 WHEN 0 THEN concat('C:\\\\dir\\\\a', event_id, '.txt') WHEN 1 THEN concat('\\\\\\\\srv\\\\x', event_id) WHEN 2 THEN concat('https://t-my.sharepoint.com/personal/u', event_id) WHEN 3 THEN concat('https://t.sharepoint.com/sites/s', event_id)
        WHEN 4 THEN concat('u', event_id, '@x.com › Inbox › hi') WHEN 5 THEN concat('OneDrive de u', event_id, '@x.com › p/a') WHEN 6 THEN concat('grupo › arquivo', event_id) WHEN 7 THEN concat('/srv/a', event_id) ELSE concat('nome', event_id) END AS item,
      CASE event_id % 7 WHEN 0 THEN 'ana' WHEN 1 THEN concat('política de retenção "P', event_id % 3, '"') WHEN 2 THEN concat('agendamento "S', event_id % 4, '" (auto)') ELSE NULL END AS actor,
      CASE event_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'retention' ELSE 'auto' END AS mode, CASE event_id % 11 WHEN 0 THEN 'file' WHEN 1 THEN 'teams' ELSE NULL END AS method,
      CASE event_id % 5 WHEN 0 THEN 'files' WHEN 1 THEN 'mail' WHEN 2 THEN 'teams' ELSE NULL END AS scan_kind,
      CASE event_id % 13 WHEN 0 THEN 'local' WHEN 1 THEN 'cloud' WHEN 2 THEN 'mail' ELSE NULL END AS target_type, CASE WHEN event_id % 10 = 0 THEN 'box@x.com' ELSE NULL END AS target_mailbox, CASE WHEN event_id % 15 = 0 THEN 'Pasta' ELSE NULL END AS target_folder,
      CASE WHEN event_id % 8 = 0 THEN 'Plano' ELSE NULL END AS schedule, CASE WHEN event_id % 17 = 0 THEN 'types' ELSE NULL END AS recorded_purpose, CASE event_id % 6 WHEN 0 THEN 'onedrive' WHEN 1 THEN 'sharepoint' ELSE NULL END AS cloud
    FROM {events}"""
_DUCK_RAW = _RAW.replace("{events}", "events").replace("\\\\", "\\")


@query(
    f"""WITH r AS (SELECT *, string_split(item, ' › ') AS p FROM ({_DUCK_RAW})),
    c AS (SELECT *, CASE WHEN cloud IS NOT NULL THEN cloud WHEN item LIKE '%-my.sharepoint.%/personal/%' THEN 'onedrive' WHEN item LIKE 'https://%sharepoint.%' THEN 'sharepoint' ELSE 'cloud' END AS by_item FROM r),
    k AS (SELECT *, CASE WHEN target_type IN ('local', 'mail') THEN target_type WHEN target_type = 'cloud' THEN by_item WHEN scan_kind = 'mail' THEN 'mail' WHEN scan_kind = 'teams' OR method = 'teams' THEN 'teams'
      WHEN starts_with(item, 'http') THEN by_item WHEN method = 'file' OR starts_with(item, 'C:') OR starts_with(item, '\\\\') OR starts_with(item, '/') THEN 'local'
      WHEN scan_kind IS NULL AND len(p) >= 3 THEN 'mail' WHEN scan_kind IS NULL AND starts_with(item, 'OneDrive de') THEN 'onedrive' WHEN scan_kind IS NULL AND len(p) = 2 THEN 'cloud'
      WHEN scan_kind = 'files' THEN CASE WHEN cloud IS NULL THEN 'local' ELSE by_item END ELSE '' END AS kind FROM c)
    SELECT seq, kind, coalesce(target_mailbox, CASE WHEN kind = 'mail' AND len(p) > 2 THEN p[1] END, '') AS mailbox,
      coalesce(target_folder, CASE WHEN kind = 'mail' AND len(p) > 2 THEN p[2] WHEN kind = 'teams' THEN array_to_string(p[1:len(p) - 1], ' › ') END, '') AS folder,
      coalesce(recorded_purpose, CASE WHEN schedule IS NULL AND starts_with(actor, 'política') THEN 'retention' END, CASE WHEN mode = 'retention' THEN 'retention' END, '') AS purpose,
      coalesce(schedule, CASE WHEN actor LIKE '%"%' THEN split_part(actor, '"', 2) END) AS schedule_name FROM k"""
)
def p12_normalised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rows of the log lack is told from the item's shape, the scan and the text about who ran it."""
    raw = spark.sql(_RAW, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    clouds = F.when(F.col("cloud").isNull(), F.array().cast("array<string>")).otherwise(F.array("cloud"))
    return d.normalised(raw.withColumn("clouds", clouds)).select("seq", "kind", "mailbox", "folder", "purpose", "schedule_name")


@query(
    """WITH l AS (SELECT item, coalesce(max(CASE WHEN status = 'deleted' THEN 'deleted' END), max_by(status, seq)) AS status FROM deletions GROUP BY item)
    SELECT count(*) FILTER (WHERE coalesce(l.status, '') NOT IN ('deleted', 'missing') AND f.repository IN ('src1', 'src2', 'src7', 'src13')) AS candidates FROM files f LEFT JOIN l ON l.item = f.id"""
)
def a21_bulk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = d.final_states(view(spark, sf_dir, "deletions"), "item").select(F.col("item").alias("id"), "status")
    records = view(spark, sf_dir, "files").select("id", "repository").join(last, "id", "left")
    repositories = spark.createDataFrame([(f"src{k}", k in (1, 2, 7, 13)) for k in range(15)], "repository string, allow_delete boolean")
    return d.bulk_candidates(records, repositories)


# chr(92) is a backslash
_LOGGED = """SELECT event_id AS seq, cast(user_id % 40 AS bigint) AS scan, CASE event_id % 5 WHEN 0 THEN 'local' WHEN 1 THEN 'local' WHEN 2 THEN 'onedrive' WHEN 3 THEN 'mail' ELSE 'cloud' END AS kind,
      CASE WHEN event_id % 5 < 2 THEN concat(CASE event_id % 7 WHEN 0 THEN 'c:' ELSE 'C:' END, chr(92), 'Base', event_id % 4, chr(92), 'Dir', event_id % 3, chr(92), 'Sub', event_id % 2, chr(92), 'f', event_id, '.txt') ELSE concat('item', event_id) END AS item,
      CASE WHEN event_id % 5 = 3 THEN concat('U', event_id % 7, '@x.com') ELSE '' END AS mailbox, CASE WHEN event_id % 11 = 0 THEN cast(900000 + event_id % 3 AS bigint) ELSE NULL END AS recorded FROM {events}"""
_TARGETS = """SELECT cast(c_custkey % 40 AS bigint) AS scan, cast(c_custkey AS bigint) AS id, CASE c_nationkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'onedrive' WHEN 2 THEN 'local' ELSE 'source' END AS type,
      CASE c_custkey % 3 WHEN 0 THEN concat('c:', chr(92), 'base', c_custkey % 4) WHEN 1 THEN concat('C:/Base', c_custkey % 4, '/Dir', c_custkey % 2, '/') ELSE concat('C:', chr(92), 'BASE', c_custkey % 4, chr(92), 'dir', c_custkey % 3, chr(92), 'sub', c_custkey % 2) END AS path FROM {customer}"""
_BOXES = "SELECT cast(c_custkey AS bigint) AS source, concat('u', c_custkey % 7, '@X.com') AS address FROM {customer} UNION ALL SELECT cast(c_custkey AS bigint), concat('u', (c_custkey + 1) % 7, '@x.com') FROM {customer}"


@query(
    "WITH e AS (" + _LOGGED.replace("{events}", "events") + "), t AS (" + _TARGETS.replace("{customer}", "customer") + "), b AS (" + _BOXES.replace("{customer}", "customer") + """),
    k AS (SELECT scan, id, unnest(CASE type WHEN 'local' THEN ['local'] WHEN 'source' THEN ['mail', 'teams'] ELSE [type, 'cloud'] END) AS kind FROM t),
    o AS (SELECT scan, kind, min(id) AS only FROM k GROUP BY 1, 2 HAVING count(*) = 1),
    n AS (SELECT *, lower(replace(item, chr(92), '/')) AS key FROM e), r AS (SELECT *, rtrim(lower(replace(path, chr(92), '/')), '/') AS root FROM t WHERE type = 'local'),
    c AS (SELECT n.seq, r.id, r.root, row_number() OVER (PARTITION BY n.seq ORDER BY length(r.root) DESC, r.id) AS nth FROM n JOIN r ON n.scan = r.scan AND n.kind = 'local' AND (n.key = r.root OR starts_with(n.key, concat(r.root, '/')))),
    m AS (SELECT e.seq, min(t.id) AS owner FROM e JOIN t ON e.scan = t.scan AND t.type = 'source' AND e.kind = 'mail' WHERE EXISTS (SELECT 1 FROM b WHERE b.source = t.id AND lower(b.address) = lower(e.mailbox)) GROUP BY e.seq HAVING count(*) = 1)
    SELECT e.seq, coalesce(e.recorded, c.id, o.only, m.owner) AS repository, CASE WHEN e.recorded IS NULL AND c.id IS NOT NULL THEN substr(e.item, length(c.root) + 2) ELSE '' END AS relative_path
    FROM e LEFT JOIN o ON o.scan = e.scan AND o.kind = e.kind LEFT JOIN (SELECT * FROM c WHERE nth = 1) c ON c.seq = e.seq LEFT JOIN m ON m.seq = e.seq"""
)
def p12_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repository of each event: recorded, the closest path of its scan, the only one of its kind, or the connection that has the mailbox."""
    made = lambda sql, **t: spark.sql(sql, **{k: spark.read.parquet(f"{sf_dir}/{k}.parquet") for k in t["tables"]})
    events, targets, boxes = made(_LOGGED, tables=["events"]), made(_TARGETS, tables=["customer"]), made(_BOXES, tables=["customer"])
    return d.with_repositories(events, targets, boxes).select("seq", "repository", "relative_path")
