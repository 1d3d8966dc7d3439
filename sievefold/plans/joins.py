"""Queries on look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import enrich
from .catalog import query
from .deletion_log import keyed
from .views import table, view


@query(
    """WITH l AS (SELECT item AS id, arg_max(status, CASE WHEN status = 'deleted' THEN 1000000000000 - seq ELSE seq END) AS status FROM deletions GROUP BY item)
    SELECT f.id, l.status FROM files f LEFT JOIN l USING (id)"""
)
def j1_records_with_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.deletions import final_states

    last = final_states(view(spark, sf_dir, "deletions").select(F.col("item").alias("id"), "seq", "status"), "id")
    return view(spark, sf_dir, "files").select("id").join(last.select("id", "status"), "id", "left")


_AUDIT = r"""WITH a AS (SELECT lower(concat('\srv\share\d', user_id % 50, '\f', event_id % 20, '.txt')) AS path, ts AS seen_at, event_id AS id, concat('u', user_id) AS u, event_type IN ('purchase', 'click') AS w FROM events)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    shape = F.when(F.col("event_id") % 2 == 0, F.lit("\\SRV/Share/D")).otherwise(F.lit("\\srv\\share\\d"))
    path = F.concat(shape, (F.col("user_id") % 50).cast("string"), F.lit("\\F"), (F.col("event_id") % 20).cast("string"), F.lit(".txt"))
    return e.select(path.alias("path"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), F.col("event_type").isin("purchase", "click").alias("writes"))


@query(_AUDIT + " SELECT path, arg_max(u, (seen_at, id)) AS last_user, arg_max(u, (seen_at, id)) FILTER (WHERE w) AS writer FROM a GROUP BY path")
def s8_last_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.last_accesses(audit(spark, sf_dir)).select("path", "last_user", "writer")


@query(
    _AUDIT
    + r""", l AS (SELECT path, arg_max(u, (seen_at, id)) AS seen, arg_max(u, (seen_at, id)) FILTER (WHERE w) AS wrote FROM a GROUP BY path)
    SELECT f.id, l.seen AS last_user, CASE WHEN l.wrote <> l.seen THEN l.wrote END AS other_writer FROM files f LEFT JOIN l ON l.path = concat('\srv\share\d', f.id % 60, '\f', f.id % 25, '.txt')"""
)
def j2_files_with_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.concat(F.lit("\\\\?\\UNC\\Srv\\Share\\D"), (F.col("id") % 60).cast("string"), F.lit("\\f"), (F.col("id") % 25).cast("string"), F.lit(".TXT"))
    key = F.regexp_replace(t.windows_path(local), r"^\\\\", r"\\")
    last = enrich.last_accesses(audit(spark, sf_dir))
    files = view(spark, sf_dir, "files").select("id", key.alias("path"))
    return files.join(last, "path", "left").select("id", "last_user", F.when(F.col("writer") != F.col("last_user"), F.col("writer")).alias("other_writer"))


@query("SELECT f.id, n.n_name AS owner FROM files f LEFT JOIN nation n ON n.n_nationkey = f.id % 30")
def j3_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "nation").select((F.col("n_nationkey")).alias("k"), F.col("n_name").alias("owner"))
    return view(spark, sf_dir, "files").select("id", (F.col("id") % 30).alias("k")).join(owners, "k", "left").select("id", "owner")


@query(
    """SELECT d.seq, n.n_name AS scan_name, r.r_name AS repository_name FROM deletions d LEFT JOIN nation n ON n.n_nationkey = d.scan LEFT JOIN region r ON concat('repo', r.r_regionkey) = d.repository"""
)
def j4_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    repositories = table(spark, sf_dir, "region").select(F.concat(F.lit("repo"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("name"))
    return enrich.with_lookups(view(spark, sf_dir, "deletions"), scan=scans, repository=repositories).select("seq", "scan_name", "repository_name")


ROOTS = (("dir1", "a"), ("dir1/Sub 1", "b"), ("dir2", "c"), ("dir", "d"), ("dir3/Sub 0", "e"))
_ROOTS = "(VALUES " + ", ".join(f"('{r}', '{n}')" for r, n in ROOTS) + ") AS r(root, name)"


@query(
    f"""WITH p AS (SELECT id, concat(folder, '/', name) AS path FROM files), j AS (SELECT p.id, r.root, r.name, row_number() OVER (PARTITION BY p.id ORDER BY length(r.root) DESC) AS nth FROM p JOIN {_ROOTS} ON p.path = r.root OR starts_with(p.path, concat(r.root, '/')))
    SELECT p.id, j.root, j.name FROM p LEFT JOIN (SELECT * FROM j WHERE nth = 1) j USING (id)"""
)
def j5_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files").select("id", F.concat_ws("/", "folder", "name").alias("path"))
    return enrich.longest_prefix(files, spark.createDataFrame(ROOTS, "root string, name string")).select("id", "root", "name")


@query("WITH h AS (SELECT mailbox, min(source) AS source FROM messages WHERE conv_id % 4 = 1 GROUP BY mailbox HAVING count(DISTINCT source) = 1) SELECT DISTINCT m.mailbox, h.source FROM messages m LEFT JOIN h USING (mailbox)")
def j6_only_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "messages")
    return enrich.only_owner(m.select("mailbox").distinct(), m.where("conv_id % 4 = 1").select("mailbox", "source"), "mailbox", "source")


@query("SELECT id FROM files WHERE id IN (SELECT item FROM deletions WHERE kind = 'local') AND id NOT IN (SELECT item FROM deletions WHERE status = 'deleted' AND scan = 1 AND mode = 'auto' AND item % 4 > 0) AND NOT starts_with(folder, 'dir3/')")
def j9_bulk_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "deletions").withColumnRenamed("item", "id")
    guards = spark.createDataFrame([("dir3", None)], "guard string, except array<string>")
    chosen = view(spark, sf_dir, "files").select("id", F.concat_ws("/", "folder", "name").alias("path")).join(log.where("kind = 'local'").select("id"), "id", "left_semi")
    return enrich.unprotected(chosen.join(log.where("status = 'deleted' and scan = 1 and mode = 'auto' and id % 4 > 0").select("id"), "id", "left_anti"), guards).select("id")


@query("SELECT k.seq, f.name FROM (SELECT * FROM deletions WHERE item % 10 <> 0) k LEFT JOIN files f ON f.id = k.item")
def j8_events_with_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = view(spark, sf_dir, "files").select(F.col("id").alias("item"), "name")
    return keyed(spark, sf_dir).where("item % 10 <> 0").select("seq", "item").join(names, "item", "left").select("seq", "name")


@query("SELECT DISTINCT n.n_name AS name, lower(split_part(m.sender, '@', 2)) AS domain FROM messages m JOIN nation n ON n.n_nationkey = length(split_part(m.sender, '@', 2))")
def j12_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain suffixes are equi-joined: here on their length, as a stand-in for a table of domains."""
    d = view(spark, sf_dir, "messages").select(t.email_domain(F.col("sender")).alias("domain")).distinct()
    return d.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), F.length("domain") == F.col("k")).select("name", "domain")


@query("SELECT event_id AS id, epoch_ms(ts) // 86400000 * 86400000 AS day FROM events")
def x28_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.unix_millis(F.to_date("ts").cast("timestamp")).alias("day"))
