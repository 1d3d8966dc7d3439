"""Queries on landed tables of services: chats, sites, accounts, messages, point look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clouds, filters, matching
from ..sources import extract
from .catalog import query
from ..operators.filters import natural_key
from .filters import numbered, placed
from .views import table, view


@query("SELECT row_number() OVER () AS nth, turn FROM (SELECT turn FROM conversations WHERE conv_id = 5 ORDER BY turn DESC LIMIT 30)")
def s21_live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of one conversation; the filter reaches the scan."""
    one = table(spark, sf_dir, "conversations").where("conv_id = 5")
    return numbered(filters.page(one.orderBy(F.desc("turn")), 1, size=30).select("turn"))


@query("SELECT id, name, md5(text) AS digest FROM files WHERE id = 42")
def s22_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").where("id = 42").select("id", "name", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT n_nationkey AS id, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0) AS in_use FROM nation")
def s23_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a catalogue that something still refers to can't be removed."""
    used = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("id")).distinct().withColumn("in_use", F.lit(True))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")).join(used, "id", "left").select("id", F.coalesce("in_use", F.lit(False)).alias("in_use"))


_CHOSEN = "SELECT CASE n_nationkey % 5 WHEN 0 THEN concat('SRC', n_nationkey % 4, chr(92), 'DIR', n_nationkey % 7) WHEN 1 THEN concat('src', n_nationkey % 3 + 4) WHEN 2 THEN concat('Dir', n_nationkey % 3, '/sub 1/') WHEN 3 THEN concat('src', n_nationkey % 9, '/none') ELSE concat('src', n_nationkey % 6 + 6, '/dir', n_nationkey % 2, '/Sub 2') END AS path FROM {nation}"


@query(
    "WITH s AS (SELECT replace(trim(lower(path), '/'), chr(92), '/') AS k FROM (" + _CHOSEN.replace("{nation}", "nation") + """)),
    p AS (SELECT DISTINCT CASE WHEN split_part(k, '/', 1) IN (SELECT repository FROM files) THEN split_part(k, '/', 1) END AS library, CASE WHEN split_part(k, '/', 1) IN (SELECT repository FROM files) THEN substr(k, length(split_part(k, '/', 1)) + 2) ELSE k END AS folder FROM s)
    SELECT id FROM files f WHERE EXISTS (SELECT 1 FROM p WHERE (p.library IS NULL OR p.library = f.repository) AND (p.folder = '' OR lower(f.folder) = p.folder OR starts_with(lower(f.folder), concat(p.folder, '/'))))"""
)
def f10_library_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in chosen folders, of which some name a library and some count in all of them."""
    files = view(spark, sf_dir, "files").select("id", F.col("repository").alias("library"), "folder")
    specs = spark.sql(_CHOSEN, nation=table(spark, sf_dir, "nation"))
    return clouds.in_library_folders(files, clouds.library_folders(specs, files.select("library"))).select("id")


@query("SELECT id FROM messages WHERE scope = 'channel' AND team IN ('team0', 'team2') AND conv_id % 7 <> 3 UNION ALL SELECT id FROM messages WHERE scope = 'chat' AND role = 'user'")
def f23_chat_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "messages")
    teams = spark.createDataFrame([("team0",), ("team2",)], "team string")
    gone = m.where("conv_id % 7 = 3").select("conv_id").distinct()
    channels = m.where("scope = 'channel'").join(F.broadcast(teams), "team", "left_semi").join(gone, "conv_id", "left_anti")
    return channels.select("id").unionByName(m.where("scope = 'chat' and role = 'user'").select("id"))


_SITES = "SELECT DISTINCT concat('https://T.x/sites/s', cast(c_nationkey AS string), CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/sub' WHEN 2 THEN '/Shared%20Documents/a.docx' ELSE '/lib/Forms/All.aspx' END) AS site FROM customer"


@query("SELECT site, regexp_replace(regexp_replace(lower(site), '/shared%20documents/.*', ''), '/lib/forms/.*', '') AS key FROM (" + _SITES + ")")
def x29_site_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = spark.sql(_SITES.replace("FROM customer", "FROM {c}"), c=table(spark, sf_dir, "customer"))
    return sites.select("site", clouds.site_key(F.col("site")).alias("key"))


@query("SELECT site, regexp_extract(site, '/s([0-9]+)', 1) = '3' OR site LIKE '%/s4/sub' OR (regexp_extract(site, '/s([0-9]+)', 1) = '4' AND site NOT LIKE '%/sub') AS protected FROM (" + _SITES + ")")
def f27_protected_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = spark.sql(_SITES.replace("FROM customer", "FROM {c}"), c=table(spark, sf_dir, "customer"))
    guards = spark.createDataFrame([("https://t.x/sites/s3",), ("https://t.x/sites/S4/sub",), ("https://t.x",)], "site string")
    return clouds.protected_sites(sites, guards)


@query("SELECT DISTINCT site FROM (" + _SITES + ") WHERE regexp_matches(site, '/s1(/|$)') OR site LIKE '%/s2/sub'")
def f27_covered_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = spark.sql(_SITES.replace("FROM customer", "FROM {c}"), c=table(spark, sf_dir, "customer"))
    return clouds.covered_sites(sites, spark.createDataFrame([("https://t.x/sites/s1/",), ("https://t.x/sites/s2/sub",)], "site string"))


@query("SELECT id FROM accounts WHERE id % 10 = 0")
def f27_covered_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "accounts")
    items = a.select("id", F.array("address", F.concat(F.lit("Alias"), F.col("id").cast("string"))).alias("aliases"))
    return clouds.covered_accounts(items, a.where("id % 10 = 0").select(F.concat(F.lit("ALIAS"), F.col("id").cast("string")).alias("account"))).select("id")


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN concat('topic ', conv_id) WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN concat('Reunião: ', role) ELSE 'Conversa em grupo' END AS label FROM conversations")
def x33_chat_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("topic "), F.col("conv_id").cast("string")))
    kind = F.when(F.col("turn") % 3 == 0, "oneOnOne").when(F.col("turn") % 3 == 1, "meeting").otherwise("group")
    names = F.array(F.when(F.col("turn") % 3 != 2, F.col("role")), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", clouds.chat_label(topic, kind, names).alias("label"))


@query("SELECT conv_id, turn, (conv_id + turn) % 4 = 0 AS attached FROM conversations")
def x43_attachment_in_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body structure as a flat array of parts; one that is an attachment is enough."""
    part = lambda d: F.struct(F.lit("text").alias("type"), d.alias("disposition"))
    parts = F.array(part(F.lit("inline")), part(F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "attachment")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", parts.alias("parts"))
    return c.select("conv_id", "turn", F.exists("parts", lambda p: F.coalesce(p["disposition"] == "attachment", F.lit(False))).alias("attached"))


@query("SELECT conv_id, turn, concat(role, ' ', turn) AS subject, 'a.txt' AS attachments, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM conversations")
def x7_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages with an attachment, made of the conversations, and read again."""
    c = table(spark, sf_dir, "conversations")
    raw = F.concat(
        F.lit("Subject: "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\r\nFrom: a@x.org\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"),
        F.base64(F.encode("text", "UTF-8")), F.lit("\r\n--B\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=a.txt\r\n\r\nx\r\n--B--\r\n"),
    )
    read = c.select("conv_id", "turn", extract.read_message(F.encode(raw, "UTF-8")).alias("m"))
    body = F.md5(F.trim(F.regexp_replace("m.body", r"\s+", " ")).cast("binary"))
    return read.select("conv_id", "turn", "m.subject", F.array_join("m.attachments", ",").alias("attachments"), body.alias("body"))


@query("SELECT id, cast(len(regexp_extract_all(text, '(?i)[a-z]+ing')) AS bigint) AS count FROM files WHERE len(regexp_extract_all(text, '(?i)[a-z]+ing')) > 0")
def m11_limited_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.user_pattern_hits(view(spark, sf_dir, "files"), "t", "[A-Za-z]+ing", seconds=5.0).select("id", "count")


@query("SELECT row_number() OVER () AS nth, name FROM (SELECT DISTINCT name, cast(regexp_extract(name, '([0-9]+)', 1) AS bigint) AS n FROM files ORDER BY n, name)")
def t6_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers within names compare as numbers."""
    return placed(view(spark, sf_dir, "files").select("name").distinct(), [natural_key(F.col("name")), F.col("name")])


@query("SELECT row_number() OVER () AS nth, n_name AS name FROM (SELECT n_name FROM nation ORDER BY lower(n_name))")
def t3_locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).orderBy(F.collate("n_name", "UNICODE_CI"), "n_name"))
