"""Queries on summaries of files, mail, chats, accounts, retention and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, filetypes
from ..functions import text as t
from ..functions.fold import fold_text
from ..operators import enrich, external, matching, reports
from .catalog import query
from .filters import at
from .matching import FOLD
from .views import table, view

USER = "CASE WHEN id % 10 = 0 THEN 'auditor' WHEN author <> '' THEN author WHEN owner <> '' THEN owner END"
SOURCE = "CASE WHEN id % 10 = 0 THEN 'audit' WHEN author <> '' THEN 'metadata' WHEN owner <> '' THEN 'owner' ELSE 'none' END"
TYPES = ["archive", "document", "audio"]


def files_with_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = enrich.last_user(("audit", F.when(F.col("id") % 10 == 0, F.lit("auditor"))), ("metadata", F.col("author")), ("owner", F.col("owner")))
    return view(spark, sf_dir, "files").withColumn("_x", x).select("*", F.col("_x.user").alias("last_user"), F.col("_x.source").alias("last_source"))


@query(
    f"""WITH f AS (SELECT {USER} AS u, {SOURCE} AS s, size % 7 AS o FROM files), g AS (SELECT coalesce(u, '(não identificado)') AS user, s, count(*) AS n, sum(o) AS o FROM f GROUP BY 1, 2)
    SELECT user, cast(sum(n) AS bigint) AS files, cast(sum(o) AS bigint) AS occurrences, coalesce(string_agg(CASE WHEN s <> 'none' THEN concat(s, '=', n) END, '|' ORDER BY s), '') AS sources FROM g GROUP BY user"""
)
def a2_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files_with_users(spark, sf_dir)
    return reports.by_user(f.select("last_user", F.when(F.col("last_source") != "none", F.col("last_source")).alias("source"), (F.col("size") % 7).alias("occurrences")))


@query(
    """SELECT 'repository' AS kind, repository AS key, count(*) AS files FROM files GROUP BY 2 UNION ALL
    SELECT 'status', status, count(*) FROM files GROUP BY 2 UNION ALL
    SELECT 'extension', coalesce(nullif(regexp_extract(lower(name), '^.+([.][^.]+)$', 1), ''), '(sem extensão)'), count(*) FROM files GROUP BY 2"""
)
def a3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the files: each row gives a pair per kind."""
    ext = t.extension(F.col("name"))
    pairs = F.array(F.struct(F.lit("repository").alias("kind"), F.col("repository").alias("key")), F.struct(F.lit("status").alias("kind"), F.col("status").alias("key")), F.struct(F.lit("extension").alias("kind"), F.when(ext == "", F.lit("(sem extensão)")).otherwise(ext).alias("key")))
    each = view(spark, sf_dir, "files").select(F.explode(pairs).alias("x")).select("x.*")
    return each.groupBy("kind", "key").agg(F.count("*").alias("files"))


_MAIL_HITS = f"""WITH g AS (SELECT id, 'subject' AS location, {FOLD.format("concat(role, ' ', folder)")} AS f, mailbox, sender FROM messages UNION ALL SELECT id, 'body', {FOLD.format("text")}, mailbox, sender FROM messages
    UNION ALL SELECT id, 'attachmentName', {FOLD.format("concat('anexo-', scope, '.data')")}, mailbox, sender FROM messages WHERE attached),
    t AS (SELECT *, 'data' AS term_id, (length(f) - length(replace(f, 'data', ''))) / 4 AS n FROM g UNION ALL SELECT *, 'user', (length(f) - length(replace(f, 'user', ''))) / 4 FROM g), h AS (SELECT * FROM t WHERE n > 0)"""


def mail_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "messages")
    groups = {
        "subject": m.select("id", F.concat_ws(" ", "role", "folder").alias("text")),
        "body": m.select("id", "text"),
        "attachmentName": m.where("attached").select("id", F.concat(F.lit("anexo-"), "scope", F.lit(".data")).alias("text")),
    }
    return matching.grouped_hits(groups, [("data", "DATA", False), ("user", "user", False)])


@query(
    _MAIL_HITS
    + """ SELECT term_id, count(DISTINCT id) AS messages, cast(sum(n) AS bigint) AS occurrences, count(*) FILTER (WHERE location = 'subject') AS in_subject, count(*) FILTER (WHERE location = 'body') AS in_body, count(*) FILTER (WHERE location NOT IN ('subject', 'body')) AS in_attachments FROM h GROUP BY term_id"""
)
def a5_mail_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_term(mail_hits(spark, sf_dir), unit="messages", inside={"in_subject": ["subject"], "in_body": ["body"], "in_attachments": []})


@query(_MAIL_HITS + " SELECT location, count(DISTINCT id) AS files FROM h GROUP BY location")
def a4_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.at_locations(mail_hits(spark, sf_dir))


@query(_MAIL_HITS + ", m AS (SELECT DISTINCT id, mailbox, sender FROM h) SELECT 'mailbox' AS kind, mailbox AS key, count(*) AS messages FROM m GROUP BY 2 UNION ALL SELECT 'sender', sender, count(*) FROM m GROUP BY 2")
def a5_mail_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = view(spark, sf_dir, "messages").join(mail_hits(spark, sf_dir).select("id").distinct(), "id", "left_semi")
    pairs = F.array(F.struct(F.lit("mailbox").alias("kind"), F.col("mailbox").alias("key")), F.struct(F.lit("sender").alias("kind"), F.col("sender").alias("key")))
    return hit.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.key").agg(F.count("*").alias("messages"))


@query(
    """SELECT type, source, count(*) AS accounts, count(*) FILTER (WHERE n_aliases > 0) AS with_aliases, cast(sum(n_aliases) AS bigint) AS aliases, count(*) FILTER (WHERE licensed) AS licensed,
    count(*) FILTER (WHERE NOT enabled) AS disabled, count(*) FILTER (WHERE enabled IS NULL) AS unknown FROM accounts GROUP BY type, source"""
)
def a6_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return view(spark, sf_dir, "accounts").groupBy("type", "source").agg(
        F.count("*").alias("accounts"), F.count_if(F.col("n_aliases") > 0).alias("with_aliases"), F.sum("n_aliases").cast("long").alias("aliases"),
        yes(F.col("licensed")).alias("licensed"), yes(~F.col("enabled")).alias("disabled"), F.count_if(F.col("enabled").isNull()).alias("unknown"),
    )


_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_MESSAGES = f"count(*) AS messages, cast(sum(length(text)) AS bigint) AS bytes, count(*) FILTER (WHERE attached) AS with_attachments, {_TIME.format('min(sent)')} AS oldest, {_TIME.format('max(sent)')} AS newest"


@query(f"SELECT mailbox, folder, {_MESSAGES} FROM messages GROUP BY mailbox, folder")
def a7_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.message_totals(view(spark, sf_dir, "messages"), "mailbox", "folder")


@query(f"SELECT {_MESSAGES} FROM messages")
def a7_message_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.message_totals(view(spark, sf_dir, "messages"))


OWN = ["empresa.com"]
_OUT = "lower(split_part(recipient, '@', 2))"
_PAIRS = f"""WITH p AS (SELECT id, mailbox, source, sender, 'to' AS field, lower(recipient) AS address, {_OUT} AS domain, sent, conv_id FROM messages
    UNION ALL SELECT id, mailbox, source, sender, 'cc', lower(sender), lower(split_part(sender, '@', 2)), sent, conv_id FROM messages WHERE turn % 2 = 0),
    x AS (SELECT id, mailbox, source, sender, address, domain, sent, conv_id, string_agg(field, '+' ORDER BY field) AS fields FROM p WHERE NOT (domain = 'empresa.com' OR domain LIKE '%.empresa.com') GROUP BY ALL)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "messages").select("id", "mailbox", "source", "sender", "sent", "conv_id", F.array("recipient").alias("to"), F.when(F.col("turn") % 2 == 0, F.array("sender")).alias("cc"), F.lit(None).cast("array<string>").alias("bcc"))
    return external.recipients(m, OWN)


@query(_PAIRS + f" SELECT address, domain, count(DISTINCT id) AS messages, count(DISTINCT mailbox) AS mailboxes, {_TIME.format('min(sent)')} AS first, {_TIME.format('max(sent)')} AS last FROM x GROUP BY address, domain")
def a8_by_recipient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(external.by_recipient(pairs(spark, sf_dir)))


@query(_PAIRS + f" SELECT domain, count(DISTINCT address) AS recipients, count(DISTINCT id) AS messages, {_TIME.format('min(sent)')} AS first, {_TIME.format('max(sent)')} AS last FROM x GROUP BY domain")
def a8_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(external.by_domain(pairs(spark, sf_dir)))


def _texts(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


@query(_PAIRS + " SELECT mailbox, count(DISTINCT id) AS messages, count(DISTINCT address) AS recipients FROM x GROUP BY mailbox")
def a8_by_mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external.by_mailbox(pairs(spark, sf_dir))


@query(_PAIRS + " SELECT fields, count(*) AS pairs FROM x GROUP BY fields")
def a8_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy(F.array_join("fields", "+").alias("fields")).agg(F.count("*").alias("pairs"))


@query(
    _PAIRS
    + """, s AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN concat('m', conv_id) ELSE concat(source, ':', mailbox, ':', id) END AS k FROM x WHERE lower(split_part(sender, '@', 2)) = 'empresa.com' OR lower(split_part(sender, '@', 2)) LIKE '%.empresa.com'),
    d AS (SELECT sender, domain, row_number() OVER (PARTITION BY sender ORDER BY count(*) DESC, domain) AS nth FROM s GROUP BY sender, domain),
    j AS (SELECT sender, string_agg(domain, '|' ORDER BY nth) AS top_domains FROM d WHERE nth <= 5 GROUP BY sender)
    SELECT sender, count(DISTINCT k) AS messages, count(DISTINCT address) AS recipients, count(DISTINCT domain) AS domains, count(DISTINCT mailbox) AS mailboxes, any_value(top_domains) AS top_domains FROM s JOIN j USING (sender) GROUP BY sender"""
)
def a9_by_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = pairs(spark, sf_dir).withColumn("message_id", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("m"), F.col("conv_id").cast("string"))))
    return external.by_sender(named, OWN)


@query("SELECT scope, CASE WHEN scope = 'channel' THEN team END AS team, role, count(*) AS messages, count(DISTINCT conv_id) AS conversations FROM messages GROUP BY 1, 2, 3")
def a10_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams only name channels; scopes without messages have no row."""
    team = F.when(F.col("scope") == "channel", F.col("team"))
    return view(spark, sf_dir, "messages").groupBy("scope", team.alias("team"), "role").agg(F.count("*").alias("messages"), F.countDistinct("conv_id").alias("conversations"))


_AGE = "floor(date_diff('millisecond', used, timestamp '1999-01-01 00:00:00') / 86400000)"
_EXPIRED = f"WITH e AS (SELECT *, greatest(0, {_AGE}) AS days FROM retained WHERE used < timestamp '1998-01-01 00:00:00')"
_BUCKET = "CASE WHEN days < 365 THEN 'ate-1-ano' WHEN days < 730 THEN '1-2-anos' WHEN days < 1826 THEN '2-5-anos' WHEN days < 3652 THEN '5-10-anos' ELSE 'mais-10-anos' END"


def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = at("1999-01-01 00:00:00")
    used = dates.known(F.col("used"))
    kept = view(spark, sf_dir, "retained").where(dates.in_window(used, dates.cutoff(now, 1, "years")))
    return kept.withColumn("days", dates.age_days(F.col("used"), now)).withColumn("age", dates.age_bucket(F.col("days")))


@query(_EXPIRED + f" SELECT {_BUCKET} AS age, count(*) AS count, cast(sum(size) AS bigint) AS bytes FROM e GROUP BY 1")
def a11_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sized(expired(spark, sf_dir), F.col("age"), "age")


@query(_EXPIRED + " SELECT extension, count(*) AS count, cast(sum(size) AS bigint) AS bytes FROM e GROUP BY 1 ORDER BY bytes DESC, count DESC, extension LIMIT 500")
def a11_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.largest(reports.sized(expired(spark, sf_dir), F.col("extension"), "extension"), "bytes", "count", "extension")


@query(_EXPIRED + " SELECT coalesce(last_user, '') AS user, count(*) AS count, cast(sum(size) AS bigint) AS bytes FROM e GROUP BY 1 ORDER BY count DESC, bytes DESC, user LIMIT 500")
def a11_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.largest(reports.sized(expired(spark, sf_dir), F.coalesce("last_user", F.lit("")), "user"), "count", "bytes", "user")


@query(_EXPIRED + " SELECT mailbox, folder, count(*) AS count, cast(sum(size) AS bigint) AS bytes FROM e GROUP BY 1, 2")
def a11_by_mailbox_and_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expired(spark, sf_dir).groupBy("mailbox", "folder").agg(F.count("*").alias("count"), F.sum("size").cast("long").alias("bytes"))


_TYPED = """WITH x AS (SELECT *, CASE WHEN lower(name) LIKE '%.tar.gz' THEN '.tar.gz' ELSE regexp_extract(lower(name), '^.+([.][^.]*)$', 1) END AS e FROM files),
    y AS (SELECT *, CASE WHEN e = '.tar.gz' THEN 'custom' WHEN e IN ('.txt', '.pdf', '.docx') THEN 'document' WHEN e = '.mp3' THEN 'audio' END AS category FROM x)"""


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").withColumn("x", filetypes.type_by_name(F.col("name"), TYPES, [".tar.gz"])).where("x is not null")


@query(_TYPED + " SELECT category, e AS extension, count(*) AS count, cast(sum(size) AS bigint) AS bytes FROM y WHERE category IS NOT NULL GROUP BY 1, 2")
def a12_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).groupBy("x.category", "x.extension").agg(F.count("*").alias("count"), F.sum("size").cast("long").alias("bytes"))


@query("SELECT folder, count(*) AS messages, count(*) FILTER (WHERE sent IS NULL) AS without_date, " + f"{_TIME.format('min(sent)')} AS oldest, {_TIME.format('max(sent)')} AS newest FROM messages GROUP BY folder")
def a17_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.census(view(spark, sf_dir, "messages"), "folder")


@query("WITH m AS (SELECT strftime(sent, '%Y-%m') AS month, count(*) AS n FROM messages WHERE sent IS NOT NULL GROUP BY 1) SELECT CASE WHEN (SELECT count(*) FROM m) > 24 THEN left(month, 4) ELSE month END AS period, cast(sum(n) AS bigint) AS messages FROM m GROUP BY 1")
def a25_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timeline(view(spark, sf_dir, "messages"))


@query("SELECT left(strftime(l_shipdate, '%Y-%m'), 4) AS period, count(*) AS messages FROM lineitem GROUP BY 1")
def a25_long_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timeline(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("sent")))


@query(
    """SELECT count(*) AS seen, count(*) FILTER (WHERE status IN ('ok', 'partial')) AS analysed, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'encrypted') AS encrypted, count(*) FILTER (WHERE status = 'skipped-size') AS too_large,
    count(*) FILTER (WHERE status = 'empty') AS empty, count(*) FILTER (WHERE status = 'error') AS errors, cast(sum(CASE status WHEN 'ok' THEN size WHEN 'partial' THEN least(size, 52428800) ELSE 0 END) AS bigint) AS bytes_analysed FROM files"""
)
def a18_scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_statistics(view(spark, sf_dir, "files"))


@query("SELECT status, count(*) AS files FROM files GROUP BY status")
def a19_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counted(view(spark, sf_dir, "files"), F.col("status"), "status")


@query("SELECT DISTINCT sender AS value FROM messages WHERE sender <> '' ORDER BY value LIMIT 500")
def a24_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.options(view(spark, sf_dir, "messages"), "sender")


@query(f"SELECT count(DISTINCT {FOLD.format('text')}) AS texts, count(DISTINCT repository) AS repositories FROM files")
def a_exact_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts are exact, never sketches; of texts their 256-bit hashes are shuffled, not the texts."""
    return view(spark, sf_dir, "files").agg(F.countDistinct(F.sha2(fold_text(F.col("text")), 256)).alias("texts"), F.countDistinct("repository").alias("repositories"))
