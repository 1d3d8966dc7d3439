"""Queries on projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import html as h
from ..functions import text as t
from .catalog import query
from .filters import at
from .matching import FOLD
from .views import table, view


@query("SELECT id, regexp_extract(lower(name), '^.+([.][^.]+)$', 1) AS extension FROM files")
def p1_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").select("id", t.extension(F.col("name")).alias("extension"))


@query("SELECT id, folder AS parent FROM files")
def p2_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").select("id", t.parent_folder(F.concat_ws("/", "folder", "name")).alias("parent"))


@query("SELECT id, round(size / 1024.0, 1) AS kb, round(size / 1048576.0, 2) AS mb FROM files")
def p3_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").select("id", t.kilobytes(F.col("size")).alias("kb"), t.megabytes(F.col("size")).alias("mb"))


@query("SELECT id, CASE WHEN author <> '' AND id % 3 > 0 THEN concat(author, ' <u', id, '@x.org>') WHEN id % 3 > 0 THEN concat('u', id, '@x.org') ELSE coalesce(author, '') END AS person FROM files")
def p4_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    email = F.when(F.col("id") % 3 > 0, F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@x.org")))
    return view(spark, sf_dir, "files").select("id", t.person(F.col("author"), email).alias("person"))


@query("SELECT id, concat(substr(text, 1, 10), '[', substr(text, 11, 5), ']', substr(text, 16, 10), CASE WHEN owner <> '' THEN concat(' (', owner, ')') ELSE '' END) AS sample FROM files")
def p5_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda a, n: F.substring("text", a, n)
    return view(spark, sf_dir, "files").select("id", t.sample_text(part(1, 10), part(11, 5), part(16, 10), F.col("owner")).alias("sample"))


@query(
    """SELECT seq, CASE status WHEN 'deleted' THEN concat('Excluído em ', strftime(done_at, '%d/%m/%Y %H:%M:%S'), ' — ', mode) WHEN 'missing' THEN concat('Não encontrado em ', strftime(done_at, '%d/%m/%Y %H:%M:%S'), ' — ', mode) ELSE concat('Não excluído em ', strftime(done_at, '%d/%m/%Y %H:%M:%S'), ' — ', mode) END AS text FROM deletions"""
)
def p6_deletion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    what = F.when(F.col("status") == "deleted", "Excluído em ").when(F.col("status") == "missing", "Não encontrado em ").otherwise("Não excluído em ")
    return view(spark, sf_dir, "deletions").select("seq", F.concat(what, t.csv_time(F.col("done_at")), F.lit(" — "), "mode").alias("text"))


@query("SELECT id, CASE WHEN s LIKE '%\"%' OR s LIKE '%;%' OR contains(s, chr(10)) OR contains(s, chr(13)) THEN concat('\"', replace(s, '\"', '\"\"'), '\"') ELSE s END AS cell FROM (SELECT id, CASE WHEN regexp_matches(x, '^[=+@\t\r-]') THEN concat('''', x) ELSE x END AS s FROM (SELECT id, concat(CASE id % 5 WHEN 0 THEN '=' WHEN 1 THEN '@' WHEN 2 THEN 'a;' WHEN 3 THEN 'say \"' ELSE '' END, text) AS x FROM files))")
def p9_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("id") % 5 == 0, "=").when(F.col("id") % 5 == 1, "@").when(F.col("id") % 5 == 2, "a;").when(F.col("id") % 5 == 3, 'say "').otherwise("")
    return view(spark, sf_dir, "files").select("id", t.csv_cell(F.concat(start, "text")).alias("cell"))


_MASKS = "SELECT event_id AS id, concat('0x', lower(hex(event_id * 37 % 600000))) AS mask FROM {events}"


@query(
    """WITH m AS (SELECT event_id AS id, event_id * 37 % 600000 AS n FROM events) SELECT id, CASE WHEN n & 65600 <> 0 THEN 'delete' WHEN n & 6 <> 0 THEN 'write' WHEN n & 786432 <> 0 THEN 'permissions' WHEN n & 256 <> 0 THEN 'attributes' WHEN n & 1 <> 0 THEN 'read' ELSE 'other' END AS label FROM m"""
)
def p13_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = spark.sql(_MASKS, events=table(spark, sf_dir, "events"))
    return masks.select("id", t.access_label(F.col("mask")).alias("label"))


@query(r"SELECT id, lower(concat('\\srv\', replace(folder, '/', '\'), '\', name)) AS path FROM files")
def p14_windows_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("id") % 2 == 0, F.lit("\\\\?\\UNC\\Srv\\")).otherwise(F.lit("\\\\Srv\\")), "folder", F.lit("/"), "name", F.when(F.col("id") % 3 == 0, "\\").otherwise(""))
    return view(spark, sf_dir, "files").select("id", t.windows_path(raw).alias("path"))


@query(f"SELECT id, CASE WHEN s = '' THEN 'relatorio' ELSE s END AS name FROM (SELECT id, substr(regexp_replace(regexp_replace({FOLD.format('substr(text, 1, 200)')}, '[^A-Za-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS s FROM files)")
def p15_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").select("id", t.safe_name(F.substring("text", 1, 200)).alias("name"))


@query("SELECT key, value FROM (SELECT count(*) AS files, cast(sum(size) AS bigint) AS bytes, count(DISTINCT repository) AS repositories FROM files) UNPIVOT (value FOR key IN (files, bytes, repositories))")
def p16_run_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "files").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"), F.countDistinct("repository").alias("repositories"))
    return s.unpivot([], ["files", "bytes", "repositories"], "key", "value")


@query("SELECT id, array_to_string([x.a, x.b], '|') AS terms, cast(x.n AS bigint) AS occurrences FROM (SELECT id, {'a': concat('t', id % 3), 'b': concat('t', id % 3 + 1), 'n': 2 * (id % 5) + id % 7} AS x FROM files)")
def p7_p8_terms_and_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda k: F.concat(F.lit("t"), k.cast("string"))
    k = F.col("id") % 3
    found = F.array(F.struct(name(k).alias("term"), (F.col("id") % 5).alias("count")), F.struct(name(k + 1).alias("term"), (F.col("id") % 5).alias("count")), F.struct(name(k).alias("term"), (F.col("id") % 7).alias("count")))
    m = view(spark, sf_dir, "files").select("id", found.alias("m"))
    terms = F.array_distinct(F.transform("m", lambda x: x["term"]))
    return m.select("id", F.array_join(terms, "|").alias("terms"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("occurrences"))


@query("SELECT DISTINCT c_mktsegment AS raw, CASE WHEN regexp_matches(lower(c_mktsegment), '^[a-z0-9]+$') THEN concat('.', lower(c_mktsegment)) END AS extension FROM customer")
def x22_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" *."), "c_mktsegment", F.lit(" "))
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("raw"), t.normal_extension(raw).alias("extension")).distinct()


_DATES = "SELECT id, {} AS at FROM files"
_KNOWN = "CASE WHEN {0} >= timestamp '1980-01-02 00:00:00' THEN {0} END"


@query(
    f"SELECT id, strftime(greatest({_KNOWN.format('modified')}, {_KNOWN.format('accessed')}, {_KNOWN.format('created')}), '%Y-%m-%d %H:%M:%S') AS used, strftime(greatest({_KNOWN.format('modified')}, {_KNOWN.format('accessed')}), '%Y-%m-%d %H:%M:%S') AS opened, strftime({_KNOWN.format('modified')}, '%Y-%m-%d %H:%M:%S') AS modified FROM files"
)
def x23_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = [F.col(c) for c in ("modified", "accessed", "created")]
    text = lambda c: F.date_format(dates.file_date(*three, c), "yyyy-MM-dd HH:mm:ss").alias(c)
    return view(spark, sf_dir, "files").select("id", *map(text, ("used", "opened", "modified")))


@query("SELECT o_orderkey AS id, strftime(o_orderdate + interval '10' hour - interval '1' month * (o_orderkey % 30), '%Y-%m-%d %H:%M:%S') AS cutoff FROM orders")
def x24_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 36000)
    cut = F.lit(None).cast("timestamp")
    for k in range(30):
        cut = F.when(F.col("o_orderkey") % 30 == k, dates.cutoff(now, k, "months")).otherwise(cut)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(cut, "yyyy-MM-dd HH:mm:ss").alias("cutoff"))


@query("SELECT id, cast(greatest(0, floor(epoch_ms(timestamp '2024-02-01 00:00:00') / 86400000.0 - epoch_ms(modified) / 86400000.0)) AS bigint) AS days FROM files WHERE modified IS NOT NULL")
def x25_age_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").where("modified is not null").select("id", dates.age_days(F.col("modified"), at()).alias("days"))


@query("SELECT id, lower(split_part(split_part(url, '://', 2), '/', 1)) AS host FROM (SELECT page_id AS id, url FROM pages)")
def x29_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), h.host(F.col("url")).alias("host"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE author END AS name FROM files WHERE author <> ''")
def x30_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.concat(F.lit('"'), "author", F.lit('" <u@x.org>'))
    own = F.concat(F.lit("U@x.org <u@x.org>"))
    return view(spark, sf_dir, "files").where("author <> ''").select("id", t.display_name(F.when(F.col("id") % 3 == 0, own).otherwise(plain)).alias("name"))


@query("SELECT id, sender, concat('a', id, ',b') AS images FROM messages")
def x31_x32_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.to_json(F.struct(F.struct(F.struct(F.col("sender").alias("displayName")).alias("user")).alias("messageSender")))
    page = F.concat(F.lit("<img src='x/hostedContents/a"), F.col("id").cast("string"), F.lit("/$value'><img src='x/hostedContents/b/$value'><img src='x/hostedContents/b/$value'>"))
    return view(spark, sf_dir, "messages").select("id", t.quote_sender(quote).alias("sender"), F.array_join(t.hosted_images(page), ",").alias("images"))


@query("SELECT id, concat('m', id, '@x') AS message_id FROM messages")
def x35_message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("id") % 2 == 0, " <M").otherwise("m"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "@X> ").otherwise("@x"))
    return view(spark, sf_dir, "messages").select("id", t.message_id(raw).alias("message_id"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate + interval '7' hour, '%Y-%m-%d %H:%M:%S') AS at FROM orders")
def x37_pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("093000+02'30'"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(t.pdf_date(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


ERRORS = {"EACCES": "sem permissão", "ENOENT": "não encontrado", "EBUSY": "em uso", "ETIMEDOUT": "tempo esgotado"}


@query("SELECT seq, CASE status WHEN 'failed' THEN 'sem permissão' WHEN 'missing' THEN 'não encontrado' WHEN 'changed' THEN 'X' END AS message FROM deletions")
def x39_error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame(list(ERRORS.items()), "code string, message string")
    code = F.when(F.col("status") == "failed", "EACCES").when(F.col("status") == "missing", "ENOENT").when(F.col("status") == "changed", "X")
    joined = view(spark, sf_dir, "deletions").withColumn("code", code).join(F.broadcast(texts), "code", "left")
    return joined.select("seq", F.coalesce("message", "code").alias("message"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN '100%/x' ELSE concat(folder, '/', name) END AS path FROM files")
def x40_drive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.concat(F.lit("/drives/1/root:/"), F.replace(F.concat_ws("/", "folder", "name"), F.lit(" "), F.lit("%20")))
    return view(spark, sf_dir, "files").select("id", t.drive_path(F.when(F.col("id") % 4 == 0, "/drive/root:/100%/x").otherwise(coded)).alias("path"))


@query("SELECT id, left(sha256(concat('{\"c0\":', id, '}')), 32) AS signature FROM accounts")
def x34_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lifecycle import signature

    return view(spark, sf_dir, "accounts").select("id", signature(F.col("id")).alias("signature"))
