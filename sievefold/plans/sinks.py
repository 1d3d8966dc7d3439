"""Queries that show what sinks write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import extract, sinks
from ..sources.workbooks import write_workbooks
from ..tables import shared_folder
from .catalog import query
from .views import view


@query(
    """SELECT concat_ws(';', id::varchar, CASE WHEN regexp_matches(name, '^[=+@-]') THEN concat('''', name) ELSE name END, rtrim(rtrim(replace(printf('%.2f', round(size / 1024.0, 2)), '.', ','), '0'), ','), coalesce(strftime(modified, '%d/%m/%Y %H:%M:%S'), ''), CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'sim' ELSE 'não' END) AS line FROM files"""
)
def s16_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("id") % 3 == 1, True).when(F.col("id") % 3 == 2, False)
    return sinks.csv_lines(view(spark, sf_dir, "files").select("id", "name", (F.col("size") / 1024).alias("kb"), "modified", flag.alias("flag")))


@query("""SELECT concat('<tr><td>', id, '</td><td>', replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '</td></tr>') AS html FROM files ORDER BY id LIMIT 10000""")
def s18_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "files").select("id", "text")
    return sinks.html_rows(rows, order=[F.col("id")])


@query("SELECT id, (row_number() OVER (ORDER BY size DESC, id) - 1) // 99 AS sheet, (row_number() OVER (ORDER BY size DESC, id) - 1) % 99 + 1 AS row FROM files")
def s15_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files").select("id", "size")
    return sinks.sheet_numbers(files, [F.desc("size"), F.asc("id")], max_rows=100).select("id", "sheet", "row")


@query(
    """WITH f AS (SELECT row_number() OVER (ORDER BY id DESC) - 1 AS nth, * FROM files), e AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS nth, * FROM deletions)
    SELECT concat('Planilha "Arquivos', CASE WHEN nth >= 300 THEN concat(' (', nth // 300 + 1, ')') ELSE '' END, '"') AS sheet, nth % 300 + 1 AS line, concat_ws(chr(9), id::varchar, name, size::varchar, repository) AS cells, cast(epoch(modified) AS bigint) AS at FROM f
    UNION ALL SELECT concat('Planilha "Exclusões  feitas', CASE WHEN nth >= 300 THEN concat(' (', nth // 300 + 1, ')') ELSE '' END, '"'), nth % 300 + 1, concat_ws(chr(9), seq::varchar, status, mode, coalesce(policy, '')), NULL FROM e WHERE policy IS NOT NULL
    UNION ALL SELECT concat('Planilha "Exclusões  feitas', CASE WHEN nth >= 300 THEN concat(' (', nth // 300 + 1, ')') ELSE '' END, '"'), nth % 300 + 1, concat_ws(chr(9), seq::varchar, status, mode), NULL FROM e WHERE policy IS NULL
    UNION ALL SELECT 'Planilha "Vazia"', 0, 'a', NULL"""
)
def s19_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of files, deletions and nothing in workbooks of two sheets of 300 rows each, opened again: every row with its sheet and line."""
    path = shared_folder(spark, "books")
    files = view(spark, sf_dir, "files").select("id", "name", "size", "repository", "modified")
    events = view(spark, sf_dir, "deletions").select("seq", "status", "mode", "policy")
    tables = [("Arquivos", files, [F.desc("id")]), ("Exclusões: feitas", events, [F.asc("seq")]), ("Vazia", files.where("false").select(F.col("id").alias("a")), [F.asc("a")])]
    write_workbooks(tables, path, "relatorio", max_rows=301, sheets=2)
    found = spark.read.format("binaryFile").load(f"{path}/*.xlsx").select("path", F.col("path").alias("name"), F.col("length").alias("size"), "content")
    each = extract.extract(found).select(F.explode("segments").alias("s")).select("s.label", F.posexplode(F.split("s.text", "\n")).alias("line", "text"))
    parts = F.split("text", "\t")
    dated = F.col("label").startswith('Planilha "Arquivos') & (F.size(parts) == 5)
    at = F.when(dated, F.round((F.get(parts, F.lit(4)).cast("double") - 25569) * 86400).cast("long"))
    cells = F.array_join(F.slice(parts, 1, F.when(dated, 4).otherwise(F.size(parts))), "\t")
    rows = each.select(F.col("label").alias("sheet"), "line", cells.alias("cells"), at.alias("at"))
    return rows.where("line > 0 or sheet = 'Planilha \"Vazia\"'").select("sheet", F.col("line").cast("long").alias("line"), "cells", "at")


@query("SELECT seq, item, status, policy, size FROM deletions")
def s17_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines without the internal fields, read again; nulls stay nulls."""
    path = shared_folder(spark, "json")
    events = view(spark, sf_dir, "deletions").select("seq", "item", "status", "policy", "size", F.lower("status").alias("_search"))
    sinks.write_json(events, path)
    read = spark.read.text(path).select(F.from_json("value", "seq long, item long, status string, policy string, size long, _search string").alias("e")).select("e.*")
    return read.where("_search is null").drop("_search")
