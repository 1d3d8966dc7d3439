"""Inputs as DataFrames: folders of files, logs, term lists, landed tables of services."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import changed_within
from ..functions.globs import excluded

#: The fields of a deletion event that analytics use.
DELETION = "scanId string, recordId long, status string, error string, note string, mode string, method string, `by` string, item string, at timestamp, scanName string, scheduleId string, scheduleName string, purpose string"


def files(spark: SparkSession, root: str, *, content: bool = True, exclude: list[str] = ()) -> DataFrame:
    """path, relative_path, name, size, modified and, if asked for, content of all files below root.

    Without content Spark doesn't open the files. Exclusions are filters on the path. Spark's reader
    leaves out files of no bytes.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^file:(//)?", "", root).rstrip("/")
    rel = F.substring(F.regexp_replace("path", "^file:(//)?", ""), F.lit(len(base) + 2), F.lit(1 << 30))
    named = found.select("path", rel.alias("relative_path"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.col("content")] if content else []))
    return named.where(~excluded(F.col("relative_path"), list(exclude))) if exclude else named


def log(spark: SparkSession, path: str, schema: str | StructType = DELETION) -> DataFrame:
    """Rows of an append-only log of JSON lines, with _file and _row in file order; broken lines are left out.

    An event that was glued to the broken end of the one before it is recovered: the last object that
    opens in the line is tried as well.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    return parsed_log(lines, schema)


def parsed_log(lines: DataFrame, schema: str | StructType = DELETION) -> DataFrame:
    """value as JSON objects of schema; other columns stay."""
    kept = [c for c in lines.columns if c != "value"]
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    kind = f"{schema if isinstance(schema, str) else ', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, _bad string"
    whole = F.from_json("value", kind, mode)
    tail = F.from_json(F.regexp_extract("value", r'^.+(\{"scanId".*)$', 1), kind, mode)
    out = lines.select(*kept, F.coalesce(F.when(whole["_bad"].isNull(), whole), F.when(tail["_bad"].isNull(), tail)).alias("x"))
    return out.where("x is not null").select(*kept, "x.*").drop("_bad")


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """value, seq: a term per line of a text file, or the first column of a CSV file, its delimiter told by the line."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("seq"))
    return lines.select(term_of_line(F.col("line"), csv=path.lower().endswith(".csv")).alias("value"), "seq").where("value <> ''")


def term_of_line(line: Column, *, csv: bool) -> Column:
    text = F.trim(F.regexp_replace(line, "^﻿", ""))
    if not csv:
        return text
    sep = F.when(F.regexp_count(text, F.lit(";")) >= F.regexp_count(text, F.lit(",")), F.lit(";")).otherwise(F.lit(","))
    quoted = F.replace(F.regexp_extract(text, r'^"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))
    return F.trim(F.when(text.startswith('"'), quoted).otherwise(F.when(sep == ";", F.substring_index(text, ";", 1)).otherwise(F.substring_index(text, ",", 1))))


def landed_messages(messages: DataFrame, *, since: Column | None = None, before: Column | None = None, at: str = "sent") -> DataFrame:
    """Messages of a landed mail or chat table within a period; the bounds reach the scan as filters."""
    return messages.where(changed_within(F.col(at), since=since, before=before))


def conversation_messages(messages: DataFrame, *, since: Column | None = None) -> DataFrame:
    """Chat messages that people wrote, not deleted: message_type message, deleted null."""
    real = messages.where((F.col("message_type") == "message") & F.col("deleted").isNull())
    return real if since is None else real.where(F.col("at") >= since)


def account_aliases(proxies: Column, address: Column) -> Column:
    """Aliases from proxy addresses: those with lower-case smtp:, without the address itself."""
    names = F.transform(F.filter(proxies, lambda p: p.startswith("smtp:")), lambda p: F.lower(F.substring(p, F.lit(6), F.length(p))))
    return F.array_sort(F.array_except(names, F.array(F.lower(address))))


def primary_address(proxies: Column, fallback: Column) -> Column:
    """The proxy address with capital SMTP:, or fallback."""
    main = F.filter(proxies, lambda p: p.startswith("SMTP:"))
    return F.lower(F.coalesce(F.substring(F.get(main, F.lit(0)), F.lit(6), F.lit(1 << 20)), fallback))


def last_login(value: Column) -> Column:
    """Null for the zero date that stands for never."""
    at = F.try_to_timestamp(value)
    return F.when(F.year(at) > 1970, at)
