"""Outputs: tables, CSV for spreadsheets, JSON lines, HTML rows, workbooks in parts. Spark writes all of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from ..functions.text import csv_cell, csv_number, csv_time, html_cell

#: Limits of a worksheet.
MAX_ROWS, MAX_CELL, MAX_NAME = 1_048_576, 32_767, 31
HTML_ROWS = 10_000


def cells(df: DataFrame) -> list[Column]:
    """Every column as a CSV cell: times and numbers in the local manner, texts made safe."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "timestamp":
            c = csv_time(c)
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = csv_number(c)
        elif kind in ("bigint", "int", "smallint", "tinyint"):
            c = F.coalesce(c.cast("string"), F.lit(""))
        elif kind == "boolean":
            c = F.when(c, "sim").when(~c, "não").otherwise("")
        elif kind.startswith("array<string"):
            c = csv_cell(F.array_join(c, ", "))
        else:
            c = csv_cell(c.cast("string"))
        out.append(c.alias(name))
    return out


def csv_lines(df: DataFrame) -> DataFrame:
    """line: cells joined by semicolons."""
    return df.select(F.concat_ws(";", *cells(df)).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """Part files with a byte order mark, a header and CRLF ends, each a whole CSV file."""
    header = ";".join(df.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for pdf in frames:
            lines = [f"{x}\r" for x in pdf["line"]]
            if first:
                lines.insert(0, f"﻿{header}\r")
                first = False
            yield pd.DataFrame({"value": lines})

    csv_lines(df).mapInPandas(run, "value string").write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; internal fields, which start with an underscore, stay inside."""
    df.select(*(c for c in df.columns if not c.startswith("_"))).write.json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Events as JSON lines in files of their own: a broken write leaves no half line behind."""
    df.write.mode("append").json(path)


def html_rows(df: DataFrame, *, most: int = HTML_ROWS, order: list[Column] | None = None) -> DataFrame:
    """A table row of markup per row, the first most of an order."""
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), html_cell(c), F.lit("</td>")) for c in (F.col(n).cast("string") for n in df.columns)), F.lit("</tr>"))
    kept = df.orderBy(*order).limit(most) if order else df
    return kept.select(row.alias("html"))


def sheet_name(name: str) -> str:
    return re.sub(r"[\[\]:*?/\\]", " ", name).strip()[:MAX_NAME] or "Planilha"


def sheet_numbers(df: DataFrame, order: list[Column], *, max_rows: int = MAX_ROWS) -> DataFrame:
    """sheet (from 0) and row (from 1, the header is row 0) of each row in an order.

    Numbers need one total order. It is dealt into ranges, which are stored once with each row's place in its range; only the
    counts per range meet in one place, not the rows.
    """
    if taken := {"sheet", "row"} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} have to be renamed: the numbers are called so")
    in_range = df if not order else df.repartitionByRange(*order).sortWithinPartitions(*order)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(in_range.withColumn("_p", F.spark_partition_id()).withColumn("_m", nth), "sheets")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    numbered = placed.join(F.broadcast(starts), "_p").withColumn("_rn", F.col("_at") + F.col("_m"))  # a row for each range
    per = max_rows - 1
    return numbered.withColumn("sheet", F.floor(F.col("_rn") / per)).withColumn("row", F.col("_rn") % per + 1).drop("_p", "_m", "_at", "_rn")
