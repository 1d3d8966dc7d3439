"""Workbooks (.xlsx) written by Spark: rows become cells in the JVM, tasks stream them into files, one task for each file.

Rows are numbered over all ranges of their order, so that a table of any size fills sheet after sheet and file after file;
nothing is held but a batch of rows. Times are dates of the format, whole numbers and dates have styles, the first line is fixed
and has a filter, a text that is too long for a cell is cut with a mark, and names of sheets are unique. A file gets its name when it is whole.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .logs import local
from .sinks import MAX_CELL, MAX_ROWS, sheet_name, sheet_numbers

SHEETS = 4  # in a file
WIDTH = 24
#: Numbers of the styles below, and the day from which the format counts.
HEADER, DATE, WHOLE, EPOCH = 1, 2, 3, 25_569
_MAIN, _PACKAGE, _OFFICE, _TYPES = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "application/vnd.openxmlformats-officedocument.spreadsheetml"
_STYLES = (
    f'<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="dd/mm/yyyy hh:mm"/></numFmts>'
    '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
    '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
    '<cellXfs count="4"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/><xf numFmtId="0" fontId="1" fillId="0" borderId="0" xfId="0" applyFont="1"/>'
    '<xf numFmtId="164" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/><xf numFmtId="3" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/></cellXfs></styleSheet>'
)
_CONTROL = "[\\u0000-\\u0008\\u000b\\u000c\\u000e-\\u001f\\ufffe\\uffff]"


def column_letters(k: int) -> str:
    """A, B, ... Z, AA, ... of a column's number from 0."""
    out, n = "", k + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _text_cell(place: Column, text: Column, style: int = 0) -> Column:
    clean = F.regexp_replace(text, _CONTROL, "")
    cut = F.when(F.length(clean) > MAX_CELL, F.concat(F.substring(clean, 1, MAX_CELL - 1), F.lit("…"))).otherwise(clean)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        cut = F.replace(cut, F.lit(char), F.lit(entity))
    cell = F.concat(F.lit('<c r="'), place, F.lit(f'" t="inlineStr"{f" s={chr(34)}{style}{chr(34)}" if style else ""}><is><t xml:space="preserve">'), cut, F.lit("</t></is></c>"))
    return F.when(F.coalesce(text, F.lit("")) != "", cell)


def _value_cell(place: Column, value: Column, style: int) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit('<c r="'), place, F.lit(f'"{f" s={chr(34)}{style}{chr(34)}" if style else ""}><v>'), value.cast("string"), F.lit("</v></c>")))


def row_xml(df: DataFrame, number: Column, *, zone: str = "UTC") -> Column:
    """The cells of a row of df as the format writes them; number is the row's own (the header has 1). Empty cells are left out."""
    out = []
    for k, (name, kind) in enumerate(df.dtypes):
        c, place = F.col(f"`{name}`"), F.concat(F.lit(column_letters(k)), number.cast("string"))
        if kind in ("bigint", "int", "smallint", "tinyint"):
            out.append(_value_cell(place, c, WHOLE))
        elif kind in ("double", "float"):
            out.append(_value_cell(place, F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c), 0))
        elif kind.startswith("decimal"):
            out.append(_value_cell(place, c, 0))
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            at = c.cast("timestamp") if kind != "timestamp" else F.from_utc_timestamp(c, zone)
            out.append(_value_cell(place, F.unix_micros(at) / F.lit(86_400_000_000.0) + EPOCH, DATE))
        elif kind == "boolean":
            out.append(_text_cell(place, F.when(c, "sim").when(~c, "não")))
        else:
            out.append(_text_cell(place, F.array_join(c, ", ") if kind.startswith("array<string") else c.cast("string")))
    cells = F.concat(*(F.coalesce(c, F.lit("")) for c in out))
    return F.concat(F.lit('<row r="'), number.cast("string"), F.lit('">'), cells, F.lit("</row>"))


def _header(columns: list[str]) -> str:
    cells = "".join(f'<c r="{column_letters(k)}1" t="inlineStr" s="{HEADER}"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for k, c in enumerate(columns))
    return f'<row r="1">{cells}</row>'


def unique_names(names: list[str], taken: set[str]) -> list[str]:
    """Names of sheets, each with a number where it is taken already, in any case."""
    out = []
    for name in names:
        base = own = sheet_name(name)
        nth = 2
        while own.lower() in taken:
            own, nth = f"{base[:27]} ({nth})", nth + 1
        taken.add(own.lower())
        out.append(own)
    return out


class Book:
    """A file under way: sheets one after another, rows as they come."""

    def __init__(self, file: str, tables: list[tuple[str, list[str]]]):
        self.zip, self.tables = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED), tables
        self.names: list[str] = []
        self.taken: set[str] = set()
        self.filters: list[str] = []
        self.now, self.out, self.rows = None, None, 0

    def row(self, table: int, sheet: int, xml: str) -> None:
        if (table, sheet) != self.now:
            self.end()
            title, columns = self.tables[table]
            self.names += unique_names([title if sheet == 0 else f"{sheet_name(title)[:24]} ({sheet + 1})"], self.taken)
            self.out = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
            widths = "".join(f'<col min="{k}" max="{k}" width="{WIDTH}" customWidth="1"/>' for k in range(1, len(columns) + 1))
            self._write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData>{_header(columns)}')
            self.now, self.rows = (table, sheet), 1
        if xml:
            self.rows += 1
            self._write(xml)

    def _write(self, text: str) -> None:
        self.out.write(text.encode("utf-8", "replace"))

    def end(self) -> None:
        if self.out:
            last = column_letters(len(self.tables[self.now[0]][1]) - 1)
            self._write("</sheetData>" + (f'<autoFilter ref="A1:{last}{self.rows}"/>' if self.rows > 1 else "") + "</worksheet>")
            self.out.close()
            self.filters.append(f"$A$1:${last}${self.rows}" if self.rows > 1 else "")
            self.out = None

    def close(self) -> None:
        self.end()
        numbers = range(1, len(self.names) + 1)
        sheets = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, name in zip(numbers, self.names, strict=True))
        quoted = [escape(name.replace("'", "''")) for name in self.names]
        filters = "".join(f"<definedName name=\"_xlnm._FilterDatabase\" localSheetId=\"{k}\" hidden=\"1\">'{name}'!{f}</definedName>" for k, (name, f) in enumerate(zip(quoted, self.filters, strict=True)) if f)
        relation = lambda k, kind, target: f'<Relationship Id="{k}" Type="{_OFFICE}/{kind}" Target="{target}"/>'
        relations = "".join(relation(f"r{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in numbers) + relation("s", "styles", "styles.xml")
        override = lambda part, kind: f'<Override PartName="/{part}" ContentType="{_TYPES}.{kind}+xml"/>'
        kinds = override("xl/workbook.xml", "sheet.main") + override("xl/styles.xml", "styles") + "".join(override(f"xl/worksheets/sheet{k}.xml", "worksheet") for k in numbers)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{relation("b", "officeDocument", "xl/workbook.xml")}</Relationships>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{relations}</Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{sheets}</sheets>' + (f"<definedNames>{filters}</definedNames>" if filters else "") + "</workbook>",
            "xl/styles.xml": _STYLES,
        }
        for name, text in parts.items():
            self.zip.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
        self.zip.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class BookWriter(DataSourceArrowWriter):
    """Rows (book, tab, sheet, row, xml), those of a book together and in order."""

    def __init__(self, path: str, name: str, tables: list[tuple[str, list[str]]]):
        self.path, self.name, self.tables, self.run = local(path), name, tables, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        context, files, book, number = TaskContext.get(), [], None, None
        os.makedirs(self.path, exist_ok=True)
        for batch in iterator:
            for at, tab, sheet, xml in zip(*(batch.column(c).to_pylist() for c in ("book", "tab", "sheet", "xml")), strict=True):
                if at != number:
                    if book:
                        book.close()
                    number = at
                    files.append((os.path.join(self.path, f".{self.run}-{at}-{context.taskAttemptId()}.part"), at))
                    book = Book(files[-1][0], self.tables)
                book.row(tab, sheet, xml)
        if book:
            book.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for file, number in m.files if m else ():
                os.rename(file, os.path.join(self.path, f"{self.name}-{number + 1:04}.xlsx"))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for n in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if n.startswith(f".{self.run}-"):
                os.remove(os.path.join(self.path, n))


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "book long, tab int, sheet long, row long, xml string"

    def writer(self, schema, overwrite: bool) -> BookWriter:
        import json

        return BookWriter(self.options["path"], self.options.get("name", "relatorio"), [tuple(t) for t in json.loads(self.options["tables"])])


def write_workbooks(tables: list[tuple[str, DataFrame, list[Column]]], path: str, name: str, *, max_rows: int = MAX_ROWS, sheets: int = SHEETS, zone: str = "UTC") -> None:
    """Files name-0001.xlsx, ... below path. tables: title, rows, and their order. A table starts in the first file, and
    goes on in further sheets; a file has at most so many sheets of each table."""
    import json

    spark = tables[0][1].sparkSession
    spark.dataSource.register(Workbook)
    parts = []
    for k, (_, df, order) in enumerate(tables):
        placed = sheet_numbers(df, order, max_rows=max_rows)
        xml = row_xml(df, F.col("row") + 1, zone=zone)
        parts.append(placed.select(F.floor(F.col("sheet") / sheets).cast("long").alias("book"), F.lit(k).alias("tab"), F.col("sheet").cast("long").alias("sheet"), F.col("row").cast("long").alias("row"), xml.alias("xml")))
        # a line without cells: a table without rows has a sheet all the same
        parts.append(spark.range(1).select(F.lit(0).cast("long").alias("book"), F.lit(k).alias("tab"), F.lit(0).cast("long").alias("sheet"), F.lit(0).cast("long").alias("row"), F.lit("").alias("xml")))
    rows = reduce(DataFrame.unionByName, parts).repartition("book").sortWithinPartitions("book", "tab", "sheet", "row")
    heads = json.dumps([(title, df.columns) for title, df, _ in tables])
    rows.write.format("workbook").option("name", name).option("tables", heads).mode("append").save(path)
