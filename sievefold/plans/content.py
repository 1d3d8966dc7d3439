"""Queries on contents: markup, types by signature, extraction."""

from __future__ import annotations

import base64
import io
import zipfile
from collections.abc import Iterator
from html.entities import name2codepoint
from string import ascii_letters, digits

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import filetypes as ft
from ..functions import html as h
from ..functions import markup
from ..sources import compound, extract, folders, logs, readers
from ..sources.batches import made
from ..tables import shared_folder
from . import office_files
from .catalog import query
from .views import table, view


def _html_sql() -> str:
    """The same chain for DuckDB, whose patterns have no references back to a group."""
    s = "coalesce(html, '')"
    for pattern, to in (
        (r"(?s)<!--.*?(?:-->|$)", " "), (r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)", " "), (r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)", " "),
        (rf"(?i)<br\s*/?>|</(?:{h.BLOCKS})\s*>", "\n"), (r"(?i)</t[dh]\s*>", "\t"), (r"</?[A-Za-z!?][^>]*>", ""),
    ):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    for name, code in {**name2codepoint, "apos": 39}.items():
        if name != "amp":  # the last one, as its result is not read again
            s = f"replace({s}, '&{name};', chr({code}))"
    return f"SELECT page_id, trim(regexp_replace(replace({s}, '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages"


@query(_html_sql())
def x1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of whole pages; checked against an HTML parser in the tests."""
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(h.html_to_text(F.col("html")), r"\s+", " ")).alias("text"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def x3_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", h.page_title(F.col("html")).alias("title"))


_HEADS = (
    ("%PDF-1.4\n%\x00\x01", "document", "pdf"),
    ("MZ" + "\x00" * 80, None, None),
    ("\x00\x00\x00\x18ftypisom\x00\x00", "video", "mp4"),
    ("\x00\x00\x00\x18ftypM4A \x00\x00", "audio", "m4a"),
    ("\x00\x00\x00\x18ftypqt  \x00\x00", "video", "mov"),
    ("\x00\x00\x00\x18ftypheic\x00\x00", "image", "heif"),
    ("\x00\x00\x00\x18ftypcrx \x00\x00", "image", "cr3"),
    ("\x00\x00\x00\x183gp\x00ftyp", None, None),
    ("\x00\x00\x00\x18ftyp3gp4\x00\x00", "video", "3gp"),
    ("\x00\x00\x00\x18ftypzzzz\x00\x00", None, "mpeg-4"),
    ("\x00\x00\x00\x08wide\x00\x00\x00\x00", "video", "mov"),
    ("GIF89a\x01\x00\x01\x00\x00", "image", "gif"),
    ("7z\xbc\xaf\x27\x1c\x00\x04", "archive", "7z"),
    ("\x89PNG\r\n\x1a\n\x00\x00", "image", "png"),
    ("PK\x03\x04" + "\x00" * 22 + "\x09\x00\x00\x00META-INF/x", "executable", "jar"),
    ("PK\x03\x04" + "\x00" * 22 + "\x08\x00\x00\x00mimetypeapp", None, "opendocument"),
    ("PK\x03\x04" + "\x00" * 22 + "\x05\x00\x00\x00a.txt", "archive", "zip"),
    ("\x1f\x8b\x08\x00\x00\x00", "archive", "gzip"),
    ("SQLite format 3\x00\x10\x00", "database", "sqlite"),
    ("plain words, no signature", None, None),
    ("ID3\x03\x00\x00\x00\x00\x0f\x76", "audio", "mp3"),
)


@query("SELECT d.doc_id AS id, v.category, v.format FROM documents d JOIN (VALUES " + ", ".join(f"({k}, {'NULL' if c is None else repr(c)}, {'NULL' if f is None else repr(f)})" for k, (_, c, f) in enumerate(_HEADS)) + f") AS v(k, category, format) ON v.k = d.doc_id % {len(_HEADS)}")
def x18_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head of each format in turn, before the document's own text."""
    heads = F.array(*(F.lit(bytearray(s.encode("latin-1"))) for s, *_ in _HEADS))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.get(heads, (F.col("doc_id") % len(_HEADS)).cast("int")), F.encode("text", "UTF-8")).alias("head"))
    return d.withColumn("x", ft.detect_type(F.col("head"))).select("id", "x.category", "x.format")


@query("SELECT id, CASE WHEN lower(name) LIKE '%.txt' OR lower(name) LIKE '%.pdf' OR lower(name) LIKE '%.docx' THEN 'document' WHEN lower(name) LIKE '%.mp3' THEN 'audio' WHEN lower(name) LIKE '%.gz' THEN 'archive' ELSE 'other' END AS category FROM files")
def x20_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").select("id", ft.type_of_all(F.col("name")).alias("category"))


@query("SELECT id, CASE WHEN lower(name) LIKE '%.mp3' THEN 'audio' ELSE 'image' END AS category, CASE WHEN lower(name) LIKE '%.mp3' THEN 'extension' ELSE 'content' END AS found_by FROM files WHERE lower(name) LIKE '%.mp3' OR (id % 2 = 0 AND NOT lower(name) LIKE '%.xyz')")
def x21_renamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures under other names, but for names of a type that isn't known."""
    head = F.when(F.col("id") % 2 == 0, F.lit(bytearray(b"\x89PNG\r\n\x1a\n\x00\x00\x00"))).otherwise(F.lit(bytearray(b"text only")))
    x = ft.typed(F.col("name"), head, F.col("size"), ["audio", "image"])
    return view(spark, sf_dir, "files").select("id", x.alias("x")).where("x is not null").select("id", "x.category", F.col("x.by").alias("found_by"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN id % 4 = 0 THEN 0 ELSE length(text) END AS chars FROM files")
def x15_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as UTF-8, with a byte order mark, as UTF-16, or empty, read back as files."""
    b = F.encode("text", "UTF-8")
    content = F.when(F.col("id") % 4 == 0, F.lit(bytearray())).when(F.col("id") % 4 == 1, b).when(F.col("id") % 4 == 2, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), b)).otherwise(F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode("text", "UTF-16LE")))
    f = view(spark, sf_dir, "files").select("id", F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), content.alias("content"))
    done = extract.extract(f.withColumn("size", F.length("content").cast("long")))
    chars = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + F.length(s["text"]))
    return done.select("id", "status", chars.alias("chars"))


@query("SELECT id, cast(least(length(text), 1000) AS bigint) AS chars FROM files")
def x16_segment_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    seg = lambda a, n: F.struct(F.lit("").alias("label"), F.substring("text", a, n).alias("text"))
    parts = F.array(seg(F.lit(1), half), seg(half + 1, F.length("text")))
    cut = extract.limited_segments(parts, 1000)
    return view(spark, sf_dir, "files").select("id", F.aggregate(cut, F.lit(0).cast("long"), lambda a, s: a + F.length(s["text"])).alias("chars"))


@query("SELECT conv_id AS id, count(*) AS lines FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def s12_tolerant_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which some are broken, and some glued to a broken one, which is recovered."""
    c = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.lit("s").alias("scanId"), F.col("conv_id").alias("recordId")))
    broken = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('{"scanId":"s","rec'), F.lit(""))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"scanId":"x","recordId":7,"it'), line)).otherwise(line)
    events = readers.parsed_log(c.select(broken.alias("value")), "scanId string, recordId long")
    return events.groupBy(F.col("recordId").alias("id")).agg(F.count("*").alias("lines"))


@query("SELECT id, term FROM (SELECT item_id AS id, trim(split_part(text, ' ', 1)) AS term FROM benchmark)")
def s24_term_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    line = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit('"'), F.substring_index("text", " ", 1), F.lit('";x,y;z'))).otherwise(F.concat(F.substring_index("text", " ", 1), F.lit(" ;x;z")))
    return b.select(F.col("item_id").alias("id"), readers.term_of_line(line, csv=True).alias("term"))


@query("SELECT id, lower(address) AS address, concat('b', id, '@y') AS aliases FROM accounts")
def s25_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    proxies = F.array(F.concat(F.lit("SMTP:"), "address"), F.concat(F.lit("smtp:"), "address"), F.concat(F.lit("smtp:B"), F.col("id").cast("string"), F.lit("@Y")))
    return view(spark, sf_dir, "accounts").select("id", readers.primary_address(proxies, F.lit("?")).alias("address"), F.array_join(readers.account_aliases(proxies, F.col("address")), ",").alias("aliases"))


@query("SELECT id FROM messages WHERE role <> 'system' AND turn % 5 <> 0 AND sent >= timestamp '2024-01-10 00:00:00'")
def s7_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "messages")
    kind = F.when(F.col("role") == "system", "systemEvent").otherwise("message")
    marked = m.select("id", kind.alias("message_type"), F.when(F.col("turn") % 5 == 0, F.col("sent")).alias("deleted"), F.col("sent").alias("at"), "turn", "sent")
    marked = marked.withColumn("deleted", F.when(F.col("turn") % 5 == 0, F.coalesce("sent", F.lit("2024-01-01").cast("timestamp"))))
    return readers.conversation_messages(marked, since=F.lit("2024-01-10").cast("timestamp")).select("id")


@query("SELECT id FROM messages WHERE (sent IS NULL OR sent >= timestamp '2023-12-01 00:00:00') AND sent < timestamp '2024-01-15 00:00:00'")
def s3_messages_in_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.landed_messages(view(spark, sf_dir, "messages"), since=F.lit("2023-12-01").cast("timestamp"), before=F.lit("2024-01-15").cast("timestamp")).select("id")


_SHAPES = ("docx", "xlsx", "odt", "rtf", "eml", "zip", "pdf", "doc", "html", "utf16")


@F.arrow_udf(BinaryType())
def _written(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A file of each shape that holds a text of letters, digits and single spaces: the input of x8_formats."""

    def zipped(parts: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return out.getvalue()

    def one(shape: str, t: str) -> bytes:
        half = len(t) // 2
        return {
            "docx": lambda: zipped({"word/document.xml": f"<w:p><w:r><w:t>{t[:half]}</w:t></w:r><w:r><w:t>{t[half:]}</w:t></w:r></w:p>", "docProps/core.xml": "<dc:creator>Ana</dc:creator>"}),
            "xlsx": lambda: zipped({"xl/workbook.xml": '<sheet name="F" sheetId="1"/>', "xl/sharedStrings.xml": f"<sst><si><t>{t}</t></si></sst>", "xl/worksheets/sheet1.xml": '<row r="1"><c t="s"><v>0</v></c></row>'}),
            "odt": lambda: zipped({"mimetype": "x", "content.xml": f"<text:p>{t}</text:p>", "meta.xml": "<meta:initial-creator>Ana</meta:initial-creator>"}),
            "rtf": lambda: ("{\\rtf1{\\fonttbl Arial}{\\info{\\author Ana}}" + t + "\\par}").encode(),
            "eml": lambda: f"Subject: s\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: base64\r\n\r\n{base64.encodebytes(t.encode()).decode()}".encode(),
            "zip": lambda: zipped({t[:40].strip().replace(" ", "_") + ".bin": "?"}),
            "pdf": lambda: office_files.pdf_file(t[:half] + t[half:].partition(" ")[0], t[half:].partition(" ")[2], packed=len(t) % 2 == 0),
            "doc": lambda: b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1\x00\x00" + t.encode() + b"\x00\x01",
            "html": lambda: f"<html><style>p {{}}</style><p>{t}</p></html>".encode(),
            "utf16": lambda: t.encode("utf-16-be"),
        }[shape]()

    yield from made(one, batches, BinaryType())


def _joined(close: Column) -> Column:
    """The texts of all segments, with a space between them or, where close says so, nothing."""
    texts = F.transform("segments", lambda s: s["text"])
    return F.when(close, F.array_join(texts, "")).otherwise(F.array_join(texts, " "))


_PLAIN = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT id, {_PLAIN} AS t, id % 10 AS k FROM files WHERE length({_PLAIN}) >= 60)
    SELECT id, CASE WHEN k = 7 THEN 'partial' ELSE 'ok' END AS status, CASE WHEN k IN (0, 2, 3, 6) THEN 'Ana' END AS author,
      md5(CASE WHEN k = 5 THEN concat(replace(trim(substr(t, 1, 40)), ' ', '_'), '.bin') ELSE t END) AS text FROM t"""
)
def x8_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text once, in a file of one of ten formats, read back."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    shape = F.get(F.array(*map(F.lit, _SHAPES)), (F.col("id") % len(_SHAPES)).cast("int"))
    f = view(spark, sf_dir, "files").select("id", plain.alias("t"), shape.alias("shape")).where("length(t) >= 60")
    name = F.concat(F.lit("f."), F.when(F.col("shape") == "utf16", "txt").otherwise(F.col("shape")))
    files = f.select("id", name.alias("name"), _written("shape", "t").alias("content"))
    done = extract.extract(files.withColumn("size", F.length("content").cast("long")))
    text = F.trim(F.regexp_replace(_joined(F.lit(False)), r"\s+", " "))
    return done.select("id", "status", "author", F.md5(text.cast("binary")).alias("text"))


_SHAPE = f"(id % {len(office_files.SHAPES)})"
_NUMBER = {shape: k for k, shape in enumerate(office_files.SHAPES)}


@query(
    f"""WITH t AS (SELECT id, {_SHAPE} AS k, {_PLAIN} AS t FROM files WHERE length({_PLAIN}) >= 20)
    SELECT id, CASE k WHEN {_NUMBER["docx"]} THEN 'encrypted' WHEN {_NUMBER["dat"]} THEN 'unsupported' ELSE 'ok' END AS status,
      CASE WHEN k < 3 THEN 'Ana' WHEN k = 3 THEN 'Ana' END AS author, CASE WHEN k < 3 THEN 'João' END AS editor, CASE WHEN k < 3 THEN '2021-03-04T05:06:07.000Z' END AS created,
      md5(CASE k WHEN {_NUMBER["docx"]} THEN '' WHEN {_NUMBER["dat"]} THEN '' WHEN {_NUMBER["xls"]} THEN concat(t, ' 1.5 42 7 12.34 fim') ELSE t END) AS text
    FROM t"""
)
def x10_office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text once in a binary office file: documents in pieces, workbooks, slides, messages, encrypted, unknown and older ones."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    shape = F.get(F.array(*map(F.lit, office_files.SHAPES)), (F.col("id") % len(office_files.SHAPES)).cast("int"))
    f = view(spark, sf_dir, "files").select("id", plain.alias("t"), shape.alias("shape")).where("length(t) >= 20")
    files = f.select("id", F.concat(F.lit("f."), "shape").alias("name"), office_files.office_file("shape", "t", "id").alias("content"))
    done = extract.extract(files.withColumn("size", F.length("content").cast("long")))
    joined = _joined(F.col("name").isin("f.msg", "f.ppt"))
    # a message's text starts with its subject and sender, and its halves stand around the attachment's name
    clean = F.when(F.col("name") == "f.msg", F.replace(F.regexp_replace(joined, r"^assunto \d+\nAna\n", ""), F.lit("\nresto.txt"), F.lit(""))).otherwise(joined)
    clean = F.when(F.col("name") == "f.ppt", F.regexp_replace(clean, "\n", "")).otherwise(F.trim(F.regexp_replace(clean, r"\s+", " ")))
    return done.select("id", "status", "author", F.col("last_modified_by").alias("editor"), F.col("metadata")["created"].alias("created"), F.md5(clean.cast("binary")).alias("text"))


@query(f"SELECT id, 'Contents' AS path, cast(length({_PLAIN}) AS bigint) AS bytes FROM files WHERE length({_PLAIN}) >= 60 UNION ALL SELECT id, 'Box/Inner/Deep', 50 FROM files WHERE length({_PLAIN}) >= 60")
def x10_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams of containers, those in storages too."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    f = view(spark, sf_dir, "files").select("id", plain.alias("t")).where("length(t) >= 60")
    files = f.select("id", office_files.office_file(F.lit("dat"), "t", "id").alias("content"))
    return compound.streams(files).select("id", "path", F.length("stream").cast("long").alias("bytes"))


def _with_single(kind: str, text: Column | str) -> Column:
    """text with a space for each run of a class of characters that has the space; those that are one space already aren't rewritten."""
    return F.regexp_replace(text, f"{kind}(?:(?<! )|(?={kind})){kind}*+", " ")


_LATIN = "trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9()\\\\áéíóúãõçñäöüßèêàâ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT id, {_LATIN} AS t FROM files WHERE length({_LATIN}) >= 40)
    SELECT id, 'ok' AS status, 'Ana' AS author, '2021-03-04T08:06:07.000Z' AS created, 2::BIGINT AS pages, 'Página 1,Página 2' AS labels,
      md5(trim(substr(t, 1, length(t) // 2))) AS first, md5(trim(substr(t, length(t) // 2 + 1))) AS second FROM t"""
)
def x11_pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a PDF file of two pages: a simple font with escapes, and a font of two-byte codes with a map; pictures aren't read. Every other file has its objects in streams."""
    # letters are listed, as Java looks them up in a table then; it tries ranges one after another
    latin = F.trim(_with_single(rf"[^{ascii_letters}{digits}()\\áéíóúãõçñäöüßèêàâ]", "text"))
    # a table may be one block of rows, which one task would read: the texts are dealt out before the work
    f = extract.once(view(spark, sf_dir, "files").select("id", "text").repartition("id"), t=latin).where("length(t) >= 40").withColumn("half", F.floor(F.length("t") / 2).cast("int"))
    parts = f.select("id", F.substring("t", F.lit(1), F.col("half")).alias("a"), F.substring("t", F.col("half") + 1, F.length("t")).alias("b"))
    files = parts.select("id", F.lit("f.pdf").alias("name"), office_files.pdf_of("a", "b", F.col("id") % 2 == 0).alias("content"))
    done = extract.extract(files.withColumn("size", F.length("content").cast("long")))
    page = lambda k: F.md5(F.trim(_with_single(r"\s", F.get("segments", F.lit(k))["text"])).cast("binary"))
    labels = F.array_join(F.transform("segments", lambda s: s["label"]), ",")
    return done.select("id", "status", "author", F.col("metadata")["created"].alias("created"), F.size("segments").cast("long").alias("pages"), labels.alias("labels"), page(0).alias("first"), page(1).alias("second"))


@query(
    f"""WITH t AS (SELECT id, {_PLAIN} AS t FROM files WHERE length({_PLAIN}) >= 60)
    SELECT id, md5(CASE id % 5
      WHEN 0 THEN concat(t, chr(10), 'a<b')
      WHEN 1 THEN concat(t, chr(10), 'fim')
      WHEN 2 THEN concat(t, chr(9), 'fim', chr(10))
      WHEN 3 THEN concat(t, chr(10), 'x')
      ELSE concat(t, chr(9), 'y') END) AS text FROM t"""
)
def x2_markup_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office XML, damaged in several ways: stray closings, elements never closed, tags without an end, empty and skipped elements, cells."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    f = view(spark, sf_dir, "files").select("id", plain.alias("t")).where("length(t) >= 60")
    run = F.concat(F.lit("<?xml version='1.0'?><!-- no --><w:r><w:instrText>PAGE</w:instrText><w:t xml:space='preserve'>"), "t", F.lit("</w:t></w:r>"))
    shapes = (
        F.concat(run, F.lit("</w:p><mc:Fallback><w:t>twice</w:t></mc:Fallback><w:t>a&lt;b</w:t>")),
        F.concat(F.lit("</w:t></mc:Fallback>"), run, F.lit("<w:br/><w:t/>between<w:t>fim")),
        F.concat(F.lit("<w:tr><w:tc><w:p>"), run, F.lit("</w:p></w:tc><w:tc><w:t>fim</w:t></w:p></w:tc></w:tr>")),
        F.concat(run, F.lit("<w:p/><w:t>x</w:t><w:t")),
        F.concat(run, F.lit("<w:tab/><w:t>y</w:t><mc:Fallback><w:p><w:t>never closed</w:t></w:p>")),
    )
    return f.select("id", F.md5(markup.rules_text(F.get(F.array(*shapes), (F.col("id") % 5).cast("int")), markup.WORD).cast("binary")).alias("text"))


_CODINGS = ("cp850", "utf-8", "mark")


@query("SELECT id, concat('ação ', id, '/', name, chr(10), 'b9', chr(10), 'b10 ñ') AS names FROM files")
def x13_zip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in archives, written in an old code page, as UTF-8 without a mark and with it; numbers count as numbers in their order."""
    names = F.array(F.lit("b10 ñ"), F.concat(F.lit("ação "), F.col("id").cast("string"), F.lit("/"), "name"), F.lit("b9"))
    coding = F.get(F.array(*map(F.lit, _CODINGS)), (F.col("id") % 3).cast("int"))
    files = view(spark, sf_dir, "files").select("id", F.lit("f.zip").alias("name"), office_files.zip_names(names, coding).alias("content"))
    done = extract.extract(files.withColumn("size", F.length("content").cast("long")))
    return done.select("id", F.get("segments", F.lit(0))["text"].alias("names"))


@query(f"SELECT id, cast(id % 5 AS bigint) AS depth, CASE WHEN id % 5 < 3 THEN md5({_PLAIN}) END AS text FROM files WHERE length({_PLAIN}) >= 4")
def x17_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document attached to a message that is attached to others: what is more than three attachments deep isn't read."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    f = view(spark, sf_dir, "files").select("id", plain.alias("t"), (F.col("id") % 5).alias("depth")).where("length(t) >= 4")
    files = f.select("id", "depth", F.lit("f.eml").alias("name"), office_files.attached_of("t", "depth").alias("content"))
    done = extract.extract(files.withColumn("size", F.length("content").cast("long")))
    found = F.get(F.filter("segments", lambda s: s["label"] == "f.docx"), F.lit(0))["text"]
    return done.select("id", "depth", F.md5(F.regexp_replace(found, r"\s+$", "").cast("binary")).alias("text"))


@query(f"SELECT id, md5({_PLAIN}) AS text FROM files WHERE length({_PLAIN}) >= 4")
def x6_printable_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text among bytes that aren't printable; in every other row two bytes wide."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    f = view(spark, sf_dir, "files").select("id", plain.alias("t")).where("length(t) >= 4")
    noise = F.lit(bytearray(b"\x00\x01\x02\x03"))
    body = F.when(F.col("id") % 2 == 0, F.encode("t", "UTF-8")).otherwise(F.encode("t", "UTF-16LE"))
    return f.select("id", F.md5(extract.printable_strings(F.concat(noise, body, noise)).cast("binary")).alias("text"))


def _write_tree(files: DataFrame, root: str) -> None:
    """Files (folder, name, content) written where the rows are, below a folder that all workers share."""
    from pathlib import Path

    def run(frames):
        for pdf in frames:
            for folder, name, content in zip(pdf["folder"], pdf["name"], pdf["content"], strict=True):
                (Path(root) / folder).mkdir(parents=True, exist_ok=True)
                (Path(root) / folder / name).write_bytes(content)
            yield pdf[["name"]]

    files.select("folder", "name", "content").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


@query("SELECT concat(folder, '/', name) AS relative_path, name, cast(CASE WHEN id % 10 = 0 THEN 0 ELSE octet_length(encode(text)) END AS bigint) AS size FROM files WHERE NOT (name LIKE '%.tar.gz' OR folder = 'dir3/Sub 1')")
def s1_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of all files, every tenth of them empty, written and scanned; a kind of names and a folder are excluded."""
    root = logs.local(shared_folder(spark, "tree"))
    files = view(spark, sf_dir, "files")
    _write_tree(files.select("folder", "name", F.when(F.col("id") % 10 == 0, F.lit(bytearray())).otherwise(F.encode("text", "UTF-8")).alias("content")), root)
    spark.dataSource.register(folders.FolderTree)
    found = spark.read.format("folder_tree").option("exclude", '["*.TAR.gz", "dir3\\\\sub 1"]').load(root)
    return found.where("kind = 'file'").select("relative_path", "name", "size")


@query("SELECT seq, status, item FROM deletions WHERE seq <> 77")
def s14_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writes to a log, of which the second breaks off in the middle of its last line: what was whole is read again."""
    events = view(spark, sf_dir, "deletions").select("seq", "status", "item")
    path = shared_folder(spark, "log")
    logs.append(events.where("seq % 3 = 0"), path, "seq")
    logs.append(events.where("seq = 77"), path, "seq")
    with open(logs.segments(path)[-1], "r+b") as f:
        f.truncate(9)
    logs.append(events.where("seq % 3 > 0 and seq <> 77"), path, "seq")
    return readers.parsed_log(spark.read.text([f"file://{p}" for p in logs.segments(path)]), "seq long, status string, item long")


@query(
    """WITH o AS (SELECT id, sender, row_number() OVER (ORDER BY id) - 1 AS line, count(*) OVER () AS n FROM messages), p AS (SELECT item_id AS page, item_id * 13 AS first, item_id * 13 + 24 AS last FROM benchmark)
    SELECT p.page, o.line, o.id, o.sender, true AS in_part FROM p JOIN o ON o.line BETWEEN p.first AND p.last"""
)
def s13_page_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 25 lines out of a log of all messages, each read by byte offsets: at most three stretches of ten lines."""
    path = shared_folder(spark, "log")
    logs.append(view(spark, sf_dir, "messages").select("id", "sender", "text"), path, "id")
    index = logs.offsets(spark, path, every=10, chunk=20_000)
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), (F.col("item_id") * 13).alias("first"), (F.col("item_id") * 13 + 24).alias("last"))
    lines = logs.pages(index, wanted, every=10)
    event = F.from_json("value", "id long, sender string")
    return lines.select("page", "line", event.alias("e"), (F.col("bytes") < 40 * 20_000).alias("in_part")).select("page", "line", "e.id", "e.sender", "in_part")
