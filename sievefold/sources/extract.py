"""Text of file contents. Spark deals files out; each is read by a small helper of its format.

PDF files are read by pdf.py, binary office files by compound.py. What only looks like such a container gives its runs
of printable characters, with the status partial.
"""

from __future__ import annotations

import email
import email.message
import email.policy
import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterator
from email.utils import getaddresses
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..functions import markup
from ..functions.html import frequent_entities, has_rare_entities, html_to_text, unescaped, xml_to_text
from . import compound, pdf
from .batches import in_batches, made

#: Limits of reading.
MAX_BYTES, MAX_CHARS, MAX_ENTRY, MAX_TOTAL, MAX_DEPTH = 50 << 20, 20_000_000, 120 << 20, 400 << 20, 3
SEGMENTS = ArrayType(StructType([StructField("label", StringType()), StructField("text", StringType())]))
FIELDS = ("status", "note", "segments", "author", "last_modified_by", "metadata")
#: What the helper gives for a file; decoded is a text whose entities it has replaced.
RESULT = StructType([StructField(n, {"segments": SEGMENTS, "metadata": MapType(StringType(), StringType())}.get(n, StringType())) for n in (*FIELDS, "decoded")])
#: Extensions read as text, and as markup.
TEXT = ".txt .csv .log .md .json .xml .yml .yaml .ini .conf .cfg .sql .js .ts .py .java .cs .php .rb .sh .ps1 .bat .tsv"
MARKUP = ".htm .html .xhtml"


def classify(head: Column, extension: Column) -> Column:
    """zip, ole, pdf, rtf, html, text or binary, by the first bytes and the extension."""
    h = F.hex(F.substring(head, 1, 8))
    is_text = ~_has_zero(head) | utf16_guess(head).isNotNull()
    return (
        F.when(h.startswith("504B0304"), "zip")
        .when(h.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(h.startswith("255044462D"), "pdf")
        .when(h.startswith("7B5C727466"), "rtf")
        .when(extension.isin(*MARKUP.split()) & is_text, "html")
        .when(h.rlike("^(EFBBBF|FFFE|FEFF)") | is_text, "text")
        .otherwise("binary")
    )


def _has_zero(content: Column) -> Column:
    return F.coalesce(F.contains(content, F.lit(bytearray(1))), F.lit(False))


def utf16_guess(head: Column) -> Column:
    """UTF-16LE or UTF-16BE for text without a byte order mark, or null: of its pairs of bytes more than 0.3 have a zero on
    one side and fewer than 0.05 on the other, and the other byte of those is nearly always printable."""
    h = F.hex(F.substring(head, 1, 4096))
    pairs = F.length(h) / 4
    picked = lambda pattern: F.length(F.regexp_replace(h, rf"\G(?:{pattern}|....|.+$)", "$1")) / 2
    visible = "(?:0[9AD]|[2-6A-F].|7[0-9A-E])"
    low, high = picked("..(00)"), picked("(00)..")
    little = (low > 0.3 * pairs) & (high < 0.05 * pairs) & (picked(f"{visible}(00)") > 0.9 * low)
    big = (high > 0.3 * pairs) & (low < 0.05 * pairs) & (picked(f"(00){visible}") > 0.9 * high)
    return F.when(little, "UTF-16LE").when(big, "UTF-16BE")


def decode_text(content: Column) -> Column:
    """By the byte order mark; else as UTF-16 where that is likely; else UTF-8 where that is valid; else Windows-1252."""
    h = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, F.lit(n + 1), F.lit(1 << 30))
    # the guess, once, and only where a zero byte calls for it
    wide = F.get(F.transform(F.array(F.when(_has_zero(F.substring(content, 1, 4096)), utf16_guess(content))), lambda w: F.when(w.isNotNull(), F.when(w == "UTF-16LE", F.decode(content, "UTF-16LE")).otherwise(F.decode(content, "UTF-16BE")))), 0)
    plain = F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8")).otherwise(_windows_1252(content))
    return (
        F.when(h == "EFBBBF", F.decode(rest(3), "UTF-8"))
        .when(h.startswith("FFFE"), F.decode(rest(2), "UTF-16LE"))
        .when(h.startswith("FEFF"), F.decode(rest(2), "UTF-16BE"))
        .otherwise(F.coalesce(wide, plain))
    )


_HIGH = bytes(range(0x80, 0xA0))


def _windows_1252(content: Column) -> Column:
    return F.translate(F.decode(content, "ISO-8859-1"), _HIGH.decode("latin-1"), _HIGH.decode("cp1252", "replace"))


@F.arrow_udf(StringType())
def printable_strings(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Runs of at least four printable characters, one byte or two bytes wide, a line each."""
    yield from made(runs_of_text, ((c,) for c in contents), StringType())


_ONE, _TWO = re.compile(rb"[\t\x20-\x7e\xa0-\xff]{4,}"), re.compile(rb"(?:[\t\x20-\x7e\xa0-\xff]\x00){4,}")


def runs_of_text(data: bytes) -> str:
    return "\n".join([m.decode("cp1252", "replace") for m in _ONE.findall(data)] + [m.decode("utf-16-le") for m in _TWO.findall(data)])


_RTF = re.compile(r"\\([a-z]{1,32})(-?[0-9]{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
#: Groups of a rich text that aren't its text, and words that stand for characters.
_RTF_SKIP = set("fonttbl colortbl datastore themedata stylesheet info pict header footer generator listtable listoverridetable".split())
_RTF_CHARS = {"par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rtf_text(data: bytes) -> str:
    """Text of a rich text document; groups of tables, pictures and unknown destinations are left out."""
    stack, skip, unicode_skip, pending = [], False, 1, 0
    out: list[str] = []
    for word, arg, hexed, symbol, brace, plain in _RTF.findall(data.decode("latin-1")):
        if brace == "{":
            stack.append((skip, unicode_skip))
        elif brace:
            skip, unicode_skip = stack.pop() if stack else (False, 1)
        elif symbol == "*" or word in _RTF_SKIP:
            skip = True
        elif skip:
            continue
        elif word == "u" and arg:
            out.append(chr(int(arg) % 0x10000))
            pending = unicode_skip
        elif word == "uc" and arg:
            unicode_skip = int(arg)
        elif word:
            out.append(_RTF_CHARS.get(word, ""))
        elif hexed:
            if pending:
                pending -= 1
            else:
                out.append(bytes.fromhex(hexed).decode("cp1252", "replace"))
        elif symbol:
            out.append({"~": " ", "_": "-", "-": ""}.get(symbol, symbol if symbol in "\\{}" else ""))
        elif plain:
            out.append(plain[pending:])
            pending = 0
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def rtf_info(data: bytes, field: str) -> str | None:
    m = re.search(rb"\{\\" + field.encode() + rb" ([^{}\\]*)\}", data)
    return m.group(1).decode("latin-1").strip() or None if m else None


def _tag(text: str, tag: str) -> str | None:
    m = re.search(rf"<(?:\w+:)?{tag}\b[^>]*>([^<]*)<", text)
    return m.group(1).strip() or None if m else None


def entry_name(entry: zipfile.ZipInfo) -> str:
    """An entry's name: UTF-8 by its flag or by the field of extra names, else as UTF-8 if it is valid, else code page 850."""
    if entry.flag_bits & 0x800:
        return entry.filename
    at, extra = 0, entry.extra
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 0x7075 and size > 5 and extra[at + 4] == 1:
            return extra[at + 9 : at + 4 + size].decode("utf-8", "replace")
        at += 4 + size
    raw = entry.orig_filename.encode("cp437")  # what the module made of the bytes
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp850")


class Parts:
    """The entries of a ZIP file, read up to a size for each and for all together."""

    def __init__(self, z: zipfile.ZipFile):
        self.zip, self.left, self.cut = z, MAX_TOTAL, False
        self.sizes = {i.filename: i.file_size for i in z.infolist()}
        self.names = [entry_name(i) for i in z.infolist()]

    def read(self, name: str) -> str:
        """The entry as text; none if it isn't there or is beyond the limits."""
        size = self.sizes.get(name)
        if size is None:
            return ""
        if size > min(MAX_ENTRY, self.left):
            self.cut = True
            return ""
        self.left -= size
        return self.zip.read(name).decode("utf-8", "replace")


def _natural(name: str) -> list[tuple[int, int, str]]:
    return [(0, int(x), "") if x.isdigit() else (1, 0, x.lower()) for x in re.split(r"([0-9]+)", name)]


#: Names of the metadata in the two families of office files.
_CORE = {"author": "creator", "title": "title", "last_modified_by": "lastModifiedBy", "created": "created", "modified": "modified"}
_APP = {"application": "Application", "company": "Company"}
_META = {"author": "initial-creator", "title": "title", "last_modified_by": "creator", "created": "creation-date", "modified": "date", "application": "generator"}


def office_segments(data: bytes) -> tuple[str, list[tuple[str, str]], dict[str, str]]:
    """status, (label, text) segments and metadata of an office file or of any ZIP file (the names in it)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = Parts(z)
        found = {k: v for names, part in ((_CORE, parts.read("docProps/core.xml")), (_APP, parts.read("docProps/app.xml")), (_META, parts.read("meta.xml"))) for k, tag in names.items() if (v := _tag(part, tag))}
        if "encryption-data" in parts.read("META-INF/manifest.xml"):
            return "encrypted", [], found
        segments = list(_office_parts(parts))
        return "partial" if parts.cut else "ok", segments, found


def _office_parts(parts: Parts) -> Iterator[tuple[str, str]]:
    names = sorted(parts.sizes, key=_natural)
    text = lambda n, rules: markup.tidy(markup.by_rules(parts.read(n), rules))
    if "word/document.xml" in parts.sizes:
        yield "", text("word/document.xml", markup.WORD)
        for n in names:
            if re.fullmatch(r"word/(comments|footnotes|endnotes|header\d*|footer\d*)\.xml", n):
                yield n[5:-4], text(n, markup.WORD)
    elif "xl/workbook.xml" in parts.sizes:
        shared = [_cell_text(s) for s in re.findall(r"<(?:\w+:)?si>(.*?)</(?:\w+:)?si>|<(?:\w+:)?si/>", parts.read("xl/sharedStrings.xml"), re.S)]
        for title, n in _sheets(parts, names):
            yield f'Planilha "{title}"', _sheet(parts.read(n), shared)
        for n in names:
            if re.fullmatch(r"xl/(comments\d*|threadedComments/[^/]+)\.xml", n):
                yield "Comentários", markup.by_rules(parts.read(n), _COMMENTS)
    elif slides := [n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]:
        for k, n in enumerate(_in_order(parts, "ppt/presentation.xml", "p:sldId", slides), 1):
            notes = [text(r, markup.DRAWING) for kind, r in _relations(parts, n).values() if kind.endswith("/notesSlide")]
            yield f"Slide {k}", "\n".join([text(n, markup.DRAWING), *notes])
    elif "content.xml" in parts.sizes:
        xml = parts.read("content.xml")
        sheets = re.findall(r"<table:table\b([^>]*)>(.*?)</table:table>", xml, re.S) if "opendocument.spreadsheet" in parts.read("mimetype") else []
        for attributes, body in sheets:
            title = re.search(r'\btable:name="([^"]*)"', attributes)
            yield f'Planilha "{markup.decoded(title[1]) if title else ""}"', re.sub(r"[ \t]+\n", "\n", re.sub(r" +\t", "\t", markup.by_rules(body, markup.OPEN_SHEET)))
        if not sheets:
            yield "", markup.tidy(markup.by_rules(xml, markup.OPEN))
    else:
        yield "Arquivos compactados", "\n".join(sorted(parts.names, key=_natural))


_COMMENTS = markup.Rules(frozenset({"t", "text"}), closes={"comment": "\n", "threadedComment": "\n"})


def _relations(parts: Parts, name: str) -> dict[str, tuple[str, str]]:
    """(kind, target) of a part's relations by their id."""
    folder, _, base = name.rpartition("/")
    found = {}
    for attributes in re.findall(r"<Relationship\b([^>]*)>", parts.read(f"{folder}/_rels/{base}.rels")):
        a = dict(re.findall(r'(\w+)="([^"]*)"', attributes))
        if "Target" in a and a.get("TargetMode") != "External":
            target = a["Target"]
            found[a.get("Id", "")] = (a.get("Type", ""), posixpath.normpath(target[1:] if target.startswith("/") else posixpath.join(folder, target)))
    return found


def _in_order(parts: Parts, name: str, element: str, otherwise: list[str]) -> list[str]:
    """Parts in the order in which elements of a part refer to them."""
    relations = _relations(parts, name)
    ids = re.findall(rf'<{element}\b[^>]*\br:id="([^"]*)"', parts.read(name))
    return [relations[i][1] for i in ids if i in relations] or otherwise


def _sheets(parts: Parts, names: list[str]) -> list[tuple[str, str]]:
    """(title, part) of a workbook's sheets, by its relations; without any, in the order of the parts."""
    relations, out = _relations(parts, "xl/workbook.xml"), []
    numbered = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    for k, attributes in enumerate(re.findall(r"<(?:\w+:)?sheet\b([^>]*)>", parts.read("xl/workbook.xml"))):
        title, own = re.search(r'\bname="([^"]*)"', attributes), re.search(r'\w+:id="([^"]*)"', attributes)
        target = relations[own[1]][1] if own and own[1] in relations else numbered[k] if not relations and k < len(numbered) else None
        if target:
            out.append((markup.decoded(title[1]) if title else "", target))
    return out


def _cell_text(xml: str) -> str:
    """The runs of a rich text, without phonetic hints."""
    xml = re.sub(r"<(?:\w+:)?rPh\b.*?</(?:\w+:)?rPh>", "", xml, flags=re.S)
    return markup.decoded("".join(re.findall(r"<(?:\w+:)?t(?:\s[^>]*)?>([^<]*)</(?:\w+:)?t>", xml)))


_CELL = re.compile(r"<(?:\w+:)?row\b([^>]*)>|<(?:\w+:)?c\b([^>]*?)(?:/>|>(.*?)</(?:\w+:)?c>)", re.S)


def _sheet(xml: str, shared: list[str]) -> str:
    """A line for each row of a sheet by its number, tabs between its values; truth values and errors are left out."""
    values, row = [], -1
    for of_row, of_cell, body in _CELL.findall(xml):
        if not of_cell and not body:
            n = re.search(r'\br="(\d+)"', of_row)
            row = int(n[1]) - 1 if n else row + 1
            continue
        kind = (re.search(r'\bt="([^"]*)"', of_cell) or ("", "n"))[1]
        v = (re.search(r"<(?:\w+:)?v>([^<]*)</", body) or ("", ""))[1]
        if kind == "s":
            text = shared[int(v)] if v.isdigit() and int(v) < len(shared) else ""
        else:
            text = _cell_text(body) if kind == "inlineStr" else "" if kind in "be" else markup.decoded(v)
        values.append((max(row, 0), text))
    return compound.row_lines(values)


@lru_cache(maxsize=1024)
def _header(name: str, value: str):
    return email.policy.default.header_fetch_parse(name, value)


class _Headers(email.policy.EmailPolicy):
    """The default policy, but for headers that it has parsed before: the library parses one anew each time that it is asked for."""

    def header_fetch_parse(self, name, value):
        return _header(name, value) if len(value) < 1000 else super().header_fetch_parse(name, value)


_HEADERS = _Headers()


def message_parts(data: bytes, depth: int = 0) -> tuple[list[tuple[str, str]], dict]:
    """(label, text) of a message's body and attachments, and its headers. Of alternatives the longest text counts."""
    return _parts_of(email.message_from_bytes(data, policy=_HEADERS), depth)


def _parts_of(m: email.message.EmailMessage, depth: int) -> tuple[list[tuple[str, str]], dict]:
    head = {k: str(m.get(k, "") or "") for k in ("subject", "from", "to", "cc", "bcc", "date", "message-id")}
    head["addresses"] = [a for k in ("from", "to", "cc", "bcc") for _, a in getaddresses([head[k]]) if a]
    head["attachments"] = []
    out: list[tuple[str, str]] = []

    def text_of(part) -> str:
        try:
            text = part.get_content()
        except (LookupError, KeyError, ValueError):
            text = (part.get_payload(decode=True) or b"").decode("cp1252", "replace")
        if part.get_content_type() == "text/html":
            text = _plain_markup(text)
        return text

    def walk(part, level: int):
        kind = part.get_content_type()
        if level > 12:
            return
        if kind == "multipart/alternative":
            bodies = [text_of(p) for p in part.walk() if p.get_content_maintype() == "text"]
            if bodies:
                out.append(("body", max(bodies, key=len)))
        elif part.is_multipart() and kind != "message/rfc822":
            for p in part.iter_parts():
                walk(p, level + 1)
        elif kind == "message/rfc822":
            inner = part.get_payload(0)
            head["attachments"].append(str(inner.get("subject", "")))
            if depth < MAX_DEPTH:
                out.extend(_parts_of(inner, depth + 1)[0])
        elif part.get_filename():
            head["attachments"].append(part.get_filename())
            if part.get_content_maintype() == "text":
                out.append((part.get_filename(), text_of(part)))
                return
            body = part.get_payload(decode=True) or b""
            segments = read_file(body, "." + part.get_filename().lower().rpartition(".")[2], depth + 1)[2] if depth < MAX_DEPTH else []
            out.extend((part.get_filename(), t) for _, t in segments)
        elif part.get_content_maintype() == "text":
            out.append(("body", text_of(part)))

    walk(m, 0)
    return out, head


def read_file(data: bytes, extension: str, depth: int = 0) -> tuple:
    """status, note, segments, author, last editor, metadata of one file's bytes."""
    if not data:
        return "empty", None, [], None, None, {}
    try:
        status, note, segments, found = _read_kind(data, extension, depth)
    except RuntimeError as e:  # an entry that needs a password
        status, note, segments, found = "encrypted", str(e)[:300], [], {}
    except Exception as e:  # noqa: BLE001 a broken file is a row, not the job's end
        status, note, segments, found = "error", f"{type(e).__name__}: {e}"[:300], [], {}
    found = {k: v for k, v in found.items() if v}
    return status, note, segments, found.get("author"), found.get("last_modified_by"), found


def _read_kind(data: bytes, extension: str, depth: int) -> tuple[str, str | None, list[tuple[str, str]], dict[str, str]]:
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
        status, segments, found = office_segments(data)
        return status, None, segments, found
    if data[:5] == b"{\\rtf":
        return "ok", None, [("", rtf_text(data))], {"author": rtf_info(data, "author"), "last_modified_by": rtf_info(data, "operator"), "title": rtf_info(data, "title")}
    if b"%PDF-" in data[:1024]:
        status, segments, found = pdf.pages(data, most=MAX_CHARS)
        return status, "pdf", segments, found
    if data[:8] == compound.MAGIC:
        return _read_compound(data, depth)
    if extension in (".eml", ".mht", ".mhtml"):
        return "ok", None, message_parts(data, depth)[0], {}
    return "other", None, [], {}


def _read_compound(data: bytes, depth: int) -> tuple[str, str | None, list[tuple[str, str]], dict[str, str]]:
    try:
        status, kind, segments, found, attached, html = compound.office_text(data)
    except (ValueError, struct.error, IndexError):
        return "partial", "ole", [("", runs_of_text(data))], {}
    if html:
        segments = [("", "\n".join([*(t for _, t in segments), _plain_markup(html.decode("utf-8", "replace"))]))]
    for name, body in attached:
        own = read_file(body, "." + name.lower().rpartition(".")[2], depth + 1) if depth < MAX_DEPTH else ("unsupported", None, [])
        text = body.decode("utf-8", "replace") if own[0] == "other" and b"\0" not in body[:4096] else None
        for label, t in [("", text)] if text is not None else own[2]:
            segments.append((f'Anexo "{name}"' + (f" › {label}" if label else ""), t))
    return status, kind, segments, found


def _plain_markup(text: str) -> str:
    import html

    text = re.sub(r"(?is)<(style|script)\b.*?</\1\s*>", " ", text)
    return html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n", text)))


@F.arrow_udf(RESULT)
def _read(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of contents, extensions and texts with entities: what read_file gives, and the decoded texts."""

    def one(content: bytes | None, extension: str | None, marked: str | None) -> tuple[dict, int]:
        status, note, segments, author, editor, found = read_file(content, extension or "") if content is not None else (None, None, [], None, None, {})
        decoded = unescaped(marked) if marked is not None else None
        row = (status, note, [{"label": a, "text": t} for a, t in segments], author, editor, list(found.items()), decoded)
        return dict(zip((*FIELDS, "decoded"), row, strict=True)), sum(len(t) for _, t in segments) + len(decoded or "")

    yield from in_batches(one, batches, RESULT)


def once(files: DataFrame, **columns: Column) -> DataFrame:
    """files with columns that are made once a row, by a generator; in a projection they would be made anew wherever they are used."""
    return files.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def extract(files: DataFrame, *, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (id, name, size, content) with status, note, segments, author, last_modified_by and metadata (title, dates, program, company).

    Text and markup are decoded in the JVM; other formats go to a helper. Text above max_bytes is read
    that far and partial; other large files are skipped.
    """
    ext = F.regexp_extract(F.lower("name"), r"^.+(\.[^.]+)$", 1)
    kind = F.when(ext.isin(".eml", ".mht", ".mhtml"), "mail").otherwise(classify(F.substring("content", 1, 4096), ext))
    marked = once(files, _ext=ext, _kind=kind, _large=F.col("size") > max_bytes)
    plain, html = F.col("_kind").isin("text", "html"), F.col("_kind") == "html"
    of_text, skipped = plain & (F.col("size") > 0), ~plain & F.col("_large")
    # one pass over the files: a helper, one worker to a task, gets nulls for what isn't its own, and contents that Python made aren't made again
    own = once(marked, _text=F.when(of_text, F.when(F.col("_large"), F.substring("content", F.lit(1), F.lit(max_bytes))).otherwise(F.col("content"))), _rest=F.when(~of_text & ~F.col("_large"), F.col("content"))).drop("content")
    decoded = once(own, _t=decode_text(F.col("_text"))).drop("_text")
    shown = once(decoded, _shown=F.when(html & F.col("_t").isNotNull(), html_to_text(F.col("_t"), entities=False)).otherwise(F.col("_t"))).drop("_t")
    read = shown.withColumn("_r", _read("_rest", "_ext", F.when(html & has_rare_entities(F.col("_shown")), F.col("_shown")))).drop("_rest")
    text = F.when(html, F.coalesce(F.col("_r.decoded"), frequent_entities(F.col("_shown")))).otherwise(F.col("_shown"))
    given = {
        "status": F.when(of_text, F.when(F.col("_large"), "partial").otherwise("ok")).when(skipped, "skipped-size").otherwise(F.col("_r.status")),
        "segments": F.when(of_text, F.array(F.struct(F.lit("").alias("label"), F.substring(text, 1, MAX_CHARS).alias("text")))).otherwise(F.col("_r.segments")),
    }
    return read.select(*(c for c in files.columns if c != "content"), *(given.get(n, F.col(f"_r.{n}")).alias(n) for n in FIELDS))


def limited_segments(segments: Column, most: int = MAX_CHARS) -> Column:
    """Segments up to a total length; the one that passes it is cut, the rest are left out."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<label:string,text:string>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        left = F.lit(most) - acc["n"]
        cut = F.struct(s["label"].alias("label"), F.substring(s["text"], F.lit(1), left).alias("text"))
        return F.struct((acc["n"] + F.length(s["text"])).alias("n"), F.when(left > 0, F.concat(acc["out"], F.array(cut))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(segments, start, step, lambda a: a["out"])


def office_xml_text(xml: Column) -> Column:
    """The text of one office XML part, as a Column."""
    return xml_to_text(xml)


MESSAGE = StructType([StructField(n, StringType()) for n in ("subject", "from", "to", "cc", "message_id", "body")] + [StructField("attachments", ArrayType(StringType())), StructField("addresses", ArrayType(StringType()))])


@F.arrow_udf(MESSAGE)
def read_message(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Headers, body and attachment names of raw messages; a broken one has empty fields."""

    def one(content: bytes | None) -> tuple[dict, int]:
        try:
            parts, head = message_parts(content or b"")
        except Exception:  # noqa: BLE001 a broken message is a row, not the job's end
            parts, head = [], {"attachments": [], "addresses": []}
        body = "\n".join(t for label, t in parts if label == "body")
        row = [*(head.get(k, "") for k in ("subject", "from", "to", "cc", "message-id")), body, head["attachments"], head["addresses"]]
        return dict(zip(MESSAGE.names, row, strict=True)), len(body)

    yield from in_batches(one, ((c,) for c in contents), MESSAGE)
