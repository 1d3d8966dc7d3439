"""Binary office files in compound-file containers: their streams, property sets and texts, by the published layouts.

A container is a small file system: sectors chained in an allocation table, small streams in a mini stream, a tree of
named entries. Each file's streams become rows of a DataFrame (streams), or one file is read as a whole (office_text):
Word by its piece table, workbooks by their cell records, slides by their text atoms, messages by their properties.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from .batches import in_batches

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Fixed values of the format: sector numbers from here on are marks, not sectors.
_MARKS = 0xFFFFFFFA
_STORAGE, _STREAM = 1, 2


class Container:
    """The streams of a compound file by path; storages are folders."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 20 or not 4 <= mini_shift <= shift:
            raise ValueError("sector size")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        _, directory, _, self.cutoff, mini_table, _, extra, n_extra = struct.unpack_from("<8I", data, 44)
        tables = list(struct.unpack_from("<109I", data, 76))
        for _ in range(min(n_extra, len(data) // self.size)):
            if extra >= _MARKS:
                break
            more = np.frombuffer(self._sector(extra), "<u4").tolist()
            tables, extra = tables + more[:-1], more[-1]
        raw = b"".join(self._sector(t) for t in tables if t < _MARKS)
        self.next = np.frombuffer(raw[: len(raw) // 4 * 4], "<u4")
        self.mini_next = np.frombuffer(self._chain(mini_table), "<u4")
        entries = self._chain(directory)
        self.entries = [entries[k : k + 128] for k in range(0, len(entries) // 128 * 128, 128)]
        if not self.entries:
            raise ValueError("no directory")
        self.small = self._chain(self._start(0))[: self._length(0)]
        self.paths = dict(self._walk())

    def _sector(self, k: int) -> bytes:
        return self.data[(k + 1) * self.size : (k + 2) * self.size]

    def _follow(self, k: int, following: np.ndarray) -> Iterator[int]:
        for _ in range(len(following)):  # a chain that is longer runs in a circle
            if k >= len(following):
                return
            yield k
            k = int(following[k])

    def _chain(self, k: int) -> bytes:
        return b"".join(self._sector(s) for s in self._follow(k, self.next))

    def _start(self, k: int) -> int:
        return struct.unpack_from("<I", self.entries[k], 116)[0]

    def _length(self, k: int) -> int:
        return struct.unpack_from("<Q", self.entries[k], 120)[0] & (0xFFFFFFFF if self.size == 512 else 0xFFFFFFFFFFFFFFFF)

    def _walk(self) -> Iterator[tuple[str, int]]:
        """(path, entry) of all streams: the tree of each storage hangs below its entry."""
        todo, seen = [(struct.unpack_from("<I", self.entries[0], 76)[0], "")], set()
        while todo:
            k, folder = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            length, kind, _, left, right, child = struct.unpack_from("<HBBIII", self.entries[k], 64)
            name = folder + self.entries[k][: min(64, max(0, length - 2))].decode("utf-16-le", "replace")
            todo += [(left, folder), (right, folder)]
            if kind == _STORAGE:
                todo.append((child, name + "/"))
            elif kind == _STREAM:
                yield name, k

    def read(self, path: str) -> bytes:
        """The bytes of a stream; none if there is no such stream."""
        k = self.paths.get(path)
        if k is None:
            return b""
        length = self._length(k)
        if length >= self.cutoff:
            return self._chain(self._start(k))[:length]
        parts = (self.small[m * self.mini : (m + 1) * self.mini] for m in self._follow(self._start(k), self.mini_next))
        return b"".join(parts)[:length]


def kind_of(paths) -> str:
    """encrypted, doc, xls, ppt, msg or ole, by the streams at the top."""
    top = {p for p in paths if "/" not in p}
    for kind, names in (("encrypted", {"EncryptedPackage", "EncryptionInfo"}), ("doc", {"WordDocument"}), ("xls", {"Workbook", "Book"}), ("ppt", {"PowerPoint Document"})):
        if names & top:
            return kind
    return "msg" if any(p.startswith("__substg1.0_") for p in top) else "ole"


def _coded(raw: bytes, page: int) -> str:
    name = {1200: "utf-16-le", 65001: "utf-8", 10000: "mac-roman"}.get(page, f"cp{page}")
    try:
        return raw.decode(name, "replace")
    except LookupError:
        return raw.decode("cp1252", "replace")


def properties(raw: bytes) -> dict[int, str]:
    """The strings and instants of a property set's first section by their number."""
    found: dict[int, str] = {}
    if len(raw) < 48 or raw[:2] != b"\xfe\xff":
        return found
    base = struct.unpack_from("<I", raw, 44)[0]
    if base + 8 > len(raw):
        return found
    count = min(struct.unpack_from("<I", raw, base + 4)[0], (len(raw) - base - 8) // 8)
    places = [(n, base + at) for n, at in struct.iter_unpack("<II", raw[base + 8 : base + 8 + 8 * count]) if base + at + 8 <= len(raw)]
    page = next((struct.unpack_from("<H", raw, at + 4)[0] for n, at in places if n == 1), 1252)
    for n, at in places:
        kind, size = struct.unpack_from("<HxxI", raw, at)
        if kind == 0x1E:
            text = _coded(raw[at + 8 : at + 8 + size], page)
        elif kind == 0x1F:
            text = raw[at + 8 : at + 8 + 2 * size].decode("utf-16-le", "replace")
        elif kind == 0x40 and at + 12 <= len(raw):
            instant = datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=min(struct.unpack_from("<Q", raw, at + 4)[0] // 10, 1 << 56))
            text = f"{instant:%Y-%m-%dT%H:%M:%S}.{instant.microsecond // 1000:03}Z" if 1980 <= instant.year < 2200 else ""
        else:
            continue
        if text := text.rstrip("\0").strip():
            found[n] = text
    return found


#: Numbers of the properties in the two sets.
SUMMARY = {"title": 2, "author": 4, "last_modified_by": 8, "created": 12, "modified": 13, "application": 18}
DOCUMENT = {"company": 15}


def metadata(c: Container) -> dict[str, str]:
    sets = ((SUMMARY, properties(c.read("\x05SummaryInformation"))), (DOCUMENT, properties(c.read("\x05DocumentSummaryInformation"))))
    return {name: own[n] for names, own in sets for name, n in names.items() if n in own}


_WORD_MARKS = str.maketrans({"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x0e": "\n", "\x07": "\t", "\x1e": "-"} | {chr(k): None for k in range(32) if k not in (7, 9, 11, 12, 13, 14, 19, 20, 21, 30)})
_FIELD = re.compile(r"\x13[^\x13-\x15]*(?:\x14([^\x13-\x15]*))?\x15")


def word_text(c: Container) -> str | None:
    """The document's pieces in order; of fields the results. None where it is encrypted."""
    doc = c.read("WordDocument")
    ident, flags = struct.unpack_from("<H8xH", doc)
    if ident != 0xA5EC:
        raise ValueError("older Word")
    if flags & 0x100:
        return None
    table = c.read("1Table" if flags & 0x200 else "0Table")
    at = 32
    for width in (2, 4):
        at += 2 + width * struct.unpack_from("<H", doc, at)[0]
    place, size = struct.unpack_from("<II", doc, at + 2 + 33 * 8)
    pieces, at = table[place : place + size], 0
    while pieces[at] == 1:  # formatting of whole pieces
        at += 3 + struct.unpack_from("<H", pieces, at + 1)[0]
    if pieces[at] != 2:
        raise ValueError("no piece table")
    length = struct.unpack_from("<I", pieces, at + 1)[0]
    plan = pieces[at + 5 : at + 5 + length]
    n = (length - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plan)
    out = []
    for k in range(n):
        chars, where = max(0, ends[k + 1] - ends[k]), struct.unpack_from("<I", plan, 4 * (n + 1) + 8 * k + 2)[0]
        start = where & 0x3FFFFFFF
        out.append(doc[start // 2 : start // 2 + chars].decode("cp1252", "replace") if where & 0x40000000 else doc[start : start + 2 * chars].decode("utf-16-le", "replace"))
    text, before = "".join(out), None
    while text != before:  # from the innermost field outwards
        before, text = text, _FIELD.sub(lambda m: m[1] or "", text)
    return re.sub("[\x13\x14\x15]", "", text.translate(_WORD_MARKS))


def _records(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(place, type, body) of a workbook's records."""
    at = 0
    while at + 4 <= len(raw):
        kind, size = struct.unpack_from("<HH", raw, at)
        yield at, kind, raw[at + 4 : at + 4 + size]
        at += 4 + size


def shared_strings(parts: list[bytes]) -> list[str]:
    """The strings of a table that goes on in further records. Characters may break off at a record's end; the next then opens
    with a byte that says how wide they are there. What a broken table still holds is kept."""
    raw, ends = b"".join(parts), np.cumsum([len(p) for p in parts]).tolist()
    borders = set(ends[:-1])
    out, at, part = [], 8, 0
    try:
        for _ in range(struct.unpack_from("<I", raw, 4)[0]):
            left, flags = struct.unpack_from("<HB", raw, at)
            at += 3
            runs, = struct.unpack_from("<H", raw, at) if flags & 8 else (0,)
            at += 2 if flags & 8 else 0
            extra, = struct.unpack_from("<I", raw, at) if flags & 4 else (0,)
            at += 4 if flags & 4 else 0
            wide, text = flags & 1, []
            while left:
                if at in borders:  # the characters go on in the next record
                    wide, at = raw[at] & 1, at + 1
                    continue
                while part < len(ends) - 1 and ends[part] <= at:  # places only grow
                    part += 1
                end = ends[part]
                take = min(left, max(0, end - at) >> wide)
                if not take:
                    at = end
                    if at >= len(raw):
                        raise IndexError
                    continue
                text.append(raw[at : at + (take << wide)].decode("utf-16-le" if wide else "latin-1", "replace"))
                left, at = left - take, at + (take << wide)
            out.append("".join(text))
            at += 4 * runs + extra
    except (struct.error, IndexError, StopIteration):
        pass
    return out


def number_text(v: float) -> str:
    """Whole numbers without a point, others by their shortest digits."""
    return str(int(v)) if v == int(v) and abs(v) < 1e21 else repr(v)


def _packed_number(bits: int) -> float:
    v = float(bits - (1 << 32) >> 2 if bits >> 31 else bits >> 2) if bits & 2 else struct.unpack("<d", struct.pack("<Q", (bits & ~3) << 32))[0]
    return v / 100 if bits & 1 else v


def _string(body: bytes, at: int) -> str:
    n, wide = struct.unpack_from("<HB", body, at)
    return body[at + 3 : at + 3 + (n << (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace")


def cells(body: bytes, kind: int, strings: list[str]) -> list[tuple[int, str]]:
    """(row, value) of one record; a formula that has a string gives None, which the next record fills."""
    row = struct.unpack_from("<H", body)[0] if len(body) >= 2 else 0
    if kind == 0xFD:
        n = struct.unpack_from("<I", body, 6)[0]
        return [(row, strings[n])] if n < len(strings) else []
    if kind == 0x204:
        return [(row, _string(body, 6))]
    if kind == 0x203:
        return [(row, number_text(struct.unpack_from("<d", body, 6)[0]))]
    if kind == 0x27E:
        return [(row, number_text(_packed_number(struct.unpack_from("<I", body, 6)[0])))]
    if kind == 0xBD:
        return [(row, number_text(_packed_number(struct.unpack_from("<I", body, at + 2)[0]))) for at in range(4, len(body) - 7, 6)]
    if kind == 6 and body[12:14] != b"\xff\xff":
        return [(row, number_text(struct.unpack_from("<d", body, 6)[0]))]
    return []


def sheet_texts(c: Container) -> list[tuple[str, str]] | None:
    """(label, text) of each sheet: a line for each row, so that lines keep their numbers, tabs between values. None where it is encrypted."""
    raw = c.read("Workbook") or c.read("Book")
    if struct.unpack_from("<H2xH", raw) != (0x809, 0x600):
        raise ValueError("older workbook")
    titles: dict[int, str] = {}
    strings: list[bytes] | list[str] = []
    out: list[tuple[str, list[tuple[int, str]]]] = []
    table, inside, pending = [], False, None
    for at, kind, body in _records(raw):
        if table and kind == 0x3C:
            table.append(body)
            continue
        if table:
            strings, table = shared_strings(table), []
        if kind == 0xFC:
            table = [body]
        elif kind == 0x85:
            start, n, wide = struct.unpack_from("<I2xBB", body)
            titles[start] = body[8 : 8 + (n << (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
        elif kind == 0x2F and not inside:
            return None
        elif kind == 0x809 and at in titles:
            inside = True
            out.append((titles[at], []))
        elif kind == 0x0A:
            inside = False
        elif inside and kind == 6 and body[12:14] == b"\xff\xff":
            pending = struct.unpack_from("<H", body)[0] if body[6] == 0 else None
        elif inside and kind == 0x207 and pending is not None:
            out[-1][1].append((pending, _string(body, 0)))
            pending = None
        elif inside:
            out[-1][1].extend(cells(body, kind, strings))
    return [(f'Planilha "{title}"', row_lines(values)) for title, values in out]


def row_lines(values: list[tuple[int, str]], gap: int = 20_000) -> str:
    """Values by row; a gap of more than so many empty rows counts as one line."""
    parts, line, first = [], 0, True
    for row, value in values:
        if value == "":
            continue
        if row > line:
            parts.append("\n" * (row - line if row - line <= gap else 1))
            line, first = row, True
        whole = re.sub(r"\r\n|[\r\n]", " ", value) if "\n" in value or "\r" in value else value
        parts.append(whole if first else "\t" + whole)
        first = False
    return "".join(parts)


def slide_text(c: Container) -> str | None:
    """The text atoms of all containers but master slides and handouts. None where it is encrypted."""
    if c.read("EncryptedSummary"):
        return None
    raw, at, out = c.read("PowerPoint Document"), 0, []
    while at + 8 <= len(raw):
        version, kind, size = struct.unpack_from("<HHI", raw, at)
        at += 8
        if kind not in (0x3F8, 0xFC9) and version & 15 == 15:
            continue  # the records inside come next
        if kind in (0xFA0, 0xFA8):
            body = raw[at : at + size]
            out.append(body[: len(body) // 2 * 2].decode("utf-16-le", "replace") if kind == 0xFA0 else body.decode("latin-1"))
        at += size
    return re.sub("[\r\x0b]", "\n", "\n".join(out))


#: Properties of a message that are keys, headers or address types, not text to search.
_NO_TEXT = set("007D 1035 1042 0E1D 0064 0C1E 3002 0070 5D0A 5D0B".split())
_PROPERTY = re.compile(r"(?:^|/)__substg1\.0_([0-9A-Fa-f]{4})([0-9A-Fa-f]{4})$")
_PART = re.compile(r"__(attach|recip)_version1\.0_", re.I)


def message(c: Container) -> tuple[list[tuple[str, str]], dict[str, str], list[tuple[str, bytes]], bytes]:
    """Texts of all properties, metadata, attachments (name, bytes) and the HTML body of an Outlook message; the latter counts if there is no plain one."""
    out, found, attached, html, plain = [], {}, [], b"", False
    named = {"0C1A": "author", "3FFA": "last_modified_by", "0037": "title"}

    def text_of(path: str, kind: str) -> str:
        raw = c.read(path)
        return (raw.decode("utf-16-le", "replace") if kind == "001F" else raw.decode("cp1252", "replace")).rstrip("\0")

    for path in sorted(c.paths, key=c.paths.get):
        m = _PROPERTY.search(path)
        if not m:
            continue
        number, kind = m[1].upper(), m[2].upper()
        if (number, kind) == ("1013", "0102"):
            html = html or c.read(path)
        elif (number, kind) == ("3701", "0102"):
            folder = path[: path.rfind("/") + 1]
            names = (text_of(f"{folder}__substg1.0_{p}{k}", k).strip() for p in ("3707", "3704", "3001") for k in ("001F", "001E"))
            attached.append((next((x for x in names if x), "anexo-sem-nome"), c.read(path)))
        elif kind in ("001F", "001E") and number not in _NO_TEXT and (text := text_of(path, kind)).strip():
            plain |= number == "1000"
            out.append(("", text))
            if number in named and not _PART.search(path):
                found.setdefault(named[number], text.strip())
    return out, found, attached, b"" if plain else html


def office_text(data: bytes) -> tuple[str, str, list[tuple[str, str]], dict[str, str], list[tuple[str, bytes]], bytes]:
    """status, kind, (label, text) segments, metadata, attachments and HTML body of a compound file.

    Where a stream isn't laid out as its format says, or is of an older version, its runs of printable characters are its text.
    """
    from .extract import runs_of_text

    c = Container(data)
    kind = kind_of(c.paths)
    if kind == "encrypted":
        return "encrypted", kind, [], {}, [], b""
    found = metadata(c)
    if kind == "ole":
        return "unsupported", kind, [], found, [], b""
    if kind == "msg":
        segments, own, attached, html = message(c)
        return "ok", kind, [("", "\n".join(t for _, t in segments))], own | found, attached, html
    try:
        text = {"doc": word_text, "xls": sheet_texts, "ppt": slide_text}[kind](c)
    except (ValueError, IndexError, struct.error):
        main = {"doc": ["WordDocument"], "xls": ["Workbook", "Book"], "ppt": ["PowerPoint Document"]}[kind]
        text = runs_of_text(next(filter(None, map(c.read, main)), b""))
    if text is None:
        return "encrypted", kind, [], found, [], b""
    return "ok", kind, text if isinstance(text, list) else [("", text)], found, [], b""


_STREAMS = ArrayType(StructType([StructField("path", StringType()), StructField("content", BinaryType())]))


@F.arrow_udf(_STREAMS)
def _streams(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def one(content: bytes | None) -> tuple[list[dict] | None, int]:
        try:
            c = Container(content)
        except (ValueError, struct.error, TypeError):
            return None, 0
        own = [{"path": p, "content": c.read(p)} for p in c.paths]
        return own, sum(len(s["content"]) for s in own)

    yield from in_batches(one, ((c,) for c in contents), _STREAMS)


def streams(files: DataFrame) -> DataFrame:
    """A row for each stream of each compound file in files (content and other columns): path, stream. Other files have none."""
    keep = [c for c in files.columns if c != "content"]
    own = F.when(F.substring("content", 1, 8) == F.lit(bytearray(MAGIC)), F.col("content"))  # a filter would have contents that Python makes made twice
    return files.select(*keep, F.explode(_streams(own)).alias("_s")).select(*keep, F.col("_s.path").alias("path"), F.col("_s.content").alias("stream"))
