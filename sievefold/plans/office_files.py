"""Inputs of the queries on formats: files in the layout of their published formats, made of texts of the tables.

The writers share nothing with the readers. What makes real files hard is in them: chains of sectors out of order, streams in the
mini stream, strings that go on in the next record, texts in pieces of two codings, fields, objects packed in
streams, fonts with codes of their own, pages out of order, names in old code pages.
"""

from __future__ import annotations

import email.message
import email.policy
import io
import random
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..sources.batches import made

SECTOR, MINI, CUTOFF = 512, 64, 4096
END, FREE, TABLE, EXTRA = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFC


def compound(streams: dict[str, bytes], seed: int = 0) -> bytes:
    """A compound file of streams by path; the sectors of every chain lie in a random order."""
    rng = random.Random(seed)
    folders = sorted({p[:k] for p in streams for k in range(len(p)) if p[k] == "/"})
    names = ["", *folders, *streams]
    number = {p: k for k, p in enumerate(names)}
    small = {p: b for p, b in streams.items() if 0 < len(b) < CUTOFF}
    mini, mini_next, starts = bytearray(), [], {}
    for p, b in small.items():
        n = -(-len(b) // MINI)
        starts[p] = len(mini_next)
        mini_next += [*range(len(mini_next) + 1, len(mini_next) + n), END]
        mini += b.ljust(n * MINI, b"\0")
    mini_table = struct.pack(f"<{len(mini_next)}I", *mini_next)
    chains = {("", "dir"): bytes(-(-len(names) * 128 // SECTOR) * SECTOR), ("", "mini"): bytes(mini), ("", "minifat"): mini_table}
    chains |= {(p, ""): b for p, b in streams.items() if len(b) >= CUTOFF}
    need = {k: -(-len(b) // SECTOR) for k, b in chains.items()}
    n_table = 1
    while (total := sum(need.values()) + n_table + (extra := max(0, -(-(n_table - 109) // 127)))) > n_table * 128:
        n_table += 1
    order = list(range(total))
    rng.shuffle(order)
    table, given, at = [FREE] * (n_table * 128), {}, 0
    for k, n in need.items():
        given[k] = order[at : at + n]
        at += n
        for a, b in zip(given[k], given[k][1:], strict=False):
            table[a] = b
        if n:
            table[given[k][-1]] = END
    tables, more = order[at : at + n_table], order[at + n_table :]
    for k in tables:
        table[k] = TABLE
    for k in more:
        table[k] = EXTRA
    first = lambda k: given[k][0] if given.get(k) else END
    siblings: dict[str, list[str]] = {}
    for p in names[1:]:
        siblings.setdefault(p.rpartition("/")[0], []).append(p)
    entries = b""
    for p in names:
        kind = 5 if p == "" else 1 if p in folders else 2
        own = siblings.get(p.rpartition("/")[0], []) if p else []
        here = own.index(p) if p else 1
        beside = lambda k: number[own[k]] if here % 2 == 0 and k < len(own) else FREE  # noqa: B023, E731
        left, right = beside(here + 1), beside(here + 2)  # a crooked tree: those at odd places hang to the left of the one before
        child = number[siblings[p][0]] if p in siblings else FREE
        body = streams.get(p, b"")
        start, size = (first(("", "mini")), len(mini)) if p == "" else (starts[p], len(body)) if p in small else (first((p, "")), len(body))
        name = ("Root Entry" if p == "" else p.rpartition("/")[2]).encode("utf-16-le")[:62]
        entries += name.ljust(64, b"\0") + struct.pack("<HBBIII", len(name) + 2, kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", start if kind != 1 else 0, size)
    chains["", "dir"] = entries.ljust(need["", "dir"] * SECTOR, b"\0")
    out = bytearray(total * SECTOR)
    for k, b in chains.items():
        for nth, s in enumerate(given[k]):
            out[s * SECTOR : s * SECTOR + SECTOR] = b[nth * SECTOR : (nth + 1) * SECTOR].ljust(SECTOR, b"\0")
    for nth, s in enumerate(tables):
        out[s * SECTOR : (s + 1) * SECTOR] = struct.pack("<128I", *table[nth * 128 : (nth + 1) * 128])
    for nth, s in enumerate(more):
        own = tables[109 + nth * 127 : 109 + (nth + 1) * 127]
        out[s * SECTOR : (s + 1) * SECTOR] = struct.pack("<128I", *own, *[FREE] * (127 - len(own)), more[nth + 1] if nth + 1 < len(more) else END)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH6xIIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, n_table, first(("", "dir")), 0, CUTOFF, first(("", "minifat")), need["", "minifat"], more[0] if more else END, extra, tables[0])
    return (head[:76] + struct.pack("<109I", *(tables[:109] + [FREE] * (109 - len(tables[:109]))))).ljust(SECTOR, b"\0") + bytes(out)


def summary(author: str, editor: str, created: datetime) -> bytes:
    """A property set with an author, the last editor, and an instant."""
    ticks = int((created - datetime(1601, 1, 1, tzinfo=UTC)).total_seconds()) * 10_000_000
    values = {1: struct.pack("<HxxH2x", 2, 1252), 12: struct.pack("<HxxQ", 0x40, ticks)}
    for n, text in ((4, author), (8, editor)):
        raw = text.encode("cp1252") + b"\0"
        values[n] = struct.pack("<HxxI", 0x1E, len(raw)) + raw + bytes(-len(raw) % 4)
    at, head, body = 8 + 8 * len(values), b"", b""
    for n, v in values.items():
        head += struct.pack("<II", n, at + len(body))
        body += v
    return struct.pack("<HHI16xI16xI", 0xFFFE, 0, 2, 1, 48) + struct.pack("<II", 8 + len(head) + len(body), len(values)) + head + body


def word(text: str) -> dict[str, bytes]:
    """A text in pieces, one byte and two bytes to a character in turn, with a field before it."""
    field = "\x13 HYPERLINK \"x\" \x14\x15"
    whole, pieces, k, nth = field + text, [], 0, 0
    while k < len(whole):
        n = 700 + 37 * nth
        part = whole[k : k + n]
        try:
            raw = part.encode("cp1252") if nth % 2 == 0 else None
        except UnicodeEncodeError:
            raw = None
        units = part.encode("utf-16-le")
        pieces.append((len(raw) if raw is not None else len(units) // 2, raw if raw is not None else units, raw is not None))
        k, nth = k + n, nth + 1
    at, body, ends, plan = 2048, b"", [0], b""
    for chars, raw, narrow in pieces:
        place = at + len(body)
        plan += struct.pack("<HIH", 0, place * 2 | 0x40000000 if narrow else place, 0)
        body += raw + b"\0" * (len(raw) % 2)
        ends.append(ends[-1] + chars)
    plan = struct.pack(f"<{len(ends)}I", *ends) + plan
    clx = b"\x01" + struct.pack("<H", 4) + b"abcd" + b"\x02" + struct.pack("<I", len(plan)) + plan
    places = bytearray(93 * 8)
    struct.pack_into("<II", places, 33 * 8, 100, len(clx))
    fib = struct.pack("<H8xH20x", 0xA5EC, 0x0200) + struct.pack("<H", 14) + bytes(28) + struct.pack("<H", 22) + bytes(88) + struct.pack("<H", 93) + bytes(places)
    return {"WordDocument": (fib.ljust(at, b"\0") + body).ljust(CUTOFF, b"\0"), "1Table": bytes(100) + clx}


def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def workbook(text: str) -> dict[str, bytes]:
    """Words in cells, eight a row, by a table of strings that is cut into records of 200 bytes at any place; then numbers of all kinds."""
    words = text.split()
    table = sorted(set(words))
    number = {w: k for k, w in enumerate(table)}
    records, now = [], bytearray(struct.pack("<II", len(words), len(table)))
    for nth, w in enumerate(table):
        wide = nth % 2 == 1 or any(ord(c) > 255 for c in w)
        raw = w.encode("utf-16-le" if wide else "latin-1")
        if len(now) + 11 > 200:
            records, now = [*records, bytes(now)], bytearray()
        rich = nth % 3 == 0
        now += struct.pack("<HB", len(raw) // (2 if wide else 1), wide | (8 if rich else 0)) + (struct.pack("<H", 1) if rich else b"")
        width = 2 if wide else 1
        while raw:
            room = (200 - len(now)) // width * width
            if room <= 0:
                records, now = [*records, bytes(now)], bytearray([wide])
                continue
            now, raw = now + raw[:room], raw[room:]
        now += bytes(4) if rich else b""
    records.append(bytes(now))
    strings = _record(0xFC, records[0]) + b"".join(_record(0x3C, r) for r in records[1:])
    begin = _record(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0))
    cells = b"".join(_record(0xFD, struct.pack("<HHHI", k // 8, k % 8, 0, number[w])) for k, w in enumerate(words))
    row = len(words) // 8 + 3
    cells += _record(0x203, struct.pack("<HHHd", row, 0, 0, 1.5)) + _record(0x27E, struct.pack("<HHHI", row, 1, 0, 42 << 2 | 2))
    cells += _record(0xBD, struct.pack("<HHHIHIH", row, 2, 0, 7 << 2 | 2, 0, 1234 << 2 | 3, 3))
    cells += _record(6, struct.pack("<HHH", row + 1, 0, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + _record(0x207, struct.pack("<HB", 3, 0) + b"fim")
    title = "Ação".encode("utf-16-le")
    sheet = lambda at: _record(0x85, struct.pack("<IHBB", at, 0, 4, 1) + title)
    end = _record(0x0A, b"")
    at = len(begin + sheet(0) + strings + end)
    return {"Workbook": begin + sheet(at) + strings + end + begin + cells + end}


def slides(text: str) -> dict[str, bytes]:
    """Halves of a text in atoms of one and two bytes to a character, after a master slide that doesn't count."""
    half = len(text) // 2
    atom = lambda kind, raw: struct.pack("<HHI", 0, kind, len(raw)) + raw
    box = lambda kind, raw: struct.pack("<HHI", 15, kind, len(raw)) + raw
    first = text[:half]
    one = atom(0xFA8, first.encode("latin-1")) if all(ord(c) < 256 for c in first) else atom(0xFA0, first.encode("utf-16-le"))
    return {"PowerPoint Document": box(0x3F8, atom(0xFA8, b"Click to edit")) + box(0x3E8, box(0x3EE, one) + box(0x3EE, atom(0xFA0, text[half:].encode("utf-16-le")))), "Pictures": b"no text" * 900}


def mail(text: str, subject: str) -> dict[str, bytes]:
    """A message with an attached text file and a recipient."""
    half, wide = len(text) // 2, lambda t: t.encode("utf-16-le") + b"\0\0"
    return {
        "__substg1.0_0037001F": wide(subject), "__substg1.0_0C1A001F": wide("Ana"), "__substg1.0_1000001F": wide(text[:half]), "__substg1.0_0064001F": wide("SMTP"),
        "__attach_version1.0_#00000000/__substg1.0_37010102": text[half:].encode(), "__attach_version1.0_#00000000/__substg1.0_3707001F": wide("resto.txt"),
    }


#: A file of each shape, from a text of words.
OFFICE = {
    "doc": lambda t, k: compound(word(t) | {"\x05SummaryInformation": summary("Ana", "João", datetime(2021, 3, 4, 5, 6, 7, tzinfo=UTC))}, k),
    "xls": lambda t, k: compound(workbook(t) | {"\x05SummaryInformation": summary("Ana", "João", datetime(2021, 3, 4, 5, 6, 7, tzinfo=UTC)), "_VBA/dir": b"x" * 70}, k),
    "ppt": lambda t, k: compound(slides(t) | {"\x05SummaryInformation": summary("Ana", "João", datetime(2021, 3, 4, 5, 6, 7, tzinfo=UTC))}, k),
    "msg": lambda t, k: compound(mail(t, f"assunto {k}"), k),
    "docx": lambda t, k: compound({"EncryptedPackage": t.encode(), "EncryptionInfo": b"\4\0\4\0" * 20}, k),
    "dat": lambda t, k: compound({"Contents": t.encode(), "Box/Inner/Deep": t.encode()[:50]}, k),
    "wps": lambda t, k: compound({"WordDocument": (b"\xdb\xa5" + bytes(600) + t.encode()).ljust(CUTOFF, b"\0")}, k),  # an older version
}
SHAPES = tuple(OFFICE)


@F.arrow_udf(BinaryType())
def office_file(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A file for each row: shape, text, number."""
    yield from made(lambda s, t, k: OFFICE[s](t, k), batches, BinaryType())


# ---- PDF


def _literal(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"a", b"\\141") + b")"


def pdf_file(first: str, second: str, *, packed: bool) -> bytes:
    """Two pages, the second one earlier in the file. The first in a simple font, line by line; the second in a font of two-byte codes
    with a map, in a form. A picture's bytes look like text operators. packed: objects in a stream, with a cross-reference stream."""
    codes = {c: k + 3 for k, c in enumerate(sorted(set(second)))}
    digits = {ord(c): "> -400 <" if c == " " else f"{k:04X}" for c, k in codes.items()}
    pairs = b"".join(b"<%04X> <%s>\n" % (k, c.encode("utf-16-be").hex().encode()) for c, k in codes.items())
    cmap = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n%d beginbfchar\n%sendbfchar endcmap" % (len(codes), pairs)
    lines = first.split(" ")
    shown = b"BT /F1 9 Tf 12 TL 1 0 0 1 50 700 Tm " + b" T* ".join(_literal(" ".join(lines[k : k + 9]).encode("cp1252")) + b" Tj" for k in range(0, len(lines), 9)) + b" ET"
    coded = f"<{second.translate(digits)}> -400".encode()
    form = b"q 1 0 0 1 0 5 cm BT /F2 9 Tf 5 5 Td [" + coded + b"] TJ ET Q"
    picture = b"BT (SECRET IMAGE) Tj ET " * 3

    def stream(extra: bytes, raw: bytes) -> bytes:
        body = zlib.compress(raw, 1)
        return b"<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (extra, len(body), body)

    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [ 8 0 R 3 0 R ] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /Im 10 0 R /Fm 11 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        4: stream(b"", b"/Im Do /Fm Do"),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [ 1 /A /eacute ] >> >>",
        6: b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode 7 0 R >>",
        7: stream(b"", cmap),
        8: b"<< /Type /Page /Parent 2 0 R /Contents [ 9 0 R ] >>",
        9: stream(b"", shown),
        10: stream(b"/Type /XObject /Subtype /Image /Width 8 /Height 9", picture),
        11: stream(b"/Type /XObject /Subtype /Form /BBox [ 0 0 9 9 ]", form),
        12: b"<< /Author <FEFF0041006E0061> /CreationDate (D:20210304050607-03'00') /Producer (none) >>",
    }
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}
    inside = [k for k, o in objects.items() if b"stream" not in o] if packed else []
    for k in sorted(set(objects) - set(inside), reverse=True):
        places[k] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (k, objects[k])
    if packed:
        heads, bodies = b"", b""
        for k in inside:
            heads += b"%d %d " % (k, len(bodies))
            bodies += objects[k] + b"\n"
        places[13] = len(out)
        out += b"13 0 obj\n" + stream(b"/Type /ObjStm /N %d /First %d" % (len(inside), len(heads)), heads + bodies) + b"\nendobj\n"
        at = places[14] = len(out)
        rows = [bytes(7)] + [struct.pack(">BIH", 2, 13, inside.index(k)) if k in inside else struct.pack(">BIH", 1, places[k], 0) for k in range(1, 15)]
        above, coded_rows = bytes(7), b""
        for r in rows:  # each byte as its difference from the row above
            coded_rows += b"\2" + bytes((a - b) & 255 for a, b in zip(r, above, strict=True))
            above = r
        head = b"/Type /XRef /Size 15 /W [ 1 4 2 ] /Root 1 0 R /Info 12 0 R /DecodeParms << /Predictor 12 /Columns 7 >>"
        out += b"14 0 obj\n" + stream(head, coded_rows) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
        return bytes(out)
    at = len(out)
    out += b"xref\n0 13\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % places[k] for k in range(1, 13))
    out += b"trailer\n<< /Size 13 /Root 1 0 R /Info 12 0 R >>\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


@F.arrow_udf(BinaryType())
def pdf_of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A file for each row: first text, second text, packed."""
    yield from made(lambda a, b, p: pdf_file(a, b, packed=p), batches, BinaryType())


def zip_of_names(names: list[str], coding: str) -> bytes:
    """A ZIP file of empty entries whose names are in the given coding, as programs write them that know no UTF-8 mark; 'mark' sets the mark."""
    entries, heads = b"", b""
    for name in names:
        raw, flags = (name.encode("utf-8"), 0x800) if coding == "mark" else (name.encode(coding), 0)
        heads += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 20, 20, flags, 0, 0, 33, 0, 0, 0, len(raw), 0, 0, 0, 0, 0, len(entries)) + raw
        entries += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 20, flags, 0, 0, 33, 0, 0, 0, len(raw), 0) + raw
    return entries + heads + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, len(names), len(names), len(heads), len(entries), 0)


@F.arrow_udf(BinaryType())
def zip_names(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A file for each row: names, coding."""
    yield from made(zip_of_names, batches, BinaryType())


@lru_cache(maxsize=1024)
def _header(name: str, value: str):
    return email.policy.default.header_store_parse(name, value)


class _Headers(email.policy.EmailPolicy):
    """The default policy, but for headers that it has made before."""

    def header_store_parse(self, name, value):
        return _header(name, value) if type(value) is str else super().header_store_parse(name, value)


_HEADERS = _Headers()


def attached(text: str, depth: int) -> bytes:
    """A message in a message, so many deep, the innermost with a workbook's text in an attached ZIP-based document."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>")
    m = email.message.EmailMessage(_HEADERS)
    m["Subject"] = "inner"
    m.set_content("see below")
    m.add_attachment(out.getvalue(), maintype="application", subtype="octet-stream", filename="f.docx")
    for k in range(depth):
        outer = email.message.EmailMessage(_HEADERS)
        outer["Subject"] = f"level {k}"
        outer.set_content(f"level {k}")
        outer.add_attachment(m)
        m = outer
    return m.as_bytes()


@F.arrow_udf(BinaryType())
def attached_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A file for each row: text, depth."""
    yield from made(attached, batches, BinaryType())
