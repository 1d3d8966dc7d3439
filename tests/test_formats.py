"""Readers of office files and PDF against files written in the layout of their formats, whole and damaged."""

import random
import re
import struct
import time
import zlib

import pytest

from sievefold.functions import markup
from sievefold.plans import office_files as w
from sievefold.sources import compound, extract, pdf


def prose(n, seed=1):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgáéñçß0123") for _ in range(rng.randint(1, 12))) for _ in range(n))


def plain(segments, between=" "):
    return re.sub(r"\s+", " ", between.join(t for _, t in segments)).strip()


@pytest.mark.parametrize("n", [3, 400, 9000])
def test_office_files(n):
    t = prose(n, n)
    read = lambda shape: extract.read_file(w.OFFICE[shape](t, n), f".{shape}")
    for shape, want in (("doc", t), ("xls", t + " 1.5 42 7 12.34 fim"), ("ppt", t)):
        status, kind, segments, author, editor, found = read(shape)
        assert (status, kind, author, editor, found["created"]) == ("ok", shape, "Ana", "João", "2021-03-04T05:06:07.000Z")
        assert plain(segments, "").replace(" ", "") == want.replace(" ", "")
    status, kind, segments, author, *_ = read("msg")
    assert (status, kind, author) == ("ok", "msg", "Ana")
    assert [label for label, _ in segments] == ["", 'Anexo "resto.txt"']
    assert (segments[0][1].split("\n")[2] + segments[1][1]) == t
    assert read("docx")[:3] == ("encrypted", "encrypted", [])
    assert read("dat")[0] == "unsupported"


def test_rows_of_a_sheet_keep_their_numbers():
    lines = extract.read_file(w.OFFICE["xls"](" ".join(f"w{k}" for k in range(20)), 1), ".xls")[2][0][1].split("\n")
    assert lines[:3] == ["\t".join(f"w{k}" for k in r) for r in (range(8), range(8, 16), range(16, 20))]
    assert lines[3:] == ["", "", "1.5\t42\t7\t12.34", "fim"]


def test_a_container_beyond_the_header_table():
    """More sectors of the allocation table than the header lists."""
    body = bytes(range(256)) * 32_000
    c = compound.Container(w.compound({"big": body, "small": b"x" * 100, "a/b/c": b"deep" * 5}, 3))
    assert c.read("big") == body and c.read("small") == b"x" * 100 and c.read("a/b/c") == b"deep" * 5 and c.read("none") == b""


def test_encrypted_documents():
    doc = w.word("secret")
    doc["WordDocument"] = doc["WordDocument"][:10] + struct.pack("<H", 0x0300) + doc["WordDocument"][12:]
    book = w.workbook("secret")
    book["Workbook"] = book["Workbook"][:20] + struct.pack("<HH", 0x2F, 4) + bytes(4) + book["Workbook"][20:]
    for streams, ext in ((doc, ".doc"), (book, ".xls"), (w.slides("x") | {"EncryptedSummary": b"x"}, ".ppt")):
        assert extract.read_file(w.compound(streams), ext)[0] == "encrypted"


def test_older_and_broken_streams_give_their_runs():
    t = "plain words here"
    for streams in ({"WordDocument": (b"\xdb\xa5" + bytes(700) + t.encode()).ljust(5000, b"\0")}, {"Workbook": struct.pack("<HHH", 0x809, 4, 0x500) + bytes(40) + t.encode() + bytes(5000)}):
        status, _, segments, *_ = extract.read_file(w.compound(streams), ".doc")
        assert status == "ok" and t in segments[0][1]


def test_chains_in_circles_end():
    data = bytearray(w.OFFICE["doc"](prose(300), 4))
    table = struct.unpack_from("<I", data, 76)[0]
    for k in range(20):
        struct.pack_into("<I", data, (table + 1) * 512 + 4 * k, k)
    began = time.time()
    extract.read_file(bytes(data), ".doc")
    assert time.time() - began < 5


def test_fields():
    c = compound.Container(w.compound(w.word('before \x13 TOC \x13 inner \x14x\x15 \x14shown \x13 PAGE \x147\x15 end\x15 after')))
    assert compound.word_text(c).strip() == "before shown 7 end after"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_pages(packed):
    a, b = prose(90, 2) + " (one) back\\slash", prose(60, 3) + " ₤ ł"
    data = w.pdf_file(a, b, packed=packed)
    status, kind, segments, author, _, found = extract.read_file(data, ".pdf")
    assert (status, kind, author, found["created"], found["application"]) == ("ok", "pdf", "Ana", "2021-03-04T08:06:07.000Z", "none")
    assert [(label, re.sub(r"\s+", " ", t)) for label, t in segments] == [("Página 1", a), ("Página 2", b)]
    assert segments[0][1].count("\n") == len(a.split()) // 9 - (len(a.split()) % 9 == 0)
    lost = data.replace(b"startxref", b"startxxxx")
    assert extract.read_file(lost, ".pdf")[2] == segments


def test_pdf_encodings():
    assert [pdf.glyph(n) for n in ("A", "eacute", "uni20AC", "germandbls", "comma", "odieresis", "nosuchglyph")] == ["A", "é", "€", "ß", ",", "ö", ""]
    font = pdf.Font(pdf.Document(b""), {"Subtype": pdf.Name("Type1"), "Encoding": {"Differences": [65, pdf.Name("eacute"), pdf.Name("f_i")], "BaseEncoding": pdf.Name("WinAnsiEncoding")}})
    assert font.text(b"A\xe7") == "éç"
    ranges = pdf.Font(pdf.Document(b""), {"Subtype": pdf.Name("Type0")})
    ranges._read_map(b"1 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 2 beginbfrange <01> <03> <0041> <8001> <8002> [<00660069> <D83DDE00>] endbfrange")
    assert ranges.text(b"\x01\x80\x01\x03\x80\x02") == "AfiC😀"


def test_pdf_limits(monkeypatch):
    data = w.pdf_file(prose(300, 5), prose(300, 6), packed=False)
    assert pdf.pages(data, seconds=-1.0)[0] == "partial"
    status, segments, _ = pdf.pages(data, most=10)
    assert status == "partial" and len(segments) == 1
    monkeypatch.setattr(pdf, "MAX_ALL", 50)
    assert extract.read_file(data, ".pdf")[0] == "error"


def test_pdf_deep_and_circular():
    deep = b"%PDF-1.4\n1 0 obj " + b"[" * 5000 + b"]" * 5000 + b" endobj 2 0 obj << /Type /Catalog /Pages 3 0 R >> endobj 3 0 obj << /Kids [ 3 0 R 3 0 R ] >> endobj"
    began = time.time()
    assert extract.read_file(deep, ".pdf")[2] == []
    assert time.time() - began < 5


@pytest.mark.parametrize("shape", [*w.SHAPES, "pdf", "packed", "zip"])
def test_damaged_files_are_rows(shape):
    """Bytes changed and cut at random: a status, never an exception, in bounded time."""
    t = prose(200, 7)
    data = w.pdf_file(t[:600], t[600:], packed=shape == "packed") if shape in ("pdf", "packed") else w.zip_of_names([t[:30], "b"], "cp850") if shape == "zip" else w.OFFICE[shape](t, 2)
    rng = random.Random(11)
    for _ in range(40):
        raw = bytearray(data)
        for _ in range(rng.randint(1, 60)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        began = time.time()
        status = extract.read_file(bytes(raw[: rng.randint(len(raw) // 3, len(raw))]), f".{shape}")[0]
        assert status in {"ok", "partial", "encrypted", "unsupported", "error", "other"}
        assert time.time() - began < 10


def test_zip_limits(monkeypatch):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w:p><w:t>" + "x" * 5000 + "</w:t></w:p>")
        z.writestr("word/footnotes.xml", "<w:p><w:t>note</w:t></w:p>")
    monkeypatch.setattr(extract, "MAX_TOTAL", 1000)
    status, _, segments, *_ = extract.read_file(out.getvalue(), ".docx")
    assert status == "partial" and plain(segments) == "note"


def test_office_open_and_sheets():
    import io
    import zipfile

    def zipped(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels", ".rels"), body)
        return out.getvalue()

    ods = zipped(mimetype="application/vnd.oasis.opendocument.spreadsheet", content_xml='<table:table table:name="A&amp;B"><table:table-row><table:table-cell><text:p>a</text:p><text:p>b</text:p></table:table-cell><table:table-cell><text:p>c<text:s text:c="3"/>d</text:p></table:table-cell></table:table-row><table:table-row table:number-rows-repeated="3"/><table:table-row><table:table-cell><text:p>e</text:p></table:table-cell></table:table-row></table:table>')
    assert extract.read_file(ods, ".ods")[2] == [('Planilha "A&B"', "a b\tc   d\n\n\n\ne\n")]
    sheet = '<row r="1"><c t="inlineStr"><is><t>one</t><rPh><t>no</t></rPh><t> two</t></is></c><c t="b"><v>1</v></c><c><v>3</v></c></row><row r="4"><c t="s"><v>0</v></c></row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<sheet name="First" r:id="r2"/><sheet name="Gone" r:id="r9"/>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationship Id="r2" Type="x/worksheet" Target="worksheets/odd.xml"/>')
        z.writestr("xl/worksheets/odd.xml", sheet)
        z.writestr("xl/sharedStrings.xml", "<sst><si><r><t>sh</t></r><r><t xml:space='preserve'>ared</t></r></si></sst>")
        z.writestr("docProps/core.xml", "<dc:creator>Ana</dc:creator><cp:lastModifiedBy>Rui</cp:lastModifiedBy><dcterms:modified xsi:type='x'>2020-01-02T03:04:05Z</dcterms:modified>")
    status, _, segments, author, editor, found = extract.read_file(out.getvalue(), ".xlsx")
    assert (status, segments, author, editor, found["modified"]) == ("ok", [('Planilha "First"', "one two\t3\n\n\nshared")], "Ana", "Rui", "2020-01-02T03:04:05Z")


def test_rules():
    by = lambda x: markup.tidy(markup.by_rules(x, markup.WORD))
    assert by("<w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr>") == "a\tb\n"
    assert by("</w:t></mc:Fallback><w:t>a<w:t>b</w:t>c</w:t>d") == "abc"
    assert by("<mc:Fallback><w:t>x</mc:Fallback><w:t>y</w:t>") == "y"
    began = time.time()
    by("<" * 200_000 + "<w:t>" * 100_000)
    assert time.time() - began < 5


def test_predictors():
    rows = [bytes(random.Random(k).randrange(256) for k in range(r * 9, r * 9 + 9)) for r in range(5)]
    coded, above = b"", bytes(9)
    for kind, row in enumerate(rows):
        near = lambda a, b, c: min((a, b, c), key=lambda v: abs(a + b - c - v))
        coded += bytes([kind])
        for k in range(9):
            left, up, corner = (row[k - 3] if k >= 3 else 0), above[k], (above[k - 3] if k >= 3 else 0)
            coded += bytes([(row[k] - (0, left, up, (left + up) // 2, near(left, up, corner))[kind]) & 255])
        above = row
    s = pdf.Stream({"Filter": pdf.Name("FlateDecode"), "DecodeParms": {"Predictor": 15, "Columns": 3, "Colors": 3}})
    s.raw = zlib.compress(coded)
    assert pdf.Document(b"").decoded(s) == b"".join(rows)


def test_nested_messages_and_single_pass(spark):
    """Attached messages are read without being written and parsed again; contents that Python makes are made once a row."""
    from pyspark.sql import functions as F

    from sievefold.plans import office_files
    from sievefold.sources import extract

    parsed = []
    real, extract.email.message_from_bytes = extract.email.message_from_bytes, lambda *a, **k: parsed.append(1) or real(*a, **k)
    try:
        status, _, segments, *_ = extract.read_file(office_files.attached("some text", 2), ".eml")
    finally:
        extract.email.message_from_bytes = real
    assert status == "ok" and ("f.docx", "some text") in [(a, t.strip()) for a, t in segments] and len(parsed) == 1

    made = spark.createDataFrame([(1, "abc")], "id long, t string").select("id", F.lit("f.eml").alias("name"), office_files.attached_of("t", F.lit(1)).alias("content"))
    done = extract.extract(made.withColumn("size", F.length("content").cast("long")))
    assert done._jdf.queryExecution().executedPlan().toString().count("attached_of") <= 2  # the node's function and its output
    assert [s.text.strip() for s in done.first().segments if s.label == "f.docx"] == ["abc"]


def test_one_worker_to_a_task_and_small_batches(spark):
    """Texts, markup and files of all kinds are read by one helper, whose results leave in small batches."""
    import pyarrow as pa
    from pyspark.sql.types import StringType

    from sievefold.sources import batches

    files = {"a.txt": "ação é".encode("cp1252") + b"\x81\x80", "b.html": "<p>&copy; &lt;&#8364;</p>".encode(), "c.html": b"<b>x &amp; y</b>", "d.rtf": rb"{\rtf1 abc}"}
    df = spark.createDataFrame([(n, len(b), bytearray(b)) for n, b in files.items()], "name string, size long, content binary")
    done = extract.extract(df)
    assert done._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.name: r.segments[0].text.strip() for r in done.collect()} == {"a.txt": "ação é�€", "b.html": "© <€", "c.html": "x & y", "d.rtf": "abc"}

    texts = pa.array(["x" * 300_000] * 9 + [None])
    made = list(batches.made(lambda t: t.upper(), [(texts,)], StringType()))
    assert [len(a) for a in made] == [4, 4, 2] and pa.concat_arrays(made).to_pylist() == ["X" * 300_000] * 9 + [None]


def test_streams_of_files_that_are_made_once(spark):
    from pyspark.sql import functions as F

    made = spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string").select("id", w.office_file(F.when(F.col("t").isNotNull(), "dat"), "t", "id").alias("content"))
    found = compound.streams(made)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2  # made, and read
    assert sorted((r.id, r.path, bytes(r.stream)) for r in found.collect()) == [(1, "Box/Inner/Deep", b"abc"), (1, "Contents", b"abc")]


@pytest.mark.parametrize(("name", "nodes"), [("x15_extraction", 1), ("x10_office_files", 2), ("x11_pdf_pages", 2)])
def test_texts_go_through_one_worker(spark, sf, name, nodes):
    """One for the reader, and one where a query makes its files."""
    from sievefold.plans import catalog

    catalog.load()
    assert catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == nodes


def test_long_lists_of_strings_are_decoded_together(monkeypatch):
    """A page costs no call for each of its words; gaps, codes without a character and strings that aren't of that kind are read as one by one."""
    calls = []
    real = pdf.Font.text
    monkeypatch.setattr(pdf.Font, "text", lambda self, raw: calls.append(1) or real(self, raw))
    a, b = prose(900, 2), prose(900, 3)
    _, segments, _ = pdf.pages(w.pdf_file(a, b, packed=False))
    assert [re.sub(r"\s+", " ", t) for _, t in segments] == [a, b] and len(calls) <= 101  # the lines of the first page

    font = pdf.Font(pdf.Document(b""), {"Subtype": pdf.Name("Type0")})
    font._read_map(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 4 beginbfchar <0003> <0061> <0004> <0062> <0005> <0020> <D800> <00E9> endbfchar")
    rng = random.Random(3)
    words = [b"<0003>", b"<0004>", b"<0005>", b"<>", b"<0009>", b"<D8000003>", b"-400", b"-201.5", b"-3", b"+7"]
    for k in range(300):
        raw = b" ".join(rng.choice(words + [b"<DFFF>"] * (k % 10 == 0) + [b"<003>"] * (k % 10 == 1) + [b"(\\0\\3)"] * (k % 10 == 2)) for _ in range(rng.randint(1, 40)))
        together, one_by_one = pdf.PageText(None, 1), pdf.PageText(None, 1)
        for page in (together, one_by_one):
            page.put(rng.choice(("", "x", "x ")) if page is together else "".join(together.out), 1.0)
            page.gap = k % 2 == 0
        together.show_flat(font, raw, 1.0)
        one_by_one.show_all(font, pdf.Reader(raw + b"]")._list(0), 1.0)
        assert ("".join(together.out), together.gap, together.shown) == ("".join(one_by_one.out), one_by_one.gap, one_by_one.shown)


def test_texts_of_pages_are_cleaned_once(spark, sf):
    """One search for the text that goes into a file, after the texts are dealt out."""
    from sievefold.plans import catalog

    catalog.load()
    plan = catalog.QUERIES["x11_pdf_pages"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") == 3 and plan.count("a-zA-Z") == 0  # the class stands three times in one search
    assert "RepartitionByExpression" in plan  # a table that is one block of rows isn't one task's work
