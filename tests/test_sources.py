"""Readers, extraction, sinks and streams on files that the tests write."""

import datetime as dt
import io
import tempfile
import zipfile
from email.message import EmailMessage
from pathlib import Path

from pyspark.sql import functions as F

from sievefold.sources import extract, readers, sinks, workbooks
from sievefold.streaming import incremental


def folder():
    return Path(tempfile.mkdtemp(prefix="spark-"))


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def message():
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "Olá", "Ana <ana@x.org>", "b@y.org"
    m.set_content("curto")
    m.add_alternative("<p>texto bem mais longo</p>", subtype="html")
    m.add_attachment(b"linha do anexo", maintype="text", subtype="plain", filename="a.txt")
    return m.as_bytes()


FILES = {
    "a.txt": "salário".encode("cp1252"),
    "b.txt": b"\xff\xfe" + "dois bytes".encode("utf-16-le"),
    "c.html": b"<p>um</p><script>x</script>",
    "d.rtf": rb"{\rtf1{\fonttbl Arial}{\info{\author Ana}{\operator Bia}}ol\'e1 " + b"\\" + rb"u8212?mundo\par fim}",
    "e.docx": zipped({"word/document.xml": "<w:p><w:t>par&amp;1</w:t></w:p><w:p><w:r><w:t>do</w:t></w:r><w:r><w:t>is</w:t></w:r></w:p>", "docProps/core.xml": "<dc:creator>Ana</dc:creator><cp:lastModifiedBy>Bia</cp:lastModifiedBy>"}),
    "f.xlsx": zipped({"xl/workbook.xml": '<sheet name="Folha 1" sheetId="1"/>', "xl/sharedStrings.xml": "<sst><si><t>um</t></si></sst>", "xl/worksheets/sheet1.xml": '<row r="1"><c t="s"><v>0</v></c><c><v>2</v></c></row>'}),
    "g.odt": zipped({"mimetype": "x", "content.xml": "<text:p>odf</text:p>"}),
    "h.zip": zipped({"dir/x.bin": "?"}),
    "i.pdf": b"%PDF-1.4 \x00",
    "j.eml": message(),
    "k.docx": b"PK\x03\x04broken",
    "l.txt": b"",
    "m.bin": b"\x00\x01\x02" * 9,
    "n.txt": b"x" * 5000,
}


def test_extraction(spark):
    root = folder()
    for name, data in FILES.items():
        (root / name).write_bytes(data)
    (root / "sub").mkdir()
    (root / "sub" / "~$lock.txt").write_bytes(b"no")
    found = readers.files(spark, str(root), exclude=["~$*"])
    assert {r.relative_path for r in found.select("relative_path").collect()} == set(FILES) - {"l.txt"}
    nothing = spark.createDataFrame([("l.txt", 0, bytearray())], "name string, size long, content binary")
    found = found.select("name", "size", "content").unionByName(nothing)
    got = {r.name: r for r in extract.extract(found, max_bytes=4000).collect()}
    text = {n: "|".join(s.text for s in r.segments) for n, r in got.items()}
    assert len(got) == len(FILES)
    assert {n: r.status for n, r in got.items()} == dict.fromkeys(FILES, "ok") | {"i.pdf": "partial", "k.docx": "error", "l.txt": "empty", "m.bin": "other", "n.txt": "partial"}
    assert text["a.txt"] == "salário" and text["b.txt"] == "dois bytes" and text["c.html"].split() == ["um"] and len(text["n.txt"]) == 4000
    assert text["d.rtf"] == "olá —mundo\nfim" and (got["d.rtf"].author, got["d.rtf"].last_modified_by) == ("Ana", "Bia")
    assert text["e.docx"].split("\n")[:2] == ["par&1", "dois"] and got["e.docx"].last_modified_by == "Bia"
    assert text["f.xlsx"] == "um\t2" and got["f.xlsx"].segments[0].label == 'Planilha "Folha 1"'
    assert text["g.odt"].strip() == "odf" and text["h.zip"] == "dir/x.bin"
    assert [(s.label, s.text.strip()) for s in got["j.eml"].segments] == [("body", "texto bem mais longo"), ("a.txt", "linha do anexo")]
    assert [r.name for r in extract.extract(nothing).collect()] == ["l.txt"]
    assert readers.files(spark, str(root), content=False).columns == ["path", "relative_path", "name", "size", "modified"]


def test_log(spark):
    path = folder() / "log.ndjson"
    good = '{"scanId":"s","recordId":1,"status":"deleted"}'
    path.write_text("\n".join([good, "{broken", '{"scanId":"s","rec' + good, "", good[:-3]]))
    assert [(r.scanId, r.recordId) for r in readers.log(spark, str(path)).collect()] == [("s", 1), ("s", 1)]


def test_term_list(spark):
    root = folder()
    (root / "t.txt").write_text("﻿um\n\n dois \n")
    (root / "t.csv").write_text('"a;b";c\nd,e\nf;g,h\n')
    assert [r["value"] for r in readers.term_list(spark, str(root / "t.txt")).orderBy("seq").collect()] == ["um", "dois"]
    assert [r["value"] for r in readers.term_list(spark, str(root / "t.csv")).orderBy("seq").collect()] == ["a;b", "d", "f"]


def test_sinks(spark):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("=n"), F.col("id").cast("string")).alias("name"), (F.col("id") / 4).alias("x"))
    root = folder()
    sinks.write_csv(df.coalesce(1), str(root / "csv"))
    data = next((root / "csv").glob("part-*")).read_bytes()
    assert data.startswith("﻿id;name;x\r\n0;'=n0;0\r\n1;'=n1;0,25\r\n".encode())
    sinks.append_log(df, str(root / "log"))
    sinks.append_log(df, str(root / "log"))
    assert spark.read.json(str(root / "log")).count() == 2000
    numbered = {r.id: (r.sheet, r.row) for r in sinks.sheet_numbers(df.repartition(7), [F.desc("id")], max_rows=5).collect()}
    assert all(numbered[999 - k] == (k // 4, k % 4 + 1) for k in range(1000))


def test_workbooks(spark):
    root = folder()
    big = spark.range(150_000).select("id", F.concat(F.lit("nome <&> "), F.col("id").cast("string")).alias("texto"), (F.col("id") / 4).alias("valor"))
    workbooks.write_workbooks([("Um", big, [F.asc("id")])], str(root / "big"), "r", max_rows=60_001, sheets=2)
    assert sorted(p.name for p in (root / "big").iterdir()) == ["r-0001.xlsx", "r-0002.xlsx"]
    lines = []
    for p in sorted((root / "big").iterdir()):
        status, _, segments, *_ = extract.read_file(p.read_bytes(), ".xlsx")
        assert status == "ok"
        lines += [(label, line) for label, text in segments for line in text.split("\n")[1:]]
    assert [line for _, line in lines] == [f"{k}\tnome <&> {k}\t{k / 4}" for k in range(150_000)]
    assert {label for label, _ in lines} == {'Planilha "Um"', 'Planilha "Um (2)"', 'Planilha "Um (3)"'}
    odd = spark.createDataFrame([(1, "x" * 40_000, True, float("nan"), ["a", "b"], dt.datetime(2024, 1, 2, 12), None, "ctl\x01\ud7ff")], "n int, t string, b boolean, d double, l array<string>, at timestamp, e string, c string")
    workbooks.write_workbooks([("A/B", odd, []), ("a b", odd, []), ("", odd.limit(0), [])], str(root / "odd"), "r")
    data = (root / "odd" / "r-0001.xlsx").read_bytes()
    segments = extract.read_file(data, ".xlsx")[2]
    assert [label for label, _ in segments] == ['Planilha "A B"', 'Planilha "a b (2)"', 'Planilha "Planilha"']
    cells = segments[0][1].split("\n")[1].split("\t")
    assert cells[0] == "1" and len(cells[1]) == 32_767 and cells[1].endswith("x…") and cells[2:] == ["sim", "a, b", "45293.5", "ctl\ud7ff"]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert 's="2"><v>45293.5' in sheet and '<autoFilter ref="A1:H2"/>' in sheet and 'state="frozen"' in sheet
    assert [workbooks.column_letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_incremental_runs(spark):
    root = folder()
    rows = spark.range(20).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("at"))
    rows.where("id < 10").write.parquet(str(root / "in"))

    def run():
        stream = incremental.changes(spark, str(root / "in"), rows.schema)
        incremental.run_available(incremental.once_each(stream, "id", at="at"), str(root / "out"), str(root / "checkpoint"))
        return spark.read.parquet(str(root / "out")).count()

    assert run() == 10
    rows.where("id >= 8").write.mode("append").parquet(str(root / "in"))
    assert run() == 20
    assert run() == 20


def test_pdf_and_old_office_without_structure():
    import zlib

    page = rb"BT /F1 9 Tf (one \(1\) \341) Tj 0 -12 Td [(tw) -20 (o)] TJ <FEFF00E7> Tj ET"
    doc = b"%PDF-1.4\n1 0 obj <</Author (Ana)>> endobj 2 0 obj <</Filter /FlateDecode>>\nstream\n" + zlib.compress(page) + b"\nendstream endobj 3 0 obj <<>>\nstream\nBT (plain) ' ET\nendstream endobj"
    status, note, segments, author, *_ = extract.read_file(doc, ".pdf")
    assert (status, note, author) == ("partial", "pdf", "Ana")
    assert [t for _, t in segments] == ["one (1) á\ntwoþÿ\0ç", "plain"]
    assert extract.read_file(doc + b"/Encrypt 9 0 R", ".pdf")[0] == "encrypted"
    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1\x00" + b"some text\x00\x01" + "wide text".encode("utf-16-le") + b"\x00\x01"
    assert extract.read_file(ole, ".doc")[:3] == ("partial", "ole", [("", "some text\nwide text")])


def test_utf16_without_a_mark(spark):
    rows = [("le", "wide Text 1".encode("utf-16-le")), ("be", "wide Text 1".encode("utf-16-be")), ("8", "ação".encode()), ("1252", "ação".encode("cp1252")), ("bin", b"\x00\x01\x02\x03" * 9)]
    got = dict(map(tuple, spark.createDataFrame(rows, "k string, b binary").select("k", extract.utf16_guess(F.col("b"))).collect()))
    assert got == {"le": "UTF-16LE", "be": "UTF-16BE", "8": None, "1252": None, "bin": None}
    text = dict(map(tuple, spark.createDataFrame(rows[:4], "k string, b binary").select("k", extract.decode_text(F.col("b"))).collect()))
    assert text == {"le": "wide Text 1", "be": "wide Text 1", "8": "ação", "1252": "ação"}
