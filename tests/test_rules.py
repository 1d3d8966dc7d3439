"""Dates, globs, types, folders, calendars, deletion states on literal cases."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from sievefold.functions import dates, filetypes, globs
from sievefold.functions import text as t
from sievefold.functions.html import html_to_text
from sievefold.operators import deletions, enrich, filters, lifecycle, recurrence
from sievefold.operators.recurrence import Rule, RuleError

D = dt.date


def value(spark, column, text="", kind="string"):
    return spark.createDataFrame([(text,)], f"text {kind}").select(column).first()[0]


@pytest.mark.parametrize(("now", "amount", "unit", "want"), [("2026-03-31 10:00:00", 5, "years", "2021-03-31 10:00:00"), ("2026-03-31 10:00:00", 1, "months", "2026-02-28 10:00:00"), ("2026-03-31 10:00:00", 30, "days", "2026-03-01 10:00:00"), ("2028-02-29 00:00:00", 1, "years", "2027-02-28 00:00:00")])
def test_cutoff(spark, now, amount, unit, want):
    c = dates.cutoff(F.lit(now).cast("timestamp"), amount, unit)
    assert value(spark, F.date_format(c, "yyyy-MM-dd HH:mm:ss")) == want


def test_file_date(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    three = (at("2010-01-01"), at("2015-01-01"), at("1980-01-01"))
    assert value(spark, F.year(dates.file_date(*three, "used"))) == 2015
    assert value(spark, F.year(dates.file_date(*three, "modified"))) == 2010
    assert value(spark, dates.file_date(*three, "created")) is None


@pytest.mark.parametrize(("days", "key"), [(364, "ate-1-ano"), (365, "1-2-anos"), (800, "2-5-anos"), (1826, "5-10-anos"), (5000, "mais-10-anos")])
def test_age(spark, days, key):
    assert value(spark, dates.age_bucket(F.lit(days))) == key


@pytest.mark.parametrize(("text", "pattern", "want"), [("RELATÓRIO12.pdf", "relat*rio??.pdf", True), ("b" * 3000 + "a", "*a*b*b*a*", False), ("b" * 3000 + "a", "*b*a", True), ("x%y", "x%y", True), ("xzy", "x%y", False), ("a_b", "a?b", True)])
def test_globs(spark, text, pattern, want):
    assert value(spark, globs.matches_any(F.col("text"), [pattern]), text) is want


@pytest.mark.parametrize(("path", "want"), [("Caixa de Entrada/Pessoal/2020", True), ("Outra/Pessoal", False), ("Arquivo/LIXO Eletrônico/x", True), ("Lixo", False), (None, False)])
def test_mail_folders(spark, path, want):
    assert value(spark, globs.folder_excluded(F.col("text"), ["caixa de entrada/pessoal", "lixo eletronico"]), path) is want


@pytest.mark.parametrize(("name", "want"), [("Férias.MP4", "video"), ("backup.TAR.GZ", "custom"), ("arquivo.gz", None), (".mp3", None), ("x.xyz", "custom")])
def test_types_by_name(spark, name, want):
    found = value(spark, filetypes.type_by_name(F.col("text"), ["audio", "video"], [".xyz", ".tar.gz"]), name)
    assert (found.category if found else None) == want


def mp3_frame():
    return b"\xff\xfb\x90\x00" + b"\x01" * 413


HEADS = [
    (b"%PDF-1.4 text", ("document", "pdf")),
    (b"MZ" + b"\0" * 100, None),
    (b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + b"\0" * 20, ("executable", "windows")),
    ("texto em dois bytes".encode("utf-16-le"), None),
    (mp3_frame() * 2, ("audio", "mp3")),
    (mp3_frame(), None),
    (b"PK\x03\x04" + b"\0" * 22 + struct.pack("<HH", 20, 0) + b"META-INF/MANIFEST.MF", ("executable", "jar")),
    (b"PK\x03\x04" + b"\0" * 22 + struct.pack("<HH", 19, 0) + b"[Content_Types].xml", (None, "ooxml")),
    ((b"G" + b"\1" * 187) * 6, ("video", "mpeg-ts")),
    (b"BZh91AY&SY\0\0", ("archive", "bzip2")),
    (b"\0" * 257 + b"ustar", ("archive", "tar")),
    (b"\0\0\0\x18ftyp3gp5\0\0", ("video", "3gp")),
    (b"\x7fELF\x02\x01\x01\0", ("executable", "elf")),
    (b"BM" + struct.pack("<I", 40) + b"\0" * 34, ("image", "bmp")),
    (b"ab", None),
    (b"", None),
    (None, None),
]


@pytest.mark.parametrize(("head", "want"), HEADS)
def test_signatures(spark, head, want):
    found = value(spark, filetypes.detect_type(F.col("text"), F.lit(40)), head and bytearray(head), "binary")
    assert (tuple(found) if found else None) == want


def test_same_container(spark):
    same = lambda c, f, e: value(spark, filetypes.same_container(F.lit(c), F.lit(f), F.lit(e)))
    assert same("archive", "zip", ".docx") and same("executable", "jar", ".zip") and same("video", "mp4", ".m4a") and same("archive", "tar", ".ova")
    assert not same("executable", "jar", ".docx") and not same("image", "png", ".pdf") and not same("archive", "gzip", ".zip")


def test_html(spark):
    html = "<title>A &ndash; B</title><style>p{x}</style><!-- no --><p>ol&aacute; &#233; &amp;lt; 1 < 2</p><td>a</td><br>b<script>var x</script>"
    assert value(spark, html_to_text(F.col("text")), html).split() == ["A", "–", "B", "olá", "é", "&lt;", "1", "<", "2", "a", "b"]


@pytest.mark.parametrize(("mask", "want"), [("0x10000", "delete"), ("0x6", "write"), ("0x120089", "read"), ("0x40000", "permissions"), ("zz", None)])
def test_access(spark, mask, want):
    assert value(spark, t.access_label(F.col("text")), mask) == want


def test_text_helpers(spark):
    assert value(spark, t.windows_path(F.col("text")), "\\\\?\\UNC\\srv\\Share\\A.txt") == "\\\\srv\\share\\a.txt"
    assert value(spark, t.csv_cell(F.col("text")), "=cmd.xlsx") == "'=cmd.xlsx"
    assert value(spark, t.csv_cell(F.col("text")), 'a"b;c') == '"a""b;c"'
    assert value(spark, t.safe_name(F.col("text")), " Relatório: ação/2024 ") == "Relatorio-acao-2024".lower()
    assert value(spark, t.email_domain(F.col("text")), " Ana@Sub.Empresa.com ") == "sub.empresa.com"
    assert value(spark, t.is_internal(F.col("text"), ["empresa.com"]), "x@mail.empresa.com") is True
    assert value(spark, t.is_internal(F.col("text"), ["empresa.com"]), "x@minhaempresa.com") is False
    assert value(spark, t.is_internal(F.col("text"), []), "x@empresa.com") is False
    assert t.normal_domains("@A.com; b@c.org,a.com ") == ["a.com", "c.org"]
    assert value(spark, t.extension(F.col("text")), ".profile") == ""
    assert value(spark, t.normal_extension(F.col("text")), "*.TAR.GZ") == ".tar.gz"
    assert value(spark, t.normal_extension(F.col("text")), "a b") is None


def test_folders(spark):
    chosen = spark.createDataFrame([("r", "a/b"), ("r", "A\\B\\c"), ("r", "ab"), ("s", ""), ("s", "x")], "repository string, path string")
    assert {(r.repository, r.key) for r in filters.outermost_folders(chosen).collect()} == {("r", "a/b"), ("r", "ab"), ("s", "")}
    files = spark.createDataFrame([(1, "r", "a/b/f"), (2, "r", "a/bc/f"), (3, "r", "a/b"), (4, "s", "x/f")], "id int, repository string, path string")
    assert [r.id for r in filters.in_folders(files, chosen.where("path = 'a/b'")).collect()] == [1]


def test_deletion_is_final(spark):
    log = [(1, "x", "failed"), (2, "x", "deleted"), (3, "x", "missing"), (4, "y", "failed"), (5, "y", "changed"), (6, "z", "deleted"), (7, "z", "deleted")]
    df = spark.createDataFrame(log, "seq int, key string, status string")
    assert {r.key: (r.status, r.seq) for r in deletions.final_states(df, "key").collect()} == {"x": ("deleted", 2), "y": ("changed", 5), "z": ("deleted", 6)}
    assert sorted(r.seq for r in deletions.with_uniqueness(df, "key").where("unique").collect()) == [2, 6]


def test_breakers(spark):
    rows = [(k, 1, "a" if k % 2 else "b", "failed") for k in range(30)]
    df = spark.createDataFrame(rows, "seq int, batch int, folder string, outcome string")
    got = {r.seq: (r.stopped, r.skipped) for r in deletions.breakers(df).collect()}
    assert min(k for k, v in got.items() if v[0]) == 20
    assert min(k for k, v in got.items() if v[1]) == 10


def test_longest_prefix(spark):
    items = spark.createDataFrame([(1, "a/b/c"), (2, "ab/c"), (3, "a/b")], "id int, path string")
    roots = spark.createDataFrame([("a", "A"), ("a/b", "B")], "root string, name string")
    assert {r.id: r.name for r in enrich.longest_prefix(items, roots).collect()} == {1: "B", 2: None, 3: "B"}


def test_batches(spark):
    rows = [(b, k, (k * 37 + b) % 91) for b in range(3) for k in range(200)]
    got = {(r.box, r.id): r.batch for r in lifecycle.batches(spark.createDataFrame(rows, "box int, id long, size long"), "box", most=7, most_bytes=250).collect()}
    for b in range(3):
        n = total = number = 0
        for _, k, size in rows[b * 200 : b * 200 + 200]:
            if n and (n >= 7 or total + size > 250):
                n, total, number = 0, 0, number + 1
            n, total = n + 1, total + size
            assert got[b, k] == number


def at(spark, rule, first, last):
    return [r.at.strftime("%m-%d %H:%M") for r in recurrence.instants(spark, rule, first, last).orderBy("at").collect()]


def test_clock_changes(spark):
    """Local times in New York; rows come back in UTC."""
    rule = Rule("hourly", D(2026, 11, 1), time="00:00", until_time="03:00", zone="America/New_York")
    found = at(spark, rule, D(2026, 11, 1), D(2026, 11, 1))
    assert len(found) == len(set(found)) == 4


@pytest.mark.parametrize("wrong", [{"frequency": "yearly"}, {"time": "25:00"}, {"interval": 0}, {"end": "date"}, {"end": "count", "count": 0}, {"frequency": "weekly", "weekdays": ()}])
def test_rule_errors(wrong):
    with pytest.raises(RuleError):
        Rule(**{"frequency": "daily", "start": D(2026, 1, 1)} | wrong)


def test_counts_and_ends(spark):
    rule = Rule("daily", D(2026, 1, 1), end="count", count=5)
    assert recurrence.upcoming(spark, rule, dt.datetime(2026, 1, 1, 3), 9, remaining=4).count() == 4
    assert recurrence.count_between(spark, Rule("daily", D(2026, 1, 1)), dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 11), cap=1000) == 10
    assert recurrence.upcoming(spark, Rule("once", D(2026, 1, 1)), dt.datetime(2026, 2, 1), 1).count() == 0


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        (Rule("once", D(2026, 9, 25)), "Uma vez, em 25/09/2026 às 02:00"),
        (Rule("daily", D(2026, 1, 1), interval=3, end="date", end_date=D(2026, 12, 31)), "A cada 3 dias, às 02:00, até 31/12/2026"),
        (Rule("weekly", D(2026, 1, 1), weekdays=(1, 4, 6)), "Às segundas e quintas e aos sábados, às 02:00"),
        (Rule("weekly", D(2027, 1, 1), weekdays=(1,)), "Toda segunda-feira, às 02:00, a partir de 01/01/2027"),
        (Rule("monthly", D(2026, 1, 1), monthly_mode="weekday", week_of_month=-1, weekday=5), "Todo mês, na última sexta-feira, às 02:00"),
        (Rule("hourly", D(2026, 1, 1), time="00:00", interval=2, weekdays=(1, 2, 3, 4, 5)), "A cada 2 horas, o dia todo, de segunda a sexta"),
    ],
)
def test_rules_in_words(rule, want):
    from sievefold.functions import describe

    assert describe.rule(rule, today=D(2026, 6, 1)) == want


def test_slow_pattern_ends(spark):
    from sievefold.operators.matching import user_pattern_hits

    docs = spark.createDataFrame([(1, "a" * 40 + "!"), (2, "xaax")], "id long, text string")
    got = {r.id: (r["count"], r.truncated) for r in user_pattern_hits(docs, "t", "(a|aa)+$", seconds=0.2).collect()}
    assert 2 not in got and got.get(1, (0, True))[1]


def test_site_keys(spark):
    from sievefold.operators.clouds import site_key

    for url, want in (("https://T.x/sites/A/Shared%20Documents/b.docx?x=1", "https://t.x/sites/a"), ("https://t.x/", "https://t.x"), ("https://t.x/a/lib/Forms/All.aspx", "https://t.x/a"), ("https://t.x/sites/pages/x", "https://t.x/sites/pages/x"), ("nothing/", "nothing")):
        assert value(spark, site_key(F.col("text")), url) == want


def test_natural_order_of_long_numbers(spark):
    want = ["a", "a0", "a1", "A2", "a10", "a010b", "a" + "9" * 30, "a1" + "0" * 30, "ab2", "b"]
    got = spark.createDataFrame([(w,) for w in reversed(want)], "t string").orderBy(filters.natural_key(F.col("t")), "t").collect()
    assert [r.t for r in got] == want


def test_expired_mail_of_any_age(spark, tmp_path):
    """Messages of large numbers, which are sent before 1980, expire too, as in the SQL."""
    from sievefold.plans import filters as queries

    rows = [(1, 1, "user", "x"), (100_000, 2, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [x.id for x in queries.f14_expired_mail(spark, str(tmp_path)).collect()] == [100_000_002]


def test_repositories_with_the_same_path(spark):
    """Many targets of one path give an item one row on the way, of the smallest id."""
    events = spark.createDataFrame([(3, "local", "C:\\Base\\x.txt", "", None), (3, "mail", "m", "u@x", None)], "scan long, kind string, item string, mailbox string, recorded long")
    targets = spark.createDataFrame([(3, k, "local", "c:/base/") for k in range(9, 3, -1)] + [(3, k, "source", "") for k in (20, 21)], "scan long, id long, type string, path string")
    boxes = spark.createDataFrame([(21, "U@x"), (21, "u@x"), (20, "v@x")], "source long, address string")
    found = deletions.with_repositories(events, targets, boxes)
    assert {(x.kind, x.repository, x.relative_path) for x in found.collect()} == {("local", 4, "x.txt"), ("mail", 21, "")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(" in plan  # paths are told apart before items meet them
