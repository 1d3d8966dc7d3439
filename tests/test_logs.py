"""The folder source, the append log with its healed end, and pages by byte offset."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sievefold.sources import folders, logs, readers


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def listed(root, exclude=(), levels=2):
    reader = folders.FolderReader(root, list(exclude), levels)
    return [row for part in reader.partitions() for row in reader.read(part)]


@pytest.mark.parametrize("levels", [0, 1, 2, 9])
def test_tree(levels):
    root = folder()
    for path in ("a/b/c/deep.txt", "a/x.txt", "z.txt", "a/b/empty.bin", "$RECYCLE.BIN/no", "k/~$lock", "old/gone.txt", "a/old/kept.txt"):
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write("" if "empty" in path else "text")
    os.symlink(root, f"{root}/a/circle")
    os.symlink(f"{root}/z.txt", f"{root}/a/link.txt")
    os.symlink(f"{root}/nowhere", f"{root}/a/broken")
    rows = listed(root, ["/old", "*.LOG", "a\\old\\nothing"], levels)
    assert len(rows) == len(set(rows))
    files = {r[2]: r[4] for r in rows if r[0] == "file"}
    assert files == {"a/b/c/deep.txt": 4, "a/x.txt": 4, "z.txt": 4, "a/b/empty.bin": 0, "a/link.txt": 4, "a/old/kept.txt": 4}
    assert {r[2] for r in rows if r[0] == "dir"} == {"", "a", "a/b", "a/b/c", "a/old", "k"}
    assert not [r for r in rows if r[0] == "error"]


def test_folders_that_fail_are_rows(monkeypatch):
    root = folder()
    os.makedirs(f"{root}/shut/in")
    os.makedirs(f"{root}/open")
    real = os.scandir

    def scandir(path):
        if str(path).endswith("shut"):
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    for levels in (0, 1, 3):
        rows = listed(root, levels=levels)
        assert [(r[2], r[6]) for r in rows if r[0] == "error"] == [("shut", "PermissionError: Permission denied")]
        assert {r[2] for r in rows if r[0] == "dir"} == {"", "open"}
    assert listed(f"{root}/none")[0][0] == "error"


def test_log_order_and_torn_end(spark):
    path = folder() + "/log"
    df = spark.range(500).select("id", F.concat(F.lit("línea\n"), F.col("id").cast("string")).alias("text")).repartition(7)
    logs.append(df, path, "id")
    assert [json.loads(line)["id"] for p in logs.segments(path) for line in open(p, encoding="utf-8")] == list(range(500))
    last = logs.segments(path)[-1]
    size = os.path.getsize(last)
    with open(last, "rb") as f:
        whole = f.read()
    start = whole[:-1].rfind(b"\n") + 1
    with open(last, "r+b") as f:
        f.truncate(size - 5)
    assert logs.heal(path) == start and logs.heal(path) is None
    logs.append(df.limit(0), path)
    logs.append(spark.range(500, 510).select("id", F.lit("x").alias("text")), path, "id")
    lines = readers.parsed_log(spark.read.text([f"file://{p}" for p in logs.segments(path)]), "id long, text string")
    assert sorted(r.id for r in lines.collect()) == [k for k in range(510) if k != 499]
    assert not [n for n in os.listdir(path) if n.startswith(".") and n.endswith(".part")]


def test_failed_write_leaves_nothing(spark):
    path = folder() + "/log"
    logs.append(spark.range(5), path, "id")

    @F.udf("string")
    def fails(k):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        logs.append(spark.range(50).select(fails("id").alias("id")), path)
    assert sum(len(open(p).readlines()) for p in logs.segments(path)) == 5 and len(os.listdir(path)) == len(logs.segments(path))
    with pytest.raises(Exception):  # noqa: B017
        spark.range(3).selectExpr("id", "id as k").write.format("append_log").mode("append").save(path)


def test_log_is_empty(spark):
    assert logs.segments(folder() + "/none") == [] and logs.heal(folder()) is None


@pytest.mark.parametrize("chunk", [50, 333, 1 << 20])
def test_pages(spark, chunk):
    path, g = folder() + "/log", random.Random(chunk)
    rows = [(k, "é" * g.choice([0, 3, 40, 200])) for k in range(300)]
    logs.append(spark.createDataFrame(rows[:200], "id long, text string"), path, "id")
    logs.append(spark.createDataFrame(rows[200:], "id long, text string"), path, "id")
    index = logs.offsets(spark, path, every=7, chunk=chunk)
    marks = sorted((r.line, r.next_line) for r in index.collect())
    assert marks[0][0] == 0 and marks[-1][1] == 300 and all(a[1] == b[0] and a[1] - a[0] <= 7 for a, b in zip(marks, marks[1:], strict=False))
    wanted = spark.createDataFrame([(0, 0, 9), (1, 195, 205), (2, 299, 400), (3, 50, 50), (4, 9, 3), (5, 1000, 1001)], "page long, first long, last long")
    got = logs.pages(index, wanted, every=7).collect()
    assert sorted((r.page, r.line) for r in got) == [(0, k) for k in range(10)] + [(1, k) for k in range(195, 206)] + [(2, 299), (3, 50)]
    assert all(json.loads(r.value) == {"id": r.line, "text": rows[r.line][1]} for r in got)
    total = sum(os.path.getsize(p) for p in logs.segments(path))
    assert next(r.bytes for r in got if r.page == 3) < total / 10
