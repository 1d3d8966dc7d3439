"""Append-only logs of JSON lines: a writer that keeps order and heals a torn end, and pages read by byte offset.

A log is a folder of segments; their names give the order. Each write adds segments in the order of its partitions, and renames
them into place when all are there: a write that fails leaves nothing. Paths are such that workers can open them.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..tables import BROADCAST, stored

CHUNK = 64 << 20  # bytes that one task looks through for line ends
_SEGMENT = re.compile(r"(\d{9})-\d{6}\.ndjson\Z")


def local(path: str) -> str:
    return re.sub("^file:(//)?(?=/)", "", path).rstrip("/")


def segments(path: str) -> list[str]:
    """The segments of a log, in order."""
    root = local(path)
    return [os.path.join(root, n) for n in sorted(os.listdir(root)) if _SEGMENT.search(n)] if os.path.isdir(root) else []


def heal(path: str) -> int | None:
    """Ends the last line of a log, if a write was cut in the middle of it: the offset at which that line starts, or None.

    The broken line stays and is skipped by readers; without its end the next line would be lost with it."""
    found = segments(path)
    size = os.path.getsize(found[-1]) if found else 0
    if not size:
        return None
    with open(found[-1], "r+b") as f:
        f.seek(-1, os.SEEK_END)
        if f.read(1) == b"\n":
            return None
        at = size
        while at:
            start = max(0, at - 65536)
            f.seek(start)
            end = f.read(at - start).rfind(b"\n")
            if end >= 0:
                at = start + end + 1
                break
            at = start
        f.seek(0, os.SEEK_END)
        f.write(b"\n")
        return at


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str


class LogWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = local(path), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        file = os.path.join(self.path, f".{self.run}-{context.partitionId():06}-{context.taskAttemptId()}.part")
        with open(file, "wb") as out:
            for row in iterator:
                out.write(row[0].replace("\n", " ").encode("utf-8", "replace") + b"\n")
        return Written(context.partitionId(), file)

    def commit(self, messages: list[Written | None]) -> None:
        heal(self.path)
        found = segments(self.path)
        number = int(_SEGMENT.search(found[-1])[1]) + 1 if found else 0
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        for m in done:
            os.rename(m.file, os.path.join(self.path, f"{number:09}-{m.partition:06}.ndjson"))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Files of attempts that didn't count."""
        for n in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if n.startswith(f".{self.run}-"):
                os.remove(os.path.join(self.path, n))


class AppendLog(DataSource):
    """spark.dataSource.register(AppendLog); df.write.format("append_log").mode("append").save(path), where df has one column of JSON texts."""

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if len(schema) != 1 or overwrite:
            raise ValueError("a log takes one column of lines, in mode append")
        return LogWriter(self.options["path"])


def append(df: DataFrame, path: str, *order: str) -> None:
    """Adds the rows of df as JSON lines, in an order."""
    df.sparkSession.dataSource.register(AppendLog)
    lines = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    lines.select(F.to_json(F.struct(*df.columns)).alias("value")).write.format("append_log").mode("append").save(path)


def offsets(spark: SparkSession, path: str, *, every: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """A sparse index of a log's lines: file, line (from 0 over all segments), offset, next_line and next_offset; entries are at most every lines apart.

    Every chunk of bytes is looked through in a task of its own; the counts of lines per chunk, a row each, give the numbers.
    """
    pieces = [(n, file, start, min(start + chunk, size)) for n, file in enumerate(segments(path)) for size in [os.path.getsize(file)] for start in range(0, size, chunk)]
    dealt = spark.createDataFrame(pieces, "nth int, file string, start long, stop long").repartition(max(1, min(len(pieces), 10_000)))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for nth, file, start, stop in frame.itertuples(index=False):
                starts = _line_starts(file, start, stop)
                kept = list(range(0, len(starts), every))
                yield pd.DataFrame({"nth": nth, "file": file, "start": start, "lines": len(starts), "own": kept, "offset": [starts[k] for k in kept], "next_own": [min(k + every, len(starts)) for k in kept], "next_offset": [starts[k + every] if k + every < len(starts) else -1 for k in kept]})

    found = stored(dealt.mapInPandas(look, "nth int, file string, start long, lines long, own long, offset long, next_own long, next_offset long"), "lines")
    counts = found.groupBy("nth", "start").agg(F.first("lines").alias("lines"))
    before = Window.orderBy("nth", "start").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("nth", "start", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("first"))  # a row for each chunk
    out = found.join(F.broadcast(firsts) if len(pieces) <= BROADCAST else firsts, ["nth", "start"])
    return stored(out.select("file", (F.col("first") + F.col("own")).alias("line"), "offset", (F.col("first") + F.col("next_own")).alias("next_line"), F.nullif("next_offset", F.lit(-1)).alias("next_offset")), "offsets")


def _line_starts(file: str, start: int, stop: int) -> list[int]:
    """Offsets of the lines that start in [start, stop)."""
    out = []
    with open(file, "rb") as f:
        f.seek(max(0, start - 1))
        at = start
        if start and f.read(1) != b"\n":
            at += len(f.readline())
        while at < stop:
            line = f.readline()
            if not line:
                break
            out.append(at)
            at += len(line)
    return out


def pages(index: DataFrame, wanted: DataFrame, *, every: int = 1000) -> DataFrame:
    """page, line, value and bytes (read for that part of the page) of the lines of pages. wanted: page, first, last (line numbers, last included).

    Only the stretches of the log that hold a page's lines are opened. A page finds its stretches by numbers of every lines.
    """
    bucket = lambda c: F.floor(F.col(c) / every)
    marks = index.withColumn("_b", F.explode(F.sequence(bucket("line"), F.floor((F.col("next_line") - 1) / every))))
    asked = wanted.where("last >= first").withColumn("_b", F.explode(F.sequence(bucket("first"), bucket("last"))))
    hit = asked.join(marks, "_b").where("line <= last and next_line > first").drop("_b").distinct()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                with open(r.file, "rb") as f:
                    f.seek(r.offset)
                    stretch = f.read(int(r.next_offset) - r.offset) if pd.notna(r.next_offset) else b"".join(f.readline() for _ in range(r.next_line - r.line))
                lines = stretch.split(b"\n")[: r.next_line - r.line]
                kept = [(r.page, r.line + k, x.decode("utf-8", "replace"), len(stretch)) for k, x in enumerate(lines) if r.first <= r.line + k <= r.last]
                yield pd.DataFrame(kept, columns=["page", "line", "value", "bytes"])

    return hit.repartition("page", "file", "offset").mapInPandas(read, "page long, line long, value string, bytes long")
