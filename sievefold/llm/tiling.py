"""Operator 8: benchmark decontamination by greedy string tiling with running Karp-Rabin.

Seeds are the hashes of MATCH consecutive words of every test item. A document's seeds are looked up
among them; those found are compared word by word and joined along diagonals to maximal common runs.
For each item the longest run whose words are unmarked on both sides is marked again and again, runs
that lose words being cut to what is left, until none of MATCH words remains. Tiles may come in any
order, so that a reordered passage is still covered. A document is contaminated if the tiles cover at
least COVERAGE of an item's words.

Items are broadcast in blocks of at most BLOCK characters on average, one block after another: a larger set of items
means more passes over the documents, which are then kept in the shared folder between passes; neither broadcasts nor
the driver grow. Documents are neither shuffled nor gathered. Where seeds repeat both in a text and in an item, their
places are paired EXPAND at a time.

Words are as in the other operators (A-Z lower-cased). An item of fewer than MATCH words matches as a whole phrase;
one without words never does. Null texts count as empty, a null coverage doesn't arise; items without id or text are
left out; without items nothing is contaminated. Of items covered alike the one of smallest item_id is reported.
Repeated rows give repeated rows, and an empty table an empty result. Of other columns none is read, whatever its name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, slices, stored, verdicts, words

MATCH, COVERAGE = 5, 0.5
BLOCK = 4_000_000
EXPAND = 2_000_000  # pairs of places of one seed that are held at once
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all runs of MATCH ids."""
    n = len(ids) - MATCH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(MATCH):
        out = out * _BASE + x[k : k + n]
    return out


class Items:
    """A block of test items: their words as numbers, and an index of their seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        self.short: dict[int, dict[bytes, int]] = {}  # words -> phrase -> item of smallest id
        for item, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
            w = words(text)
            if len(w) >= MATCH:
                self.ids.append(item)
                self.words.append(np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int64))
            elif w:
                phrase = np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int64).tobytes()
                self.short.setdefault(len(w), {}).setdefault(phrase, item)
        hashes = [rolling(w) for w in self.words]
        seeds = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]

    def runs(self, ids: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """item -> maximal common runs (length, place in item, place in document)."""
        inside = ids >= 0
        if inside.sum() < MATCH or not len(self.seeds):
            return {}
        ok = np.lib.stride_tricks.sliding_window_view(inside, MATCH).all(axis=1)
        at = np.flatnonzero(ok)
        if not len(at):
            return {}
        h = rolling(ids)[at]
        lo = np.searchsorted(self.seeds, h, side="left")
        hit = self.seeds[np.minimum(lo, len(self.seeds) - 1)] == h
        at, h, lo = at[hit], h[hit], lo[hit]
        if not len(at):
            return {}
        count = np.searchsorted(self.seeds, h, side="right") - lo
        total = np.cumsum(count)
        open_: dict[tuple[int, int], tuple[int, int]] = {}  # (item, diagonal) -> first and next place in the document
        found: list[tuple[int, int, int, int]] = []
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + EXPAND, side="right")))
            part = slice(begin, end)
            n = count[part]
            which = np.repeat(lo[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            i, item, j = np.repeat(at[part], n), self.owner[which], self.place[which]
            order = np.lexsort((i, i - j, item))
            i, item, j = i[order], item[order], j[order]
            new = np.ones(len(i), bool)
            new[1:] = (item[1:] != item[:-1]) | (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
            starts = np.flatnonzero(new)
            for s, size in zip(starts.tolist(), np.diff(np.concatenate([starts, [len(i)]])).tolist(), strict=True):
                key, first = (int(item[s]), int(i[s] - j[s])), int(i[s])
                before = open_.get(key)
                if before and before[1] == first:  # it goes on from the last part
                    open_[key] = (before[0], first + size)
                else:
                    if before:
                        found.append((*key, *before))
                    open_[key] = (first, first + size)
            begin = end
        found += [(*k, *v) for k, v in open_.items()]
        out: dict[int, list[tuple[int, int, int]]] = {}
        for t, diagonal, first, following in found:
            n, a = following - first + MATCH - 1, first - diagonal
            if (self.words[t][a : a + n] == ids[first : first + n]).all():  # hashes may collide
                out.setdefault(t, []).append((n, a, first))
        return out

    def phrase(self, ids: np.ndarray) -> int | None:
        """The item of smallest id among short ones that stand whole in the document."""
        best = None
        for size, known in self.short.items():
            if len(ids) >= size:
                windows = np.lib.stride_tricks.sliding_window_view(ids, size)
                hits = {known.get(w.tobytes()) for w in windows[(windows >= 0).all(axis=1)]} - {None}
                best = min([*hits, *([] if best is None else [best])], default=None)
        return best


def tile(runs: list[tuple[int, int, int]], size: int) -> tuple[int, int]:
    """Greedy tiling: words of the item covered, and tiles. size: the item's words."""
    heap = [(-n, a, b) for n, a, b in runs]
    heapq.heapify(heap)
    in_item = bytearray(size)
    in_doc: set[int] = set()
    covered = tiles = 0
    while heap and size - covered >= 1:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [not in_item[a + k] and b + k not in in_doc for k in range(n)]
        if all(free):
            for k in range(n):
                in_item[a + k] = 1
                in_doc.add(b + k)
            covered += n
            tiles += 1
            continue
        k = 0
        while k < n:  # what is left of the run, in pieces
            if free[k]:
                e = k
                while e < n and free[e]:
                    e += 1
                if e - k >= MATCH:
                    heapq.heappush(heap, (-(e - k), a + k, b + k))
                k = e
            else:
                k += 1
    return covered, tiles


def best_item(text: str | None, items: Items) -> tuple[int | None, float, int]:
    """Item covered most, its coverage and tiles."""
    number = items.number
    ids = np.array([number.get(w, -1) for w in words(text)], np.int64)
    best: tuple[int | None, float, int] = (None, 0.0, 0)
    for t, runs in sorted(items.runs(ids).items()):
        size = len(items.words[t])
        covered, tiles = tile(runs, size)
        if covered / size > best[1]:
            best = (items.ids[t], covered / size, tiles)
    whole = items.phrase(ids) if items.short else None
    if whole is not None and (best[1] < 1 or whole < best[0]):
        best = (whole, 1.0, 1)
    return best


def blocks_of(spark: SparkSession, benchmark: DataFrame, block: int) -> Iterator[tuple[Broadcast, bool]]:
    """The items, broadcast block by block, each of a size that is checked before; and whether it is the last."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        yield spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()]), k == blocks - 1


def contamination(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, item_id (null without a match), coverage, n_tiles and contaminated of every row of docs."""
    state = "item_id long, coverage double, n_tiles int"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"), F.lit(0).alias("n_tiles"))
    for shared, last in blocks_of(docs.sparkSession, benchmark, block):
        rows = rows.mapInArrow(_pass(shared, last), "doc_id long, " + "text string, " * (not last) + state)
        if not last:
            rows = stored(rows, "tiled")
            shared.unpersist()
    return rows.select("doc_id", "item_id", "coverage", "n_tiles", (F.col("coverage") >= coverage).alias("contaminated"))


def _pass(shared, last: bool):
    def run(batches):
        give_back()
        items = Items(shared.value)
        for b in slices(batches, column=1):
            found = []
            for text, *before in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                now = best_item(text, items)
                better = now[1] > before[1] or now[1] == before[1] > 0 and now[0] < before[0]
                found.append(now if better else tuple(before))
            cols = [b.column(0), *([] if last else [b.column(1)]), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int32())))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *([] if last else ["text"]), "item_id", "coverage", "n_tiles"])

    return run


def _marks(shared: Broadcast, coverage: float):
    @F.arrow_udf("boolean")
    def marked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        items = Items(shared.value)
        for s in texts:
            yield verdicts(s, lambda own: [best_item(x, items)[1] >= coverage for x in own])

    return marked


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """docs without the rows that contamination marks; all columns stay, and nothing is shuffled."""
    for shared, last in blocks_of(docs.sparkSession, benchmark, block):
        docs = docs.where(~_marks(shared, coverage)(F.col("text")))
        if not last:
            docs = stored(docs, "tiled")
            shared.unpersist()
    return docs
