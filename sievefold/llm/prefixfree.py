"""Operator 7: repeated 200-byte strings by prefix-free parsing.

A rolling hash of TRIGGER bytes runs over every document. In each window of LENGTH bytes the smallest
hash, the rightmost of equals, is the window's trigger; as it hangs on the window's bytes alone, equal
windows anywhere have their trigger at the same place. Consecutive windows of one trigger form a
phrase; phrases overlap by LENGTH - 1 bytes, so that the windows of a document are dealt out among its
phrases exactly once. The corpus is then a dictionary of distinct phrases and a parse, the list of
their occurrences. The question asks of corpus order only which suffixes share LENGTH bytes, and no window leaves its
phrase. So of the parse's order the number of a phrase's occurrences is enough, and the dictionary's suffixes have
to be sorted by LENGTH bytes only, within a trigger and a distance from it:

* a phrase that the parse holds twice repeats in all its windows;
* else a window can only equal one of another dictionary phrase with the same trigger, and aligned on
  it. Those few phrases are brought together by ranges of triggers. Karp-Rabin hashes leave out suffixes that equal no
  other; the rest are sorted by their bytes into the suffix array of the range, and neighbours in it that share LENGTH
  bytes repeat.

Phrases are named by two 64-bit hashes (of the trigger and of all bytes), documents by id and a 64-bit hash of id and
text; rows equal in both are removed alike, and count as occurrences of their own. Null texts count as
empty; very long texts are parsed in overlapping pieces; an empty table gives an empty result; other columns are not
read. Nothing of a hot phrase is gathered: counting pre-aggregates, joins can be split by Spark, and
triggers with more than GROUP distinct phrases are resolved window by window, by 128-bit hashes, with Spark's own grouping.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

LENGTH = 200
TRIGGER = 32
SPAN = LENGTH - TRIGGER + 1  # places where a window's trigger can stand
CHUNK = 1 << 17  # bytes that are parsed at once
GROUP = 30_000  # distinct phrases of one trigger that one task resolves
_BITS = 20
_rng = np.random.default_rng(20240607)
_T1 = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_T2 = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd bases
_SIZE = CHUNK + 2 * (LENGTH + SPAN)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_P1, _I1 = _powers(_B1, _SIZE + 1), _powers(pow(_B1, -1, 1 << 64), _SIZE + 1)
_P2, _I2 = _powers(_B2, _SIZE + 1), _powers(pow(_B2, -1, 1 << 64), _SIZE + 1)


def _prefix(data: np.ndarray, table: np.ndarray, power: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=out[1:])
    return out


def parse(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of the pieces that lie in data one after another; ends: where each piece ends.

    Returns first window, number of windows, trigger's distance from the first window, trigger hash
    and phrase hash of each phrase.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty, empty
    p1 = _prefix(data, _T1, _P1)
    h = _mix((p1[TRIGGER:] - p1[:-TRIGGER]) * _I1[: n - TRIGGER + 1])
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << _BITS) - 1)
    key = (h & ~low) | (low - place)
    size = 1
    while 2 * size <= SPAN:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < SPAN:
        key = np.minimum(key[: len(key) - (SPAN - size)], key[SPAN - size :])
    trigger = (low - (key & low)).astype(np.int64)
    windows = n - LENGTH + 1
    begins = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(windows + 1, np.int64)
    real = ends - begins >= LENGTH
    np.add.at(inside, begins[real], 1)
    np.add.at(inside, ends[real] - LENGTH + 1, -1)
    valid = np.cumsum(inside[:windows]) > 0
    trigger[~valid] = -1
    starts = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
    counts = np.diff(np.concatenate([starts, [windows]]))
    keep = trigger[starts] >= 0
    starts, counts = starts[keep], counts[keep]
    at = trigger[starts]
    p2 = _prefix(data, _T2, _P2)
    stop = starts + counts + LENGTH - 1
    phrase = _mix((p2[stop] - p2[starts]) * _I2[starts] + _mix(counts.astype(np.uint64)))
    return starts, counts, at - starts, h[at].view(np.int64), phrase.view(np.int64)


def pieces(texts: list[bytes]):
    """Cuts texts into pieces and packs them into arrays of about CHUNK bytes.

    Yields data, ends, and for each piece its text's number, its place in it, and the first and the
    last place (exclusive) at which phrases that count may begin. Pieces of a long text overlap so
    far that every phrase lies whole in the one that it begins in.
    """
    held: list[tuple[bytes, int, int, int, int]] = []
    size = 0

    def out():
        return np.frombuffer(b"".join(x[0] for x in held), np.uint8), np.cumsum([len(x[0]) for x in held]), *(np.array([x[k] for x in held], np.int64) for k in range(1, 5))

    for k, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for begin in range(0, len(text), CHUNK):
            first = max(0, begin - SPAN)
            piece = text[first : begin + CHUNK + SPAN + LENGTH]
            if len(piece) < LENGTH:
                continue
            if held and size + len(piece) > CHUNK:
                yield out()
                held, size = [], 0
            held.append((piece, k, first, begin, begin + CHUNK))
            size += len(piece)
    if held:
        yield out()


def phrases(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of every phrase: its text's number, first window, windows, trigger distance, trigger hash, phrase hash."""
    parts = []
    for data, ends, owner, first, begin, stop in pieces(texts):
        lo, count, off, trig, phrase = parse(data, ends)
        piece = np.searchsorted(ends, lo, side="right")
        at = lo - np.concatenate([[0], ends[:-1]])[piece] + first[piece]
        keep = (at >= begin[piece]) & (at < stop[piece])
        parts.append([x[keep] for x in (owner[piece], at, count, off, trig, phrase)])
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def packed(lo: np.ndarray, count: np.ndarray, off: np.ndarray) -> np.ndarray:
    return lo << 16 | count << 8 | off


def unpacked(place):
    return place >> 16, place >> 8 & 0xFF, place & 0xFF


def _parse_rows(batches):
    for b in batches:
        for part in slices([b], 256, column=2):
            texts = [x or b"" for x in part.column(2).to_pylist()]
            k, lo, count, off, trig, phrase = phrases(texts)
            doc, id_ = (part.column(c).to_numpy(zero_copy_only=False)[k] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, id_, packed(lo, count, off), trig, phrase)], names=["doc", "id", "place", "trig", "phrase"])


def _phrase_bytes(batches):
    """Rows with text and a document's phrases: each phrase's bytes."""
    for b in batches:
        for part in slices([b], 256, column=2):
            rows = part.to_pylist()
            out = [(r["doc"], r["id"], x["place"], x["trig"], x["n"], r["body"][(lo := x["place"] >> 16) : lo + (x["place"] >> 8 & 0xFF) + LENGTH - 1]) for r in rows for x in r["wanted"]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((*[pa.int64()] * 5, pa.binary()))], names=["doc", "id", "place", "trig", "n", "bytes"])


WIDTH = LENGTH + 2 * SPAN


def aligned(body: list[bytes], off: np.ndarray) -> np.ndarray:
    """Phrases laid out so that their triggers stand in one column."""
    m = np.zeros((len(off), WIDTH), np.uint8)
    for k, (x, o) in enumerate(zip(body, off, strict=True)):
        m[k, SPAN - 1 - o : SPAN - 1 - o + len(x)] = np.frombuffer(x, np.uint8)
    return m


def prefix_hashes(m: np.ndarray, table: np.ndarray = _T2, power: np.ndarray = _P2) -> np.ndarray:
    out = np.zeros((len(m), WIDTH + 1), np.uint64)
    np.cumsum(table[m] * power[:WIDTH], axis=1, out=out[:, 1:])
    return out


def equal_neighbours(suffixes: np.ndarray) -> np.ndarray:
    """Which rows of (n, LENGTH) bytes equal another: they are sorted, and neighbours compared."""
    text = np.ascontiguousarray(suffixes).view(f"S{LENGTH}").ravel()
    order = np.argsort(text, kind="stable")
    same = text[order][1:] == text[order][:-1]
    out = np.zeros(len(text), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def repeated_windows(trig: np.ndarray, off: np.ndarray, count: np.ndarray, body: list[bytes]) -> np.ndarray:
    """(phrases, SPAN) booleans: window d bytes before the trigger equals one of another phrase here."""
    n = len(off)
    hashes, m = np.zeros((n, SPAN), np.uint64), aligned(body, off)
    for at in range(0, n, 4096):
        rows = slice(at, min(n, at + 4096))
        p = prefix_hashes(m[rows])
        for d in range(SPAN):
            c = SPAN - 1 - d
            hashes[rows, d] = p[:, c + LENGTH] - p[:, c]
    salt = _mix(trig.view(np.uint64))
    out = np.zeros((n, SPAN), bool)
    for d in range(SPAN):
        own = np.flatnonzero((d <= off) & (d > off - count))
        if len(own) < 2:
            continue
        key = _mix(hashes[own, d] ^ salt[own])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(own), bool)
        hit[1:] |= same
        hit[:-1] |= same
        likely = own[order[hit]]
        if len(likely):
            c = SPAN - 1 - d
            out[likely[equal_neighbours(m[likely, c : c + LENGTH])], d] = True
    return out


def intervals(off: int, lo: int, marks: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of a text that the marked windows of a phrase cover."""
    out: list[tuple[int, int]] = []
    for d in np.flatnonzero(marks)[::-1]:
        begin = lo + off - int(d)
        if out and out[-1][1] >= begin:
            out[-1] = (out[-1][0], begin + LENGTH)
        else:
            out.append((begin, begin + LENGTH))
    return out


def _resolve(batches):
    """Rows sorted by trigger; groups of one trigger stay together. Ranges of phrases that occur once."""
    held: list[tuple] = []

    def done(rows):
        doc, id_, place, trig, n = (np.array([r[k] for r in rows], np.int64) for k in range(5))
        lo, count, off = unpacked(place)
        marks = repeated_windows(trig, off, count, [r[5] for r in rows])
        found = [(doc[k], id_[k], s, e) for k in np.flatnonzero(marks.any(axis=1) & (n == 1)) for s, e in intervals(int(off[k]), int(lo[k]), marks[k])]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(4)], names=["doc", "id", "s", "e"])

    for b in batches:
        held += zip(*(b.column(k).to_pylist() for k in range(6)), strict=True)
        if len(held) >= 10_000:
            cut = len(held)
            while cut and held[cut - 1][3] == held[-1][3]:
                cut -= 1
            if cut:
                yield done(held[:cut])
                held = held[cut:]
    if held:
        yield done(held)


def _windows(batches):
    """Window hashes of phrases, one row each: for triggers whose phrases don't fit one task."""
    for b in batches:
        rows = list(zip(*(b.column(k).to_pylist() for k in range(6)), strict=True))
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            doc, id_, place, trig, n = (np.array([r[k] for r in part], np.int64) for k in range(5))
            lo, count, off = unpacked(place)
            m = aligned([r[5] for r in part], off)
            p, p1 = prefix_hashes(m), prefix_hashes(m, _T1, _P1)
            cols = []
            for d in range(SPAN):
                k = np.flatnonzero((d <= off) & (d > off - count))
                c = SPAN - 1 - d
                cols.append((doc[k], id_[k], lo[k] + off[k] - d, trig[k], np.full(len(k), d), *(_mix(x[k, c + LENGTH] - x[k, c]).view(np.int64) for x in (p, p1)), n[k]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*cols, strict=True)], names=["doc", "id", "s", "trig", "d", "h", "h1", "n"])


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _digest(batches):
    for b in batches:
        for part in slices([b], 256, column=1):
            cols = [[], [], [], [], []]
            for doc_id, body, ranges in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                body = body or b""
                spans = merge([(r["s"], r["e"]) for r in ranges or ()])
                kept, last = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(body[last:s])
                    last = e
                kept.update(body[last:])
                for c, v in zip(cols, (doc_id, len(body), sum(e - s for s, e in spans), len(spans), kept.hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(docs: DataFrame, *, group: int = GROUP) -> DataFrame:
    """doc, id, s, e: byte ranges that repeated windows cover, not merged. docs has doc and id (its name) and body (bytes)."""
    rows = docs.select("doc", "id", "body").mapInArrow(_parse_rows, "doc long, id long, place long, trig long, phrase long")
    # as a table, so that the join below has nothing to keep together and Spark may split a hot trigger
    shared = stored(rows.groupBy("trig").agg(F.count("*").alias("k")).where("k > 1").select("trig"), "triggers")
    found = stored(rows.join(shared.hint("shuffle_hash"), "trig"), "parse")
    words = found.groupBy("trig", "phrase").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), F.min_by("id", "doc").alias("id"), F.min_by("place", "doc").alias("place"))
    words = stored(words, "dictionary")
    lo, windows = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255))
    whole = found.join(words.where("n > 1").select("trig", "phrase"), ["trig", "phrase"], "left_semi")
    whole = whole.select("doc", "id", lo.alias("s"), (lo + windows + (LENGTH - 1)).alias("e"))
    # as a table, too: of a hot trigger there may be very many phrases
    sizes = stored(words.groupBy("trig").agg(F.count("*").alias("k")).where("k > 1"), "sizes")

    def with_bytes(which: str) -> DataFrame:
        wanted = words.join(sizes.where(which).select("trig"), "trig").groupBy("doc", "id").agg(F.collect_list(F.struct("place", "trig", "n")).alias("wanted"))
        return docs.join(wanted, ["doc", "id"]).select("doc", "id", "body", "wanted").mapInArrow(_phrase_bytes, "doc long, id long, place long, trig long, n long, bytes binary")

    partial = with_bytes(f"k <= {group}").repartition("trig").sortWithinPartitions("trig").mapInArrow(_resolve, "doc long, id long, s long, e long")
    out = whole.unionByName(partial)
    if sizes.where(f"k > {group}").limit(1).count():
        each = with_bytes(f"k > {group}").mapInArrow(_windows, "doc long, id long, s long, trig long, d long, h long, h1 long, n long")
        again = each.groupBy("trig", "d", "h", "h1").agg(F.count("*").alias("times")).where("times > 1")
        out = out.unionByName(each.where("n = 1").join(again, ["trig", "d", "h", "h1"], "left_semi").select("doc", "id", "s", (F.col("s") + LENGTH).alias("e")))
    return out


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"), F.xxhash64(doc_id, text).alias("doc"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).cast("long").alias("id"))
    ranges = repeated_ranges(own, group=group).groupBy("doc", "id").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return own.join(ranges, ["doc", "id"], "left").select("doc_id", "body", "ranges").mapInArrow(_digest, schema)
