"""Operator 2: token ids as binary files of patched frame-of-reference blocks.

A dataset is a folder of Parquet files with one row per segment: the part (a range of doc_id), the
segment's number and first place in it, the documents' ids and token counts, and a payload. The payload holds blocks
of BLOCK ids: each block subtracts its minimum, keeps the low bits of every offset at the width that
the PERCENTILE of its offsets needs, and lists the rest as exceptions (position, value). A block
index in front (start of each block's words and exceptions) lets a reader decode one block alone; read_ids does.
Spark's writer commits the files, so that a lost executor leaves none half written, on any store.

Payload, little-endian: u32 ids, u32 blocks; per block u32 minimum, u8 width; then for blocks + 1
the u32 starts of words and of exceptions; u32 words; u16 positions and u32 values of exceptions.

The tokenizers library's model encodes. A text's ids are those of the pieces that the tokenizer's pattern cuts it into,
one after another, so that each worker has the library encode a piece once and remembers it.

Null texts count as empty; every document ends with the end id, so that none is empty. Rows of equal doc_id are kept,
ordered by crc32 of their texts, all in one part; a null doc_id comes first. Very long texts make a segment of their own. An empty table
gives an empty folder. Columns other than id and text, whatever their names, are not read.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet, pieces, tokenizer
from .common import new_path, remembered, slices

BLOCK = 1024
LANES = 32  # ids of a block lie in 32 lanes of 32; each lane is packed on its own
PERCENTILE = 0.9
SEGMENT = 1 << 16  # ids of a segment at most, but for one longer document
PART_ROWS = 20_000  # documents of a part, about
MOST_PARTS = 1 << 15  # the driver samples 100 ids for each part's bounds and keeps a sum of each: at 100 TB 3 GB of text a part
KNOWN = 300_000  # pieces that a worker remembers, some 60 MB; the memory is emptied when full
SEGMENT_SCHEMA = "part int, segment int, at long, doc_ids array<long>, counts array<long>, n_ids long, payload binary"


def pack(v: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) values below 2**width as (n, width * LANES) words."""
    n = len(v)
    rows = v.reshape(n, BLOCK // LANES, LANES)
    out = np.zeros((n, width, LANES), np.uint32)
    for r in range(BLOCK // LANES if width else 0):
        word, shift = divmod(r * width, 32)
        out[:, word] |= rows[:, r] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= rows[:, r] >> np.uint32(32 - shift)
    return out.reshape(n, width * LANES)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    w = words.reshape(n, width, LANES)
    out = np.zeros((n, BLOCK // LANES, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for r in range(BLOCK // LANES if width else 0):
        word, shift = divmod(r * width, 32)
        x = w[:, word] >> np.uint32(shift)
        if shift + width > 32:
            x |= w[:, word + 1] << np.uint32(32 - shift)
        out[:, r] = x & mask
    return out.reshape(n, BLOCK)


def encode_payload(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.zeros(blocks * BLOCK, np.uint32)
    v[:n] = ids
    if n:
        v[n:] = ids[n - 1]
    v = v.reshape(blocks, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    off = v - low[:, None]
    at = int(PERCENTILE * (BLOCK - 1))
    chosen = np.partition(off, at, axis=1)[:, at] if blocks else low
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    packed: list[np.ndarray | None] = [None] * blocks
    for w in np.unique(width):
        where = np.flatnonzero(width == w)
        rows = pack(off[where] & np.uint32((1 << int(w)) - 1), int(w))
        for k, b in enumerate(where):
            packed[b] = rows[k]
    over_b, over_p = np.nonzero(off >> width[:, None].astype(np.uint32))
    words_at = np.concatenate([[0], np.cumsum(width.astype(np.uint32) * LANES)]).astype("<u4")
    over_at = np.concatenate([[0], np.cumsum(np.bincount(over_b, minlength=blocks))]).astype("<u4")
    words = np.concatenate(packed).astype("<u4") if blocks else np.zeros(0, "<u4")
    return b"".join(x.tobytes() for x in (np.array([n, blocks], "<u4"), low.astype("<u4"), width, words_at, over_at, words, over_p.astype("<u2"), off[over_b, over_p].astype("<u4")))


def decode_range(payload: bytes, first: int, last: int) -> np.ndarray:
    """Ids first to last (exclusive) of a payload; only the blocks that hold them are unpacked."""
    n, blocks = (int(x) for x in np.frombuffer(payload, "<u4", 2))
    first, last = max(0, first), min(n, last)
    if first >= last:
        return np.zeros(0, np.uint32)
    low_at = 8
    width_at = low_at + 4 * blocks
    index_at = width_at + blocks
    words_at = np.frombuffer(payload, "<u4", blocks + 1, index_at)
    over_at = np.frombuffer(payload, "<u4", blocks + 1, index_at + 4 * (blocks + 1))
    data_at = index_at + 8 * (blocks + 1)
    positions_at = data_at + 4 * int(words_at[-1])
    values_at = positions_at + 2 * int(over_at[-1])
    b0, b1 = first // BLOCK, -(-last // BLOCK)
    low = np.frombuffer(payload, "<u4", b1 - b0, low_at + 4 * b0)
    width = np.frombuffer(payload, "u1", b1 - b0, width_at + b0)
    begin, end = int(words_at[b0]), int(words_at[b1])
    words = np.frombuffer(payload, "<u4", end - begin, data_at + 4 * begin)
    off = np.zeros((b1 - b0, BLOCK), np.uint32)
    for w in np.unique(width):
        where = np.flatnonzero(width == w)
        index = (words_at[b0 + where] - begin)[:, None] + np.arange(int(w) * LANES, dtype=np.uint32)
        off[where] = unpack(words[index], int(w))
    begin, end = int(over_at[b0]), int(over_at[b1])
    positions = np.frombuffer(payload, "<u2", end - begin, positions_at + 2 * begin)
    values = np.frombuffer(payload, "<u4", end - begin, values_at + 4 * begin)
    off[np.repeat(np.arange(b1 - b0), np.diff(over_at[b0 : b1 + 1])), positions] = values
    return (off + low[:, None]).reshape(-1)[first - b0 * BLOCK : last - b0 * BLOCK]


def decode_payload(payload: bytes) -> np.ndarray:
    return decode_range(payload, 0, int(np.frombuffer(payload, "<u4", 1)[0]))


class Encoder(dict):
    """The tokenizers library's model, with the ids of pieces that it has encoded; a piece is looked up once wherever it stands."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenize = Tokenizer.from_str(content).model.tokenize
        own = tokenizer(content)
        self.split_added, self.added = own.split_added, own.added
        #: the model reads bytes as the printable characters that stand for them
        self.shown = {byte: char for char, byte in byte_alphabet().items()}
        #: pieces that are forgotten after their text
        self.long: list[str] = []

    def __missing__(self, piece: str) -> bytes:
        if piece in self.added:
            ids = [self.added[piece]]
        else:
            ids = [t.id for t in self.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown))]
        made = np.array(ids, "<u4").tobytes() if sys.byteorder != "little" else array("I", ids).tobytes()
        if len(self) >= KNOWN:
            self.clear()
        self[piece] = made
        if len(piece) > 64:
            self.long.append(piece)
        return made

    def _pieces(self, text: str) -> list[str]:
        if self.split_added is None:
            return pieces(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [*pieces(text[at : m.start()]), m.group()]
            at = m.end()
        return out + pieces(text[at:])

    def encode(self, text: str) -> np.ndarray:
        out = np.frombuffer(b"".join(map(self.__getitem__, self._pieces(text))), "<u4")
        while self.long:
            self.pop(self.long.pop(), None)
        return out


_encoders: dict[int, Encoder] = remembered({})


def encoder(content: str) -> Encoder:
    key = hash(content)
    if key not in _encoders:
        _encoders[key] = Encoder(content)
    return _encoders[key]


def _segments(rows, part: int, content: str, end_id: int):
    """rows: (doc_id, text) in order. Yields rows of SEGMENT_SCHEMA."""
    own, end = encoder(content), np.array([end_id], np.uint32)
    segment = at = held = 0
    docs: list[tuple[int, np.ndarray]] = []

    def flush():
        ids = [x for _, x in docs]
        return (part, segment, at, [d for d, _ in docs], [len(x) for x in ids], held, encode_payload(np.concatenate(ids)))

    for doc, text in rows:
        ids = np.concatenate([own.encode(text or ""), end])
        if docs and held + len(ids) > SEGMENT:
            yield flush()
            segment, at, docs, held = segment + 1, at + held, [], 0
        docs.append((doc, ids))
        held += len(ids)
    if docs:
        yield flush()


def write(docs: DataFrame, path: str, content: str, *, end_id: int = 0, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes docs and writes them in ascending doc_id order.

    Parts are ranges of doc_id and, where many rows share one, of their texts' crc32: Spark finds the bounds from a
    sample, sends each text once, and a retried task encodes the same rows to the same segments.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.crc32(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("crc"))
    if parts is None:
        parts = min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_ROWS)))
    shared = spark.sparkContext.broadcast(content)

    def run(batches):
        rows = (r for b in slices(batches, column=1) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        names = [x.split(" ")[0] for x in SEGMENT_SCHEMA.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        for s in _segments(rows, TaskContext.get().partitionId(), shared.value, end_id):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(s, types, strict=True)], names=names)

    order = [F.col("doc_id").asc_nulls_first(), F.col("crc")]
    ids.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, SEGMENT_SCHEMA).write.parquet(path)


def _before(files: DataFrame) -> dict[int, int]:
    """Ids before each part: a sum per part on the driver, of MOST_PARTS parts at most."""
    sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    return dict(zip([p for p, _ in sums], accumulate([0, *(n for _, n in sums)]), strict=False))


def read_ids(spark, path: str, first: int, last: int) -> DataFrame:
    """start and ids of the stretches that make up ids first to last (exclusive) of all; only their blocks are decoded."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    before = _before(files)
    parts = [p for p in before if before[p] < last]

    def run(batches):
        for b in slices(batches, 8):
            for part, at, n, payload in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                at += before[part]
                if at < last and at + n > first:
                    ids = decode_range(payload, first - at, last - at)
                    yield pa.RecordBatch.from_arrays([pa.array([max(at, first)], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["start", "ids"])

    return files.where(F.col("part").isin(parts)).select("part", "at", "n_ids", "payload").mapInArrow(run, "start long, ids array<int>")


def read(spark, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids, of every document in the files."""
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    before = _before(files)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        for b in slices(batches, 8):
            for doc_ids, counts, payload, part, at in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                at += before[part]
                ids = decode_payload(payload)
                ends = np.cumsum(counts)
                own = np.split(ids, ends[:-1])
                cols = [pa.array(doc_ids, pa.int64()), pa.array(at + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return files.select("doc_ids", "counts", "payload", "part", "at").mapInArrow(run, schema)


def token_files(docs: DataFrame, content: str, *, path: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs' ids to path (a new folder in the shared one by default) and reads them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    write(docs, path, content, end_id=end_id, doc_id=doc_id, text=text)
    return read(spark, path)
