"""Operator 10: byte-pair encoding by backtracking, and decoding by an offset table.

Each piece of text (as the tokenizer's pre-tokenizer cuts it) is scanned once by an Aho-Corasick
automaton over all tokens, which gives the longest token at every position. The encoder takes these
greedily, accepts a token only if it is compatible with the one before it, falls back to shorter
tokens, and backtracks where none fits. Two neighbours are compatible if encoding their joined bytes
gives exactly the two; that is decided by undoing merges from the later rank on. Positions proven
dead are never tried again, so that the work is linear in the piece.

Nulls count as empty texts, which have no tokens; ids of an empty list hash as the empty string.
The text of an added token becomes its id, as the tokenizers library does by default. Very long texts are encoded whole,
few at a time. Each row is encoded for itself: repeated rows, and rows of one doc_id, give a row each, and nothing ties.
An empty table gives an empty result; of other columns none is read, and the pipeline's stage gives back none but the contract's.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from .common import give_back, remembered, slices

#: The pattern of the byte-level pre-tokenizer for texts in which only characters stand whose classes every version of Unicode
#: knows alike; other texts are cut by the library itself. Listed classes are looked up faster than \w and \d.
_LETTERS, _OTHERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-я", r"!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷–—‘-„…€"
_FAST = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[{_OTHERS}]+|\s+(?!\S)|\s+")
_UNSAFE = re.compile(rf"[^\t\n\r 0-9{_LETTERS}{_OTHERS}]")
_BYTE_LEVEL = ByteLevel(add_prefix_space=False)
CACHE = 150_000  # pieces that a worker remembers; the memory is emptied when full


def pieces(text: str) -> list[str]:
    if _UNSAFE.search(text):
        return [text[s:e] for _, (s, e) in _BYTE_LEVEL.pre_tokenize_str(text)]
    return _FAST.findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if visible, else 256 + k."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizer:
    """Built from the content of a byte-level BPE vocabulary file; kept once in each worker."""

    def __init__(self, content: str):
        spec = json.loads(content)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: raw(s) for s, i in vocab.items() if s not in self.added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {i: -1 for i in self.bytes_of}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((left, right), k)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), k
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, str] = {}

    @cached_property
    def automaton(self):
        a = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if len(b) == 1 or i in self.parts:
                a.add_word(b.decode("latin-1"), (i, len(b)))
        a.make_automaton()
        return a

    @cached_property
    def shorter(self) -> dict[int, int]:
        """For each token the longest other token that it starts with."""
        by_bytes = {b: i for i, b in self.bytes_of.items() if len(b) == 1 or i in self.parts}
        out = {}
        for b, i in by_bytes.items():
            for n in range(len(b) - 1, 0, -1):
                if b[:n] in by_bytes:
                    out[i] = by_bytes[b[:n]]
                    break
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether left, right is how their joined bytes are encoded: no merge across the seam comes first.

        The two tokens grow from bytes by merges. Going back in time, the one merged last is undone
        first; the neighbours then at the seam must not have had a merge earlier than that undoing.
        """
        known = self.compatible.get((left, right))
        if known is None:
            known = self._fits(left, right)
            if len(self.compatible) >= 2 * CACHE:
                self.compatible.clear()
            self.compatible[left, right] = known
        return known

    def _fits(self, left: int, right: int) -> bool:
        rank, a, b = self.rank, left, right
        limit = float("inf")  # merges of this rank or later did not happen any more at this seam
        while True:
            k = self.pair.get((a, b))
            if k is not None and k < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            # of equal ranks the left one was merged first, so that the right one is undone first
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                # a seam merge of the same rank would have stood further left, and so come first
                limit, b = rb + 1, self.parts[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest: list[int] = [0] * n
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # later ends are longer
        size_of, shorter, fits = self.bytes_of, self.shorter, self.fits
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            while True:
                end = at + len(size_of[token])
                if alive[end] and (last is None or fits(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else 0
                    break
                if token in shorter:
                    token = shorter[token]
                    continue
                alive[at] = 0  # nothing fits here after what stands before
                token = out.pop()
                at -= len(size_of[token])
                break
        return out

    def encoded(self, piece: str) -> str:
        """Decimal ids of a piece, joined by commas."""
        ids = ",".join(map(str, self.encode_piece(piece.encode("utf-8", "surrogatepass"))))
        if len(self.known) >= CACHE:
            self.known.clear()
        if len(piece) <= 64:
            self.known[piece] = ids
        return ids

    def encode_joined(self, text: str) -> str:
        known, encoded = self.known, self.encoded
        if self.split_added is None or not (cuts := list(self.split_added.finditer(text))):
            return ",".join([known.get(p) or encoded(p) for p in pieces(text)])
        out, at = [], 0
        for m in cuts:
            out += [known.get(p) or encoded(p) for p in pieces(text[at : m.start()])]
            out.append(str(self.added[m.group()]))
            at = m.end()
        out += [known.get(p) or encoded(p) for p in pieces(text[at:])]
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return list(map(int, joined.split(","))) if joined else []

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes in one array, with each id's start and length."""
        content = self.bytes_of | {i: s.encode() for s, i in self.added.items()}
        size = np.zeros(max(content) + 1, np.int64)
        for i, b in content.items():
            size[i] = len(b)
        start = np.cumsum(size) - size
        blob = np.frombuffer(b"".join(content.get(i, b"") for i in range(len(size))), np.uint8)
        return blob, start, size

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        blob, start, size = self.table
        n = size[ids]
        where = np.repeat(start[ids] - (np.cumsum(n) - n), n)
        where += np.arange(len(where))
        return blob[where].tobytes().decode("utf-8", "replace")


_built: dict[str, Tokenizer] = remembered({})


def tokenizer(content: str) -> Tokenizer:
    key = hashlib.md5(content.encode()).hexdigest()
    if key not in _built:
        _built[key] = Tokenizer(content)
    return _built[key]


def alone() -> None:
    """Of what a worker remembers, only the tokenizers stay."""
    give_back(_built)


def vocabulary(path: str) -> str:
    """The file's content, read on the driver and broadcast; its size doesn't depend on the corpus."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    Every row gives a row, repeated ids too; other columns of docs are not read.
    """
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        alone()
        t = tokenizer(content.value)
        for b in slices(batches, column=1):
            n, sha, back, all_ids, texts = [], [], [], [], []
            for s in b.column(1).to_pylist():
                joined = t.encode_joined(s or "")
                ids = np.fromstring(joined, np.int64, sep=",") if joined else np.empty(0, np.int64)
                decoded = t.decode(ids)
                n.append(len(ids))
                sha.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
                    texts.append(decoded)
            cols = [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(doc_id, text).mapInArrow(run, schema)
