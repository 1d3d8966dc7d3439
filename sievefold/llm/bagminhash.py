"""Operator 6: near duplicates by BagMinHash over weighted word shingles, banding and verification.

A document is a bag: its shingles of five words, each weighted by how often it occurs. For every shingle
the weight axis is cut into blocks [0,1), [1,2), [2,4), [4,8), ...; each block has a Poisson process of
its length as rate, drawn from hashes of shingle and block alone. A point has a time, a signature slot
and a place on the weight axis; it counts for a document if the place lies below the weight. A slot
keeps its earliest point. Two documents then agree in a slot with the probability of their weighted
Jaccard similarity, the sum of smaller weights over the sum of larger ones. Points later than what
fills all slots are not drawn.

Blocks take the place of the hierarchical splitting that
BagMinHash uses to draw the earliest points first: the process is the same, and points that come too
late to count are left out by a time limit.

A slot is kept as 16 bits of its time, four slots make a band of 64 bits, and the bands together are the
signature. Documents of one bag are one node. Nodes that agree in a band meet in a bucket:

* First each is linked to its bucket's smallest node and to the smallest that also agrees in the next
  band; links are verified by exact overlap, and components give classes.
* Then, in each bucket that holds several classes, every member outside its largest class is compared with HEADS
  members of that class, which a hash picks anew for each bucket and turn; signatures choose the likely pairs. Turns
  go on while they find many links.
* Last, in what buckets still hold several classes, all members outside the largest are compared with
  all members of other classes. Blocks of both sides are brought together, first as signatures, then with the
  texts that have a likely partner, so that no task sees a whole bucket and no pair leaves its task but as a link. Pairs that agree in fewer than SCREEN slots are out (for texts that are alike enough that is as unlikely
  as sharing no band); the rest are verified by exact overlap. No pair of different classes in a bucket stays untested.

To verify a unit of pairs (a lead with some members, or two blocks), each of its texts is sent to it once.

Texts of fewer than five words are one shingle. Texts without words, and rows without doc_id, are in
a class of their own. Rows that share a doc_id share a class. Null texts count as empty; very long texts
are sketched whole, few at a time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, if_few, one_of_each, remembered, slices, stored, whole_groups, words
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
SCREEN = 76  # slots that compared signatures have in common at least; at similarity 0.8 it is 102 on average, give or take 4.5
HEADS, BEST = 2, 8  # members of the largest class that others are compared with in a bucket; likeliest of all these pairs that are verified
FOUND = 20  # of so many likely pairs one has to be a link for another turn of heads
STAR, STAR_SIZE = 256, 1 << 18  # members that are verified with one lead in a unit, about, and their shingles
LEFT, RIGHT = 1024, 4096  # members of the two blocks of a unit, about,
LEFT_SIZE, RIGHT_SIZE = 1 << 18, 1 << 19  # and their shingles
FEW = 300_000  # rows of 24 bytes, or signatures, that are broadcast at most
DRAWN = 4096  # points that are drawn at once, if so many blocks aren't left
CACHE = 100_000  # words whose hashes a worker remembers; the memory is emptied when full
_U = np.uint64


class _Hashes(dict):
    """Hashes of words, made when they are first asked for."""

    def __missing__(self, word: str) -> int:
        own = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return own


_known: dict[str, int] = remembered(_Hashes())


def _mix(x: np.ndarray) -> np.ndarray:
    shifted = x >> _U(30)
    x = x ^ shifted
    for factor, shift in ((_U(0xBF58476D1CE4E5B9), _U(27)), (_U(0x94D049BB133111EB), _U(31))):  # in place
        x *= factor
        np.right_shift(x, shift, out=shifted)
        x ^= shifted
    return x


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles, in order."""
    w = words(text)
    if len(_known) > CACHE:
        _known.clear()
    h = np.fromiter(map(_known.__getitem__, w), np.uint64, len(w))
    if not len(w):
        return h
    n = max(1, len(w) - size + 1)
    out = np.full(n, len(w) if len(w) < size else size, np.uint64)
    for k in range(min(size, len(w))):
        out = _mix(out + h[k : k + n])
    return out


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """(bags, slots) times of the earliest points; bags are not empty."""
    sig = np.full((len(bags), slots), np.inf)
    flat = sig.reshape(-1)
    total = np.array([c.sum() for _, c in bags], np.float64)
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    element = np.concatenate([h for h, _ in bags])
    weight = np.concatenate([c for _, c in bags]).astype(np.float64)
    rows = [(doc, element, weight, np.zeros(len(doc)), np.ones(len(doc)))]  # block [low, low + rate)
    low, rate = 1.0, 1.0
    while len(more := np.flatnonzero(weight > low)):
        rows.append((doc[more], element[more], weight[more], np.full(len(more), low), np.full(len(more), rate)))
        low, rate = low + rate, 2 * rate if low > 1 else 2.0
    doc, element, weight, low, rate = (np.concatenate(x) for x in zip(*rows, strict=True))
    seed = _mix(element ^ _mix(low.astype(np.uint64) + _U(0x9E3779B97F4A7C15)))
    todo, limit = np.arange(len(bags)), slots / total * (np.log(slots) + 3)
    while len(todo):
        chosen = np.zeros(len(bags), bool)
        chosen[todo] = True
        at, nth = np.flatnonzero(chosen[doc]), 0
        time = np.zeros(len(at))
        while len(at):
            # a point of each block, or several of few blocks: those of short documents have hundreds
            many = max(1, DRAWN // len(at))
            steps = np.arange(nth + 1, nth + many + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)
            nth += many
            h = _mix(seed[at][:, None] + steps)
            passed = np.log(_uniform(h)) / -rate[at][:, None]
            passed[:, 0] += time
            times = np.cumsum(passed, axis=1, out=passed) if many > 1 else passed
            on = times <= limit[doc[at]][:, None]
            own, h, drawn = (np.repeat(at, many) if many > 1 else at)[on.ravel()], h[on], times[on]
            mark = _mix(h ^ _U(0xA0761D6478BD642F))
            below = low[own] + rate[own] * ((mark >> _U(32)).astype(np.float64) * 2.0**-32) < weight[own]
            place = doc[own] * slots + (mark & _U(0xFFFFFFFF)).astype(np.int64) % slots
            np.minimum.at(flat, place[below], drawn[below])
            at, time = at[on[:, -1]], times[on[:, -1], -1]
        todo = todo[np.isinf(sig[todo]).any(axis=1)]
        limit[todo] *= 2
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """(bags, BANDS): each band's ROWS times, cut to 16 bits each."""
    cut = _mix(sig.view(np.uint64)).astype("<u2")
    return cut.view("<u8").view(np.int64)


def bag_name(own: tuple[np.ndarray, np.ndarray], seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(own[0].tobytes() + own[1].astype(np.int64).tobytes(), seed)


def _sketch(batches):
    give_back(_known)
    for part in slices(batches, 128, column=1):
        bags = [bag(s) for s in part.column(1).to_pylist()]
        full = [k for k, (h, _) in enumerate(bags) if len(h)]
        found = bands(signatures([bags[k] for k in full])) if full else []
        rows: list = [None] * len(bags)
        for k, x in zip(full, found, strict=True):
            rows[k] = x
        names = (pa.array(np.array([bag_name(x, seed) for x in bags], np.uint64).view(np.int64)) for seed in (0, 1))
        cols = [part.column(0).cast(pa.int64()), *names, pa.array([int(c.sum()) for _, c in bags], pa.int64()), pa.array(rows, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "bag1", "bag2", "size", "bands"])
    _known.clear()


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if both else 0.0


def _verify(batches):
    """Rows (unit, node, bag1, text, v, vbag), sorted by unit; a row has a text, or says that node is paired with v: the pairs that overlap enough."""
    give_back(_known)
    for unit in whole_groups(batches, "unit"):
        texts, pairs = unit.filter(pc.is_null(unit.column("v"))), unit.filter(pc.is_valid(unit.column("v")))
        bags = {}
        for part in slices(texts.to_batches(), column=texts.column_names.index("text")):
            for own, text in zip(zip(part.column("node").to_pylist(), part.column("bag1").to_pylist(), strict=True), part.column("text").to_pylist(), strict=True):
                if own not in bags:
                    b = bag(text)
                    if bag_name(b) == own[1] % (1 << 64):  # else a text of the same id with another bag
                        bags[own] = b
        us, ubags, vs, vbags = (pairs.column(c).to_pylist() for c in ("node", "bag1", "v", "vbag"))
        good = [k for k in range(len(us)) if overlap(bags[us[k], ubags[k]], bags[vs[k], vbags[k]]) >= SIMILARITY]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in good], pa.int64()) for x in (us, vs)], names=["u", "v"])
    _known.clear()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v of those of pairs (unit, u, ubag, v, vbag) whose bags overlap enough. A unit has a bounded number of texts."""
    ends = pairs.select("unit", F.col("u").alias("node"), F.col("ubag").alias("bag1")).union(pairs.select("unit", "v", "vbag"))
    needs = stored(ends.distinct(), "needs")
    own = texts.join(if_few(needs, FEW), "node").select("unit", "node", "bag1", "text", F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("vbag"))
    listed = pairs.select("unit", F.col("u").alias("node"), F.col("ubag").alias("bag1"), F.lit(None).cast("string").alias("text"), "v", "vbag")
    rows = own.unionByName(listed).repartition("unit").sortWithinPartitions("unit")
    return stored(rows.mapInArrow(_verify, "u long, v long"), "links")


def _nearest(batches):
    """Members with heads of their bucket's largest class: the pairs that may be alike enough, with the slots that agree."""
    give_back(_known)
    for b in batches:
        table = pa.Table.from_batches([b])
        sig, head = _bands_of(table.column("bands")), _bands_of(table.column("vbands"))
        agree = (sig.view("<u2") == head.view("<u2")).sum(axis=1)
        yield table.select(["unit", "u", "ubag", "v", "vbag"]).append_column("agree", pa.array(agree, pa.int64())).filter(pa.array(agree >= SCREEN)).combine_chunks().to_batches()[0] if (agree >= SCREEN).any() else pa.RecordBatch.from_pylist([], schema=pa.schema([(c, pa.int64()) for c in ("unit", "u", "ubag", "v", "vbag", "agree")]))


@dataclass
class Unit:
    """Members of a bucket in two blocks: side is 1 for those outside its largest class, 2 for those that they are compared with."""

    nth: int
    node: np.ndarray
    bag1: np.ndarray
    size: np.ndarray
    root: np.ndarray
    side: np.ndarray
    sig: np.ndarray  # rows of BANDS

    def take(self, rows: np.ndarray) -> Unit:
        return Unit(self.nth, *(x[rows] for x in (self.node, self.bag1, self.size, self.root, self.side, self.sig)))


def _bands_of(column) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, BANDS) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy().reshape(-1, BANDS)


def _likely(u: Unit):
    """Each left row with the right rows that may be alike enough and belong to this bucket."""
    left, right = np.flatnonzero(u.side == 1), np.flatnonzero(u.side == 2)
    lefts = {(int(u.node[k]), int(u.bag1[k])) for k in left}
    in_left = np.array([(int(u.node[k]), int(u.bag1[k])) in lefts for k in right], bool)
    lanes = u.sig[right].view("<u2")
    for k in left:
        fits = (u.root[right] != u.root[k]) & (np.minimum(u.size[right], u.size[k]) >= SIMILARITY * np.maximum(u.size[right], u.size[k]))
        at = np.flatnonzero(fits & (~in_left | (u.node[right] < u.node[k])))
        at = at[(lanes[at] == u.sig[k].view("<u2")).sum(axis=1) >= SCREEN]
        at = right[at]
        at = at[(u.sig[at] == u.sig[k]).argmax(axis=1) == u.nth]  # a pair belongs to the first bucket that it shares
        if len(at):
            yield k, at


UNIT = ("nth", "key", "i", "j")
PACKED = "nth int, key long, own int, others int, side int, n int, body binary"
MEMBER = "nth int, key long, i int, j int, side int, node long, bag1 long, size long, root long, bands array<long>"


def _pack(batches):
    """Members (nth, key, own, others, side, node, bag1, size, root, bands), sorted by block: a row for each block, its columns as bytes."""
    give_back(_known)
    for block in whole_groups(batches, "nth", "key", "own", "side"):
        columns = [block.column(c).to_numpy().astype("<i8") for c in ("node", "bag1", "size", "root")]
        body = b"".join(c.tobytes() for c in columns) + _bands_of(block.column("bands")).astype("<i8").tobytes()
        row = {c: block.column(c)[0].as_py() for c in ("nth", "key", "own", "others", "side")}
        yield pa.RecordBatch.from_pylist([row | {"n": block.num_rows, "body": body}], schema=pa.schema([("nth", pa.int32()), ("key", pa.int64()), *((c, pa.int32()) for c in ("own", "others", "side", "n")), ("body", pa.binary())]))


def _unpacked(nth: int, side: int, n: int, body: bytes) -> Unit:
    flat = np.frombuffer(body, "<i8")
    columns = [flat[k * n : (k + 1) * n] for k in range(4)]
    return Unit(nth, *columns, np.full(n, side, np.int32), flat[4 * n :].reshape(n, BANDS))


def _screen(batches):
    """Blocks of units, the left one first: the members that have a likely partner in their unit."""
    give_back(_known)
    held: tuple[tuple, Unit] | None = None
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in (*UNIT, "side", "n", "body")), strict=True)
        for *unit, side, n, body in rows:
            own = _unpacked(unit[0], side, n, body)
            if side == 1:
                held = (tuple(unit), own)
                continue
            if held is None or held[0] != tuple(unit):
                continue
            a = held[1]
            both = Unit(a.nth, *(np.concatenate([getattr(a, c), getattr(own, c)]) for c in ("node", "bag1", "size", "root", "side", "sig")))
            wanted = np.zeros(len(both.node), bool)
            for k, at in _likely(both):
                wanted[k] = wanted[at] = True
            if wanted.any():
                out = both.take(wanted)
                n = len(out.node)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(out.sig.reshape(-1)))
                ids = [pa.array(np.full(n, v), kind) for v, kind in zip(unit, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(out.side.astype(np.int32)), *(pa.array(c) for c in (out.node, out.bag1, out.size, out.root)), bands], names=[*UNIT, "side", "node", "bag1", "size", "root", "bands"])


def _links(batches):
    """Rows of units with their texts, sorted: pairs of left and right rows that overlap enough."""
    give_back(_known)
    for unit in whole_groups(batches, *UNIT):
        bags: list = [None] * unit.num_rows
        name, at = unit.column("bag1").to_pylist(), 0
        for part in slices(unit.to_batches(), column=unit.column_names.index("text")):
            for text in part.column("text").to_pylist():
                own = bag(text)
                bags[at] = own if bag_name(own) == name[at] % (1 << 64) else None  # a text of the same id with another bag
                at += 1
        own = np.flatnonzero(np.array([b is not None for b in bags], bool))
        u = Unit(int(unit.column("nth")[0].as_py()), *(unit.column(c).to_numpy() for c in ("node", "bag1", "size", "root", "side")), _bands_of(unit.column("bands"))).take(own)
        node, us, vs = u.node, [], []
        for k, at in _likely(u) if len(own) else ():
            h, c = bags[own[k]]
            others = [bags[own[x]] for x in at]
            all_h, all_c = np.concatenate([o[0] for o in others]), np.concatenate([o[1] for o in others])
            place = np.minimum(np.searchsorted(h, all_h), len(h) - 1)
            both = np.where(h[place] == all_h, np.minimum(c[place], all_c), 0)
            starts = np.cumsum([0] + [len(o[0]) for o in others[:-1]])
            both = np.add.reduceat(both, starts)
            sums = c.sum() + np.add.reduceat(all_c, starts)
            good = at[both >= SIMILARITY * (sums - both)]
            us += [node[k]] * len(good)
            vs += node[good].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
    _known.clear()


def _blocks(rows: Column, size: Column, most: int, most_size: int) -> Column:
    return F.ceil(F.greatest(rows / most, size / most_size)).cast("int")


def _similar_size(a: str, b: str) -> Column:
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _leads(bucket: DataFrame) -> DataFrame:
    """unit, u, ubag, v, vbag: each member with its bucket's smallest, and with the smallest that agrees in the next band, too."""
    closer = bucket.groupBy("nth", "key", "next").agg(F.min_by(F.struct("node", "bag1", "size"), F.struct("node", "bag1")).alias("lead"), F.count("*").alias("k"), F.sum("size").alias("all")).where("k > 1")
    closer = bucket.drop("lead", "k", "all").join(stored(closer, "closer"), ["nth", "key", "next"])
    near = bucket.select(closer.columns).unionByName(closer)
    fits = (F.struct("node", "bag1") != F.struct("lead.node", "lead.bag1")) & _similar_size("size", "lead.size")
    part = F.pmod(F.xxhash64("node", "bag1"), _blocks(F.col("k"), F.col("all"), STAR, STAR_SIZE))
    pairs = near.where(fits).select(F.xxhash64("lead.node", "lead.bag1", part).alias("unit"), F.col("node").alias("u"), F.col("bag1").alias("ubag"), F.col("lead.node").alias("v"), F.col("lead.bag1").alias("vbag"))
    # a unit of a lead has as many members as its bucket gives it; of a pair in several buckets the smallest unit stays
    return stored(pairs.groupBy("u", "ubag", "v", "vbag").agg(F.min("unit").alias("unit")), "pairs")


def _mixed(bucket: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets of several classes, with their class, the bucket's largest class, and the counts of blocks."""
    classes = bucket.select("nth", "key", "node", "bag1", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = stored(classes, "classes")
    each = classes.groupBy("nth", "key", "root").agg(F.count("*").alias("k"), F.sum("size").alias("all"))
    largest = F.struct("k", "root")
    mixed = each.groupBy("nth", "key").agg(F.max_by("root", largest).alias("big"), F.sum("k").alias("k"), F.sum("all").alias("all"), (F.sum("k") - F.max("k")).alias("m"), (F.sum("all") - F.max_by("all", largest)).alias("part"), F.count("*").alias("n")).where("n > 1")
    mixed = mixed.select("nth", "key", "big", _blocks(F.col("m"), F.col("part"), LEFT, LEFT_SIZE).alias("lefts"), _blocks(F.col("k"), F.col("all"), RIGHT, RIGHT_SIZE).alias("rights"))
    rows = stored(classes.join(stored(mixed, "mixed"), ["nth", "key"]), "members")
    return stored(rows.join(if_few(nodes, FEW // 3), ["node", "bag1"]), "members")


def _heads(members: DataFrame, turn: int) -> DataFrame:
    """unit, u, ubag, v, vbag: members outside the largest class of their bucket, with the likeliest of its heads."""
    picks = [F.min_by(F.struct(F.col("node").alias("v"), F.col("bag1").alias("vbag"), F.col("size").alias("vsize"), F.col("bands").alias("vbands")), F.xxhash64("node", F.lit(turn * HEADS + k))) for k in range(HEADS)]
    heads = stored(members.where("root = big").groupBy("nth", "key").agg(F.array_distinct(F.array(*picks)).alias("heads")), "heads")
    rows = members.where("root <> big").join(heads, ["nth", "key"]).withColumn("h", F.explode("heads")).where(_similar_size("size", "h.vsize"))
    unit = F.xxhash64("h.v", "h.vbag", F.pmod(F.xxhash64("node", "bag1"), F.col("lefts") * (LEFT // STAR)))
    rows = rows.select(unit.alias("unit"), F.col("node").alias("u"), F.col("bag1").alias("ubag"), "h.v", "h.vbag", "bands", "h.vbands")
    likely = rows.mapInArrow(_nearest, "unit long, u long, ubag long, v long, vbag long, agree long")
    once = likely.groupBy("u", "ubag", "v", "vbag").agg(F.min("unit").alias("unit"), F.first("agree").alias("agree"))
    best = once.groupBy("u", "ubag").agg(F.slice(F.sort_array(F.collect_list(F.struct("agree", "v", "vbag", "unit")), False), 1, BEST).alias("best"))  # of BANDS * HEADS at most
    best = best.select("u", "ubag", F.explode("best").alias("b"))
    return stored(best.select("b.unit", "u", "ubag", "b.v", "b.vbag"), "pairs")


def _rest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v of all links between different classes in a bucket. Blocks go to their units as one row each."""
    name = F.xxhash64("node", "bag1")
    block = lambda rows, own, others, side: rows.select("nth", "key", F.pmod(name, F.col(own)).cast("int").alias("own"), F.col(others).alias("others"), F.lit(side).alias("side"), "node", "bag1", "size", "root", "bands")
    rows = block(members.where("root <> big"), "lefts", "rights", 1).unionByName(block(members, "rights", "lefts", 2))
    blocks = ("nth", "key", "own", "side")
    packed = stored(rows.repartition(*blocks).sortWithinPartitions(*blocks).mapInArrow(_pack, PACKED), "blocks")
    every = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    left = F.col("side") == 1
    met = every.select("nth", "key", F.when(left, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(left, F.col("other")).otherwise(F.col("own")).alias("j"), "side", "n", "body")
    wanted = stored(met.repartition(*UNIT).sortWithinPartitions(*UNIT, "side").mapInArrow(_screen, MEMBER), "wanted")
    held = texts.join(if_few(stored(wanted.select("node").distinct(), "held")), "node", "left_semi")
    in_units = wanted.join(held, "node").repartition(*UNIT).sortWithinPartitions(*UNIT)
    return stored(in_units.mapInArrow(_links, "u long, v long"), "links")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id) and class_size of every row."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = stored(own.mapInArrow(_sketch, "doc_id long, bag1 long, bag2 long, size long, bands array<long>"), "sketch")
    real = sketch.where("size > 0 and doc_id is not null")
    # as a table, so that the joins with it may be split where one bag has very many copies
    bags = stored(real.groupBy("bag1", "bag2").agg(F.min("doc_id").alias("node")), "bags")
    member = stored(real.select("doc_id", "bag1", "bag2").join(bags, ["bag1", "bag2"]).select("doc_id", "node").distinct(), "nodes")
    first = bags.select(F.col("node").alias("doc_id"), "bag1", "bag2")
    nodes = real.join(first, ["doc_id", "bag1", "bag2"], "left_semi").dropDuplicates(["doc_id", "bag1", "bag2"]).select(F.col("doc_id").alias("node"), "bag1", "size", "bands")
    rows = nodes.select("node", "bag1", "size", F.posexplode("bands").alias("nth", "key"), F.col("bands").alias("b"))
    rows = rows.select("node", "bag1", "size", "nth", "key", F.try_element_at("b", (F.col("nth") + 1) % BANDS + 1).alias("next"))
    shared = rows.groupBy("nth", "key").agg(F.min_by(F.struct("node", "bag1", "size"), F.struct("node", "bag1")).alias("lead"), F.count("*").alias("k"), F.sum("size").alias("all")).where("k > 1")
    bucket = stored(rows.join(stored(shared, "shared"), ["nth", "key"]), "buckets")
    texts = own.where("doc_id is not null").withColumnRenamed("doc_id", "node")
    # documents that share an id share a class
    ids = member.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("u")).where("u <> v").select("u", "v")
    roots = components(_verified(_leads(bucket), texts).unionByName(ids))
    sketches, turn = stored(nodes.select("node", "bag1", "bands"), "sketches"), 0
    while True:
        members = _mixed(bucket, sketches, roots)
        if members.isEmpty():
            break
        likely = _heads(members, turn)
        more = _verified(likely, texts)
        found = more.count()
        roots = _joined(roots, more) if found else roots
        # classes only grow together: a bucket of one class stays one
        bucket, turn = members, turn + 1
        if FOUND * found < likely.count():
            more = _rest(_mixed(bucket, sketches, roots) if found else members, texts)
            roots = roots if more.isEmpty() else _joined(roots, more)
            break
    known = stored(member.join(roots, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("class_id")), "known")
    # as a table, so that the join below may be split where one class is large
    each = stored(sketch.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")), "each")
    sizes = stored(each.where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("class_size")).where("class_size > 1"), "sizes")
    return each.join(sizes, "class_id", "left").select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots after links (u, v) are added: only the classes that they touch are connected anew."""
    name = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = more.join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    top = components(ends).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = top.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return stored(moved.unionByName(alone), "roots")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class stays, the one of smallest doc_id; rows without doc_id stay; all columns stay."""
    gone = near_duplicates(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(if_few(stored(gone, "gone")), docs["doc_id"] == F.col("_gone"), "left_anti")
    return one_of_each(left, "doc_id")
