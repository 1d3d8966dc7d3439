"""Operator 11: hard negatives by a two-dimensional block matrix product of anchors and rows.

Anchors and rows are dealt into blocks by a hash of their ids, and each block is cut into chunks of dimensions: the
cells of two matrices. As in SUMMA, cell (i, k) of the anchors meets every cell (j, k) of the rows; the product is a
partial tile of scores. Partial tiles of (i, j) are shuffled together and added, and each tile is reduced at once to the
few rows of each anchor that can still be in the result. Scores leave their task only as partial tiles, and nothing
is gathered for an anchor but the first rows of each task.

The product runs twice. First over tiles of one label: its rows give an anchor's positives. Labels of many rows have
blocks of their own, the others share some, so that only blocks that hold the same labels meet. Then over all tiles: the
window of each anchor and positive is applied to a tile as it is reduced. Positives have to be known before
a window is, and keeping all tiles of the first run for the second would cost more than multiplying again.

Rows with a null label, null vector, null or non-finite component, or null vec_id take no part. Of rows that share a
vec_id one takes part: the smallest by label, then by vector. Rows that are alike but for their id are rows of their own. Shorter
vectors count as ending in zeros. Ties go to the smaller vec_id. A label that holds a third of all rows is many
blocks. An anchor without positives, or a positive without negatives in its window, has no row; nor has an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_few, stored, whole_groups
from .vectors import best, by_key, finite, first_of_each, from_bytes, matrix, parts_for, product, ranked, to_bytes, whole

ANCHORS, ROWS, CHUNK = 256, 2048, 32  # rows of the two sides of a tile, about, and dimensions of a cell
FACTOR = 256
POSITIVES, NEGATIVES = 5, 5
LEAST, MOST = 80, 100  # a negative's score in percent of the positive's
CELL = "shelf long, block int, across int, k int, n int, ids binary, labels binary, x binary, near binary, near_scores binary, n_near int"
TILE = "shelf long, i int, j int, k int, tile binary, a_n int, a_ids binary, a_labels binary, near binary, near_scores binary, n_near int, b_n int, b_ids binary, b_labels binary"
_META = ("ids", "labels", "near", "near_scores")


def _pack(dims: int, chunk: int) -> Callable:
    """Rows (shelf, block, across, vec_id, label, x, near), sorted by block: its cells. The first chunk's cell also carries ids, labels and positives."""

    def pack(batches):
        for block in whole_groups(batches, "shelf", "block"):
            x, n = matrix(block.column("x"), dims), block.num_rows
            near = block.column("near").to_pylist()
            meta = {"ids": block.column("vec_id").to_numpy().astype("<i8").tobytes(), "labels": block.column("label").to_numpy().astype("<i8").tobytes()}
            meta["near"] = np.array([len(p) for p in near] + [q["id"] for p in near for q in p], "<i8").tobytes()
            meta["near_scores"] = np.array([q["score"] for p in near for q in p], "<i8").tobytes()
            for k in range(max(1, -(-dims // chunk))):
                row = {"shelf": block.column("shelf")[0].as_py(), "block": block.column("block")[0].as_py(), "across": block.column("across")[0].as_py(), "k": k, "n": n}
                row |= meta if k == 0 else dict.fromkeys(_META, b"")
                row |= {"x": to_bytes(x[:, k * chunk : (k + 1) * chunk]), "n_near": sum(map(len, near))}
                yield pa.RecordBatch.from_pylist([row], schema=_schema(CELL))

    return pack


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _cells(rows: DataFrame, dims: int, chunk: int) -> DataFrame:
    dealt = rows.repartition("shelf", "block").sortWithinPartitions("shelf", "block", "vec_id")
    return stored(dealt.mapInArrow(_pack(dims, chunk), CELL), "cells")


def _multiply(dims: int, chunk: int) -> Callable:
    """The two cells of (shelf, i, j, k), the anchors' first: their partial tile."""

    def multiply(batches):
        held = None
        for key, row in by_key(batches, "shelf", "i", "j", "k", "side"):
            width = min(chunk, dims - key[3] * chunk) if dims else 0
            if key[4] == 0:
                held = (key[:4], row, from_bytes(row["x"], row["n"], width))
                continue
            if held is None or held[0] != key[:4]:
                continue  # no anchors meet these rows
            _, a, left = held
            tile = product(left, from_bytes(row["x"], row["n"], width))
            out = dict(zip(("shelf", "i", "j", "k"), key, strict=False)) | {"tile": to_bytes(tile), "a_n": a["n"], "a_ids": a["ids"], "a_labels": a["labels"], "near": a["near"], "near_scores": a["near_scores"], "n_near": a["n_near"]}
            yield pa.RecordBatch.from_pylist([out | {"b_n": row["n"], "b_ids": row["ids"], "b_labels": row["labels"]}], schema=_schema(TILE))

    return multiply


def _reduced(reduce: Callable) -> Callable:
    """Partial tiles of (shelf, i, j), sorted by k: reduce's rows of their sum. One partial tile is held beside the sum."""

    def add(batches):
        now, total, meta = None, None, None
        for key, row in by_key(batches, "shelf", "i", "j", "k"):
            tile = from_bytes(row["tile"], row["a_n"], row["b_n"])
            if key[:3] != now:
                if now is not None:
                    yield reduce(total, meta)
                now, total, meta = key[:3], tile, row
            else:
                total = total + tile
        if now is not None:
            yield reduce(total, meta)

    return add


def _longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8").astype(np.int64)


def _positives(most: int) -> Callable:
    def reduce(tile: np.ndarray, meta: dict) -> pa.RecordBatch:
        a_ids, a_labels, b_ids, b_labels = (_longs(meta[c]) for c in ("a_ids", "a_labels", "b_ids", "b_labels"))
        out: list[list] = [[], [], []]
        for r, own in enumerate(a_ids.tolist()):
            at = best(tile[r], b_ids, np.flatnonzero((b_labels == a_labels[r]) & (b_ids != own)), most)
            for column, values in zip(out, ([own] * len(at), b_ids[at].tolist(), tile[r][at].tolist()), strict=True):
                column += values
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "id", "score"])

    return reduce


def _negatives(most: int, least: int, upto: int) -> Callable:
    def reduce(tile: np.ndarray, meta: dict) -> pa.RecordBatch:
        a_ids, a_labels, b_ids, b_labels = (_longs(meta[c]) for c in ("a_ids", "a_labels", "b_ids", "b_labels"))
        near, scores = _longs(meta["near"]), _longs(meta["near_scores"]).tolist()
        counts, near = near[: len(a_ids)].tolist(), near[len(a_ids) :].tolist()
        out: list[list] = [[], [], [], [], []]
        nth = 0
        for r, own in enumerate(a_ids.tolist()):
            other = b_labels != a_labels[r]
            for positive, score in zip(near[nth : nth + counts[r]], scores[nth : nth + counts[r]], strict=True):
                low, high = -(-least * score // 100), upto * score // 100  # Python's integers: no product overflows
                at = best(tile[r], b_ids, np.flatnonzero(other & (tile[r] >= max(low, -(1 << 63))) & (tile[r] <= min(high, (1 << 63) - 1))), most) if low <= high else ()
                for column, values in zip(out, ([own] * len(at), [positive] * len(at), b_ids[at].tolist(), [score] * len(at), tile[r][at].tolist()) if len(at) else [()] * 5, strict=True):
                    column += values
            nth += counts[r]
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return reduce


def _tiles(anchors: DataFrame, rows: DataFrame, dims: int, chunk: int, units: int, reduce: Callable, out: str) -> DataFrame:
    """reduce's rows for each pair of blocks of a shelf. Both sides: shelf, block, across (blocks of the other side), vec_id, label, x, near."""
    over = lambda cells, own, other, side: cells.select("shelf", F.col("block").alias(own), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias(other), "k", F.lit(side).alias("side"), "n", *_META, "x", "n_near")
    cells = over(_cells(anchors, dims, chunk), "i", "j", 0).unionByName(over(_cells(rows, dims, chunk), "j", "i", 1))
    met = cells.repartition(parts_for(rows, units, 16), "shelf", "i", "j", "k").sortWithinPartitions("shelf", "i", "j", "k", "side")
    partial = met.mapInArrow(_multiply(dims, chunk), TILE)
    added = partial.repartition(parts_for(rows, units, 32), "shelf", "i", "j").sortWithinPartitions("shelf", "i", "j", "k")
    return added.mapInArrow(_reduced(reduce), out)


def _block(blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), blocks).cast("int")


def _blocks(rows: Column | int, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / most)).cast("int")


def hard_negatives(
    vectors: DataFrame, *, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", factor: int = FACTOR,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, chunk: int = CHUNK, anchor_rows: int = ANCHORS, block_rows: int = ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors and label may be expressions over the columns of vectors; negatives score between least and most percent of the positive.
    """
    own = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), own.cast("long").alias("label"), whole(F.col(vector), factor).alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"), finite(F.col(vector)).alias("fine"))
    rows = stored(first_of_each(rows.where("fine and vec_id is not null and label is not null").drop("fine"), "vec_id"), "vectors")
    total = rows.agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("dims")).first()
    n, n_anchors, dims = total.n, total.anchors or 0, total.dims

    # shelves: a label of many rows has one of its own, the others share some
    labels = stored(rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("a")), "labels")
    large = F.col("n") >= block_rows
    small = labels.where(~large).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = max(1, -(-small // block_rows))
    shelf = F.when(large, F.xxhash64("label", F.lit("alone"))).otherwise(F.pmod(F.xxhash64("label"), F.lit(shared)))
    labels = labels.withColumn("shelf", shelf)
    each = labels.groupBy("shelf").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).where("a > 0").select("shelf", _blocks(F.col("n"), block_rows).alias("js"), _blocks(F.col("a"), anchor_rows).alias("is"))
    shelves = stored(labels.select("label", "shelf").join(each, "shelf"), "shelves")
    placed = rows.join(if_few(shelves), "label").withColumn("near", F.expr("cast(array() as array<struct<id:long,score:long>>)"))
    side = lambda df, own, other, seed: df.select("shelf", _block(F.col(own), seed).alias("block"), F.col(other).alias("across"), "vec_id", "label", "x", "near")
    chunks = max(1, -(-dims // chunk))
    i, j = max(1, -(-n_anchors // anchor_rows)), max(1, -(-n // block_rows))
    found = _tiles(side(placed.where("anchor"), "is", "js", 1), side(placed, "js", "is", 2), dims, chunk, i * j * chunks, _positives(positives), "anchor_id long, id long, score long")
    near = ranked(found, ["anchor_id"], positives, "score", "id").groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("near"))
    near = stored(near, "positives")

    all_of = lambda df, own, other, seed: df.select(F.lit(0).cast("long").alias("shelf"), _block(F.lit(own), seed).alias("block"), F.lit(other).alias("across"), "vec_id", "label", "x", "near")
    starts = rows.where("anchor").join(near, F.col("vec_id") == F.col("anchor_id"))
    everything = rows.withColumn("near", F.expr("cast(array() as array<struct<id:long,score:long>>)"))
    out = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = _tiles(all_of(starts, i, j, 3), all_of(everything, j, i, 4), dims, chunk, i * j * chunks, _negatives(negatives, least, most), out)
    return ranked(found, ["anchor_id", "positive_id"], negatives, "negative_score", "negative_id").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
