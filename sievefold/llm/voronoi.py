"""Operator 12: exact top-k by inner product as a Voronoi kNN join.

Rows fall to the cell of their nearest pivot; pivots are a bounded number of rows that a hash of the ids picks. Each
cell is summed up: how many rows it holds, their largest distance to the pivot, the distances of the nearest few, and for queries
how many there are, their largest distance and their largest norm. Only these summaries, a few numbers for each pivot, reach the driver.

For queries q of cell i (pivot p, distance at most U, norm at most N) and a row x of cell j (pivot r, distance d)

    p.r - U|r| - N d  <=  q.x  <=  p.r + U|r| + N d,

as q.x = p.r + (q-p).r + q.(x-r). The k-th largest lower bound over the summaries is a score that every query of cell i
reaches (the query itself is left out of account by taking the bound after it). A row whose upper bound stays below
it is needed by no query of the cell: a row has to be as far from its pivot as a threshold of (i, j) says. Bounds are doubles with
a margin far above their rounding.

Cells of queries that lie together form groups of a bounded number, and cells of rows form blocks; a cell that is too
large for either is split by a hash. Each row is sent only to the groups that need it, in blocks; each pair of group
and block is solved on its own with exact products, and the first rows of every query are merged. How much is left
out depends on the data: where vectors lie in clusters much is, of vectors without any structure nearly nothing.

Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part. Of rows that share
a vec_id one takes part, the one of the smallest vector. Rows alike but for their id are rows of their own; ties go to the
smaller vec_id. Shorter vectors count as ending in zeros. A query that is alone, and an empty table, give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_groups
from .vectors import best, by_key, finite, first_of_each, from_bytes, matrix, parts_for, product, ranked, to_bytes, whole

FACTOR = 256
PIVOTS = 256
QUERIES, ROWS = 1024, 4096  # rows of a group of queries and of a block, about
MARGIN = 1e-9  # of the product of the norms in a bound
BLOCK = "shelf int, part int, n int, ids binary, x binary, cells binary, distances binary"
UNIT = "g int, g_part int, b int, b_part int, side int, n int, ids binary, x binary, cells binary, distances binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _assign(pivots: np.ndarray) -> Callable:
    """Rows (vec_id, query, x) with their nearest pivot, the distance to it, and their norm."""
    p = pivots.astype(np.float64)

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = matrix(part.column("x"), p.shape[1]).astype(np.float64)
                cell = ((p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
                distance = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
                norm = np.sqrt((x * x).sum(axis=1))
                columns = [*part.columns, pa.array(cell, pa.int32()), pa.array(distance), pa.array(norm)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "cell", "distance", "norm"])

    return assign


def thresholds(pivots: np.ndarray, rows: dict, queries: dict, k: int) -> np.ndarray:
    """(cells of queries, cells of rows): how far from its pivot a row is at least if a query of the cell may need it. Infinite: none is.

    rows: for each cell the smallest distances, in order, up to k + 1; queries: for each cell (largest distance, largest norm).
    """
    p = pivots.astype(np.float64)
    norms, dots = np.sqrt((p * p).sum(axis=1)), p @ p.T
    out = np.full((len(p), len(p)), np.inf)
    cells = sorted(rows)
    flat = np.array([(j, d) for j in cells for d in rows[j]], np.float64).reshape(-1, 2)
    of, near = flat[:, 0].astype(int), flat[:, 1]
    for i, (far, norm) in queries.items():
        low = dots[i, of] - far * norms[of] - norm * near
        low -= MARGIN * (norms[i] + far) * (norms[of] + near)
        reached = np.partition(low, len(low) - k - 1)[len(low) - k - 1] if len(low) > k else -np.inf
        for j in cells:
            room = reached - dots[i, j] - far * norms[j] - MARGIN * (norms[i] + far) * (norms[j] + norm)
            out[i, j] = -np.inf if norm == 0 or not np.isfinite(room) else room / norm * (1 - MARGIN * np.sign(room))
    return out


def gathered(counts: dict[int, int], pivots: np.ndarray, most: int) -> tuple[dict[int, int], dict[int, int]]:
    """Cells put together, neighbours first, up to about most rows: the shelf of each cell and the parts of each shelf. A larger cell has a shelf of several parts."""
    p = pivots.astype(np.float64)
    left, shelf, parts = set(counts), {}, {}
    while left:
        seed = min(left, key=lambda c: (-counts[c], c))
        near = sorted(left, key=lambda c: (((p[c] - p[seed]) ** 2).sum(), c != seed, c))
        room, number = most - counts[seed], len(parts)
        shelf[seed], parts[number] = number, max(1, -(-counts[seed] // most))
        left.discard(seed)
        for c in near:
            if c in left and counts[c] <= room:
                room -= counts[c]
                shelf[c] = number
                left.discard(c)
    return shelf, parts


def _pack(dims: int) -> Callable:
    def pack(batches):
        for block in whole_groups(batches, "shelf", "part"):
            row = {"shelf": block.column("shelf")[0].as_py(), "part": block.column("part")[0].as_py(), "n": block.num_rows, "ids": block.column("vec_id").to_numpy().astype("<i8").tobytes(), "x": to_bytes(matrix(block.column("x"), dims))}
            row |= {"cells": block.column("cell").to_numpy().astype("<i4").tobytes(), "distances": block.column("distance").to_numpy().astype("<f8").tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=_schema(BLOCK))

    return pack


def _packed(rows: DataFrame, shelf: dict[int, int], parts: dict[int, int], dims: int) -> DataFrame:
    """rows in blocks by the shelf of their cell; a shelf's rows are dealt to its parts by a hash."""
    spark = rows.sparkSession
    where = spark.createDataFrame([(c, s, parts[s]) for c, s in shelf.items()], "cell int, shelf int, parts int")  # a row for each pivot
    placed = rows.join(F.broadcast(where), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    return placed.repartition("shelf", "part").sortWithinPartitions("shelf", "part", "vec_id").mapInArrow(_pack(dims), BLOCK)


def _deal(needs: np.ndarray, parts: dict[int, int], dims: int) -> Callable:
    """Blocks of rows, sent to every part of each group that needs some of them: only the rows that it needs."""

    def deal(batches):
        for key, row in by_key(batches, "shelf", "part"):
            cells, distances = np.frombuffer(row["cells"], "<i4"), np.frombuffer(row["distances"], "<f8")
            ids, x = np.frombuffer(row["ids"], "<i8"), from_bytes(row["x"], row["n"], dims)
            for g in range(len(needs)):
                on = distances >= needs[g, cells]
                if not on.any():
                    continue
                own = {"b": key[0], "b_part": key[1], "side": 1, "n": int(on.sum()), "ids": ids[on].tobytes(), "x": to_bytes(x[on]), "cells": cells[on].tobytes(), "distances": distances[on].tobytes()}
                for part in range(parts[g]):
                    yield pa.RecordBatch.from_pylist([own | {"g": g, "g_part": part}], schema=_schema(UNIT))

    return deal


def _call(wanted: dict[int, list[int]], parts: dict[int, int]) -> Callable:
    """Blocks of queries, sent to every part of the blocks of rows that their group may need."""

    def call(batches):
        for key, row in by_key(batches, "shelf", "part"):
            for b in wanted[key[0]]:
                for part in range(parts[b]):
                    yield pa.RecordBatch.from_pylist([row | {"g": key[0], "g_part": key[1], "b": b, "b_part": part, "side": 0}], schema=_schema(UNIT))

    return call


def _solve(needs: np.ndarray, dims: int, k: int) -> Callable:
    """The queries of a unit, then its rows: each query's first k of the rows that its own cell needs. needs: thresholds of cells."""

    def solve(batches):
        held = None
        for key, row in by_key(batches, "g", "g_part", "b", "b_part", "side"):
            if key[4] == 0:
                held = (key[:4], np.frombuffer(row["ids"], "<i8"), from_bytes(row["x"], row["n"], dims), np.frombuffer(row["cells"], "<i4"))
                continue
            if held is None or held[0] != key[:4]:
                continue  # no query of the group meets this block
            _, q_ids, q, q_cells = held
            ids, cells, distances = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["cells"], "<i4"), np.frombuffer(row["distances"], "<f8")
            scores = product(q, from_bytes(row["x"], row["n"], dims))
            out: list[list] = [[], [], []]
            fit_of: dict[int, np.ndarray] = {}
            for r, (own, cell) in enumerate(zip(q_ids.tolist(), q_cells.tolist(), strict=True)):
                if cell not in fit_of:
                    fit_of[cell] = np.flatnonzero(distances >= needs[cell, cells])
                fit = fit_of[cell]
                at = best(scores[r], ids, fit[ids[fit] != own], k)
                for column, values in zip(out, ([own] * len(at), ids[at].tolist(), scores[r][at].tolist()), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return solve


def top_k(
    vectors: DataFrame, *, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", factor: int = FACTOR, k: int = 5,
    pivots: int = PIVOTS, query_rows: int = QUERIES, block_rows: int = ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product for each row of the condition queries, itself left out."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("query"), whole(F.col(vector), factor).alias("x"), finite(F.col(vector)).alias("fine"))
    rows = stored(first_of_each(rows.where("fine and vec_id is not null").drop("fine"), "vec_id"), "vectors")
    dims = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # at most so many as the parameter says
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    p = np.zeros((len(chosen), dims), np.int64)
    for at, r in enumerate(chosen):
        p[at, : len(r.x)] = r.x
    cells = stored(rows.mapInArrow(_assign(p), "vec_id long, query boolean, x array<long>, cell int, distance double, norm double"), "cells")

    # a few numbers for each pivot
    near: dict[int, list[float]] = {}
    for r in ranked(cells.select("cell", (-F.col("distance")).alias("close"), "vec_id"), ["cell"], k + 1, "close", "vec_id").orderBy("cell", "rank").collect():
        near.setdefault(r.cell, []).append(-r.close)
    asked = lambda c: F.when(F.col("query"), F.col(c))
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.count(asked("cell")).alias("asked"), F.max(asked("distance")).alias("asked_far"), F.max(asked("norm")).alias("norm")).collect()
    calls = {r.cell: (r.asked_far, r.norm) for r in summary if r.asked}
    need = thresholds(p, near, calls, k)
    groups, group_parts = gathered({r.cell: r.asked for r in summary if r.asked}, p, query_rows)
    blocks, block_parts = gathered({r.cell: r.n for r in summary}, p, block_rows)
    group_need = np.full((len(group_parts), len(p)), np.inf)
    for cell, g in groups.items():
        group_need[g] = np.minimum(group_need[g], need[cell])
    far = {r.cell: r.far for r in summary}
    wanted = {g: sorted({b for cell, b in blocks.items() if far[cell] >= group_need[g, cell]}) for g in group_parts}

    left = _packed(cells.where("query"), groups, group_parts, dims).mapInArrow(_call(wanted, block_parts), UNIT)
    right = _packed(cells, blocks, block_parts, dims).mapInArrow(_deal(group_need, group_parts, dims), UNIT)
    units = sum(group_parts[g] * block_parts[b] for g, bs in wanted.items() for b in bs)
    unit = ["g", "g_part", "b", "b_part"]
    met = left.unionByName(right).repartition(parts_for(rows, units, 8), *unit).sortWithinPartitions(*unit, "side")
    found = met.mapInArrow(_solve(need, dims, k), "query_id long, vec_id long, score long")
    return ranked(found, ["query_id"], k, "score", "vec_id").select("query_id", "rank", "vec_id", "score")
