"""Operators on embeddings against plain Python: whole-number scores, Voronoi thresholds, error-free sums, edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievefold.llm import queries as q
from sievefold.llm import summa, voronoi, whitening
from sievefold.llm.vectors import best, from_bytes, product, to_bytes

SCHEMA = "vec_id long, embedding array<double>, label int, x string, cell int, shelf string, anchor string, rank int, near int"
EXTRA = ("a", 1, "b", "c", 2, 3)


def rows_of_edges():
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).round(2).tolist(), int(k % 3)) for k in range(1, 60)]
    rows += [(k, [0.5, -0.25, 0.125, 0.0, 1.0, -1.0], 1) for k in range(100, 160)]  # copies: ties
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (202, [1.0, math.nan, 0.0, 0.0, 0.0, 0.0], 1), (203, [math.inf] * 6, 1), (204, [1.0] * 6, None)]
    rows += [(210, [0.5, 0.5], 2), (211, [], 2), (212, [1e6] * 6, 0), (213, [-1e6] * 6, 0), (None, [1.0] * 6, 0)]
    rows += [(300, [0.1] * 6, 0), (300, [0.1] * 6, 0), (301, [0.3] * 6, 0), (301, [0.2] * 6, 0), (302, [0.2] * 6, 2), (302, [0.2] * 6, 1)]
    return rows


def plain_rows(rows, factor=256, labels=True):
    """vec_id -> (label, whole vector): the rows that take part, one of each id."""
    found = {}
    for own, vector, label in rows:
        if own is None or vector is None or any(c is None or not math.isfinite(c) for c in vector) or (labels and label is None):
            continue
        whole = [math.floor(c * factor) for c in vector]
        key = (label if labels else 0, whole)
        found[own] = min(found.get(own, key), key)
    return found


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def plain_negatives(found, every):
    out = set()
    for a, (label, vector) in found.items():
        if a % every:
            continue
        order = sorted((-dot(vector, v), own, other) for own, (other, v) in found.items() if own != a)
        for score, positive, _ in [o for o in order if o[2] == label][:5]:
            fit = [o for o in order if o[2] != label and 80 * -score <= 100 * -o[0] <= 100 * -score]
            out |= {(a, positive, nth, own, -score, -s) for nth, (s, own, _) in enumerate(fit[:5], 1)}
    return out


def plain_top(found, every, k=5):
    out = set()
    for a, (_, vector) in found.items():
        if a % every == 0:
            order = sorted((-dot(vector, v), own) for own, (_, v) in found.items() if own != a)
            out |= {(a, nth, own, -s) for nth, (s, own) in enumerate(order[:k], 1)}
    return out


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows_of_edges()], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def real(spark, sf):
    return [(r.vec_id, [float(c) for c in r.embedding], r.label) for r in q.embeddings(spark, sf).collect()]


@pytest.mark.parametrize("sizes", [(256, 2048, 32), (3, 7, 4)], ids=["one block", "small blocks"])
def test_hard_negatives_edges(spark, edges, sizes):
    got = summa.hard_negatives(edges, anchors=F.col("vec_id") % 10 == 0, anchor_rows=sizes[0], block_rows=sizes[1], chunk=sizes[2]).collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == plain_negatives(plain_rows(rows_of_edges()), 10)


def test_hard_negatives_query(spark, sf, real):
    rows = [(own, v, (label + 1) % 10 if own % 7 == 0 else label) for own, v, label in real]
    assert set(map(tuple, q.op11_hard_negatives(spark, sf).collect())) == plain_negatives(plain_rows(rows), 100)


@pytest.mark.parametrize("sizes", [(256, 1024, 4096), (9, 4, 8), (1, 2, 16)], ids=["one group", "small groups", "one pivot"])
def test_top_k_edges(spark, edges, sizes):
    got = voronoi.top_k(edges, queries=F.col("vec_id") % 3 == 0, pivots=sizes[0], query_rows=sizes[1], block_rows=sizes[2]).collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == plain_top(plain_rows(rows_of_edges(), labels=False), 3)


def test_top_k_query(spark, sf, real):
    assert set(map(tuple, q.op12_top_k(spark, sf).collect())) == plain_top(plain_rows(real, labels=False), 50)


def test_clusters_prune():
    """Where vectors lie in clusters, rows of other clusters aren't sent; what is needed always is."""
    rng = np.random.default_rng(1)
    centres = np.eye(8) * 2000
    x = np.concatenate([c + rng.integers(-40, 40, (50, 8)) for c in centres]).astype(np.int64)
    pivots = x[::50]
    cell = ((x[:, None] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1)
    distance = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
    near = {c: sorted(distance[cell == c])[:6] for c in range(8)}
    calls = {c: (distance[cell == c].max(), np.sqrt((x[cell == c] ** 2).sum(axis=1)).max()) for c in range(8)}
    need = voronoi.thresholds(pivots, near, calls, 5)
    sent = distance[None, :] >= need[:, cell]
    assert sent.mean() < 0.2
    scores = x @ x.T
    np.fill_diagonal(scores, np.iinfo(np.int64).min)
    top = np.argsort(-scores, axis=1)[:, :5]
    assert all(sent[cell[a], top[a]].all() for a in range(len(x)))


@pytest.mark.parametrize("operator", [lambda d: summa.hard_negatives(d, anchors=F.lit(True)), lambda d: voronoi.top_k(d, queries=F.lit(True)), whitening.whitened], ids=["negatives", "top_k", "whitening"])
def test_empty(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = spark.createDataFrame([(1, None, 1, *EXTRA), (2, [None], 1, *EXTRA)], SCHEMA)
    assert operator(nothing).collect() == []
    alone = spark.createDataFrame([(1, [1.0, 2.0], 1, *EXTRA)], SCHEMA)
    assert operator(alone).collect() == []


def exact_whitening(vectors, factor=64, shift=1_000_000):
    """n, sums, covariance in fractions turned to doubles at the end."""
    x = [tuple(math.floor(c * factor) + shift for c in v) for v in vectors]
    fit = sorted(set(x))
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(dims)]
    z = [[n * v[d] - sums[d] for d in range(dims)] for v in fit]
    covariance = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(dims)] for i in range(dims)])
    return x, n, sums, covariance


def check_whitening(got, rows, components=16):
    x, n, sums, covariance = exact_whitening([v for _, v, _ in rows])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(components, len(values))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert len(got) == kept * len(rows)
    signs = None
    for (own, _, _), v in zip(rows, x, strict=True):
        want = np.array([Fraction(n * c - s, n) for c, s in zip(v, sums, strict=True)], float) @ axes[:, :kept] / np.sqrt(values[:kept])
        for c in range(1, kept + 1):
            found = by[own][c]
            assert {r.n for r in found} == {n} and all(r.identity_error < 1e-9 for r in found)
            assert sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) in {r.deviation for r in found}
            assert math.isclose(found[0].explained, values[c - 1] / values.sum(), rel_tol=1e-9)
        if signs is None and all(abs(want) > 1e-6):
            signs = np.sign([by[own][c][0].whitened for c in range(1, kept + 1)]) * np.sign(want)
        if signs is not None and len(by[own][1]) == 1:
            np.testing.assert_allclose([by[own][c][0].whitened for c in range(1, kept + 1)], want * signs, atol=1e-7)


def test_whitening_query(spark, sf, real):
    check_whitening(q.op13_whitening(spark, sf).collect(), real)


def test_whitening_edges(spark, edges):
    got = whitening.whitened(edges.where("vec_id not in (212, 213) or vec_id is null")).collect()
    fine = [r for r in rows_of_edges() if r[0] not in (212, 213) and r[1] is not None and len(r[1]) == 6 and all(c is not None and math.isfinite(c) for c in r[1])]
    check_whitening(got, fine)


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(k, [1.5, 2.5], 1, *EXTRA) for k in range(5)], SCHEMA)
    assert whitening.whitened(same).collect() == []
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], 1, *EXTRA) for k in range(5)], SCHEMA)
    assert {r.component for r in whitening.whitened(line).collect()} == {1}


def test_compensated_sums():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 5)) * 10.0 ** rng.integers(-8, 9, (500, 1))
    high, low = whitening.outer(rows, np.zeros_like(rows))
    i, j = np.triu_indices(5)
    for k in range(len(i)):
        exact = sum(Fraction(float(r[i[k]])) * Fraction(float(r[j[k]])) for r in rows)
        assert abs(Fraction(float(high[k])) + Fraction(float(low[k])) - exact) <= abs(exact) * Fraction(1, 2**90) + Fraction(1, 2**60)


def test_large_components():
    z = whitening._centred(10**6, np.array([10**15, -(10**15)], object))(np.array([[3 * 10**15, 5]], np.int64))
    assert z.tolist() == [[3 * 10**21 - 10**15, 5 * 10**6 + 10**15]]
    assert whitening._deviations(z) == [None]
    a = np.array([[2**40, -3], [1, 1]], np.int64)
    assert product(a, a).tolist() == [[(2**80 + 9) % 2**64, 2**40 - 3], [2**40 - 3, 2]]
    for values in (a, a >> 20):
        assert (from_bytes(to_bytes(values), 2, 2) == values).all()
    assert best(np.array([5, 7, 7, 1, 7]), np.array([1, 9, 3, 4, 5]), np.arange(5), 2).tolist() == [2, 4]
