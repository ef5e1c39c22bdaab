import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from squadron.functions import geo
from squadron.kernel import cluster, geometry, paths, tours

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
L_SHAPE = [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6), (0, 0)]


def rows(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


@pytest.fixture(scope="module")
def grid(spark):
    pts = [(float(x) / 2, float(y) / 2) for x in range(-2, 15) for y in range(-2, 15)]
    return pts, spark.createDataFrame(pts, "x double, y double").withColumn("ring", F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in L_SHAPE)))


def inside_l(x, y):
    return 0 < x < 6 and 0 < y < 2 or 0 < x < 2 and 0 < y < 6


def test_contains_excludes_the_boundary(grid):
    pts, d = grid
    got = {(r.x, r.y): r.c for r in d.select("x", "y", geo.contains(F.col("ring"), F.col("x"), F.col("y")).alias("c")).collect()}
    for x, y in pts:
        assert got[x, y] == inside_l(x, y) == geometry.inside((x, y), L_SHAPE)[0], (x, y)


@pytest.mark.parametrize(
    ("p", "q", "blocked"),
    [((-1, 1), (7, 1), True), ((-1, 0), (7, 0), False), ((0, 0), (6, 0), False), ((0, 0), (2, 2), True), ((6, 2), (2, 6), False), ((2, 2), (7, 7), False), ((1, 1), (1.5, 1.5), True), ((-1, 1), (1, -1), False), ((-1, 3), (3, 3), True), ((3, 3), (5, 5), False), ((0, 6), (0, -5), False)],
)
def test_segments(spark, p, q, blocked):
    ring = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in L_SHAPE))
    lit = lambda v: F.struct(F.lit(float(v[0])).alias("x"), F.lit(float(v[1])).alias("y"))
    got = spark.range(1).select(geo.blocks(lit(p), lit(q), ring).alias("a"), geo.blocks(lit(q), lit(p), ring).alias("b")).first()
    assert (got.a, got.b) == (blocked, blocked)
    assert geometry.blocked(p, q, L_SHAPE) == geometry.blocked(q, p, L_SHAPE) == blocked


def test_area_and_centroid(spark):
    d = spark.createDataFrame([(rows(SQUARE),), (rows(L_SHAPE),)], "ring array<struct<x: double, y: double>>")
    got = d.select(geo.area(F.col("ring")).alias("a"), geo.centroid(F.col("ring")).alias("c")).collect()
    assert [r.a for r in got] == [16.0, 20.0] and (got[0].c.x, got[0].c.y) == (2.0, 2.0)
    assert math.isclose(got[1].c.x, (12 * 3 + 8 * 1) / 20) and math.isclose(got[1].c.y, (12 * 1 + 8 * 4) / 20)


def test_letters(spark):
    want = {1: "A", 26: "Z", 27: "AA", 52: "AZ", 53: "BA", 702: "ZZ", 703: "AAA"}
    got = {r.n: r.s for r in spark.createDataFrame([(n,) for n in want], "n long").select("n", geo.letter_id(F.col("n")).alias("s")).collect()}
    assert got == want
    with pytest.raises(Exception, match="letter id"):
        spark.range(1).select(geo.letter_id(F.col("id"))).collect()


def test_hull_and_simplify():
    assert geometry.hull(L_SHAPE).tolist() == [[0, 0], [6, 0], [6, 2], [2, 6], [0, 6], [0, 0]]
    noisy = [(0, 0), (1, 0.01), (2, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert geometry.simplify(noisy, 0.1).tolist() == [list(p) for p in SQUARE]


@pytest.mark.parametrize(("shift", "area", "parts"), [((2, 2), 28, 1), ((2, 0), 24, 1), ((5, 5), 32, 2), ((4, 0), 32, 1)])
def test_union(shift, area, parts):
    other = [(x + shift[0], y + shift[1]) for x, y in SQUARE]
    out = geometry.union([SQUARE, other])
    assert len(out) == parts and math.isclose(sum(geometry.signed_area(r) for r in out), area)


def test_union_of_contained_ring():
    (out,) = geometry.union([SQUARE, [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]])
    assert math.isclose(geometry.signed_area(out), 16)
    assert geometry.overlap(SQUARE, [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]) and geometry.overlap(SQUARE, SQUARE)
    assert not geometry.overlap(SQUARE, [(4, 0), (8, 0), (8, 4), (4, 4), (4, 0)])


def test_traced_cells():
    ring = {(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (1, 2), (2, 2)}
    out = sorted(geometry.signed_area(r) for r in geometry.trace_cells(ring))
    assert out == [-1, 9]
    assert sorted(geometry.signed_area(r) for r in geometry.trace_cells({(0, 0), (1, 1)})) == [1, 1]


def test_path_round_one_square():
    z = paths.Zones([[(1, -1), (2, -1), (2, 1), (1, 1), (1, -1)]])
    d, line = z.path((0, 0), (3, 0))
    assert line in ([(0, 0), (1, 1), (2, 1), (3, 0)], [(0, 0), (1, -1), (2, -1), (3, 0)])
    assert math.isclose(d, sum(float(geometry.haversine(a, b)) for a, b in zip(line[:-1], line[1:], strict=True)))
    assert d >= float(geometry.haversine((0, 0), (3, 0)))
    assert z.path((1.5, 0), (3, 0)) == (math.inf, []) and z.path((0, 0), (0, 0))[0] == 0
    assert z.path((3, 0), (0, 0))[0] == d


def test_path_round_two_squares():
    z = paths.Zones([[(1, -1), (2, -1), (2, 3), (1, 3), (1, -1)], [(3, -3), (4, -3), (4, 1), (3, 1), (3, -3)]])
    _, line = z.path((0, 0), (5, 0))
    assert line[1:-1] in ([(1, -1), (2, -1), (3, 1), (4, 1)],)
    for a, b in zip(line[:-1], line[1:], strict=True):
        assert z.visible(a, b)


def test_hungarian_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5), (6, 6)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in enumerate(cluster.hungarian(c)))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert math.isclose(got, best)
    assert sorted(cluster.hungarian(rng.random((4, 2)))) == [-1, -1, 0, 1]


def test_capped_kmeans():
    rng = np.random.default_rng(1)
    x = rng.random((40, 2))
    label = cluster.capped_kmeans(x, 6, rng)
    assert np.bincount(label).max() <= 6
    assert len(np.unique(cluster.capped_kmeans(x, 10, rng, k=5))) == 5
    with pytest.raises(ValueError, match="do not fit"):
        cluster.capped_kmeans(x, 6, rng, k=3)


def test_two_opt_leaves_no_better_swap():
    rng = np.random.default_rng(2)
    p = rng.random((12, 2))
    m = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    first = tours.nearest_neighbour(m)
    out = tours.two_opt(first, m)
    assert tours.length(out, m) <= tours.length(first, m) and sorted(out[:-1]) == list(range(12)) and out[0] == out[-1] == 0
    for i in range(1, len(out) - 2):
        for j in range(i + 1, len(out) - 1):
            assert tours.length(tours.swap(out, i, j), m) >= tours.length(out, m) - 1e-9


def test_sorties():
    rng = np.random.default_rng(3)
    p = rng.random((11, 2))
    m = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    m[:, 5] = m[5, :] = np.inf
    out = tours.sorties(m, 0, 10, list(range(1, 10)), 3, 3)
    assert sorted(k for s in out for k in s) == [1, 2, 3, 4, 6, 7, 8, 9] and len(out) <= 3 and max(map(len, out)) <= 3
