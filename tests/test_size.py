"""Work is shared by the tasks and grows with the rows, and the faster ways give the results of the plain ones."""

import numpy as np
from pyspark.sql import functions as F

from squadron.kernel import geometry
from squadron.kernel.paths import Zones
from squadron.operators import paths
from squadron.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
L_SHAPE = [(6, 0), (12, 0), (12, 2), (8, 2), (8, 6), (6, 6), (6, 0)]


def tasks(df) -> int:
    """Tasks that get rows."""
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


def test_many_segments_as_one_by_one():
    rng = np.random.default_rng(1)
    p, q = (np.vstack([rng.integers(-2, 15, (600, 2)) / 1.0, rng.uniform(-2, 14, (600, 2))]) for _ in range(2))
    for ring in (SQUARE, L_SHAPE):
        assert geometry.blocked_many(p, q, ring).tolist() == [geometry.blocked(a, b, ring) for a, b in zip(p, q, strict=True)]
    z = Zones([SQUARE, L_SHAPE])
    free = z.sight(p, q)
    assert free.tolist() == [z.visible(a, b) for a, b in zip(p, q, strict=True)]
    for (d, way), a, b, seen in zip(z.ways(p, q), p, q, free, strict=True):
        inner = z.covered([a, b]).any()
        assert np.isinf(d) == (inner and tuple(a) != tuple(b)) or way == []
        if way and len(way) > 1:
            assert way[0] == tuple(a) and way[-1] == tuple(b) and (len(way) == 2) == bool(seen)
            assert all(z.visible(*leg) for leg in zip(way[:-1], way[1:], strict=True))


def test_the_matrix_of_one_group_is_shared_by_tasks(spark):
    m = paths.distance_matrix(fx.sites(spark, "/root/testdata/sf0.01").withColumn("run_id", F.lit(0)), fx.obstacles(spark, SF))
    assert tasks(m) > 1
    assert m.count() == 100 * 99 == m.select("i", "j").distinct().count()


def test_ways_of_few_pairs_are_shared_by_tasks(spark):
    from squadron.plans.queries import Inputs
    from squadron.plans.zoned import rings_of

    legs = Inputs(spark, SF).sortie_legs.drop("dist_m", "cluster_seq")
    out = paths.feasible_paths(legs, rings_of(spark, SF), path=False)
    assert tasks(out) > 1 and out.count() == legs.count() and "path" not in out.columns


def test_assignment_of_many_rows_to_few_columns():
    from squadron.kernel import cluster

    rng = np.random.default_rng(2)
    cost = rng.random((20_000, 2))
    got = cluster.hungarian(cost)
    best = [np.argsort(cost[:, b])[:2] for b in range(2)]
    least = min(cost[i, 0] + cost[j, 1] for i in best[0] for j in best[1] if i != j)
    assert sorted(b for b in got if b >= 0) == [0, 1] and np.isclose(cost[got.index(0), 0] + cost[got.index(1), 1], least)


def test_sortie_tours_measure_only_their_own_ways(spark):
    from squadron.operators import metrics

    stops = spark.createDataFrame([(0, 1, 1, 146.2, -16.5), (0, 1, 2, 146.4, -16.1), (0, 2, 1, 146.9, -16.9)], "run_id bigint, sortie_id int, stop_idx int, x double, y double")
    depots = spark.createDataFrame([(0, 146.0, -17.0)], "run_id bigint, depot_x double, depot_y double")
    got = {r.sortie_id: r.dist_m for r in metrics.sortie_tours(stops, depots, ("run_id", "sortie_id"), "stop_idx").collect()}
    way = lambda *p: float(geometry.haversine(np.array(p[:-1]), np.array(p[1:])).sum())
    home, a, b, c = (146.0, -17.0), (146.2, -16.5), (146.4, -16.1), (146.9, -16.9)
    assert np.isclose(got[1], way(home, a, b, home)) and np.isclose(got[2], way(home, c, home))


def test_a_long_path_is_improved_without_a_matrix():
    import tracemalloc

    from squadron.kernel import tours

    n = 2500
    p = np.random.default_rng(3).random((n, 2)) + [146, -17]
    tracemalloc.start()
    order = np.array(tours.two_opt_path(p))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n * 8 / 2 and sorted(order) == list(range(n)) and (order[0], order[-1]) == (0, n - 1)
    q = p[order]
    m = geometry.haversine(q[:, None], q[None])
    legs = np.diag(m, 1)
    gain = legs[:, None] + legs[None] - m[:-1, :-1] - m[1:, 1:]
    np.fill_diagonal(gain, 0)
    assert gain.max() < 1e-5


def test_sorties_without_a_matrix_are_those_of_one():
    from squadron.kernel import tours

    p = np.random.default_rng(4).random((200, 2)) + [146, -17]
    m = geometry.haversine(p[:, None], p[None])
    for cap in (10, 66):
        assert tours.sorties_on_points(p, 3, cap) == tours.sorties(m, 0, 199, list(range(1, 199)), 3, cap)


def test_kmeans_takes_some_points_at_a_time():
    import tracemalloc

    from squadron.kernel import cluster

    x = np.random.default_rng(5).random((3000, 3))
    c = x[:900]
    label, near = cluster.nearest(x, c)
    d = ((x[:200, None] - c[None]) ** 2).sum(2)
    assert label[:200].tolist() == d.argmin(1).tolist() and np.array_equal(near[:200], d.min(1))
    tracemalloc.start()
    assert len(np.unique(cluster.kmeans(x, 900, np.random.default_rng(0), max_iter=3))) == 900
    assert tracemalloc.get_traced_memory()[1] < 3000 * 900 * 8
    tracemalloc.stop()


def test_kept_ways_are_bounded(monkeypatch):
    from squadron.kernel import paths as k

    monkeypatch.setattr(k, "KEPT_WAYS", 10)
    z = Zones([SQUARE])
    for i in range(40):
        assert z.path((-1.0, 2.0), (5.0, float(i)))[0] >= float(geometry.haversine((-1.0, 2.0), (5.0, float(i)))) - 1e-9
    assert len(z._paths) <= 11


def test_waypoints_inside_zones_move_to_the_nearest_free_corner():
    from squadron.kernel import solution as s

    fleet = s.Fleet((-1.0, -1.0), 0.2, 0.075, 1, 1, z := Zones([SQUARE, L_SHAPE]), z)
    assert s.adjusted([(1.0, 1.0), (5.0, 1.0), (4.0, 4.0)], fleet) == ((0.0, 0.0), (5.0, 1.0), (4.0, 4.0))


def test_chains_are_shared_by_tasks(spark):
    from squadron.functions.session import dealt

    chains = spark.range(40).coalesce(1).select((F.col("id") % 10).alias("run_id"), F.floor(F.col("id") / 10).alias("chain"))
    assert tasks(dealt(chains, "run_id", "chain", per_core=8)) > 8


def test_letters_go_on_beyond_three(spark):
    from squadron.functions import geo

    got = spark.createDataFrame([(18278,), (18279,), (60000,)], "n long").select(geo.letter_id(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["ZZZ", "AAAA", "CJSR"]


def test_zones_of_many_sizes_are_looked_at_together(monkeypatch):
    """Points and segments against rings of 3 to 40 corners: as one by one, on corners and edges too, in one look a size."""
    rng = np.random.default_rng(5)
    rings = []
    for n in (3, 4, 4, 5, 9, 40, 4, 17):
        turn = np.sort(rng.random(n)) * 2 * np.pi
        rings.append(rng.random(2) * 4 + np.column_stack([np.cos(turn), np.sin(turn)]) * (0.3 + rng.random((n, 1))))
    rings += [np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float), np.array([(1, 0), (2, 0), (2, 1), (1, 1)], float)]
    zones = Zones(rings)
    on = np.vstack([r[:-1] for r in zones.rings] + [(r[:-1] + r[1:]) / 2 for r in zones.rings])
    p = np.vstack([rng.random((300, 2)) * 6 - 1, on, rng.integers(0, 5, (100, 2)) / 2])
    assert zones.covered(p).tolist() == [any(bool(geometry.inside(x, r)[0]) for r in zones.rings) for x in p]
    q = p[rng.permutation(len(p))]
    assert zones.sight(p, q).tolist() == [not any(geometry.blocked(a, b, r) for r in zones.rings) for a, b in zip(p, q, strict=True)]
    from squadron.kernel import paths

    calls = []
    monkeypatch.setattr(paths, "blocked_pairs", lambda *a: calls.append(1) or geometry.blocked_pairs(*a))
    zones.sight(p, q)
    assert len(calls) == len(zones.groups) < len(rings)


def test_ways_of_sorties_are_summed_once(monkeypatch):
    zones = Zones([[(0.4, -1.0), (0.6, -1.0), (0.6, 1.0), (0.4, 1.0)]])
    way = ((0.0, 0.0), (1.0, 0.0), (1.0, 0.5))
    want = sum(d for d, _ in zones.legs(way))
    assert zones.length(way) == want
    monkeypatch.setattr(zones, "legs", None)
    assert zones.length(way) == want


def test_an_event_leaves_the_plan_before_it():
    """After it, searches with kept lengths give the score that a fresh set of zones gives."""
    from squadron.kernel import solution

    rng = np.random.default_rng(6)
    ring = [(0.45, 0.2), (0.55, 0.2), (0.55, 0.8), (0.45, 0.8)]
    nodes = {c: {10 * c + k: (c / 4 + float(rng.random()) / 9, float(rng.random())) for k in range(5)} for c in range(4)}
    fleet = lambda: solution.Fleet((0.0, 0.0), 5.0, 2.0, 3, 2, z := Zones([ring]), z)
    f = fleet()
    plan, _ = solution.anneal(solution.first_plan(f, nodes), f, np.random.default_rng(1), min_iters=60)
    after, _ = solution.anneal(solution.after_event(plan, f, 2, {}, np.random.default_rng(2)), f, np.random.default_rng(3), low=2, min_iters=60)
    assert after.order[0] == plan.order[0] and after.points[:3] == plan.points[:3]
    assert solution.score(after, f) == solution.score(after, fleet())


def test_a_step_of_the_search_looks_at_its_ways_together(monkeypatch):
    """One look for all that a step asks for, and scores with kept lengths as a plan without any gives them."""
    from dataclasses import replace

    from squadron.kernel import solution

    rng = np.random.default_rng(7)
    nodes = {c: {10 * c + k: (c / 6 + float(rng.random()) / 9, float(rng.random())) for k in range(6)} for c in range(6)}
    zones = Zones([[(0.45, 0.2), (0.55, 0.2), (0.55, 0.8), (0.45, 0.8)], [(0.1, 0.4), (0.2, 0.4), (0.2, 0.6), (0.1, 0.6)]])
    f = solution.Fleet((-0.1, 0.0), 5.0, 2.0, 3, 2, zones, zones)
    now = solution.first_plan(f, nodes)
    solution.score(now, f)
    looks, ways = [], zones.ways
    monkeypatch.setattr(zones, "ways", lambda *a: looks.append(len(a[0])) or ways(*a))
    across = 0
    for step in range(60):
        looks.clear()
        kept = dict(now.known)
        new = solution.perturbed_across(now, f, 1, 6, rng) if step % 2 else solution.perturbed_within(now, f, 1 + step % 6, rng)
        got = solution.score(new, f)
        assert len(looks) <= 1 and all(now.known[c] is kept[c] for c in kept)
        across += step % 2 and new is not now
        assert got == solution.score(replace(new, known={}, means={}), f)
        fresh = Zones(zones.rings)
        assert np.allclose(got, solution.score(replace(new, known={}, means={}), solution.Fleet(f.depot, 5.0, 2.0, 3, 2, fresh, fresh)), rtol=1e-12)
        now = new if step % 3 else now
    assert across > 10


def test_ways_of_both_directions_asked_for_together(monkeypatch):
    zones = Zones([SQUARE])
    a, b = (-1.0, 2.0), (5.0, 1.0)
    zones.learn([(a, b), (b, a), (a, a)])
    (d, there), (e, back) = zones.path(a, b), zones.path(b, a)
    assert d == e and there == back[::-1] and len(there) > 2 and zones.path(a, a) == (0.0, [a])
    asked = [a, (1.0, 1.0), (0.0, 2.0)]
    assert zones.hidden(asked) == zones.covered(asked).tolist() == [False, True, False]
    monkeypatch.setattr(zones, "covered", None)
    assert zones.hidden(asked) == [False, True, False]


def test_steps_after_an_event_look_once(monkeypatch):
    from squadron.kernel import solution

    rng = np.random.default_rng(8)
    nodes = {c: {10 * c + k: (c / 6 + float(rng.random()) / 9, float(rng.random())) for k in range(6)} for c in range(6)}
    zones = Zones([[(0.45, 0.2), (0.55, 0.2), (0.55, 0.8), (0.45, 0.8)]])
    f = solution.Fleet((-0.1, 0.0), 5.0, 2.0, 3, 2, zones, zones)
    first = solution.first_plan(f, nodes)
    now = solution.after_event(first, f, 2, {}, rng)
    solution.score(now, f)
    looks, ways = [], zones.ways
    monkeypatch.setattr(zones, "ways", lambda *a: looks.append(1) or ways(*a))
    most = 0
    for _ in range(30):
        looks.clear()
        new = solution.perturbed_across(now, f, 2, len(now.order), rng)
        solution.score(new, f)
        most = max(most, len(looks))
        assert new.points[:3] == first.points[:3]
    assert most == 1


def test_chains_side_by_side_look_together_and_find_what_each_finds_alone(monkeypatch):
    """With the two vessels' zones apart too: as many looks as the longest chain asks for, not as all of them."""
    from squadron.kernel import solution

    rng = np.random.default_rng(9)
    nodes = {c: {10 * c + k: (c / 6 + float(rng.random()) / 9, float(rng.random())) for k in range(6)} for c in range(6)}
    rings = [[(0.45, 0.2), (0.55, 0.2), (0.55, 0.8), (0.45, 0.8)], [(0.1, 0.4), (0.2, 0.4), (0.2, 0.6), (0.1, 0.6)]]

    def fleet(two: bool):
        z = Zones(rings)
        return solution.Fleet((-0.1, 0.0), 5.0, 2.0, 3, 2, Zones(rings[:1]) if two else z, z)

    for two in (False, True):
        alone, most = [], 0
        for seed in range(5):
            f, looks = fleet(two), []
            ways = f.tender.ways
            monkeypatch.setattr(f.tender, "ways", lambda *a, ways=ways, looks=looks: looks.append(1) or ways(*a))
            alone.append(solution.anneal(solution.first_plan(f, nodes), f, np.random.default_rng(seed), min_iters=80))
            most += len(looks)
        f, looks = fleet(two), []
        ways = f.tender.ways
        first = solution.first_plan(f, nodes)
        monkeypatch.setattr(f.tender, "ways", lambda *a, ways=ways, looks=looks: looks.append(1) or ways(*a))
        found = solution.together([solution.annealing(first, f, np.random.default_rng(seed), 1, None, 0.25, 0.9, 80, 1, 1 << 31) for seed in range(5)])
        assert [t for _, t in found] == [t for _, t in alone]
        assert all(a.sorties == b.sorties and a.points == b.points and a.nodes == b.nodes for (a, _), (b, _) in zip(found, alone, strict=True))
        assert len(looks) * 2 < most


def test_metres_do_not_depend_on_what_was_asked_for_before():
    """Either direction, alone or among others, by whole arrays or one by one: the same to the last bit."""
    from squadron.kernel import paths

    rng = np.random.default_rng(10)
    rings = [np.array([(x, y), (x + 0.6, y), (x + 0.6, y + 0.5), (x, y + 0.5)]) for x in range(3) for y in range(3)]
    at = [tuple(p) for p in (rng.random((24, 2)) * 4 - 0.5).tolist()]
    pairs = [(a, b) for a in at for b in at if a != b]
    whole = Zones(rings)
    whole.learn(pairs)
    assert any(len(whole.path(*w)[1]) > 2 for w in pairs)
    for a, b in pairs[::7]:
        fresh, few = Zones(rings), Zones(rings)
        d, way = fresh.path(a, b)
        assert whole.metres([a, b]) == whole.metres([b, a]) == few.metres((b, a)) == [d]
        assert way == whole.path(b, a)[1][::-1] and (d == np.inf or abs(sum(map(float, geometry.haversine(np.array(way[:-1]), np.array(way[1:])))) - d) < 1e-6)
        want = fresh.around(min(a, b), max(a, b)) if len(way) > 2 else (d, way)
        assert want[0] == d and paths.DENSE > len(fresh.points)
    free = [not any(geometry.blocked(a, b, r) for r in whole.rings) for a, b in pairs]
    assert whole.sight(*(np.array(e) for e in zip(*pairs, strict=True))).tolist() == free


def test_chains_are_dealt_evenly(spark):
    from squadron.functions.session import dealt

    chains = spark.range(96).coalesce(1).select((F.col("id") * 7).alias("run_id"))
    sizes = [r["count"] for r in dealt(chains).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and 4 <= min(sizes) and max(sizes) <= 8  # each of four inputs gives a task one or two


def test_each_point_with_each_other_is_as_pair_by_pair(monkeypatch):
    """Metres to the last bit, on edges, corners and equal points too, round convex and other rings, with few corners or many."""
    from squadron.kernel import paths

    rng = np.random.default_rng(11)
    hexagon = [(9 + 1.5 * np.cos(a), 9 + 1.5 * np.sin(a)) for a in np.arange(6) * np.pi / 3]
    rings = [SQUARE, L_SHAPE, hexagon, [(0, 8), (4, 8), (4, 12), (0, 12)], [(4, 8), (5, 8), (5, 9), (4, 9)]]
    p, q = (np.vstack([rng.integers(-2, 14, (60, 2)) / 1.0, rng.uniform(-2, 13, (60, 2)), np.array(SQUARE[:4], float)]) for _ in range(2))
    q[:9] = p[:9]
    assert [paths.sides(r) is None for r in Zones(rings).rings] == [False, True, False, False, False]
    monkeypatch.setattr(paths, "MESH", 1000)
    for dense in (128, 0):
        monkeypatch.setattr(paths, "DENSE", dense)
        one, other = np.repeat(p, len(q), 0), np.tile(q, (len(p), 1))
        z = Zones(rings)
        assert np.array_equal(z.sights(p, q).ravel(), z.sight(one, other))
        parts = list(z.meshes(p, q))
        assert len(parts) > 1 and np.array_equal(np.vstack([far for _, far in parts]).ravel(), z.ways(one, other, points=False))


def test_a_matrix_comes_of_blocks_not_of_pairs(spark, monkeypatch):
    """Several runs, equal ids and missing places: the rows of the pairs one by one, with no row for a pair on the way."""
    rows = [(r, n, 146 + (n * 7919 + r) % 10007 / 10007, -17 + n * 104729 % 10009 / 10009) for r, most in ((0, 70), (1, 9), (2, 1)) for n in range(most)]
    nodes = spark.createDataFrame([*rows, (0, 16, 146.5, -16.5), (0, 500, None, -16.5), (1, None, 146.5, -16.5)], "run_id int, node_id bigint, x double, y double")
    zones = fx.obstacles(spark, SF)
    monkeypatch.setattr(paths, "BLOCK", 17)
    m = paths.distance_matrix(nodes, zones, path=False)
    assert "_part" not in m._jdf.queryExecution().toString() and tasks(m) > 1
    one = paths.feasible_paths(paths.all_pairs(nodes), zones, path=False)
    want = one.select("run_id", "i", "j", "dist_m").union(one.select("run_id", "j", "i", "dist_m"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(m) == key(want) and m.dtypes == want.dtypes
    assert key(paths.distance_matrix(nodes, zones, path=False, digits=4)) == key(want.withColumn("dist_m", F.round("dist_m", 4)))


def plain_kmeans(x, k, rng, tol=0.01):
    """Every point with every seed and every centre, one cluster after the other."""
    seeds, d = [x[rng.integers(len(x))]], None
    while len(seeds) < k:
        last = ((x - seeds[-1]) ** 2).sum(1)
        d = last if d is None else np.minimum(d, last)
        seeds.append(x[rng.choice(len(x), p=d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x)))])
    c, before = np.array(seeds), np.inf
    while True:
        m = ((x[:, None] - c) ** 2).sum(2)
        label, near = m.argmin(1), m.min(1)
        cost = float(near.sum())
        for j in range(k):
            if (label == j).any():
                c[j] = x[label == j].mean(0)
            else:
                far = int(near.argmax())
                near[far] = ((x[far] - c[j]) ** 2).sum()
                c[j], label[far] = x[far], j
        if before - cost <= tol * max(cost, 1e-300) and np.isfinite(before):
            return label
        before = cost


def test_many_clusters_are_the_plain_ones_without_all_distances(monkeypatch):
    """Also with equal points, more clusters than places, far outliers, and points on a line."""
    from squadron.kernel import cluster

    rng = np.random.default_rng(12)
    spread, lattice = rng.random((1500, 3)), rng.integers(0, 20, (1200, 2)) / 1.0
    sets = [(spread, 500), (lattice, 300), (lattice, 500), (rng.normal(size=(1200, 3)) ** 5, 400), (spread * [1, 0, 0], 400), (spread[:90], 7)]
    seen, whole = [], cluster.nearest_of_all
    monkeypatch.setattr(cluster, "nearest_of_all", lambda x, c: seen.append(len(x) * len(c)) or whole(x, c))
    for x, k in sets:
        assert cluster.kmeans(x, k, np.random.default_rng(k)).tolist() == plain_kmeans(x, k, np.random.default_rng(k)).tolist()
        c = x[rng.choice(len(x), k)]
        want = whole(x, c)
        for way in (cluster.nearest, cluster.nearest_by_halves):
            assert all(np.array_equal(a, b) for a, b in zip(way(x, c), want, strict=True))
    seen.clear()
    many = rng.random((20_000, 3))
    cluster.nearest(many, many[:4000])
    assert sum(seen) < 20_000 * 4000 / 20


def test_restarts_share_one_row_of_a_run(spark):
    """The plan deals a row a restart, not a row a point and restart, and the best restart is that of the kernel."""
    from squadron.kernel import cluster
    from squadron.operators import clustering

    at = [(r, n, float((n * 37 + r) % 101), float(n * 53 % 97)) for r in (3, 8) for n in range(60 + r)]
    points = spark.createDataFrame(at, "run_id bigint, node_id bigint, x double, y double").repartition(3)
    made = clustering.capped_kmeans(points, 9, seed=5, n_restarts=4)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    got = sorted(map(tuple, made.collect()))
    want = []
    for run in (3, 8):
        x = np.array([p[2:] for p in at if p[0] == run])
        tries = [np.unique(cluster.capped_kmeans(x, 9, np.random.default_rng([5, run, k])), return_inverse=True)[1] for k in range(4)]
        best = min(range(4), key=lambda k: (round(cluster.score(x, tries[k]), 6), k))
        want += [(run, n, int(c) + 1) for n, c in enumerate(tries[best])]
    assert got == want
