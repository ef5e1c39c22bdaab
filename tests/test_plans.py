"""Invariants of whole plans, each as a count of violations."""

import json

import pytest
from pyspark.sql import functions as F

from squadron.operators import clustering, paths, regions, spatial, tours
from squadron.plans import layers, solve
from squadron.plans.queries import Inputs
from squadron.schemas import Vessel, half
from squadron.sources import fixtures as fx
from squadron.sources import problem as src
from squadron.sources import sinks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def problem(spark):
    return Inputs(spark, SF).problem


@pytest.fixture(scope="module")
def history(spark, problem):
    return solve.solve(problem, restarts=3, chains=2, min_iters=40, max_iters=40, events=[2, 3]).cache()


@pytest.fixture(scope="module")
def tabs(history, problem):
    return solve.tables(history, problem)


def test_every_target_is_served_once(history, problem):
    n = problem.targets.points.count()
    first = history.where("event_idx = 0")
    nodes, stops = first.select(F.inline("nodes")), first.select(F.explode("sorties").alias("s")).select(F.explode("s.stops").alias("node_id"))
    assert nodes.count() == n == stops.count() == stops.distinct().count() == nodes.select("node_id").distinct().count()


def test_capacities(history):
    r = history.select(F.inline("sorties"), "event_idx", "run_id")
    assert r.where(F.size("stops") > 2).count() == 0
    assert r.groupBy("run_id", "event_idx", "cluster_id").count().where("count > 3").count() == 0


def test_legs_and_waypoints(tabs, history):
    n = history.select("run_id", "event_idx", F.size("order").alias("n"))
    w = tabs.waypoints.groupBy("run_id", "event_idx").count().join(n, ["run_id", "event_idx"])
    assert w.where("count <> 2 * n + 2").count() == 0
    assert tabs.legs.groupBy("run_id", "event_idx").count().join(n, ["run_id", "event_idx"]).where("count <> 2 * n + 1").count() == 0
    assert tabs.sequence.groupBy("run_id", "event_idx").count().join(n, ["run_id", "event_idx"]).where("count <> n + 2").count() == 0
    assert tabs.legs.where("dist_m = double('infinity') or size(path) < 1").count() == 0


def test_sortie_ends_are_waypoints(tabs):
    w = tabs.waypoints.select("run_id", "event_idx", "wp_idx", "x", "y")
    last = tabs.sortie_legs.groupBy("run_id", "event_idx", "cluster_seq", "sortie_id").agg(F.min_by("path", "leg_idx").alias("a"), F.max_by("path", "leg_idx").alias("b"))
    p = last.join(w, (w.run_id == last.run_id) & (w.event_idx == last.event_idx) & (w.wp_idx == 2 * F.col("cluster_seq")))
    assert p.where((F.element_at("a", 1)["x"] != F.col("x")) | (F.element_at("a", 1)["y"] != F.col("y"))).count() == 0 and p.count() == last.count()
    q = last.join(w, (w.run_id == last.run_id) & (w.event_idx == last.event_idx) & (w.wp_idx == 2 * F.col("cluster_seq") + 1))
    assert q.where((F.element_at("b", -1)["x"] != F.col("x")) | (F.element_at("b", -1)["y"] != F.col("y"))).count() == 0


def test_no_waypoint_in_a_zone(tabs, problem):
    w = tabs.waypoints.select(F.xxhash64("event_idx", "wp_idx").alias("node_id"), "x", "y")
    assert spatial.excluded(w, problem.zones).count() == 0


def test_no_path_crosses_a_zone(spark, tabs):
    pairs = sinks.export_routes(tabs.legs, ("run_id", "event_idx")).select(F.col("line")[0]["x"].alias("ax"), F.col("line")[0]["y"].alias("ay"), F.col("line")[1]["x"].alias("bx"), F.col("line")[1]["y"].alias("by"))
    assert spatial.visible_pairs(pairs, fx.obstacles(spark, SF)).count() == pairs.count()


def test_prefix_before_an_event_stays(history):
    a, b = history.where("event_idx = 0").first(), history.where("event_idx = 1").first()
    assert a.order[:1] == b.order[:1] and a.points[:3] == b.points[:3]


def test_annealing_does_not_harm(spark, problem):
    first = solve.initial_solution(problem, restarts=3).cache()
    better = solve.improve_solution(first, problem, chains=2, min_iters=40, max_iters=40)
    assert better.first().hours <= first.first().hours + 1e-12
    trace = [r.best for r in better.select(F.inline("trace")).orderBy("iter").collect()]
    assert trace == sorted(trace, reverse=True) and len(trace) == 40
    moved = solve.optimise_waypoints(first, problem, generations=3)
    assert moved.first().hours <= first.first().hours + 1e-12
    assert solve.improve_solution(first, problem, low=99).first().hours == first.first().hours


def test_partitions_do_not_matter(spark, problem):
    t = problem.targets.points
    got = [sorted(map(tuple, clustering.capped_kmeans(t.repartition(n), 6, n_restarts=3).collect())) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2]


def test_matrix_is_symmetric(spark):
    z = fx.obstacles(spark, SF)
    m = paths.distance_matrix(fx.sites(spark, SF).where("node_id < 15").withColumn("run_id", F.lit(0)), z).cache()
    other = m.select("run_id", F.col("i").alias("j"), F.col("j").alias("i"), F.col("dist_m").alias("d"))
    assert m.join(other, ["run_id", "i", "j"]).where("d <> dist_m and not abs(d - dist_m) <= 1e-6").count() == 0
    direct = paths.distance_matrix(fx.sites(spark, SF).where("node_id < 15").withColumn("run_id", F.lit(0))).select("i", "j", F.col("dist_m").alias("d"))
    assert m.join(direct, ["i", "j"]).where("dist_m < d - 1e-6").count() == 0


def test_regions_and_polygons(spark):
    cells = spark.createDataFrame([(0, 0), (1, 0), (3, 0), (3, 1), (2, 2), (1, 1), (7, 7)], "ix int, iy int")
    got = {}
    for r in regions.cell_regions(cells).collect():
        got.setdefault(r.label, set()).add((r.ix, r.iy))
    assert sorted(map(sorted, got.values())) == [[(0, 0), (1, 0), (1, 1)], [(2, 2)], [(3, 0), (3, 1)], [(7, 7)]]
    assert sorted(r.ring_no for r in regions.polygonise(cells).collect()) == [0, 0, 0, 0]


def test_union_and_adjusting(spark):
    d = fx.boxes(spark, SF).select((F.col("row_idx") + 1).alias("poly_idx"), "ring")
    whole = regions.unioned(regions.buffered(d.where("poly_idx in (1, 2, 25)"), 0.01))
    assert whole.count() == 2
    again = regions.unioned(whole)
    assert again.count() == 2
    z = fx.obstacles(spark, SF).select("poly_idx", "ring")
    p = fx.sites(spark, SF)
    assert spatial.excluded(p, z).count() > 0
    out = regions.adjusted(z, p)
    inside = spatial.containing(p, z).where("poly_idx > 0").groupBy("poly_idx").count()
    for r in out.join(inside, "poly_idx").collect():
        assert len(r.ring) == 5 + r["count"]


def test_load_problem(spark, tmp_path):
    def feature(x, y, s, props=None):
        return {"type": "Feature", "properties": props or {}, "geometry": {"type": "Polygon", "coordinates": [[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]}}

    def write(name, features):
        (tmp_path / name).write_text(json.dumps({"type": "FeatureCollection", "features": features}))
        return str(tmp_path / name)

    targets = write("targets.geojson", [feature(146 + i * 0.1, -17 + j * 0.1, 0.01) for i in range(6) for j in range(6)] + [feature(150, 0, 0.01)])
    study, noise = write("study.geojson", [feature(145.9, -17.1, 1.2)]), write("noise.geojson", [feature(146, -17, 0.3, {"Hs_MEAN": "0.4"}), feature(146, -17, 0.6, {"Hs_MEAN": "0.9"})])
    cells = str(tmp_path / "cells")
    spark.createDataFrame([(i, j, -3.0 if (i, j) in ((2, 2), (2, 3), (6, 6)) else -30.0) for i in range(12) for j in range(12)], "ix int, iy int, v double").write.parquet(cells)
    for debug in (True, False):
        p = src.load_problem(spark, targets, study, cells, noise, (145.95, -17.05), -10.0, -5.0, 0.2, 0.075, 3, 2, cell=(0.1, 146.0, -17.0), output_dir=str(tmp_path / "cache"), debug=debug)
        assert p.targets.points.count() == 36 and p.zones.where("zone_set = 'tender'").count() == 2
        values = {r.disturbance_value for r in p.targets.disturbance.collect()}
        assert values == {0.4, 0.9}
    assert p.fleet.first().w_ms == half(0.2) != 0.2


def test_vessel():
    assert Vessel(weighting=0.2).weighting == 0.199951171875
    with pytest.raises(ValueError, match="capacity, number"):
        Vessel(capacity=0, number=-1)


def test_route_expressions(spark):
    d = spark.createDataFrame([([1, 2, 3, 4, 5],)], "r array<int>")
    got = d.select(tours.swap(F.col("r"), 2, 4).alias("s"), tours.orient(F.col("r"), F.lit(3)).alias("o")).first()
    assert got.s == [1, 4, 3, 2, 5] and got.o == [3, 4, 5, 1, 2]
    with pytest.raises(Exception, match="should lead"):
        d.select(tours.orient(F.col("r"), F.lit(9))).collect()


def test_layers(history, tabs, problem):
    out = layers.solution(problem.targets.points, problem.zones.where("zone_set = 'ms'"), problem.fleet, tabs.sequence.where("event_idx = 0"), tabs.legs.where("event_idx = 0"), tabs.sortie_legs.where("event_idx = 0"))
    assert {r.layer for r in out.select("layer").distinct().collect()} == {"depot", "targets", "exclusions", "zone_labels", "sequence", "route", "tenders"}
    hours = history.where("event_idx = 0").select("run_id", "hours")
    assert layers.compared(hours, hours).first().gain == 0


def test_event_stream(spark, tmp_path):
    from squadron.streaming import events

    kind = "run_id long, place int, ts timestamp, event_id long"
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    spark.createDataFrame([(0, 3, t, 1), (0, 2, t, 2), (1, 5, t, 3), (0, 3, t, 4)], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    events.run_stream(spark, stream, str(tmp_path / "cp"), lambda b, n: got.extend((r.run_id, r.event_idx, r.place) for r in b.collect()))
    assert sorted(got) == [(0, 1, 2), (0, 2, 3), (1, 1, 5)]
    assert events.disturbance_events(spark.read.parquet(f"{SF}/events.parquet")).count() == 2


def test_random_points(spark):
    z, o = fx.boxes(spark, SF).where("row_idx % 3 = 0").select("ring"), fx.obstacles(spark, SF).select("ring")
    p = src.random_points(spark, 30, z, o, (146.0, 147.0, -17.0, -16.0), seed=3)
    assert p.count() == 30 and spatial.excluded(p, o).count() == 0 and spatial.excluded(p, z).count() == 30


def test_local_search_on_tables(spark):
    from squadron.operators import search

    x = Inputs(spark, SF)
    stops = x.sorties.where("stop_idx <= 8").select("run_id", "cluster_id", "sortie_id", "stop_idx", "x", "y")
    from squadron.operators.metrics import legs, route_length

    keys = ("run_id", "cluster_id", "sortie_id")
    before = route_length(legs(stops, keys, "stop_idx"), *keys).withColumnRenamed("dist_m", "before")
    after = route_length(legs(search.two_opt_sorties(stops), keys, "stop_idx"), *keys)
    both = before.join(after, list(keys))
    assert both.where("dist_m > before + 1e-6").count() == 0 and both.where("dist_m < before - 1").count() > 0
    made = search.tender_sorties(x.targets, tours.tender_ends(x.points), 3, 4)
    assert made.groupBy("run_id", "cluster_id", "sortie_id").count().where("count > 4 or sortie_id > 3").count() == 0
    assert made.count() == made.select("node_id").distinct().count() == 300
    tour = search.two_opt_tour(x.seq, fx.obstacles(spark, SF)).collect()
    assert sorted(r.cluster_id for r in tour if r.run_id == 0) == [0, 0, 1, 6, 11, 16, 21]


def test_every_target_gets_a_sortie(spark):
    from squadron.plans.queries import QUERIES

    made = QUERIES["i8_tender_sorties"](spark, SF)
    nodes = fx.targets(spark, SF)
    assert made.count() == nodes.count() and nodes.join(made, ["run_id", "cluster_id", "node_id"], "left_anti").count() == 0
    assert made.where(f"sortie_id > {fx.N_TENDERS}").count() == 0


def test_queries_run_their_whole_tables(spark):
    from squadron.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert QUERIES["i5_two_opt_sorties"](spark, SF).count() == fx.sorties(spark, SF).count()
    assert QUERIES["e9_assignment"](spark, SF).select("a").distinct().count() == fx.sites(spark, SF).count()
    zones = QUERIES["d5_prepared_zones"](spark, sf)
    assert {r.poly_idx for r in spatial.containing(fx.boxes(spark, sf).select(F.col("row_idx").alias("node_id"), (F.col("x0") + 0.1).alias("x"), (F.col("y0") + 0.1).alias("y")), zones).select("poly_idx").collect()}.isdisjoint({0})
    runs = {r.run_id for r in QUERIES["h2_disturbed_clusters"](spark, sf).select("run_id").distinct().collect()}
    assert runs == {r.run_id for r in fx.targets(spark, sf).select("run_id").distinct().collect()}


@pytest.mark.parametrize("sf, least", [("/root/testdata/sf0.01", 1), ("/root/testdata/sf0.1", 10)])
def test_problem_has_every_free_site(spark, sf, least):
    p = Inputs(spark, sf).problem
    free = spatial.excluded(fx.sites(spark, sf), fx.obstacles(spark, sf), how="left_anti").select("node_id").collect()
    got = p.targets.points.select("run_id", "node_id").collect()
    assert sorted(r.node_id for r in got) == sorted(r.node_id for r in free)
    assert sorted(r.node_id for r in p.targets.disturbance.collect()) == sorted(r.node_id for r in free)
    assert {r.run_id for r in got} == {r.run_id for r in p.fleet.collect()} and p.fleet.count() == least


def test_two_unlike_fleets_together_are_each_alone(spark):
    """Two fleets that share node ids, with other depots, zones, boats, stops and sites: each plan is that of its own."""
    from squadron.functions.geo import box
    from squadron.schemas import Problem, Targets

    fleet = spark.createDataFrame([(0, 146.0, -17.0, 0.2, 0.075, 3, 2), (1, 146.9, -16.1, 0.3, 0.1, 1, 1)], "run_id bigint, depot_x double, depot_y double, w_ms double, w_t double, n_tenders tinyint, t_cap smallint")
    places = [(r, n, 146.1 + 0.11 * n + 0.02 * r, -16.9 + 0.09 * n * (1 + r) % 0.7) for r in (0, 1) for n in range(1, 7)]
    points = spark.createDataFrame(places, "run_id bigint, node_id bigint, x double, y double")
    zones = spark.createDataFrame([(0, 1, 146.3, -16.95), (1, 1, 146.75, -16.4), (None, 2, 146.02, -16.2)], "run_id bigint, poly_idx int, x double, y double")
    zones = zones.select("run_id", "poly_idx", box(F.col("x"), F.col("y"), F.col("x") + 0.05, F.col("y") + 0.05).alias("ring"))
    zones = zones.withColumn("zone_set", F.lit("ms")).union(zones.withColumn("zone_set", F.lit("tender")))
    values = points.select("run_id", "node_id", (F.col("node_id") % 3 / 10 + F.col("run_id")).alias("disturbance_value"))

    def problem(run=None):
        own = lambda df: df if run is None else df.where(F.col("run_id") == run)
        return Problem(own(fleet), Targets(own(points), own(values)), zones if run is None else zones.where(F.col("run_id").isNull() | (F.col("run_id") == run)))

    solved = lambda p: {(r.run_id, r.event_idx): (r.order, r.hours, r.total, r.sorties) for r in solve.solve(p, restarts=2, chains=2, min_iters=20, max_iters=20, events=[2]).collect()}
    both = solved(problem())
    assert both == {**solved(problem(0)), **solved(problem(1))} and len(both) == 4
    assert {r.run_id: (len(r.ms_zones), len(r.t_zones)) for r in solve.fleets(problem()).collect()} == {0: (2, 2), 1: (2, 2)}
    for run, cap in ((0, 2), (1, 1)):
        order, _, _, sorties = both[run, 0]
        assert sorted(n for s in sorties for n in s.stops) == [1, 2, 3, 4, 5, 6] and max(len(s.stops) for s in sorties) <= cap
        assert len(order) == (1 if run == 0 else 6)
    alone = [clustering.disturbed(points.where(f"run_id = {r}").withColumn("cluster_id", F.lit(1).cast("bigint")), values, 2, 3) for r in (0, 1)]
    together = clustering.disturbed(points.withColumn("cluster_id", F.lit(1).cast("bigint")), values, 2, 3)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(together) == sorted(key(alone[0]) + key(alone[1]))
