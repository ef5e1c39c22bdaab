"""Registered queries that keep out of zones, and those on shapes; their SQL has its own shortest paths.

The obstacles are boxes, so SQL can find ways round them: a segment crosses a box's interior if it is inside on both axes
for a common stretch, corners that see each other make a graph, and four rounds of joining ways at common ends, each way
kept at its shortest, cover sixteen edges.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from squadron.functions import geo
from squadron.functions.session import checkpointed
from squadron.operators import clustering, metrics, paths, regions, tours
from squadron.plans import layers
from squadron.plans.queries import Inputs, from_depot, query, rounded
from squadron.sources import fixtures as fx
from squadron.sources import sinks
from squadron.sources.fixtures import metres

METRES = 4


def _axis(p: str, d: str, a: str, b: str) -> tuple[str, str]:
    """SQL of the parts of a segment at which it enters and leaves a strip."""
    leave = f"CASE WHEN {d} = 0 THEN CASE WHEN {p} > {a} AND {p} < {b} THEN 1 ELSE -1 END ELSE greatest(({a} - {p}) / {d}, ({b} - {p}) / {d}) END"
    return f"CASE WHEN {d} = 0 THEN 0 ELSE least(({a} - {p}) / {d}, ({b} - {p}) / {d}) END", leave


def enters(ax: str, ay: str, bx: str, by: str) -> tuple[str, str]:
    """SQL of the parts of a segment between which it lies in box ``z``."""
    x, y = _axis(ax, f"({bx} - {ax})", "z.x0", "z.x1"), _axis(ay, f"({by} - {ay})", "z.y0", "z.y1")
    return f"greatest(0, {x[0]}, {y[0]})", f"least(1, {x[1]}, {y[1]})"


def sees(ax: str, ay: str, bx: str, by: str) -> str:
    a, z = enters(ax, ay, bx, by)
    return f"NOT EXISTS (SELECT 1 FROM obstacles z WHERE {z} > {a} + 1e-9)"


def covered(x: str, y: str) -> str:
    return f"EXISTS (SELECT 1 FROM obstacles z WHERE {x} > z.x0 AND {x} < z.x1 AND {y} > z.y0 AND {y} < z.y1)"


def text(x: str, y: str) -> str:
    return f"printf('%.6f %.6f', {x}, {y})"


_SHORTER = "{b} AS (SELECT p.s, q.t, min(p.w + q.w) AS w, arg_min(list_concat(p.p, q.p[2:]), p.w + q.w) AS p FROM {a} p JOIN {a} q ON p.t = q.s GROUP BY p.s, q.t)"
CORNERS = f"""corners AS (SELECT poly_idx, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y FROM obstacles),
verts AS (SELECT row_number() OVER (ORDER BY x, y) AS v, x, y FROM (SELECT DISTINCT x, y FROM corners) WHERE NOT {covered("x", "y")}),
w1 AS (SELECT a.v AS s, b.v AS t, {metres("a.x", "a.y", "b.x", "b.y")} AS w, [{text("a.x", "a.y")}, {text("b.x", "b.y")}] AS p FROM verts a JOIN verts b ON a.v <> b.v WHERE {sees("a.x", "a.y", "b.x", "b.y")}
 UNION ALL SELECT v, v, 0.0::DOUBLE, [{text("x", "y")}] FROM verts),
{", ".join(_SHORTER.format(a=f"w{1 << k}", b=f"w{2 << k}") for k in range(4))}"""


def ways(pairs: str, name: str = "") -> str:
    """CTEs from ``pairs`` (id, ax, ay, bx, by) to ``way`` (id, dist_m, path): the shortest ways round the boxes."""
    n = name
    return f"""pr{n} AS ({pairs}),
bad{n} AS (SELECT id FROM pr{n} WHERE {covered("ax", "ay")} OR {covered("bx", "by_")}),
direct{n} AS (SELECT id, {metres("ax", "ay", "bx", "by_")} AS dist_m, [{text("ax", "ay")}, {text("bx", "by_")}] AS path FROM pr{n} WHERE id NOT IN (SELECT id FROM bad{n}) AND {sees("ax", "ay", "bx", "by_")}),
rest{n} AS (SELECT * FROM pr{n} WHERE id NOT IN (SELECT id FROM bad{n}) AND id NOT IN (SELECT id FROM direct{n})),
out{n} AS (SELECT id, v, {metres("ax", "ay", "x", "y")} AS d FROM rest{n}, verts WHERE {sees("ax", "ay", "x", "y")}),
back{n} AS (SELECT id, v, {metres("bx", "by_", "x", "y")} AS d FROM rest{n}, verts WHERE {sees("bx", "by_", "x", "y")}),
via{n} AS (SELECT o.id, min(o.d + w + i.d) AS dist_m, arg_min(p, o.d + w + i.d) AS p FROM out{n} o JOIN w16 ON w16.s = o.v JOIN back{n} i ON i.id = o.id AND i.v = w16.t GROUP BY o.id),
way{n} AS (SELECT id, CASE WHEN ax = bx AND ay = by_ THEN 0.0::DOUBLE ELSE dist_m END AS dist_m, CASE WHEN ax = bx AND ay = by_ THEN path[1:1] ELSE path END AS path FROM direct{n} JOIN pr{n} USING (id)
 UNION ALL SELECT id, dist_m, list_concat(list_concat([{text("ax", "ay")}], list_filter(p, lambda v: v <> {text("ax", "ay")} AND v <> {text("bx", "by_")})), [{text("bx", "by_")}]) FROM via{n} JOIN rest{n} USING (id)
 UNION ALL SELECT id, 'Infinity'::DOUBLE, [] FROM bad{n})"""


def path_text(path="path"):
    return F.array_join(F.transform(path, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), ";")


def rings_of(s, d):
    return fx.obstacles(s, d).select("poly_idx", "ring")


# --- ways round the zones ---
_DEPOT = "SELECT node_id AS id, CAST(146.175 AS DOUBLE) AS ax, CAST(-16.84 AS DOUBLE) AS ay, x AS bx, y AS by_ FROM sites"
query("f1_feasible_paths", f", {CORNERS}, {ways(_DEPOT)} SELECT id AS node_id, round(dist_m, {METRES}) AS dist_m, array_to_string(path, ';') AS path FROM way")(
    lambda s, d: paths.feasible_paths(from_depot(s, d).drop("pair_id"), rings_of(s, d)).select("node_id", F.round("dist_m", METRES).alias("dist_m"), path_text().alias("path"))
)
query("e5_distances_from_depot", f", {CORNERS}, {ways(_DEPOT)} SELECT id AS node_id, round(dist_m, {METRES}) AS dist_m FROM way")(lambda s, d: rounded(paths.distances_from(fx.DEPOT, fx.sites(s, d), rings_of(s, d)), METRES, "dist_m"))
_PAIRS = "SELECT a.node_id || '-' || b.node_id AS id, a.node_id AS i, b.node_id AS j, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM sites a JOIN sites b ON a.node_id < b.node_id"
query("e3_feasible_matrix", f", {CORNERS}, {ways(_PAIRS)} SELECT 0 AS run_id, unnest([i, j]) AS i, unnest([j, i]) AS j, round(dist_m, {METRES}) AS dist_m FROM way JOIN pr USING (id)")(
    lambda s, d: paths.distance_matrix(fx.sites(s, d).withColumn("run_id", F.lit(0)), rings_of(s, d), path=False, digits=METRES)
)
query("f3_visibility_edges", f", {CORNERS} SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, round(w, {METRES}) AS w FROM w1 JOIN verts a ON a.v = s JOIN verts b ON b.v = t WHERE s <> t")(
    lambda s, d: paths.visibility_edges(rings_of(s, d)).select(F.col("src.x").alias("ax"), F.col("src.y").alias("ay"), F.col("dst.x").alias("bx"), F.col("dst.y").alias("by"), F.round("w", METRES).alias("w"))
)
_IN, _OUT = enters("CAST(146.175 AS DOUBLE)", "CAST(-16.84 AS DOUBLE)", "x", "y")
_HIT = f"hit AS (SELECT node_id, x, y, arg_min(poly_idx, (t, poly_idx)) AS poly_idx FROM (SELECT node_id, x, y, poly_idx, {_IN} AS t FROM sites, obstacles z WHERE {_OUT} > {_IN} + 1e-9) GROUP BY ALL)"
query("f9_nearest_crossed", f", {_HIT} SELECT node_id AS pair_id, poly_idx FROM hit")(lambda s, d: paths.crossed(from_depot(s, d), rings_of(s, d)))
query("f9_nearest_crossed_but_visited", f", {_HIT.replace('FROM sites, obstacles z WHERE', 'FROM sites, obstacles z WHERE poly_idx NOT IN (1, 4) AND')} SELECT node_id AS pair_id, poly_idx FROM hit")(lambda s, d: paths.crossed(from_depot(s, d), rings_of(s, d), skip=(1, 4)))
_TURN = "atan2((x - 146.175) * (cy + 16.84) - (y + 16.84) * (cx - 146.175), (x - 146.175) * (cx - 146.175) + (y + 16.84) * (cy + 16.84))"
query("f5_widest_points", f""", {_HIT}, c AS (SELECT node_id, poly_idx, k, cx, cy, round({_TURN}, 12) AS a FROM (SELECT node_id, hit.poly_idx, x, y, unnest([x0, x1, x1, x0]) AS cx, unnest([y0, y0, y1, y1]) AS cy, unnest([0, 1, 2, 3]) AS k FROM hit JOIN obstacles USING (poly_idx)))
 SELECT node_id AS pair_id, poly_idx, arg_max(cx, (a, -k)) FILTER (a > 0) AS lx, arg_max(cy, (a, -k)) FILTER (a > 0) AS ly, arg_max(cx, (-a, -k)) FILTER (a < 0) AS rx, arg_max(cy, (-a, -k)) FILTER (a < 0) AS ry FROM c GROUP BY ALL""")(
    lambda s, d: paths.widest_points(from_depot(s, d), rings_of(s, d)).select("pair_id", "poly_idx", F.col("left.x").alias("lx"), F.col("left.y").alias("ly"), F.col("right.x").alias("rx"), F.col("right.y").alias("ry"))
)


def moved(x: str, y: str) -> tuple[str, str]:
    """SQL of a point moved to the nearest corner of the box that holds it."""
    near = f"(SELECT arg_min({{'x': c.x, 'y': c.y}}, (round(pow(c.x - {x}, 2) + pow(c.y - {y}, 2), 15), c.x, c.y)) FROM corners c JOIN obstacles z USING (poly_idx) WHERE {x} > z.x0 AND {x} < z.x1 AND {y} > z.y0 AND {y} < z.y1)"
    return f"coalesce({near}.x, {x})", f"coalesce({near}.y, {y})"


_X, _Y = moved("t.x", "t.y")
query("f10_moved_out", f", {CORNERS} SELECT node_id, {_X} AS x, {_Y} AS y FROM targets t")(lambda s, d: paths.moved_out(fx.targets(s, d).select("node_id", "x", "y"), rings_of(s, d)))

# --- tours that keep out of zones ---
_CX, _CY = moved("c0.cx", "c0.cy")
_NODES = "SELECT run_id, cluster_id AS id, cx AS x, cy AS y FROM zcent UNION ALL SELECT run_id, 0, depot_x, depot_y FROM fleet"
_RUNS = f"SELECT a.run_id || ':' || a.id || '-' || b.id AS id, a.run_id AS run_id, a.id AS i, b.id AS j, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM ({_NODES}) a JOIN ({_NODES}) b ON a.run_id = b.run_id AND a.id < b.id"
TOUR = f"""{CORNERS}, zcent AS (SELECT run_id, cluster_id, {_CX} AS cx, {_CY} AS cy FROM cent c0), {ways(_RUNS, "m")},
far AS (SELECT run_id, list({{'i': i, 'j': j, 'd': round(dist_m, 6)}}) AS m FROM waym JOIN prm USING (id) GROUP BY run_id),
zwalk(run_id, m, rest, tour) AS (
 SELECT run_id, any_value(m), list({{'id': cluster_id, 'x': cx, 'y': cy}}), any_value([{{'id': CAST(0 AS BIGINT), 'x': depot_x, 'y': depot_y}}]) FROM zcent JOIN fleet USING (run_id) JOIN far USING (run_id) GROUP BY run_id
 UNION ALL SELECT run_id, m, list_filter(rest, lambda p: p.id <> best.id), list_append(tour, {{'id': best.id, 'x': best.x, 'y': best.y}}) FROM (SELECT *, list_min(list_transform(rest, lambda p: {{'d': list_filter(m, lambda e: e.i = least(p.id, tour[-1].id) AND e.j = greatest(p.id, tour[-1].id))[1].d, 'id': p.id, 'x': p.x, 'y': p.y}})) AS best FROM zwalk WHERE len(rest) > 0)),
zwhole AS (SELECT run_id, list_append(tour, tour[1]) AS tour FROM zwalk WHERE len(rest) = 0),
zseq AS (SELECT run_id, CAST(k AS INTEGER) AS seq, tour[k].id AS cluster_id, tour[k].x AS lon, tour[k].y AS lat FROM (SELECT run_id, tour, unnest(range(1, len(tour) + 1)) AS k FROM zwhole))"""


def ztour(x):
    return checkpointed(tours.nearest_neighbour(x.centroids, x.fleet, rings_of(x.spark, x.d)))


query("i1_nearest_neighbour", f", {TOUR} SELECT run_id, seq, cluster_id, lon, lat FROM zseq")(lambda s, d: ztour(Inputs(s, d)))
_WX, _WY = moved("t.x", "t.y")
POINTS = f"""{TOUR},
znear AS (SELECT *, lag(cluster_id) OVER w AS b, lag(lon) OVER w AS bx, lag(lat) OVER w AS by_, lead(cluster_id) OVER w AS a, lead(lon) OVER w AS ax, lead(lat) OVER w AS ay FROM zseq WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
zinner AS (SELECT run_id, CAST(2 * (seq - 1) AS INTEGER) AS wp_idx, (2 * lon + bx) / 3 AS x, (2 * lat + by_) / 3 AS y, b AS from_id, cluster_id AS to_id FROM znear WHERE a IS NOT NULL AND b IS NOT NULL
 UNION ALL SELECT run_id, CAST(2 * (seq - 1) + 1 AS INTEGER), (2 * lon + ax) / 3, (2 * lat + ay) / 3, cluster_id, a FROM znear WHERE a IS NOT NULL AND b IS NOT NULL),
zwps AS (SELECT run_id, wp_idx, {_WX} AS x, {_WY} AS y, from_id, to_id FROM zinner t
 UNION ALL SELECT run_id, CAST(CASE WHEN b IS NULL THEN 1 ELSE 2 * (seq - 1) END AS INTEGER), lon, lat, cluster_id, cluster_id FROM znear WHERE a IS NULL OR b IS NULL)"""


def zpoints(x):
    return checkpointed(tours.waypoints(ztour(x), rings_of(x.spark, x.d)))


query("i9_waypoints", f", {POINTS} SELECT run_id, wp_idx, round(x, 9) AS x, round(y, 9) AS y, from_id, to_id FROM zwps")(lambda s, d: rounded(zpoints(Inputs(s, d)), 9, "x", "y"))
_LEGS = "SELECT run_id || '-' || wp_idx AS id, run_id, wp_idx AS leg_idx, x AS ax, y AS ay, nx AS bx, ny AS by_ FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM zwps WINDOW w AS (PARTITION BY run_id ORDER BY wp_idx)) WHERE nx IS NOT NULL"
query("e4_feasible_vector", f", {POINTS}, {ways(_LEGS, 'v')} SELECT run_id, CAST(leg_idx AS INTEGER) AS leg_idx, round(dist_m, {METRES}) AS dist_m, array_to_string(path, ';') AS path FROM wayv JOIN prv USING (id)")(
    lambda s, d: paths.feasible_vector(zpoints(Inputs(s, d)).withColumnRenamed("wp_idx", "o"), ("run_id",), "o", rings_of(s, d)).select("run_id", "leg_idx", F.round("dist_m", METRES).alias("dist_m"), path_text().alias("path"))
)
_STOPS = "SELECT run_id || '-' || cluster_id || '-' || sortie_id || '-' || leg_idx AS id, run_id, cluster_id, sortie_id, leg_idx, ax, ay, bx, by_ FROM slegs"
query("i19_sortie_routes", f", {CORNERS}, {ways(_STOPS, 'r')} SELECT run_id, cluster_id, sortie_id, leg_idx, round(dist_m, {METRES}) AS dist_m FROM wayr JOIN prr USING (id)")(
    lambda s, d: rounded(paths.feasible_paths(Inputs(s, d).sortie_legs.drop("dist_m", "cluster_seq"), rings_of(s, d), path=False).select("run_id", "cluster_id", "sortie_id", "leg_idx", "dist_m"), METRES, "dist_m")
)
_MOVED = """SELECT run_id || '-' || cluster_id || '-' || sortie_id || '-' || leg_idx AS id, run_id, cluster_id, sortie_id, leg_idx, CASE WHEN leg_idx = 1 THEN ax + CASE WHEN cluster_id % 2 = 0 THEN 0.013 ELSE 0 END ELSE ax END AS ax, ay, bx,
 CASE WHEN leg_idx = last THEN by_ - CASE WHEN cluster_id % 2 = 0 THEN 0.017 ELSE 0 END ELSE by_ END AS by_, dist_m AS old, cluster_id % 2 = 0 AND leg_idx IN (1, last) AS changed FROM (SELECT *, max(leg_idx) OVER (PARTITION BY run_id, cluster_id, sortie_id) AS last FROM slegs)"""


def with_moved_ends(s, d):
    x = Inputs(s, d)
    even = F.col("cluster_id") % 2 == 0
    ends = tours.tender_ends(x.points).withColumn("ex", F.when(even, F.col("ex") + 0.013).otherwise(F.col("ex"))).withColumn("ly", F.when(even, F.col("ly") - 0.017).otherwise(F.col("ly")))
    out = tours.rebuilt_ends(x.sortie_legs, ends, rings_of(s, d))
    return rounded(out.select("run_id", "cluster_id", "sortie_id", "leg_idx", "dist_m"), METRES, "dist_m")


query("i16_rebuilt_ends", f", {CORNERS}, moves AS ({_MOVED}), {ways('SELECT * FROM moves WHERE changed', 'e')} SELECT run_id, cluster_id, sortie_id, leg_idx, round(CASE WHEN changed THEN waye.dist_m ELSE old END, {METRES}) AS dist_m FROM moves LEFT JOIN waye USING (id)")(with_moved_ends)
def sortie_tours(s, d):
    """Sorties of each cluster from the depot and back."""
    x = Inputs(s, d)
    return rounded(metrics.sortie_tours(x.sorties, x.fleet.select("run_id", "depot_x", "depot_y"), ("run_id", "cluster_id", "sortie_id"), "stop_idx"), 3, "dist_m")


query("g5_sortie_tours", f"""SELECT run_id, cluster_id, sortie_id, round(sum({metres("px", "py", "x", "y")}) + sum(CASE WHEN nx IS NULL THEN {metres("x", "y", "CAST(146.175 AS DOUBLE)", "CAST(-16.84 AS DOUBLE)")} ELSE 0 END), 3) AS dist_m
 FROM (SELECT run_id, cluster_id, sortie_id, x, y, coalesce(lag(x) OVER w, CAST(146.175 AS DOUBLE)) AS px, coalesce(lag(y) OVER w, CAST(-16.84 AS DOUBLE)) AS py, lead(x) OVER w AS nx FROM sorties WINDOW w AS (PARTITION BY run_id, cluster_id, sortie_id ORDER BY stop_idx)) GROUP BY ALL""")(
    lambda s, d: sortie_tours(s, d)
)


# --- clusters matched with earlier ones, plans compared ---
query("e8_cluster_mapping", "SELECT run_id, cluster_id, cluster_id + 100 AS new_id FROM cent")(
    lambda s, d: clustering.cluster_mapping((x := Inputs(s, d)).targets, x.centroids.select("run_id", (F.col("cluster_id") + 100).alias("cluster_id"), (F.col("cx") + 1e-5).alias("cx"), (F.col("cy") - 1e-5).alias("cy")))
)
query("l20_compared_plans", "SELECT run_id, round(hours, 6) AS hours_a, round(m * w_ms, 6) AS hours_b, round(round(hours, 6) - round(m * w_ms, 6), 6) AS gain FROM hours JOIN (SELECT run_id, sum(dist_m) / 1000 / 3.6::DOUBLE AS m FROM legs GROUP BY 1) USING (run_id) JOIN fleet USING (run_id)")(
    lambda s, d: rounded(layers.compared(rounded(metrics.critical_path((x := Inputs(s, d)).legs, x.sortie_legs, x.fleet), 6, "hours"), rounded(metrics.critical_path(x.legs, x.sortie_legs.where("false"), x.fleet), 6, "hours")), 6, "gain")
)


# --- shapes ---
def corners_cut(s, d):
    """Obstacles with a notch: the upper right quarter is missing, so rings are no hulls of their own."""
    b = fx.obstacles(s, d)
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return b.select("poly_idx", F.array(p(x0, y0), p(x1, y0), p(x1, my), p(mx, my), p(mx, y1), p(x0, y1), p(x0, y0)).alias("ring"))


query("c13_in_convex_hull", "SELECT node_id, coalesce((SELECT min(poly_idx) FROM obstacles WHERE x > x0 AND x < x1 AND y > y0 AND y < y1 AND (x - (x0 + x1) / 2) * ((y1 - y0) / 2) + (y - (y0 + y1) / 2) * ((x1 - x0) / 2) < (x1 - x0) * (y1 - y0) / 4), 0) AS poly_idx FROM targets")(
    lambda s, d: paths.hull_zone(fx.targets(s, d).select("node_id", "x", "y"), corners_cut(s, d)).select("node_id", "poly_idx")
)
query("c12_in_notched_zone", "SELECT node_id, coalesce((SELECT min(poly_idx) FROM obstacles WHERE x > x0 AND x < x1 AND y > y0 AND y < y1 AND NOT (x >= (x0 + x1) / 2 AND y >= (y0 + y1) / 2)), 0) AS poly_idx FROM targets")(
    lambda s, d: paths.containing(fx.targets(s, d).select("node_id", "x", "y"), corners_cut(s, d)).select("node_id", "poly_idx")
)


def nicked(s, d):
    """Obstacles with a middle point a hair off one side; those of even number are a hundredth of their size."""
    b = fx.obstacles(s, d).withColumn("k", F.when(F.col("poly_idx") % 2 == 0, F.lit(0.1)).otherwise(F.lit(1.0)))
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, w = F.col("x0"), F.col("y0"), F.lit(0.1) * F.col("k")
    return b.select("poly_idx", F.array(p(x0, y0), p(x0 + w / 2, y0 + 1e-6), p(x0 + w, y0), p(x0 + w, y0 + w), p(x0, y0 + w), p(x0, y0)).alias("ring"))


query("d6_simplified_zones", "SELECT poly_idx, 5 AS n, round(100 * (x1 - x0) * (y1 - y0), 4) AS area FROM obstacles WHERE poly_idx % 2 = 1")(
    lambda s, d: regions.simplify_and_filter(nicked(s, d), 1e-3, 1e-4).select("poly_idx", F.size("ring").alias("n"), F.round(geo.area(F.col("ring")) * 100, 4).alias("area"))
)
_XY = "CASE WHEN k IN (1, 2) THEN x1 ELSE x0 END AS x, CASE WHEN k IN (2, 3) THEN y1 ELSE y0 END AS y"


def spread(df, *keys: str, ring="ring"):
    return df.select(*keys, F.posexplode(ring).alias("k", "p")).select(*keys, "k", "p.x", "p.y")


query("d7_exploded_rings", f", r AS (SELECT CAST(row_idx AS INTEGER) AS poly_idx, x0, x1, y0, y1 FROM boxes UNION ALL SELECT CAST(24 + row_number() OVER (ORDER BY row_idx) AS INTEGER), x0 + 2, x1 + 2, y0, y1 FROM boxes) SELECT poly_idx, CAST(k AS INTEGER) AS k, round(CASE WHEN k IN (1, 2) THEN x1 ELSE x0 END, 9) AS x, round(CASE WHEN k IN (2, 3) THEN y1 ELSE y0 END, 9) AS y FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k)")(
    lambda s, d: rounded(spread(regions.exploded(fx.boxes(s, d).select(F.col("row_idx").alias("poly_idx"), F.array("ring", F.transform("ring", lambda p: F.struct((p["x"] + 2).alias("x"), p["y"].alias("y")))).alias("rings"))), "poly_idx"), 9, "x", "y")
)
query("d8_closed_rings", f"SELECT poly_idx, CAST(k AS INTEGER) AS k, {_XY} FROM obstacles, (SELECT unnest([0, 1, 2, 3, 4]) AS k)")(lambda s, d: spread(fx.obstacles(s, d).select("poly_idx", geo.close_ring(F.slice("ring", 1, 4)).alias("ring")), "poly_idx"))
query("d18_path_parts", f"SELECT poly_idx, 'from' AS part, CAST(k - 2 AS INTEGER) AS k, {_XY} FROM obstacles, (SELECT unnest([2, 3, 4]) AS k) UNION ALL SELECT poly_idx, 'to', CAST(k AS INTEGER), {_XY} FROM obstacles, (SELECT unnest([0, 1, 2]) AS k)")(
    lambda s, d: spread((o := fx.obstacles(s, d)).select("poly_idx", F.lit("from").alias("part"), geo.suffix_from(F.col("ring"), F.get("ring", F.lit(2))).alias("ring")), "poly_idx", "part").union(spread(o.select("poly_idx", F.lit("to").alias("part"), geo.prefix_to(F.col("ring"), F.get("ring", F.lit(2))).alias("ring")), "poly_idx", "part"))
)
query("b3_exclusions", f"SELECT row_number() OVER (PARTITION BY k ORDER BY poly_idx) AS id, 'ms' AS zone_set, CAST(k AS INTEGER) AS k, {_XY} FROM obstacles, (SELECT unnest([0, 1, 2, 3, 4]) AS k)")(lambda s, d: spread(sinks.export_exclusions(fx.obstacles(s, d).withColumn("zone_set", F.lit("ms"))), "id", "zone_set"))
_ENDS = "CAST(k AS INTEGER) AS k, round(CASE WHEN k = 0 THEN ax ELSE bx END, 9) AS x, round(CASE WHEN k = 0 THEN ay ELSE by_ END, 9) AS y"


def routed(legs):
    return legs.withColumn("path", F.array(geo.point("ax", "ay"), geo.point("bx", "by")))


query("b5_mothership_routes", f"SELECT run_id, CAST(leg_idx AS BIGINT) AS id, {_ENDS} FROM legs, (SELECT unnest([0, 1]) AS k)")(
    lambda s, d: rounded(spread(sinks.export_routes(routed(Inputs(s, d).legs)), "run_id", "id", ring="line").withColumn("id", F.col("id").cast("bigint")), 9, "x", "y")
)
query("b7_tender_routes", "SELECT run_id, cluster_id, sortie_id, CAST(2 * leg_idx - 2 + k AS INTEGER) AS k, round(CASE WHEN k = 0 THEN ax ELSE bx END, 9) AS x, round(CASE WHEN k = 0 THEN ay ELSE by_ END, 9) AS y FROM slegs, (SELECT unnest([0, 1]) AS k)")(
    lambda s, d: rounded(spread(sinks.export_tender_routes(routed(Inputs(s, d).sortie_legs)), "run_id", "cluster_id", "sortie_id", ring="line"), 9, "x", "y")
)
query("l38_points_of_flat_list", f"SELECT poly_idx, CAST(k AS INTEGER) AS k, {_XY} FROM obstacles, (SELECT unnest([0, 1, 2, 3]) AS k)")(
    lambda s, d: spread(fx.obstacles(s, d).select("poly_idx", geo.pairs_of(F.flatten(F.transform(F.slice("ring", 1, 4), lambda p: F.array(p["x"], p["y"])))).alias("ring")), "poly_idx")
)
