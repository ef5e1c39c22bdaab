"""Registered queries over the projected inputs, each with the SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadron.functions import geo
from squadron.functions.session import checkpointed
from squadron.operators import clustering, metrics, paths, regions, search, spatial, tours
from squadron.plans import layers, solve
from squadron.schemas import Problem, Targets
from squadron.sources import fixtures as fx
from squadron.sources import problem as src
from squadron.sources import sinks
from squadron.sources.fixtures import metres

#: Sites of one fleet of the problem, about.
FLEET_SITES = 100
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Further inputs for the SQL engine, each built on those before it.
CHAIN = f"""{fx.SQL},
fleet AS (SELECT DISTINCT run_id, CAST(146.175 AS DOUBLE) AS depot_x, CAST(-16.84 AS DOUBLE) AS depot_y, CAST({fx.W_MS} AS DOUBLE) AS w_ms, CAST({fx.W_T} AS DOUBLE) AS w_t FROM targets),
cent AS (SELECT run_id, cluster_id, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy FROM targets GROUP BY ALL),
walk(run_id, rest, tour) AS (
 SELECT run_id, list({{'id': cluster_id, 'x': cx, 'y': cy}}), any_value([{{'id': CAST(0 AS BIGINT), 'x': depot_x, 'y': depot_y}}]) FROM cent JOIN fleet USING (run_id) GROUP BY run_id
 UNION ALL SELECT run_id, list_filter(rest, lambda p: p.id <> best.id), list_append(tour, {{'id': best.id, 'x': best.x, 'y': best.y}}) FROM (SELECT *, list_min(list_transform(rest, lambda p: {{'d': round({metres("tour[-1].x", "tour[-1].y", "p.x", "p.y")}, 6), 'id': p.id, 'x': p.x, 'y': p.y}})) AS best FROM walk WHERE len(rest) > 0)),
whole AS (SELECT run_id, list_append(tour, tour[1]) AS tour FROM walk WHERE len(rest) = 0),
seq AS (SELECT run_id, CAST(k AS INTEGER) AS seq, tour[k].id AS cluster_id, tour[k].x AS lon, tour[k].y AS lat FROM (SELECT run_id, tour, unnest(range(1, len(tour) + 1)) AS k FROM whole)),
near AS (SELECT *, lag(cluster_id) OVER w AS b, lag(lon) OVER w AS bx, lag(lat) OVER w AS by_, lead(cluster_id) OVER w AS a, lead(lon) OVER w AS ax, lead(lat) OVER w AS ay FROM seq WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
wps AS (
 SELECT run_id, CAST(2 * (seq - 1) AS INTEGER) AS wp_idx, (2 * lon + bx) / 3 AS x, (2 * lat + by_) / 3 AS y, b AS from_id, cluster_id AS to_id FROM near WHERE a IS NOT NULL AND b IS NOT NULL
 UNION ALL SELECT run_id, CAST(2 * (seq - 1) + 1 AS INTEGER), (2 * lon + ax) / 3, (2 * lat + ay) / 3, cluster_id, a FROM near WHERE a IS NOT NULL AND b IS NOT NULL
 UNION ALL SELECT run_id, CAST(CASE WHEN b IS NULL THEN 1 ELSE 2 * (seq - 1) END AS INTEGER), lon, lat, cluster_id, cluster_id FROM near WHERE a IS NULL OR b IS NULL),
legs AS (SELECT run_id, CAST(wp_idx AS INTEGER) AS leg_idx, x AS ax, y AS ay, nx AS bx, ny AS by_, {metres("x", "y", "nx", "ny")} AS dist_m FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM wps WINDOW w AS (PARTITION BY run_id ORDER BY wp_idx)) WHERE nx IS NOT NULL),
ends AS (SELECT i.run_id, i.to_id AS cluster_id, i.x AS ex, i.y AS ey, o.x AS lx, o.y AS ly FROM wps i JOIN wps o ON i.run_id = o.run_id AND i.to_id = o.from_id AND o.wp_idx = i.wp_idx + 1 WHERE i.to_id <> 0 AND o.from_id <> 0),
stops AS (
 SELECT run_id, cluster_id, sortie_id, stop_idx, x, y FROM sorties
 UNION ALL SELECT run_id, cluster_id, sortie_id, 0, ex, ey FROM (SELECT DISTINCT run_id, cluster_id, sortie_id FROM sorties) JOIN ends USING (run_id, cluster_id)
 UNION ALL SELECT run_id, cluster_id, sortie_id, n + 1, lx, ly FROM (SELECT run_id, cluster_id, sortie_id, max(stop_idx) AS n FROM sorties GROUP BY ALL) JOIN ends USING (run_id, cluster_id)),
slegs AS (SELECT run_id, CAST(seq - 1 AS INTEGER) AS cluster_seq, cluster_id, sortie_id, CAST(stop_idx + 1 AS INTEGER) AS leg_idx, x AS ax, y AS ay, nx AS bx, ny AS by_, {metres("x", "y", "nx", "ny")} AS dist_m
 FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM stops WINDOW w AS (PARTITION BY run_id, cluster_id, sortie_id ORDER BY stop_idx)) JOIN seq USING (run_id, cluster_id) WHERE nx IS NOT NULL),
per AS (SELECT run_id, cluster_seq, sortie_id, sum(dist_m) AS d FROM slegs GROUP BY ALL),
hours AS (SELECT run_id, between_h + cluster_h AS hours FROM
 (SELECT run_id, sum(dist_m) / 1000 * any_value(w_ms) / 3.6::DOUBLE AS between_h FROM legs JOIN fleet USING (run_id) WHERE leg_idx % 2 = 1 GROUP BY run_id)
 JOIN (SELECT run_id, sum(greatest(longest / 1000 * w_t, within_m / 1000 * w_ms) / 3.6::DOUBLE) AS cluster_h FROM (SELECT run_id, CAST(leg_idx // 2 AS INTEGER) AS cluster_seq, dist_m AS within_m FROM legs WHERE leg_idx % 2 = 0) JOIN (SELECT run_id, cluster_seq, max(d) AS longest FROM per GROUP BY ALL) USING (run_id, cluster_seq) JOIN fleet USING (run_id) GROUP BY run_id) USING (run_id))
"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {CHAIN.rstrip()}{'' if sql.startswith(',') else ' '}{sql}"
        return f

    return register


class Inputs:
    """Frames of the flagship chain, made as they are asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.targets = fx.targets(spark, d)
        lit = lambda v, n: F.lit(v).alias(n)
        self.fleet = self.targets.select("run_id").distinct().select("run_id", lit(fx.DEPOT[0], "depot_x"), lit(fx.DEPOT[1], "depot_y"), lit(fx.W_MS, "w_ms"), lit(fx.W_T, "w_t"), F.lit(fx.N_TENDERS).cast("tinyint").alias("n_tenders"), F.lit(2).cast("smallint").alias("t_cap"))

    @property
    def centroids(self):
        return metrics.centroids(self.targets).drop("nodes")

    @cached_property
    def seq(self):
        """The tours, written once: waypoints, ends and sorties all read them."""
        return checkpointed(tours.nearest_neighbour(self.centroids, self.fleet))

    @property
    def points(self):
        return tours.waypoints(self.seq)

    @property
    def legs(self):
        return metrics.legs(self.points.withColumn("leg_idx", F.col("wp_idx")), ("run_id",), "wp_idx")

    @property
    def sorties(self):
        return fx.sorties(self.spark, self.d)

    @property
    def sortie_legs(self):
        seq = self.seq
        stops = tours.sortie_stops(self.sorties, tours.tender_ends(tours.waypoints(seq)), seq)
        return metrics.legs(stops, ("run_id", "cluster_seq", "cluster_id", "sortie_id"), "stop_idx")

    @property
    def least_cap(self) -> int:
        """Stops of a boat with which the boats serve every node of the largest cluster."""
        most = self.targets.groupBy("run_id", "cluster_id").count().agg(F.max("count")).first()[0]
        return -(-(most or 0) // fx.N_TENDERS)

    @property
    def problem(self):
        """All sites outside the obstacles, dealt to fleets of up to about FLEET_SITES; the obstacles are both zone sets."""
        z = fx.obstacles(self.spark, self.d).select(F.lit(None).cast("bigint").alias("run_id"), "poly_idx", "ring")
        zones = z.withColumn("zone_set", F.lit("ms")).unionByName(z.withColumn("zone_set", F.lit("tender")))
        sites = fx.sites(self.spark, self.d)
        run = (F.col("node_id") % max(1, -(-sites.count() // FLEET_SITES))).cast("bigint").alias("run_id")
        t = spatial.excluded(sites, z, how="left_anti").select(run, "node_id", "x", "y")
        values = spatial.disturbance_of(t, fx.boxes(self.spark, self.d)).select(run, "node_id", "disturbance_value")
        fleet = self.fleet.drop("run_id").distinct().crossJoin(t.select("run_id").distinct()).select(*self.fleet.columns)
        return Problem(fleet, Targets(t, values), zones)


def rounded(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- the flagship and metrics ---


@query("makespan", "SELECT run_id, round(hours, 6) AS hours FROM hours")
def makespan(spark, d):
    x = Inputs(spark, d)
    return rounded(metrics.critical_path(x.legs, x.sortie_legs, x.fleet), 6, "hours")


query("g14_total_distance", "SELECT run_id, round(m * w_ms + t * w_t, 3) AS total FROM (SELECT run_id, sum(dist_m) AS m FROM legs GROUP BY 1) JOIN (SELECT run_id, sum(dist_m) AS t FROM slegs GROUP BY 1) USING (run_id) JOIN fleet USING (run_id)")(
    lambda s, d: rounded(metrics.total_distance((x := Inputs(s, d)).legs, x.sortie_legs, x.fleet), 3, "total")
)
query("g16_cluster_centroids", "SELECT run_id, cluster_id, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy, list_sort(list(node_id)) AS nodes FROM targets GROUP BY ALL")(lambda s, d: metrics.centroids(fx.targets(s, d)))
query("g15_raster_centroids", "SELECT CAST(-v AS INTEGER) AS label, round(avg(ix), 9) AS cx, round(avg(iy), 9) AS cy, count(*) AS cells FROM cells GROUP BY 1")(
    lambda s, d: rounded(metrics.raster_centroids(fx.raster(s, d).withColumn("label", (-F.col("v")).cast("int"))), 9, "cx", "cy")
)
query("g6_sortie_length", "SELECT run_id, cluster_id, sortie_id, round(sum(dist_m), 3) AS dist_m FROM slegs GROUP BY ALL")(lambda s, d: rounded(metrics.route_length(Inputs(s, d).sortie_legs, "run_id", "cluster_id", "sortie_id"), 3, "dist_m"))
query("g10_between_clusters", "SELECT run_id, round(sum(dist_m), 3) AS between_m FROM legs WHERE leg_idx % 2 = 1 GROUP BY 1")(lambda s, d: rounded(metrics.between_clusters(Inputs(s, d).legs, "run_id"), 3, "between_m"))
query("g11_within_clusters", "SELECT run_id, CAST(leg_idx // 2 AS INTEGER) AS cluster_seq, round(dist_m, 3) AS within_m FROM legs WHERE leg_idx % 2 = 0")(lambda s, d: rounded(metrics.within_clusters(Inputs(s, d).legs, "run_id"), 3, "within_m"))
query("g1_route_distance", "SELECT run_id, round(sum(dist_m), 3) AS dist_m FROM legs GROUP BY 1")(lambda s, d: rounded(metrics.route_length(Inputs(s, d).legs, "run_id"), 3, "dist_m"))

_MATRIX = f"m AS (SELECT a.node_id AS i, b.node_id AS j, {metres('a.x', 'a.y', 'b.x', 'b.y')} AS dist_m FROM sites a JOIN sites b ON a.node_id <> b.node_id)"
_TOUR = "t AS (SELECT node_id AS i, coalesce(lead(node_id) OVER (ORDER BY node_id), min(node_id) OVER ()) AS j, lead(node_id) OVER (ORDER BY node_id) AS o FROM sites)"


def site_matrix(s, d):
    return paths.distance_matrix(fx.sites(s, d).withColumn("run_id", F.lit(0)))


query("g2_closed_tour", f", {_MATRIX}, {_TOUR} SELECT 0 AS run_id, round(sum(dist_m), 3) AS dist_m FROM t JOIN m USING (i, j)")(
    lambda s, d: rounded(metrics.closed_tour_length(fx.sites(s, d).withColumn("run_id", F.lit(0)), site_matrix(s, d).drop("run_id", "path"), ("run_id",), "node_id"), 3, "dist_m")
)
query("g8_open_path", f", {_MATRIX}, {_TOUR} SELECT 0 AS run_id, round(sum(dist_m), 3) AS dist_m FROM t JOIN m ON t.i = m.i AND t.o = m.j")(
    lambda s, d: rounded(metrics.open_path_length(fx.sites(s, d).withColumn("run_id", F.lit(0)), site_matrix(s, d).drop("run_id", "path"), ("run_id",), "node_id"), 3, "dist_m")
)
query("g3_superdiagonal", f", {_MATRIX} SELECT i AS leg_idx, round(dist_m, 6) AS dist_m FROM m WHERE j = i + 1")(lambda s, d: rounded(metrics.superdiagonal(site_matrix(s, d)), 6, "dist_m"))
query("l29_critical_parts", "SELECT run_id, cluster_seq, CASE WHEN d * w_t >= within_m * w_ms THEN 'tender' ELSE 'mothership' END AS critical, CASE WHEN d * w_t >= within_m * w_ms THEN sortie_id END AS sortie_id FROM (SELECT run_id, CAST(leg_idx // 2 AS INTEGER) AS cluster_seq, dist_m AS within_m FROM legs WHERE leg_idx % 2 = 0) JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_seq ORDER BY d DESC, sortie_id) AS r FROM per) USING (run_id, cluster_seq) JOIN fleet USING (run_id) WHERE r = 1")(
    lambda s, d: metrics.highlight_critical((x := Inputs(s, d)).legs, x.sortie_legs, x.fleet)
)
query("l27_cost_text", "SELECT run_id, printf('%d hr, %.1f min', CAST(floor(hours) AS BIGINT), round((hours - floor(hours)) * 60, 1)) AS cost FROM (SELECT run_id, round(hours, 6) AS hours FROM hours)")(lambda s, d: makespan(s, d).select("run_id", layers.cost_text(F.col("hours")).alias("cost")))
query("l28_speeds", "SELECT run_id, round(1.0 / w_ms, 2) AS ms, round(1.0 / w_t, 2) AS tender FROM fleet")(lambda s, d: Inputs(s, d).fleet.select("run_id", layers.speed_text(F.col("w_ms")).alias("ms"), layers.speed_text(F.col("w_t")).alias("tender")))

# --- tours ---
query("i10_waypoints_from_here", "SELECT run_id, wp_idx, CASE WHEN wp_idx = 1 THEN 146.5::DOUBLE WHEN wp_idx = 2 THEN round((x * 3 - depot_x + 146.5::DOUBLE) / 3, 6) ELSE round(x, 6) END AS x, CASE WHEN wp_idx = 1 THEN -16.5::DOUBLE WHEN wp_idx = 2 THEN round((y * 3 - depot_y - 16.5::DOUBLE) / 3, 6) ELSE round(y, 6) END AS y, from_id, CASE WHEN wp_idx = 1 THEN (SELECT s.cluster_id FROM seq s WHERE s.run_id = wps.run_id AND s.seq = 2) ELSE to_id END AS to_id FROM wps JOIN fleet USING (run_id)")(
    lambda s, d: rounded(tours.waypoints_from((x := Inputs(s, d)).seq, x.fleet.select("run_id", F.lit(146.5).alias("x"), F.lit(-16.5).alias("y"))), 6, "x", "y")
)
query("e11_tender_ends", "SELECT run_id, cluster_id, round(ex, 9) AS ex, round(ey, 9) AS ey, round(lx, 9) AS lx, round(ly, 9) AS ly FROM ends")(lambda s, d: rounded(tours.tender_ends(Inputs(s, d).points), 9, "ex", "ey", "lx", "ly"))
_NATIONS = "r AS (SELECT n_regionkey AS region, list(n_nationkey ORDER BY n_nationkey) AS route FROM nation GROUP BY 1)"


def nation_routes(s, d):
    return fx.table(s, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("route"))


query("i7_two_opt_swap", f", {_NATIONS} SELECT region, list_concat(list_concat(route[1:1], list_reverse(route[2:4])), route[5:]) AS route FROM r")(lambda s, d: nation_routes(s, d).select("region", tours.swap(F.col("route"), 2, 4).alias("route")))
query("i12_orient_route", f", {_NATIONS} SELECT region, list_concat(route[3:], route[1:2]) AS route FROM r")(lambda s, d: nation_routes(s, d).select("region", tours.orient(F.col("route"), F.get("route", F.lit(2))).alias("route")))
query("i13_orient_to_second", f", {_NATIONS} SELECT region, list_reverse(list_append(route, route[1])) AS route FROM r")(
    lambda s, d: nation_routes(s, d).select("region", tours.orient_to(F.concat("route", F.slice("route", 1, 1)), F.element_at("route", -1)).alias("route"))
)
query("e10_cluster_order", "SELECT run_id, seq, cluster_id FROM seq WHERE cluster_id <> 0 AND cluster_id IN (SELECT cluster_id FROM targets WHERE node_id % 2 = 0)")(
    lambda s, d: Inputs(s, d).seq.where("cluster_id <> 0").join(fx.targets(s, d).where("node_id % 2 = 0").select("cluster_id").distinct(), "cluster_id", "left_semi").select("run_id", "seq", "cluster_id")
)

# --- spatial filters and lookups ---
query("c1_rings_in_bbox", "SELECT CAST(row_idx AS INTEGER) AS row_idx FROM boxes WHERE x0 >= 146.2 AND x1 <= 146.85 AND y0 >= -16.85 AND y1 <= -16.15")(
    lambda s, d: fx.boxes(s, d).where(geo.ring_in_bbox(F.col("ring"), F.lit(146.2), F.lit(146.85), F.lit(-16.85), F.lit(-16.15))).select("row_idx")
)
query("c2_points_in_bbox", "SELECT node_id, x, y FROM targets WHERE x BETWEEN 146.2 AND 146.7 AND y BETWEEN -16.9 AND -16.4")(lambda s, d: spatial.points_within(fx.targets(s, d).select("node_id", "x", "y"), 146.2, 146.7, -16.9, -16.4))
query("c3_filter_within_bbox", "SELECT CAST(row_idx AS INTEGER) AS row_idx FROM boxes, (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS e FROM sites) WHERE x0 >= a AND x1 <= b AND y0 >= c AND y1 <= e")(lambda s, d: spatial.within(fx.boxes(s, d), spatial.point_bounds(fx.sites(s, d))).select("row_idx"))
query("c4_bounds_of_rings", "SELECT min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM boxes")(lambda s, d: spatial.bounds(fx.boxes(s, d)))
query("c5_bounds_of_zones", "SELECT min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM obstacles")(lambda s, d: spatial.bounds(fx.obstacles(s, d)))
query("c6_bounds_of_points", "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM targets")(lambda s, d: spatial.point_bounds(fx.targets(s, d)))
query("c7_merged_bounds", "SELECT min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM (SELECT x0, x1, y0, y1 FROM obstacles UNION ALL SELECT x, x, y, y FROM sites)")(lambda s, d: spatial.merged_bounds(spatial.bounds(fx.obstacles(s, d)), spatial.point_bounds(fx.sites(s, d))))
query("c8_target_threshold", "SELECT ix, iy, CASE WHEN v >= -8 THEN v ELSE 0 END AS v FROM cells")(lambda s, d: spatial.thresholded(fx.raster(s, d), -8))
query("c9_exclusion_cells", "SELECT ix, iy, v FROM cells WHERE v >= -10")(lambda s, d: spatial.exclusion_cells(fx.raster(s, d), fx.DRAFT_MS))
query("c11_points_in_exclusion", "SELECT node_id FROM targets WHERE EXISTS (SELECT 1 FROM obstacles WHERE x > x0 AND x < x1 AND y > y0 AND y < y1)")(lambda s, d: spatial.excluded(fx.targets(s, d), fx.obstacles(s, d)).select("node_id"))
query("c12_containing_exclusion", "SELECT node_id, coalesce((SELECT min(poly_idx) FROM obstacles WHERE x > x0 AND x < x1 AND y > y0 AND y < y1), 0) AS poly_idx FROM targets")(lambda s, d: spatial.containing(fx.targets(s, d).select("node_id", "x", "y"), fx.obstacles(s, d)).select("node_id", "poly_idx"))
#: A segment crosses an axis-aligned box's interior if it is inside on both axes for a common stretch.
_SLAB = """SELECT node_id FROM sites WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, x - 146.175::DOUBLE AS dx, y + 16.84::DOUBLE AS dy FROM obstacles) WHERE
 least(1, CASE WHEN dx = 0 THEN CASE WHEN 146.175 > x0 AND 146.175 < x1 THEN 1 ELSE -1 END ELSE greatest((x0 - 146.175) / dx, (x1 - 146.175) / dx) END, CASE WHEN dy = 0 THEN CASE WHEN -16.84 > y0 AND -16.84 < y1 THEN 1 ELSE -1 END ELSE greatest((y0 + 16.84) / dy, (y1 + 16.84) / dy) END)
 > greatest(0, CASE WHEN dx = 0 THEN 0 ELSE least((x0 - 146.175) / dx, (x1 - 146.175) / dx) END, CASE WHEN dy = 0 THEN 0 ELSE least((y0 + 16.84) / dy, (y1 + 16.84) / dy) END) + 1e-9)"""


def from_depot(s, d):
    p = fx.sites(s, d)
    return p.select(F.col("node_id").alias("pair_id"), "node_id", F.lit(fx.DEPOT[0]).alias("ax"), F.lit(fx.DEPOT[1]).alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))


query("c16_visible_from_depot", _SLAB)(lambda s, d: spatial.visible_pairs(from_depot(s, d), fx.obstacles(s, d)).select("node_id"))
query("e1_disturbance_values", "SELECT node_id, coalesce((SELECT arg_min(hs_mean, row_idx) FROM boxes WHERE x > x0 AND x < x1 AND y > y0 AND y < y1), 0.0::DOUBLE) AS disturbance_value FROM targets")(lambda s, d: spatial.disturbance_of(fx.targets(s, d).select("node_id", "x", "y"), fx.boxes(s, d)))
query("d1_ring_centroids", "SELECT CAST(row_idx AS INTEGER) AS row_idx, round((x0 + x1) / 2, 9) AS x, round((y0 + y1) / 2, 9) AS y FROM boxes")(
    lambda s, d: fx.boxes(s, d).select("row_idx", geo.centroid(F.col("ring")).alias("c")).select("row_idx", F.round("c.x", 9).alias("x"), F.round("c.y", 9).alias("y"))
)
query("d2_snapped_targets", ", b AS (SELECT min(x) - 0.03::DOUBLE AS bx, min(y) - 0.03::DOUBLE AS by_ FROM targets) SELECT ix, iy, p.x AS x, p.y AS y FROM (SELECT CAST(floor((x - bx) / 0.03::DOUBLE) AS INTEGER) AS ix, CAST(floor((y - by_) / 0.03::DOUBLE) AS INTEGER) AS iy, arg_max({'x': x, 'y': y}, node_id) AS p FROM targets, b GROUP BY 1, 2)")(
    lambda s, d: spatial.snapped(fx.targets(s, d), 0.03)
)
query("d3_cells_to_points", "SELECT row_number() OVER (ORDER BY iy, ix) AS id, ix, iy FROM cells WHERE v >= -10")(lambda s, d: spatial.cells_to_points(spatial.exclusion_cells(fx.raster(s, d), fx.DRAFT_MS).withColumn("v", F.lit(1))))
query("d4_boundary_edges", ", e AS (SELECT ix, iy FROM cells WHERE v >= -10) SELECT e.ix, e.iy, side FROM e, (VALUES ('s', 0, -1), ('e', 1, 0), ('n', 0, 1), ('w', -1, 0)) n(side, dx, dy) WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.ix = e.ix + dx AND o.iy = e.iy + dy)")(
    lambda s, d: spatial.boundary_edges(spatial.exclusion_cells(fx.raster(s, d), fx.DRAFT_MS))
)
query("d4_regions")(lambda s, d: regions.cell_regions(spatial.exclusion_cells(fx.raster(s, d), fx.DRAFT_T)))
query("d4_polygons")(lambda s, d: regions.polygonise(spatial.exclusion_cells(fx.raster(s, d), fx.DRAFT_T)))
query("d9_dilated_cells", "SELECT DISTINCT ix + dx AS ix, iy + dy AS iy FROM cells, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE v >= -10")(lambda s, d: spatial.dilated(spatial.exclusion_cells(fx.raster(s, d), fx.DRAFT_MS), 1))
query("d15_ring_vertices", "SELECT poly_idx, CAST(k AS INTEGER) AS k, CASE WHEN k IN (1, 2) THEN x1 ELSE x0 END AS x, CASE WHEN k IN (2, 3) THEN y1 ELSE y0 END AS y FROM obstacles, (SELECT unnest([0, 1, 2, 3]) AS k)")(
    lambda s, d: fx.obstacles(s, d).select("poly_idx", F.posexplode(geo.vertices(F.col("ring"))).alias("k", "p")).select("poly_idx", "k", "p.x", "p.y")
)
query("d19_letter_ids", "SELECT s_suppkey + 1 AS n, CASE WHEN s_suppkey >= 702 THEN chr(CAST(65 + (s_suppkey - 702) // 676 AS INTEGER)) || chr(CAST(65 + (s_suppkey - 26) // 26 % 26 AS INTEGER)) WHEN s_suppkey >= 26 THEN chr(CAST(64 + s_suppkey // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) AS letter FROM supplier")(
    lambda s, d: spatial.letter_ids(fx.table(s, d, "supplier").select((F.col("s_suppkey") + 1).alias("n")), "n")
)
query("d22_cluster_table", "SELECT run_id, CAST(0 AS BIGINT) AS id, depot_x AS lon, depot_y AS lat FROM fleet UNION ALL SELECT run_id, cluster_id, cx, cy FROM cent")(lambda s, d: spatial.cluster_table((x := Inputs(s, d)).centroids, x.fleet))
query("d23_sequence_table", "SELECT run_id, seq, cluster_id, lon, lat FROM seq")(lambda s, d: spatial.sequence_table((x := Inputs(s, d)).seq.where("cluster_id <> 0").select("run_id", "seq", "cluster_id"), x.centroids, x.fleet))
query("d5_prepared_zones")(lambda s, d: regions.prepared(fx.boxes(s, d).select((F.col("row_idx") + 1).alias("poly_idx"), "ring"), 0.01, 1e-4, 1e-4))
query("d14_adjusted_zones")(lambda s, d: regions.adjusted(fx.obstacles(s, d).select("poly_idx", "ring"), fx.sites(s, d)))
query("f7_angles", "SELECT node_id, round(atan2(0.5::DOUBLE * (y + 16.84) + 0.25::DOUBLE * (x - 146.175), 0.5::DOUBLE * (x - 146.175) - 0.25::DOUBLE * (y + 16.84)), 9) AS angle FROM sites")(
    lambda s, d: fx.sites(s, d).select("node_id", F.round(geo.signed_angle(F.lit(0.5), F.lit(-0.25), F.col("x") - fx.DEPOT[0], F.col("y") - fx.DEPOT[1]), 9).alias("angle"))
)

# --- relabelling and clustering ---
_MAP = "(SELECT run_id, cluster_id, cluster_id + 100 AS new_id FROM cent WHERE cluster_id % 2 = 0)"
query("e7_relabelled", f"SELECT t.run_id, node_id, coalesce(new_id, t.cluster_id) AS cluster_id FROM targets t LEFT JOIN {_MAP} m ON t.run_id = m.run_id AND t.cluster_id = m.cluster_id")(
    lambda s, d: clustering.relabelled((x := Inputs(s, d)).targets.select("run_id", "node_id", "cluster_id"), x.centroids.where("cluster_id % 2 = 0").select("run_id", "cluster_id", (F.col("cluster_id") + 100).alias("new_id")))
)
query("h3_capped_kmeans")(lambda s, d: clustering.capped_kmeans(fx.sites(s, d).withColumn("run_id", (F.col("node_id") % 5).cast("bigint")), 6, n_restarts=4))
query("h1_cluster_problem")(lambda s, d: clustering.cluster_problem((p := Inputs(s, d).problem).targets.points, p.zones.where("zone_set = 'tender'"), fx.DEPOT, 6))


query("h2_disturbed_clusters")(lambda s, d: clustering.disturbed(t := fx.targets(s, d), spatial.disturbance_of(t, fx.boxes(s, d)), 5, 1000))

# --- sinks, summaries, layers ---
query("b1_points", "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY cluster_id, node_id) AS id, cluster_id, x, y FROM targets")(lambda s, d: sinks.export_points(fx.targets(s, d)))
query("b2_clusters", "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS order_id, cluster_id, lon, lat FROM seq WHERE cluster_id <> 0")(lambda s, d: sinks.export_clusters(Inputs(s, d).seq))
query("b9_cluster_summary", "SELECT run_id, cluster_id, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy, count(*) AS n_nodes FROM targets GROUP BY ALL")(lambda s, d: sinks.cluster_summary(fx.targets(s, d)))
query("b10_clusters_summary", "SELECT run_id, count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_nodes FROM targets GROUP BY 1")(lambda s, d: sinks.clusters_summary(fx.targets(s, d)))
query("b11_mothership_summary", "SELECT run_id, 2 * count(*) - 2 AS n_waypoints, string_agg(CAST(cluster_id AS VARCHAR), '-' ORDER BY seq) AS sequence FROM seq GROUP BY 1")(lambda s, d: sinks.mothership_summary(Inputs(s, d).seq))
query("b12_tender_summary", "SELECT run_id, cluster_id, count(DISTINCT sortie_id) AS n_sorties, count(*) AS n_stops FROM sorties GROUP BY ALL")(lambda s, d: sinks.tender_summary(fx.sorties(s, d)))
query("b13_tenders_summary", "SELECT run_id, count(DISTINCT cluster_id) AS n_tenders, count(DISTINCT (cluster_id, sortie_id)) AS n_sorties FROM sorties GROUP BY 1")(lambda s, d: sinks.tenders_summary(fx.sorties(s, d)))
query("b14_solution_summary", "SELECT run_id, 0 AS event_idx, count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT (cluster_id, sortie_id)) AS n_sorties, count(*) AS n_stops FROM sorties GROUP BY 1")(lambda s, d: sinks.solution_summary(fx.sorties(s, d).withColumn("event_idx", F.lit(0))))
query("b15_route_summary", "SELECT run_id, count(*) + 1 AS n_nodes, round(sum(dist_m), 3) AS dist_m FROM legs GROUP BY 1")(lambda s, d: sinks.route_summary(Inputs(s, d).legs, "run_id"))
query("l1_cluster_layer", "SELECT run_id, 'clusters' AS layer, CAST(cluster_id AS VARCHAR) AS series, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY node_id) AS INTEGER) AS ord, x, y, CAST(cluster_id % 12 + 2 AS INTEGER) AS style FROM targets")(lambda s, d: layers.clusters(fx.targets(s, d)))
query("l5_sequence_layer", "SELECT run_id, 'sequence' AS layer, CAST(cluster_id AS VARCHAR) AS series, CAST(row_number() OVER (PARTITION BY run_id ORDER BY cluster_id) AS INTEGER) AS ord, lon AS x, lat AS y, CAST(cluster_id % 12 + 2 AS INTEGER) AS style FROM seq WHERE cluster_id <> 0")(lambda s, d: layers.sequence(Inputs(s, d).seq))
query("l3_circles", "SELECT run_id, 'circles' AS layer, CAST(cluster_id AS VARCHAR) AS series, CAST(k AS INTEGER) AS ord, round(lon + cos(k * 6.283185307179586::DOUBLE / 99) * 0.01, 9) AS x, round(lat + sin(k * 6.283185307179586::DOUBLE / 99) * 0.01, 9) AS y, CAST(cluster_id % 12 + 2 AS INTEGER) AS style FROM seq, range(100) r(k) WHERE cluster_id <> 0")(
    lambda s, d: rounded(layers.circles(Inputs(s, d).seq, 0.01), 9, "x", "y")
)
query("l9_problem_layers")(lambda s, d: layers.problem((p := Inputs(s, d).problem).targets.points, p.zones.where("zone_set = 'ms'"), p.fleet))

# --- whole plans ---


def plans(s, d, **options):
    return solve.solve(Inputs(s, d).problem, **options)


query("k1_initial_solution")(lambda s, d: solve.initial_solution(Inputs(s, d).problem).select("run_id", "event_idx", "order", F.round("hours", 6).alias("hours"), F.round("total", 3).alias("total")))
query("k2_solve")(lambda s, d: plans(s, d).select("run_id", "event_idx", "order", F.round("hours", 6).alias("hours")))
query("k6_disturbance_events")(lambda s, d: plans(s, d, events=[2, 3]).select("run_id", "event_idx", "order", F.round("hours", 6).alias("hours")))
query("j14_waypoint_search")(lambda s, d: solve.optimise_waypoints(solve.initial_solution(Inputs(s, d).problem), Inputs(s, d).problem).select("run_id", F.round("hours", 6).alias("hours")))
query("l24_search_trace")(lambda s, d: layers.best_so_far(plans(s, d).select("run_id", F.inline("trace"))))
query("a3_random_points")(lambda s, d: src.random_points(s, 50, fx.boxes(s, d).where("row_idx % 3 = 0").select("ring"), fx.obstacles(s, d).select("ring"), (146.0, 147.0, -17.0, -16.0)))
query("a7_threshold_targets", "SELECT ix, iy, 1.0::DOUBLE AS v FROM cells WHERE v >= -8 AND ix BETWEEN 5 AND 30 AND iy BETWEEN 5 AND 30")(lambda s, d: src.threshold_targets(fx.raster(s, d), -8, 5, 30, 5, 30))
query("a1_thinned_targets", "SELECT node_id FROM sites, (SELECT greatest(1, count(*) // 28) AS n FROM sites) WHERE (node_id - 1) % n = 0")(lambda s, d: src.thinned(fx.sites(s, d)).select("node_id"))

# --- further rows of the inventory ---
query("c10_points_in_each_ring", "SELECT CAST(b.row_idx AS INTEGER) AS row_idx, count(*) AS n FROM boxes b JOIN targets ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY 1")(
    lambda s, d: spatial.by_cell(fx.boxes(s, d)).join(fx.targets(s, d).withColumn("_i", F.floor(F.col("x") / spatial.CELL).cast("int")).withColumn("_j", F.floor(F.col("y") / spatial.CELL).cast("int")), ["_i", "_j"]).where(geo.contains(F.col("ring"), F.col("x"), F.col("y"))).groupBy("row_idx").agg(F.count("*").alias("n"))
)
query("c14_visible_past_each_ring", _SLAB.replace("SELECT node_id FROM sites WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, x - 146.175::DOUBLE AS dx, y + 16.84::DOUBLE AS dy FROM obstacles) WHERE", "SELECT node_id, poly_idx FROM (SELECT *, x - 146.175::DOUBLE AS dx, y + 16.84::DOUBLE AS dy FROM obstacles, sites) WHERE NOT ("))(
    lambda s, d: from_depot(s, d).crossJoin(fx.obstacles(s, d).select("poly_idx", "ring")).where(geo.is_visible(geo.point("ax", "ay"), geo.point("bx", "by"), F.col("ring"))).select("node_id", "poly_idx")
)
query("e2_disturbance_table", "SELECT node_id, coalesce((SELECT arg_min(hs_mean, row_idx) FROM boxes WHERE x > x0 AND x < x1 AND y > y0 AND y < y1), 0.0::DOUBLE) AS disturbance_value FROM sites")(lambda s, d: spatial.disturbance_of(fx.sites(s, d), fx.boxes(s, d)))
query("e6_relabelled_cells", "SELECT ix, iy, CASE WHEN v >= -5 THEN 100 + CAST(-v AS BIGINT) ELSE CAST(-v AS BIGINT) END AS cluster_id FROM cells")(
    lambda s, d: clustering.relabelled(fx.raster(s, d).select(F.lit(0).cast("bigint").alias("run_id"), "ix", "iy", (-F.col("v")).cast("bigint").alias("cluster_id")), s.range(0, 6).select(F.lit(0).cast("bigint").alias("run_id"), F.col("id").alias("cluster_id"), (F.col("id") + 100).alias("new_id"))).drop("run_id")
)
query("e9_assignment")(lambda s, d: clustering.hungarian(fx.sites(s, d).select(F.lit(0).cast("bigint").alias("run_id"), F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")).join(fx.boxes(s, d).select(F.col("row_idx").cast("bigint").alias("b"), "x0", "y0"), F.lit(True)).select("run_id", "a", "b", F.hypot(F.col("ax") - F.col("x0"), F.col("ay") - F.col("y0")).alias("cost"))))
query("g9_cluster_sortie_lengths", "SELECT run_id, cluster_seq, round(max(d), 3) AS longest_m, round(sum(d), 3) AS sorties_m FROM per GROUP BY ALL")(
    lambda s, d: rounded(metrics._slowest((x := Inputs(s, d)).legs, x.sortie_legs, ("run_id",)).select("run_id", "cluster_seq", "longest_m", "sorties_m"), 3, "longest_m", "sorties_m")
)
query("i3_two_opt_tour")(lambda s, d: search.two_opt_tour(Inputs(s, d).seq, fx.obstacles(s, d)))
query("i5_two_opt_sorties")(lambda s, d: search.two_opt_sorties(Inputs(s, d).sorties.select("run_id", "cluster_id", "sortie_id", "stop_idx", "x", "y")))
query("i8_tender_sorties")(lambda s, d: search.tender_sorties((x := Inputs(s, d)).targets, tours.tender_ends(x.points), fx.N_TENDERS, x.least_cap))
query("k4_improve_solution")(lambda s, d: solve.improve_solution(solve.initial_solution((p := Inputs(s, d).problem)), p).select("run_id", "order", F.round("hours", 6).alias("hours")))
query("b8_problem_summary")(lambda s, d: sinks.problem_summary((p := Inputs(s, d).problem).targets.points, p.zones, p.fleet))
query("l7_exclusion_layer", "SELECT 0 AS run_id, 'exclusions' AS layer, CAST(poly_idx AS VARCHAR) AS series, CAST(k AS INTEGER) AS ord, round(CASE WHEN k IN (1, 2) THEN x1 ELSE x0 END, 9) AS x, round(CASE WHEN k IN (2, 3) THEN y1 ELSE y0 END, 9) AS y, 0 AS style FROM obstacles, (SELECT unnest([0, 1, 2, 3, 4]) AS k)")(
    lambda s, d: rounded(layers.exclusions(fx.obstacles(s, d).withColumn("run_id", F.lit(0))).where("layer = 'exclusions'"), 9, "x", "y")
)
query("l10_route_layer", "SELECT run_id, 'route' AS layer, 'mothership' AS series, CAST(2 * leg_idx - 1 + k AS INTEGER) AS ord, round(CASE WHEN k = 0 THEN ax ELSE bx END, 9) AS x, round(CASE WHEN k = 0 THEN ay ELSE by_ END, 9) AS y, 1 AS style FROM legs, (SELECT unnest([0, 1]) AS k)")(
    lambda s, d: rounded(layers.routes(Inputs(s, d).legs.withColumn("path", F.array(geo.point("ax", "ay"), geo.point("bx", "by")))), 9, "x", "y")
)
query("l14_tender_layer", "SELECT run_id, 'tenders' AS layer, cluster_id || '-' || sortie_id AS series, CAST(2 * leg_idx - 1 + k AS INTEGER) AS ord, round(CASE WHEN k = 0 THEN ax ELSE bx END, 9) AS x, round(CASE WHEN k = 0 THEN ay ELSE by_ END, 9) AS y, CAST((cluster_id + sortie_id) % 12 + 2 AS INTEGER) AS style FROM slegs, (SELECT unnest([0, 1]) AS k)")(
    lambda s, d: rounded(layers.tenders(Inputs(s, d).sortie_legs.withColumn("path", F.array(geo.point("ax", "ay"), geo.point("bx", "by")))), 9, "x", "y")
)
query("l37_waypoint_layer", "SELECT run_id, 'waypoints' AS layer, 'waypoints' AS series, wp_idx AS ord, round(x, 9) AS x, round(y, 9) AS y, 1 AS style FROM wps")(lambda s, d: rounded(layers.waypoints(Inputs(s, d).points), 9, "x", "y"))

from squadron.plans import zoned  # noqa: E402, F401  (registers the queries that keep out of zones)
