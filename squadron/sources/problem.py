"""Sources: GeoJSON polygons, cell tables, exclusion zones with a Parquet cache, and whole problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from squadron.functions import geo
from squadron.operators import regions, spatial
from squadron.schemas import Problem, Targets, Vessel

#: More targets than this are thinned to every floor(n / THIN)-th.
THIN = 28


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, ring, props): the outer rings of polygons, a multi-polygon giving one row for each part."""
    kind = "type string, features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(kind).option("multiLine", True).json(path).select(F.posexplode("features").alias("row_idx", "f"))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).otherwise(many)
    d = f.select("row_idx", F.col("f.properties").alias("props"), F.explode(parts).alias("rings"))
    return d.select("row_idx", F.transform(F.get("rings", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("ring"), "props")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Raster cells (ix, iy, v) from Parquet; missing cells have no row or null."""
    return spark.read.schema("ix int, iy int, v double").parquet(path)


def cell_targets(polygons: DataFrame, box: DataFrame, size: float = 1e-4) -> DataFrame:
    """(node_id, x, y): centroids of the polygons in ``box``, one for each grid cell, numbered with x fastest."""
    c = spatial.within(polygons, box).select(F.col("row_idx").alias("node_id"), geo.centroid(F.col("ring")).alias("c")).select("node_id", "c.x", "c.y")
    s = spatial.snapped(c, size)
    ids = spatial.cells_to_points(s.select("ix", "iy", F.lit(1).alias("v")))
    return ids.join(s, ["ix", "iy"]).select(F.col("id").cast("bigint").alias("node_id"), "x", "y")


def threshold_targets(cells: DataFrame, least: float, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Cells of a value of ``least`` or more within the bounds, edges included."""
    return cells.where((F.col("v") >= least) & F.col("ix").between(x0, x1) & F.col("iy").between(y0, y1)).withColumn("v", F.lit(1.0))


def thinned(targets: DataFrame, most: int = THIN) -> DataFrame:
    """Every floor(n / most)-th target where there are more than ``most``; n is counted in the plan, not on the driver."""
    n = targets.agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("_step"))
    d = targets.crossJoin(F.broadcast(n))
    return d.where((F.col("node_id") - 1) % F.col("_step") == 0).drop("_step")


def exclusions(cells: DataFrame, draft: float, size: float = 1.0, x0: float = 0.0, y0: float = 0.0, tolerance: float = 5e-4, min_area: float = 3e-5, buffer_cells: int = 0) -> DataFrame:
    """Zones (poly_idx, ring) a vessel of ``draft`` cannot enter. The buffer is a whole number of cells, taken before the
    outline, where it and the union are exact."""
    c = spatial.exclusion_cells(cells, draft)
    if buffer_cells:
        c = spatial.dilated(c, buffer_cells)
    p = regions.polygonise(c, size, x0, y0).where("ring_no = 0")
    p = p.select(F.row_number().over(W.orderBy("label")).alias("poly_idx"), "ring")
    return regions.prepared(p, 0.0, min_area, tolerance)


def cached_exclusions(spark: SparkSession, cells: DataFrame, draft: float, folder: str, case: str, tolerance: float = 5e-4, **options) -> DataFrame:
    """As ``exclusions``, kept as Parquet by case, draft and tolerance; an unreadable copy is made anew."""
    path = f"{folder.rstrip('/')}/{case}_{draft:g}_{tolerance:g}.parquet"
    try:
        known = spark.read.parquet(path)
        known.limit(1).count()
        return known
    except Exception:
        exclusions(cells, draft, tolerance=tolerance, **options).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def random_points(spark: SparkSession, n: int, buffered: DataFrame, original: DataFrame, box: tuple[float, float, float, float], seed: int = 0, block: int = 4096) -> DataFrame:
    """(node_id, x, y): the first ``n`` hashed points that lie in some buffered zone, in no original one, and in the box.

    Coordinates are hashes of the seed and the number, so neither partitions nor order matter. Blocks are doubled until
    enough are accepted.
    """
    x0, x1, y0, y1 = box
    unit = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "node_id"), F.lit(1 << 40)) / float(1 << 40)
    while True:
        p = spark.range(1, block + 1).select(F.col("id").alias("node_id")).select("node_id", (F.lit(x0) + unit(1) * (x1 - x0)).alias("x"), (F.lit(y0) + unit(2) * (y1 - y0)).alias("y"))
        ok = spatial.excluded(spatial.excluded(p, buffered), original, how="left_anti").select("node_id", "x", "y")
        if ok.limit(n).count() >= n:
            return ok.orderBy("node_id").limit(n)
        if block >= 1 << 32:
            raise ValueError(f"of {block} points fewer than {n} lie in the buffered zones and outside the original ones")
        block *= 2


def random_problem(spark: SparkSession, n: int, zones: DataFrame, fleet: DataFrame, box: tuple[float, float, float, float], reach: float, seed: int = 0) -> Problem:
    """Random targets near the boats' zones; every disturbance value is 0."""
    own = zones.where("zone_set = 'tender'").select("poly_idx", "ring")
    p = random_points(spark, n, regions.buffered(regions_hulls(own), reach), own, box, seed)
    p = fleet.select("run_id").crossJoin(p)
    return Problem(fleet, Targets(p, p.select("run_id", "node_id", F.lit(0.0).alias("disturbance_value"))), zones)


def regions_hulls(rings: DataFrame) -> DataFrame:
    return rings.withColumn("ring", regions.hull_of("ring"))


def load_problem(spark: SparkSession, target_path: str, subset_path: str, cells_path: str, disturbance_path: str, depot: tuple[float, float], draft_ms: float, draft_t: float, weight_ms: float, weight_t: float, n_tenders: int, t_cap: int, cell: tuple[float, float, float] = (1.0, 0.0, 0.0), tolerance: float = 5e-4, output_dir: str = "", debug: bool = False) -> Problem:
    """Reads the four inputs and builds a problem of one run. ``cell``: size and origin of the raster's cells.

    With ``debug`` nothing is cached, and both vessels take the default area and no buffer, as the two modes are defined.
    """
    Vessel(capacity=t_cap, number=n_tenders, weighting=weight_t)
    ms = Vessel(weighting=weight_ms)
    study = spatial.bounds(read_geojson(spark, subset_path))
    targets = thinned(cell_targets(read_geojson(spark, target_path), study))
    noise = read_geojson(spark, disturbance_path).withColumn("hs_mean", F.element_at("props", "Hs_MEAN").cast("double"))
    values = spatial.disturbance_of(targets, noise)
    cells, (size, x0, y0) = read_cells(spark, cells_path), cell
    make = {"size": size, "x0": x0, "y0": y0, "tolerance": tolerance}
    if debug:
        zone_ms, zone_t = (exclusions(cells, d, **make) for d in (draft_ms, draft_t))
    else:
        zone_ms = cached_exclusions(spark, cells, draft_ms, output_dir, "mothership", buffer_cells=1, **make)
        zone_t = cached_exclusions(spark, cells, draft_t, output_dir, "tender", min_area=1e-7, **make)
    zone_t = regions.adjusted(zone_t, targets)
    both = zone_ms.select("poly_idx", "ring").union(zone_t.select(F.col("poly_idx") + F.lit(1_000_000), "ring"))
    zones = regions.unioned(both).withColumn("zone_set", F.lit("ms")).unionByName(zone_t.withColumn("zone_set", F.lit("tender")))
    fleet = spark.createDataFrame([(0, depot[0], depot[1], ms.weighting, Vessel(weighting=weight_t).weighting, n_tenders, t_cap)], "run_id bigint, depot_x double, depot_y double, w_ms double, w_t double, n_tenders tinyint, t_cap smallint")
    run = F.lit(0).cast("bigint").alias("run_id")
    return Problem(fleet, Targets(targets.select(run, "*"), values.select(run, "*"), target_path), zones.select(run, "*"))
