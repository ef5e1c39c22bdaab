"""Distances and makespan as multi-level aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from squadron.functions.geo import haversine

HOURS = 3.6


def centroids(nodes: DataFrame, keys: tuple[str, ...] = ("run_id", "cluster_id"), digits: int = 9) -> DataFrame:
    """Mean point of each cluster with its node list in id order; rounded, so that the order of sums cannot show."""
    g = nodes.groupBy(*keys).agg(F.round(F.avg("x"), digits).alias("cx"), F.round(F.avg("y"), digits).alias("cy"), F.sort_array(F.collect_list("node_id")).alias("nodes"))
    return g


def raster_centroids(cells: DataFrame, label: str = "label") -> DataFrame:
    """Mean cell place of each label of a raster; missing cells have no label."""
    return cells.where(F.col(label).isNotNull()).groupBy(label).agg(F.avg("ix").alias("cx"), F.avg("iy").alias("cy"), F.count("*").alias("cells"))


def legs(stops: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Consecutive pairs along a route: leg n joins stop n to stop n + 1."""
    w = W.partitionBy(*keys).orderBy(order)
    d = stops.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).withColumn("leg_idx", F.row_number().over(w))
    d = d.where(F.col("nx").isNotNull())
    return d.select(*keys, "leg_idx", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"), haversine(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")).alias("dist_m"))


def route_length(legs_: DataFrame, *keys: str) -> DataFrame:
    """Sum of legs; 0 where a route has none."""
    return legs_.groupBy(*keys).agg(F.coalesce(F.sum("dist_m"), F.lit(0.0)).alias("dist_m"))


def closed_tour_length(stops: DataFrame, matrix: DataFrame, keys: tuple[str, ...], order: str, node: str = "node_id") -> DataFrame:
    """Length of a tour with its return leg, on a long distance matrix (i, j, dist_m)."""
    w = W.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pairs = stops.select(*keys, F.col(node).alias("i"), F.coalesce(F.lead(node).over(w), F.first(node).over(whole)).alias("j"))
    return pairs.join(matrix, ["i", "j"]).groupBy(*keys).agg(F.sum("dist_m").alias("dist_m"))


def sortie_tours(stops: DataFrame, depots: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Length of each sortie (x, y) as a tour from its run's depot (run_id, depot_x, depot_y) and back: of all pairs of
    nodes only those that follow one another are measured."""
    w = W.partitionBy(*keys).orderBy(order)
    d = stops.join(F.broadcast(depots), "run_id").select(*keys, "x", "y", "depot_x", "depot_y", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"), F.lead("x").over(w).alias("nx"))
    out = haversine(F.coalesce("px", "depot_x"), F.coalesce("py", "depot_y"), F.col("x"), F.col("y"))
    home = F.when(F.col("nx").isNull(), haversine(F.col("x"), F.col("y"), F.col("depot_x"), F.col("depot_y"))).otherwise(F.lit(0.0))
    return d.groupBy(*keys).agg(F.sum(out + home).alias("dist_m"))


def open_path_length(stops: DataFrame, matrix: DataFrame, keys: tuple[str, ...], order: str, node: str = "node_id") -> DataFrame:
    """Length of a path along its stops, without a return."""
    w = W.partitionBy(*keys).orderBy(order)
    pairs = stops.select(*keys, F.col(node).alias("i"), F.lead(node).over(w).alias("j")).where("j is not null")
    return pairs.join(matrix, ["i", "j"]).groupBy(*keys).agg(F.sum("dist_m").alias("dist_m"))


def superdiagonal(matrix: DataFrame) -> DataFrame:
    """Leg vector of a long matrix whose rows are in route order."""
    return matrix.where("j = i + 1").select(F.col("i").alias("leg_idx"), "dist_m")


def between_clusters(ms_legs: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """Odd legs lie between clusters: all, or those up to leg 2n + 1."""
    d = ms_legs if n is None else ms_legs.where(F.col("leg_idx") <= 2 * n + 1)
    return d.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("leg_idx") % 2 == 1, F.col("dist_m"))), F.lit(0.0)).alias("between_m"))


def within_clusters(ms_legs: DataFrame, *keys: str) -> DataFrame:
    """Even legs lie within clusters: leg 2j belongs to the j-th."""
    return ms_legs.where(F.col("leg_idx") % 2 == 0).select(*keys, (F.col("leg_idx") / 2).cast("int").alias("cluster_seq"), F.col("dist_m").alias("within_m"))


def _slowest(ms_legs: DataFrame, sortie_legs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    per = sortie_legs.groupBy(*keys, "cluster_seq", "sortie_id").agg(F.sum("dist_m").alias("d"))
    per = per.groupBy(*keys, "cluster_seq").agg(F.max("d").alias("longest_m"), F.sum("d").alias("sorties_m"))
    return within_clusters(ms_legs, *keys).join(per, [*keys, "cluster_seq"], "left")


def critical_path(ms_legs: DataFrame, sortie_legs: DataFrame, fleet: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Hours: for each cluster the slower of its longest sortie and the mothership's leg within, plus the way between.

    A cluster without sorties counts 0 for its boats. A way that does not exist (infinite) raises.
    """
    w = fleet.select("run_id", "w_ms", "w_t")
    s = _slowest(ms_legs, sortie_legs, keys).join(w, "run_id")
    slow = F.greatest(F.coalesce("longest_m", F.lit(0.0)) / 1000 * F.col("w_t"), F.col("within_m") / 1000 * F.col("w_ms")) / HOURS
    inner = s.groupBy(*keys).agg(F.sum(slow).alias("clusters_h"))
    out = between_clusters(ms_legs, *keys).join(w, "run_id").join(inner, list(keys), "left")
    hours = F.coalesce("clusters_h", F.lit(0.0)) + F.col("between_m") / 1000 * F.col("w_ms") / HOURS
    return out.select(*keys, F.when(hours < F.lit(float("inf")), hours).otherwise(F.raise_error(F.lit("a leg has no feasible way"))).alias("hours"))


def total_distance(ms_legs: DataFrame, sortie_legs: DataFrame, fleet: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Weighted metres of all vessels."""
    w = fleet.select("run_id", "w_ms", "w_t")
    a = ms_legs.groupBy(*keys).agg(F.sum("dist_m").alias("ms_m"))
    b = sortie_legs.groupBy(*keys).agg(F.sum("dist_m").alias("t_m"))
    d = a.join(b, list(keys), "left").join(w, "run_id")
    return d.select(*keys, (F.col("ms_m") * F.col("w_ms") + F.coalesce("t_m", F.lit(0.0)) * F.col("w_t")).alias("total"))


def highlight_critical(ms_legs: DataFrame, sortie_legs: DataFrame, fleet: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Which part of each cluster is critical: 'tender' (also at a tie) with its sortie, or 'mothership'."""
    per = sortie_legs.groupBy(*keys, "cluster_seq", "sortie_id").agg(F.sum("dist_m").alias("d"))
    top = per.withColumn("r", F.row_number().over(W.partitionBy(*keys, "cluster_seq").orderBy(F.col("d").desc(), "sortie_id"))).where("r = 1")
    d = within_clusters(ms_legs, *keys).join(top, [*keys, "cluster_seq"], "left").join(fleet.select("run_id", "w_ms", "w_t"), "run_id")
    boats = F.coalesce("d", F.lit(0.0)) * F.col("w_t") >= F.col("within_m") * F.col("w_ms")
    return d.select(*keys, "cluster_seq", F.when(boats, "tender").otherwise("mothership").alias("critical"), F.when(boats, F.col("sortie_id")).alias("sortie_id"))
