"""Exports as plain tables, written as Parquet, and text summaries as one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def export_points(nodes: DataFrame) -> DataFrame:
    """(run_id, id, cluster_id, x, y): nodes numbered in the order of clusters and ids."""
    return nodes.select("run_id", F.row_number().over(W.partitionBy("run_id").orderBy("cluster_id", "node_id")).cast("bigint").alias("id"), "cluster_id", "x", "y")


def export_clusters(sequence: DataFrame, depot: bool = False) -> DataFrame:
    """(run_id, order_id, cluster_id, lon, lat); numbers start at 0 with the depot, else at 1."""
    d = sequence if depot else sequence.where("cluster_id <> 0")
    n = F.row_number().over(W.partitionBy("run_id").orderBy("seq")) - F.lit(1 if depot else 0)
    return d.select("run_id", n.cast("bigint").alias("order_id"), "cluster_id", "lon", "lat")


def export_exclusions(zones: DataFrame) -> DataFrame:
    return zones.select(F.row_number().over(W.partitionBy("zone_set").orderBy("poly_idx")).cast("bigint").alias("id"), "zone_set", "ring")


def export_routes(legs: DataFrame, keys: tuple[str, ...] = ("run_id",), order: tuple[str, ...] = ("leg_idx",)) -> DataFrame:
    """A row for each two-point piece of the legs' paths."""
    d = legs.select(*keys, *order, F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))).alias("k", "s"))
    return d.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy(*order, "k")).alias("id"), F.array("s.a", "s.b").alias("line"))


def export_tender_routes(sortie_legs: DataFrame, keys: tuple[str, ...] = ("run_id", "cluster_id", "sortie_id")) -> DataFrame:
    """A row for each sortie: the points of its legs one after the other, joints twice."""
    g = sortie_legs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("leg_idx", "path"))).alias("l"))
    return g.select(*keys, F.row_number().over(W.partitionBy(keys[0]).orderBy(*keys)).cast("bigint").alias("id"), F.flatten(F.transform("l", lambda x: x["path"])).alias("line"))


def write_table(df: DataFrame, path: str, if_absent: bool = False) -> None:
    df.write.mode("ignore" if if_absent else "overwrite").parquet(path)


def zone_path(folder: str, vessel: str, draft: float, tolerance: float, case: str, adjusted: bool = False) -> str:
    """Zones before and after targets are put on their boundaries have names of their own."""
    return f"{folder.rstrip('/')}/{vessel}_{draft:g}_{tolerance:g}_{case}{'_adjusted' if adjusted else ''}.parquet"


def problem_summary(targets: DataFrame, zones: DataFrame, fleet: DataFrame) -> DataFrame:
    t = targets.groupBy("run_id").agg(F.count("*").alias("n_targets"))
    z = zones.groupBy().agg(F.count_if(F.col("zone_set") == "ms").alias("n_ms_zones"), F.count_if(F.col("zone_set") == "tender").alias("n_tender_zones"))
    return fleet.join(t, "run_id", "left").crossJoin(F.broadcast(z)).select("run_id", F.coalesce("n_targets", F.lit(0)).alias("n_targets"), "n_ms_zones", "n_tender_zones", "n_tenders", "t_cap", "w_ms", "w_t")


def cluster_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("run_id", "cluster_id").agg(F.round(F.avg("x"), 9).alias("cx"), F.round(F.avg("y"), 9).alias("cy"), F.count("*").alias("n_nodes"))


def clusters_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("run_id").agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_nodes"))


def mothership_summary(sequence: DataFrame) -> DataFrame:
    """Number of waypoints and the ids in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "cluster_id"))), lambda s: s["cluster_id"].cast("string"))
    return sequence.groupBy("run_id").agg((2 * F.count("*") - 2).alias("n_waypoints"), F.array_join(ids, "-").alias("sequence"))


def tender_summary(sorties: DataFrame) -> DataFrame:
    return sorties.groupBy("run_id", "cluster_id").agg(F.countDistinct("sortie_id").alias("n_sorties"), F.count("*").alias("n_stops"))


def tenders_summary(sorties: DataFrame) -> DataFrame:
    return sorties.groupBy("run_id").agg(F.countDistinct("cluster_id").alias("n_tenders"), F.countDistinct("cluster_id", "sortie_id").alias("n_sorties"))


def solution_summary(sorties: DataFrame, event: str = "event_idx") -> DataFrame:
    """Counts of the last version of each run."""
    last = sorties.withColumn("_last", F.max(event).over(W.partitionBy("run_id"))).where(F.col(event) == F.col("_last"))
    return last.groupBy("run_id", event).agg(F.countDistinct("cluster_id").alias("n_clusters"), F.countDistinct("cluster_id", "sortie_id").alias("n_sorties"), F.count("*").alias("n_stops"))


def route_summary(legs: DataFrame, *keys: str) -> DataFrame:
    return legs.groupBy(*keys).agg((F.count("*") + 1).alias("n_nodes"), F.round(F.sum("dist_m"), 3).alias("dist_m"))
