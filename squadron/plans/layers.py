"""Plot-ready layers: what a figure would draw, as rows (layer, series, ord, x, y, style)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PALETTE = 12
#: The first colours of a palette are left to depot and zones.
SKIP = 2


def style(key) -> F.Column:
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(PALETTE)).cast("int") + SKIP


def layer(df: DataFrame, name: str, series, order, x, y, colour) -> DataFrame:
    """Columns may be names; ``order`` and ``colour`` expressions or names."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return df.select("run_id", F.lit(name).alias("layer"), c(series).cast("string").alias("series"), c(order).cast("int").alias("ord"), c(x).alias("x"), c(y).alias("y"), c(colour).cast("int").alias("style"))


def clusters(nodes: DataFrame) -> DataFrame:
    return layer(nodes, "clusters", "cluster_id", F.row_number().over(W.partitionBy("run_id", "cluster_id").orderBy("node_id")), "x", "y", style("cluster_id"))


def sequence(seq: DataFrame) -> DataFrame:
    """Cluster centres without the depot, in the order of ids."""
    return layer(seq.where("cluster_id <> 0"), "sequence", "cluster_id", F.row_number().over(W.partitionBy("run_id").orderBy("cluster_id")), "lon", "lat", style("cluster_id"))


def circle(radius: float) -> F.Column:
    """100 points of a circle about 0; null without a radius."""
    turn = lambda i: i * F.lit(6.283185307179586 / 99)
    points = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.struct((F.cos(turn(i)) * radius).alias("x"), (F.sin(turn(i)) * radius).alias("y")))
    return points if radius > 0 else F.lit(None).cast("array<struct<x: double, y: double>>")


def circles(seq: DataFrame, radius: float) -> DataFrame:
    d = seq.where("cluster_id <> 0").select("run_id", "cluster_id", "lon", "lat", F.posexplode(circle(radius)).alias("k", "p"))
    return layer(d, "circles", "cluster_id", "k", F.col("lon") + F.col("p.x"), F.col("lat") + F.col("p.y"), style("cluster_id"))


def exclusions(zones: DataFrame) -> DataFrame:
    """Rings as lines and a label at the mean of each ring's vertices."""
    d = zones.select("run_id", "poly_idx", F.posexplode("ring").alias("k", "p"))
    lines = layer(d, "exclusions", "poly_idx", "k", "p.x", "p.y", F.lit(0))
    mean = d.groupBy("run_id", "poly_idx").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    return lines.unionByName(layer(mean, "zone_labels", "poly_idx", F.lit(0), "x", "y", F.lit(0)))


def routes(legs: DataFrame, name: str = "route", series: str | None = None) -> DataFrame:
    d = legs.select("run_id", *([series] if series else []), "leg_idx", F.posexplode("path").alias("k", "p"))
    return layer(d, name, series or F.lit("mothership"), F.row_number().over(W.partitionBy("run_id", *([series] if series else [])).orderBy("leg_idx", "k")), "p.x", "p.y", style(series) if series else F.lit(1))


def tenders(sortie_legs: DataFrame) -> DataFrame:
    """Sorties as lines; the shade counts sorties within a cluster."""
    d = sortie_legs.select("run_id", "cluster_id", "sortie_id", "leg_idx", F.posexplode("path").alias("k", "p"))
    by = W.partitionBy("run_id", "cluster_id", "sortie_id").orderBy("leg_idx", "k")
    return layer(d, "tenders", F.concat_ws("-", "cluster_id", "sortie_id"), F.row_number().over(by), "p.x", "p.y", style(F.col("cluster_id") + F.col("sortie_id")))


def problem(targets: DataFrame, zones: DataFrame, fleet: DataFrame) -> DataFrame:
    d = layer(fleet, "depot", F.lit("depot"), F.lit(0), "depot_x", "depot_y", F.lit(1))
    return d.unionByName(layer(targets, "targets", F.lit("targets"), "node_id", "x", "y", F.lit(0))).unionByName(exclusions(zones))


def waypoints(points: DataFrame) -> DataFrame:
    return layer(points, "waypoints", F.lit("waypoints"), "wp_idx", "x", "y", F.lit(1))


def solution(targets, zones, fleet, seq, ms_legs, sortie_legs) -> DataFrame:
    d = problem(targets, zones, fleet).unionByName(sequence(seq)).unionByName(routes(ms_legs))
    return d.unionByName(tenders(sortie_legs))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs' hours side by side (run_id, hours_a, hours_b, gain)."""
    d = a.select("run_id", F.col("hours").alias("hours_a")).join(b.select("run_id", F.col("hours").alias("hours_b")), "run_id", "full")
    return d.withColumn("gain", F.col("hours_a") - F.col("hours_b"))


def best_so_far(trace: DataFrame) -> DataFrame:
    """Running best of a search trace."""
    return trace.withColumn("best_so_far", F.min("proposed").over(W.partitionBy("run_id").orderBy("iter").rowsBetween(W.unboundedPreceding, 0)))


def log_trace(trace: DataFrame, least: float = 1e-12) -> DataFrame:
    """Values fit for a logarithmic axis."""
    return trace.withColumn("log_value", F.greatest(F.col("best"), F.lit(least)))


def cost_text(hours) -> F.Column:
    """'H hr, M min' with minutes to one digit."""
    h = F.floor(hours)
    return F.format_string("%d hr, %.1f min", h.cast("bigint"), F.round((hours - h) * 60, 1))


def speed_text(weight) -> F.Column:
    return F.round(F.lit(1.0) / weight, 2)
