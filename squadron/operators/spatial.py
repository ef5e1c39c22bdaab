"""Spatial filters, lookups and reshaping as joins and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from squadron.functions import geo

CELL = 0.1


def bounds(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """One row (x0, x1, y0, y1) over all envelopes."""
    e = rings.select(geo.envelope(F.col(ring)).alias("e"))
    return e.agg(F.min("e.x0").alias("x0"), F.max("e.x1").alias("x1"), F.min("e.y0").alias("y0"), F.max("e.y1").alias("y1"))


def point_bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def merged_bounds(*many: DataFrame) -> DataFrame:
    """Bounds of several bounds."""
    d = many[0]
    for m in many[1:]:
        d = d.unionByName(m)
    return d.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def within(rings: DataFrame, box: DataFrame, ring: str = "ring") -> DataFrame:
    """Rows whose ring lies in the one-row ``box``, edges included."""
    b = F.broadcast(box.select(F.struct("x0", "x1", "y0", "y1").alias("_box")))
    return rings.crossJoin(b).where(geo.ring_in_bbox(F.col(ring), F.col("_box.x0"), F.col("_box.x1"), F.col("_box.y0"), F.col("_box.y1"))).drop("_box")


def points_within(points: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    return points.where(geo.point_in_bbox(F.col("x"), F.col("y"), F.lit(x0), F.lit(x1), F.lit(y0), F.lit(y1)))


def thresholded(cells: DataFrame, least: float) -> DataFrame:
    """Values below ``least`` become 0; they are not dropped."""
    return cells.withColumn("v", F.when(F.col("v") >= least, F.col("v")).when(F.col("v").isNotNull(), F.lit(0.0)))


def exclusion_cells(cells: DataFrame, draft: float) -> DataFrame:
    """Cells that a vessel of this draft cannot enter; missing cells are navigable."""
    return cells.where(F.col("v").isNotNull() & (F.col("v") >= draft))


def _cells(lo, hi, cell: float):
    return F.sequence(F.floor(lo / cell).cast("int"), F.floor(hi / cell).cast("int"))


def by_cell(rings: DataFrame, ring: str = "ring", cell: float = CELL) -> DataFrame:
    """A row for each grid cell that a ring's envelope meets: an equi key for spatial joins."""
    d = rings.withColumn("_e", geo.envelope(F.col(ring))).withColumn("_i", F.explode(_cells(F.col("_e.x0"), F.col("_e.x1"), cell)))
    return d.withColumn("_j", F.explode(_cells(F.col("_e.y0"), F.col("_e.y1"), cell))).drop("_e")


def containing(points: DataFrame, rings: DataFrame, index: str = "poly_idx", cell: float = CELL, extra: str | None = None) -> DataFrame:
    """Points with ``index`` of the FIRST ring, in the order of ``index``, that holds them in its interior, and ``extra`` of it.

    An equi join on grid cells with an exact test, and one aggregation on the point's id; 0 and null where none does.
    """
    r = by_cell(rings.select(index, "ring", *([extra] if extra else [])), cell=cell)
    p = points.withColumn("_i", F.floor(F.col("x") / cell).cast("int")).withColumn("_j", F.floor(F.col("y") / cell).cast("int"))
    hit = p.join(r, ["_i", "_j"]).where(geo.contains(F.col("ring"), F.col("x"), F.col("y")))
    first = hit.groupBy("node_id").agg(F.min(index).alias(index), *([F.min_by(extra, index).alias(extra)] if extra else []))
    out = points.join(first, "node_id", "left")
    return out.withColumn(index, F.coalesce(index, F.lit(0)))


def excluded(points: DataFrame, rings: DataFrame, cell: float = CELL, how: str = "left_semi") -> DataFrame:
    """Points in the interior of some ring (or, with 'left_anti', of none)."""
    r = by_cell(rings.select("ring"), cell=cell)
    p = points.withColumn("_i", F.floor(F.col("x") / cell).cast("int")).withColumn("_j", F.floor(F.col("y") / cell).cast("int"))
    on = (p._i == r._i) & (p._j == r._j) & geo.contains(r.ring, p.x, p.y)
    return p.join(r, on, how).drop("_i", "_j")


def disturbance_of(nodes: DataFrame, zones: DataFrame, row: str = "row_idx", value: str = "hs_mean") -> DataFrame:
    """(node_id, disturbance_value): the value of the first zone that contains the node, else 0."""
    d = containing(nodes, zones.withColumn("_row", F.col(row) + 1), index="_row", extra=value)
    return d.select("node_id", F.coalesce(value, F.lit(0.0)).alias("disturbance_value"))


def segment_cells(pairs: DataFrame, cell: float = CELL) -> DataFrame:
    """A row for each grid cell that the segment (ax, ay) to (bx, by) may touch: column by column, the rows between the
    places where it enters and leaves."""
    lo, hi = F.least("ax", "bx"), F.greatest("ax", "bx")
    d = pairs.withColumn("_i", F.explode(_cells(lo, hi, cell)))
    rise = F.when(F.col("ax") == F.col("bx"), F.lit(0.0)).otherwise((F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    at = lambda x: F.col("ay") + (x - F.col("ax")) * rise
    y0, y1 = at(F.greatest(lo, F.col("_i") * F.lit(cell))), at(F.least(hi, (F.col("_i") + 1) * F.lit(cell)))
    flat = F.col("ax") == F.col("bx")
    low = F.when(flat, F.least("ay", "by")).otherwise(F.least(y0, y1)) - 1e-9
    high = F.when(flat, F.greatest("ay", "by")).otherwise(F.greatest(y0, y1)) + 1e-9
    return d.withColumn("_j", F.explode(_cells(low, high, cell)))


def visible_pairs(pairs: DataFrame, rings: DataFrame) -> DataFrame:
    """Pairs (ax, ay, bx, by) that no ring blocks; rings and segments meet by grid cells."""
    ends = ["ax", "ay", "bx", "by"]
    d = segment_cells(pairs.select(*ends).distinct()).join(by_cell(rings.select("ring")), ["_i", "_j"])
    blocked = d.where(geo.blocks(geo.point("ax", "ay"), geo.point("bx", "by"), F.col("ring"))).select(*ends).distinct()
    return pairs.join(blocked, ends, "left_anti")


def snapped(points: DataFrame, size: float) -> DataFrame:
    """Points on the grid over their extent padded by one cell; of a cell the last point stays: (ix, iy, x, y)."""
    b = point_bounds(points).select(F.struct((F.col("x0") - size).alias("x0"), (F.col("y0") - size).alias("y0")).alias("_b"))
    d = points.crossJoin(F.broadcast(b))
    d = d.withColumn("ix", F.floor((F.col("x") - F.col("_b.x0")) / size).cast("int")).withColumn("iy", F.floor((F.col("y") - F.col("_b.y0")) / size).cast("int"))
    return d.groupBy("ix", "iy").agg(F.max_by(F.struct("x", "y"), "node_id").alias("p")).select("ix", "iy", "p.x", "p.y")


def cells_to_points(cells: DataFrame) -> DataFrame:
    """Cells of value 1 as (id, ix, iy), numbered with x fastest; numbers come from counts per row of cells."""
    ones = cells.where("v = 1")
    rows = ones.groupBy("iy").agg(F.count("*").alias("n"))
    rows = rows.withColumn("before", F.sum("n").over(W.orderBy("iy")) - F.col("n"))
    return ones.join(rows.select("iy", "before"), "iy").select((F.col("before") + F.row_number().over(W.partitionBy("iy").orderBy("ix"))).alias("id"), "ix", "iy")


def boundary_edges(cells: DataFrame) -> DataFrame:
    """Edges between a cell of the set and a place outside it: (ix, iy, side), by an anti join with each neighbour."""
    side = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), (F.col("ix") + dx).alias("nx"), (F.col("iy") + dy).alias("ny")) for s, dx, dy in (("s", 0, -1), ("e", 1, 0), ("n", 0, 1), ("w", -1, 0)))))
    e = cells.select("ix", "iy", side.alias("n")).select("ix", "iy", "n.side", "n.nx", "n.ny")
    own = cells.select(F.col("ix").alias("nx"), F.col("iy").alias("ny"))
    return e.join(own, ["nx", "ny"], "left_anti").select("ix", "iy", "side")


def dilated(cells: DataFrame, steps: int) -> DataFrame:
    """Cells within ``steps`` of the set in both directions: a buffer in whole cells."""
    d = F.sequence(F.lit(-steps), F.lit(steps))
    a = cells.select("ix", "iy", F.explode(d).alias("dx")).select((F.col("ix") + F.col("dx")).alias("ix"), "iy").distinct()
    return a.select("ix", "iy", F.explode(d).alias("dy")).select("ix", (F.col("iy") + F.col("dy")).alias("iy")).distinct()


def letter_ids(ids: DataFrame, key: str = "cluster_id") -> DataFrame:
    return ids.withColumn("letter", geo.letter_id(F.col(key)))


def cluster_table(centroids: DataFrame, fleet: DataFrame) -> DataFrame:
    """(run_id, id, lon, lat) with the depot as id 0; real cluster ids are kept."""
    depot = fleet.select("run_id", F.lit(0).cast("bigint").alias("id"), F.col("depot_x").alias("lon"), F.col("depot_y").alias("lat"))
    return depot.unionByName(centroids.select("run_id", F.col("cluster_id").alias("id"), F.col("cx").alias("lon"), F.col("cy").alias("lat")))


def sequence_table(order: DataFrame, centroids: DataFrame, fleet: DataFrame) -> DataFrame:
    """(run_id, seq, cluster_id, lon, lat) of clusters in the order of ``order`` (run_id, seq, cluster_id), depot at both ends."""
    c = order.join(centroids, ["run_id", "cluster_id"]).select("run_id", (F.row_number().over(W.partitionBy("run_id").orderBy("seq")) + 1).alias("seq"), "cluster_id", F.col("cx").alias("lon"), F.col("cy").alias("lat"))
    n = order.groupBy("run_id").agg(F.count("*").cast("int").alias("n")).join(fleet.select("run_id", "depot_x", "depot_y"), "run_id")
    ends = n.select("run_id", F.explode(F.array(F.lit(1), F.col("n") + 2)).alias("seq"), F.lit(0).cast("bigint").alias("cluster_id"), F.col("depot_x").alias("lon"), F.col("depot_y").alias("lat"))
    return c.unionByName(ends)
