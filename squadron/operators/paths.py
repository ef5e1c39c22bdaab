"""Constrained distances: visibility, widest points, shortest feasible paths, and the pair tables built on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from squadron.functions import geo
from squadron.functions.session import dealt
from squadron.kernel.paths import Zones
from squadron.operators.regions import as_array, hull_of
from squadron.operators.metrics import legs
from squadron.operators.spatial import CELL, by_cell, containing, excluded, segment_cells, visible_pairs

PATH = "dist_m double, path array<struct<x: double, y: double>>"


#: Vertices of a zone set that may be sent to every task, 16 bytes each; a larger set has to be split by study area.
MAX_VERTICES = 2_000_000


def bounded(values: Column, vertices: Column) -> Column:
    """``values``, or an error where they hold too many vertices to be sent to every task."""
    return F.when(vertices <= MAX_VERTICES, values).otherwise(F.raise_error(F.lit("zones have too many vertices for one study area")))


def zone_array(rings: DataFrame) -> DataFrame:
    """One row with all rings in the order of poly_idx, of a checked size: it is broadcast to the pairs it is joined to."""
    z = F.transform(F.array_sort(F.collect_list(F.struct("poly_idx", "ring"))), lambda z: z["ring"])
    return rings.agg(z.alias("zones"), F.coalesce(F.sum(F.size("ring")), F.lit(0)).alias("n")).select(bounded(F.col("zones"), F.col("n")).alias("zones"))


def crossed(pairs: DataFrame, rings: DataFrame, skip: tuple[int, ...] = ()) -> DataFrame:
    """For each pair (pair_id, ax, ay, bx, by) the crossed ring nearest to a, but those in ``skip``: (pair_id, poly_idx).

    Rings and segments meet by the grid cells of both; distance is that from a to the first point where the segment meets
    the ring.
    """
    r = by_cell(rings.where(~F.col("poly_idx").isin(*skip)).select("poly_idx", "ring"))
    p, q = geo.point("ax", "ay"), geo.point("bx", "by")
    d = segment_cells(pairs).join(r, ["_i", "_j"]).where(geo.blocks(p, q, F.col("ring")))
    return d.withColumn("t", first_meeting(p, q, F.col("ring"))).groupBy("pair_id").agg(F.min_by("poly_idx", F.struct("t", "poly_idx")).alias("poly_idx"))


def first_meeting(p: Column, q: Column, ring: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]

    def meets(e: Column) -> Column:
        ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        d = geo.cross(dx, dy, ex, ey)
        t = geo.cross(e["a"]["x"] - p["x"], e["a"]["y"] - p["y"], ex, ey) / d
        u = geo.cross(e["a"]["x"] - p["x"], e["a"]["y"] - p["y"], dx, dy) / d
        return F.when((d != 0) & t.between(0, 1) & u.between(0, 1), t)

    return F.array_min(F.transform(geo.edges(ring), meets))


def widest_points(pairs: DataFrame, rings: DataFrame) -> DataFrame:
    """For each blocked pair the widest vertices of its nearest crossed ring to the left and to the right (null where none).

    The angle is taken at a between the way to b and the way to the vertex; of equal angles the first vertex wins.
    """
    d = pairs.join(crossed(pairs, rings), "pair_id").join(rings.select("poly_idx", "ring"), "poly_idx")
    d = d.select("pair_id", "poly_idx", "ax", "ay", "bx", "by", F.posexplode(F.array_distinct("ring")).alias("k", "v"))
    d = d.withColumn("angle", geo.signed_angle(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("v.x") - F.col("ax"), F.col("v.y") - F.col("ay")))
    side = lambda s: F.max_by("v", F.when(F.col("angle") * s > 0, F.struct(F.round(F.col("angle") * s, 12).alias("a"), (-F.col("k")).alias("k"))))
    return d.groupBy("pair_id", "poly_idx").agg(side(1).alias("left"), side(-1).alias("right"))


def hulls(rings: DataFrame) -> DataFrame:
    return rings.withColumn("ring", hull_of("ring"))


def zone_rings(rings: DataFrame) -> list[np.ndarray]:
    """All rings in the order of poly_idx, as arrays, of a checked size."""
    flat = lambda axis: F.flatten(F.transform("zones", lambda r: F.transform(r, lambda p: p[axis]))).alias(axis)
    z = zone_array(rings).select(F.transform("zones", lambda r: F.size(r)).alias("n"), flat("x"), flat("y")).toArrow()
    n, x, y = (z[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("n", "x", "y"))
    return np.split(np.column_stack([x, y]), np.cumsum(n)[:-1]) if len(n) else []


def feasible_paths(pairs: DataFrame, rings: DataFrame, path: bool = True, deal: bool = True) -> DataFrame:
    """``pairs`` (ax, ay, bx, by, ...) with dist_m and, unless left out, path.

    Distance is that along the shortest way round all zones on their visibility graph; Infinity and no path where an end
    lies inside a zone. Zones come to each process once; a visibility graph serves all pairs of a task, which are looked at
    in whole arrays. Pairs are dealt to all tasks, unless they are already; those without an end's place are left out.
    """
    zones = pairs.sparkSession.sparkContext.broadcast(zone_rings(rings))
    ends = ["ax", "ay", "bx", "by"]
    rows = dealt(pairs, *ends) if deal else pairs
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def each(batches):
        known: Zones | None = None
        for b in batches:
            known = known or Zones(zones.value)
            at = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ends])
            found = known.ways(at[:, :2], at[:, 2:])
            made = [*b.columns, pa.array([f[0] for f in found], pa.float64())]
            if path:
                flat = np.array([p for f in found for p in f[1]], float).reshape(-1, 2)
                points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(kind.value_type))
                made.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[1]) for f in found)]), pa.int32()), points))
            yield pa.RecordBatch.from_arrays(made, [*b.schema.names, *(["dist_m", "path"] if path else ["dist_m"])])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", " + (PATH if path else PATH.split(",")[0])
    return rows.dropna(subset=ends).mapInArrow(each, shape)


#: Parts of a group of nodes, in each of which some nodes meet all of the group.
PARTS = 64


def all_pairs(nodes: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Pairs i < j within a group, by an equi join on the group's keys and on one of its parts, so that several tasks
    share a group."""
    a = nodes.select(*keys, F.col("node_id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.pmod(F.xxhash64("node_id"), F.lit(PARTS)).cast("int").alias("_part"))
    b = nodes.select(*keys, F.col("node_id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    return dealt(a, *keys, "_part").join(b, [*keys, "_part"]).where("i < j").drop("_part")


#: Nodes of a block at most, and at least where a group is so large; blocks that a group is cut into, if they are so large.
BLOCK, LEAST, BLOCKS = 2000, 16, 8


def met_blocks(nodes: DataFrame, rings: DataFrame, keys: tuple[str, ...], digits: int | None) -> DataFrame:
    """(keys, i, j, dist_m) both ways, round the zones. A group is cut into blocks in the order of node_id, and each two of
    them are one row; pairs are made, looked at and written out in whole arrays, some of them at a time."""
    zones = nodes.sparkSession.sparkContext.broadcast(zone_rings(rings))
    rows, w = nodes.select(*keys, "node_id", "x", "y").dropna(), W.partitionBy(*keys)
    size = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST), F.ceil(F.count("*").over(w) / BLOCKS)))
    rows = rows.withColumn("_n", F.ceil(F.count("*").over(w) / size)).withColumn("_to", F.floor((F.row_number().over(w.orderBy("node_id")) - 1) / size))
    b = rows.groupBy(*keys, "_n", "_to").agg(F.sort_array(F.collect_list(F.struct("node_id", "x", "y"))).alias("_b"))
    a = b.select(*keys, F.explode(F.sequence("_to", F.col("_n") - 1)).alias("_to"), F.col("_b").alias("_a"))
    parts = [F.col(f"{s}.{c}").alias(s + c) for s in ("_a", "_b") for c in ("node_id", "x", "y")]
    two = dealt(a.join(b.drop("_n"), [*keys, "_to"]).select(*keys, *parts), per_core=8)

    def each(batches):
        known = Zones(zones.value)
        for batch in batches:
            for r in range(batch.num_rows):
                of = lambda c, r=r, batch=batch: batch.column(c)[r].values.to_numpy(zero_copy_only=False)
                (i, p), (j, q) = ((of(f"{s}node_id"), np.column_stack([of(f"{s}x"), of(f"{s}y")])) for s in ("_a", "_b"))
                apart, kind = i[-1] < j[0], batch.schema.field("_anode_id").type.value_type
                for at, far in known.meshes(p, q):
                    some = i[at : at + len(far)]
                    one, other, d = np.repeat(some, len(j)), np.tile(j, len(some)), far.ravel()
                    if not apart:
                        less = one < other
                        one, other, d = one[less], other[less], d[less]
                    if digits is not None:
                        d = np.floor(d * 10.0**digits + 0.5) / 10.0**digits
                    made = [np.concatenate(c) for c in ((one, other), (other, one), (d, d))]
                    group = pa.array(np.full(len(made[0]), r))
                    columns = [batch.column(k).take(group) for k in keys] + [pa.array(made[0], kind), pa.array(made[1], kind), pa.array(made[2])]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "i", "j", "dist_m"])

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    return two.mapInArrow(each, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} {kinds['node_id']}" for c in "ij"), "dist_m double"]))


def distance_matrix(nodes: DataFrame, rings: DataFrame | None = None, keys: tuple[str, ...] = ("run_id",), path: bool = True, digits: int | None = None) -> DataFrame:
    """Symmetric long matrix (keys, i, j, dist_m, path); paths, unless left out, stand on rows with i < j only. Metres round
    the zones without paths are rounded to ``digits``, if given, half up."""
    if rings is not None and not path:
        return met_blocks(nodes, rings, keys, digits)
    p = all_pairs(nodes, keys)
    if rings is not None:
        d = feasible_paths(p, rings, path, deal=False)
    else:
        d = p.withColumn("dist_m", geo.haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
        d = d.withColumn("path", F.array(geo.point("ax", "ay"), geo.point("bx", "by"))) if path else d
    # Both directions come of one row, so that no way is sought twice.
    row = lambda i, j, way: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), "dist_m", *([way.alias("path")] if path else []))
    return d.select(*keys, F.inline(F.array(row("i", "j", F.col("path")), row("j", "i", F.lit(None).cast("array<struct<x: double, y: double>>")))))


def distances_from(origin: tuple[float, float], nodes: DataFrame, rings: DataFrame) -> DataFrame:
    """(node_id, dist_m) from one point to all nodes; Infinity where a node, or the origin, lies inside a zone."""
    p = nodes.select("node_id", F.lit(origin[0]).alias("ax"), F.lit(origin[1]).alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return feasible_paths(p, rings, path=False).select("node_id", "dist_m")


def visibility_edges(rings: DataFrame) -> DataFrame:
    """Visible vertex pairs of all rings, both directions: (src, dst, w) with points as ends."""
    v = rings.select(F.explode(F.array_distinct("ring")).alias("v")).distinct()
    bad = excluded(v.select(F.xxhash64("v.x", "v.y").alias("node_id"), "v.x", "v.y"), rings, how="left_anti")
    a, b = bad.select(F.struct("x", "y").alias("src")), bad.select(F.struct("x", "y").alias("dst"))
    # Every two vertices are a question of their own; zones are looked up by the cells of the way between.
    pairs = a.join(b, F.col("src") < F.col("dst")).select("src", "dst", F.col("src.x").alias("ax"), F.col("src.y").alias("ay"), F.col("dst.x").alias("bx"), F.col("dst.y").alias("by"))
    e = visible_pairs(pairs, rings).select("src", "dst", geo.between(F.col("src"), F.col("dst")).alias("w"))
    return e.union(e.select("dst", "src", "w"))


def moved_out(points: DataFrame, rings: DataFrame) -> DataFrame:
    """Points (node_id, x, y) inside zones' convex hulls moved to the nearest vertex, in the plane, of these hulls that lies
    in no hull; others stay, as do those without such a vertex."""
    h = hulls(rings)
    v = h.select("poly_idx", F.explode(F.array_distinct("ring")).alias("v")).select("poly_idx", "v.x", "v.y", F.xxhash64("v.x", "v.y").alias("node_id"))
    free = excluded(v, h, how="left_anti").select("poly_idx", F.col("x").alias("vx"), F.col("y").alias("vy"))
    cell = lambda c: F.floor(F.col(c) / CELL).cast("int")
    hit = points.select("node_id", "x", "y", cell("x").alias("_i"), cell("y").alias("_j")).join(by_cell(h.select("poly_idx", "ring")), ["_i", "_j"])
    hit = hit.where(geo.contains(F.col("ring"), F.col("x"), F.col("y"))).select("node_id", "x", "y", "poly_idx").join(free, "poly_idx")
    far = F.round(F.pow(F.col("vx") - F.col("x"), 2) + F.pow(F.col("vy") - F.col("y"), 2), 15)
    near = hit.groupBy("node_id").agg(F.min_by(F.struct("vx", "vy"), F.struct(far, "vx", "vy")).alias("n"))
    return points.select("node_id", "x", "y").join(near, "node_id", "left").select("node_id", F.coalesce("n.vx", "x").alias("x"), F.coalesce("n.vy", "y").alias("y"))


def cleared(rows: DataFrame, rings: DataFrame, keys: tuple[str, ...], x: str = "x", y: str = "y") -> DataFrame:
    """``rows``, told apart by ``keys``, with their points moved out of the zones."""
    d = rows.withColumn("_id", F.xxhash64(*keys))
    out = moved_out(d.select(F.col("_id").alias("node_id"), F.col(x).alias("x"), F.col(y).alias("y")), rings)
    out = out.select(F.col("node_id").alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    d = d.join(out, "_id")
    return d.select(*(F.col("_x").alias(c) if c == x else F.col("_y").alias(c) if c == y else F.col(c) for c in rows.columns))


def feasible_vector(stops: DataFrame, keys: tuple[str, ...], order: str, rings: DataFrame) -> DataFrame:
    """Legs along routes, (keys, leg_idx, ax, ay, bx, by, dist_m, path), each the shortest way round the zones."""
    return feasible_paths(legs(stops, keys, order).drop("dist_m"), rings)


def zones_of(pdf_zones) -> Zones:
    return Zones([as_array(r) for r in pdf_zones])


def first_zone(points: np.ndarray, rings: list) -> list[int]:
    """Places (from 1) of the first containing ring of each point, 0 for none."""
    z = Zones(rings)
    return [z.first_containing(p) for p in points]


def hull_zone(points: DataFrame, rings: DataFrame) -> DataFrame:
    """As a lookup of the first containing ring, against convex hulls that are made once per ring."""
    return containing(points, hulls(rings))


