"""Tours as Column expressions and windows; local search per group by Arrow functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from squadron.functions.geo import between, haversine
from squadron.operators.paths import cleared, distance_matrix, feasible_paths


def orient(route: Column, first) -> Column:
    """Rotates a route so that ``first`` leads."""
    at = F.array_position(route, first).cast("int")
    return F.when(at > 0, F.concat(F.slice(route, at, F.size(route)), F.slice(route, F.lit(1), at - 1))).otherwise(F.raise_error(F.lit("the route lacks the point that should lead")))


def orient_to(route: Column, second) -> Column:
    """Keeps a closed route whose second point is ``second``, or turns it round; else raises."""
    return F.when(F.get(route, F.lit(1)) == second, route).when(F.element_at(route, -2) == second, F.reverse(route)).otherwise(F.raise_error(F.lit("the route has no such second point")))


def swap(route: Column, i, j) -> Column:
    """The places i to j (from 1) in reverse."""
    i, j = (F.lit(v) if isinstance(v, int) else v for v in (i, j))
    return F.concat(F.slice(route, F.lit(1), i - 1), F.reverse(F.slice(route, i, j - i + 1)), F.slice(route, j + 1, F.size(route)))


def nearest_neighbour(centroids: DataFrame, fleet: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """Greedy tours of all runs at once: (run_id, seq, cluster_id, lon, lat), the depot as id 0 at both ends.

    A run's centroids become one array, folded by one expression: no loop on the driver, no recursion limit, one task
    per run. Distances are rounded to micrometres before they are compared; ties go to the smaller id. With ``rings``
    centroids inside a zone are moved out first, and distances are those of the ways round the zones.
    """
    if rings is not None:
        centroids = cleared(centroids.select("run_id", "cluster_id", "cx", "cy"), rings, ("run_id", "cluster_id"), "cx", "cy")
    c = centroids.groupBy("run_id").agg(F.collect_list(F.struct(F.col("cluster_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))).alias("left"))
    c = c.join(fleet.select("run_id", F.struct(F.lit(0).cast("bigint").alias("id"), F.col("depot_x").alias("x"), F.col("depot_y").alias("y")).alias("depot")), "run_id")
    if rings is not None:
        nodes = c.select("run_id", F.inline(F.concat("left", F.array("depot")))).select("run_id", F.col("id").alias("node_id"), "x", "y")
        m = distance_matrix(nodes, rings, path=False).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "dist_m"))).alias("far"))
        c = c.join(m, "run_id")
    way = between if rings is None else (lambda a, p: F.element_at("far", F.struct(a["id"].alias("i"), p["id"].alias("j"))))

    def step(acc: Column, _: Column) -> Column:
        at = F.element_at(acc["tour"], -1)
        best = F.array_min(F.transform(acc["left"], lambda p: F.struct(F.round(way(at, p), 6).alias("d"), p["id"].alias("id"), p["x"].alias("x"), p["y"].alias("y"))))
        pick = F.struct(best["id"].alias("id"), best["x"].alias("x"), best["y"].alias("y"))
        return F.struct(F.filter(acc["left"], lambda p: p["id"] != best["id"]).alias("left"), F.concat(acc["tour"], F.array(pick)).alias("tour"))

    start = F.struct(F.col("left"), F.array("depot").alias("tour"))
    tour = F.aggregate(F.sequence(F.lit(1), F.size("left")), start, step, lambda a: a["tour"])
    d = c.select("run_id", F.concat(tour, F.array("depot")).alias("tour")).select("run_id", F.posexplode("tour").alias("seq", "p"))
    return d.select("run_id", (F.col("seq") + 1).alias("seq"), F.col("p.id").alias("cluster_id"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def waypoints(sequence: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """(run_id, wp_idx, x, y, from_id, to_id): two per cluster, a third of the way to its neighbours; the depot at both ends.

    With n clusters there are 2n + 2; the j-th cluster is entered at 2j and left at 2j + 1. With ``rings`` waypoints, but
    not the ends, are moved out of the zones.
    """
    if rings is not None:
        d = waypoints(sequence)
        ends = F.col("from_id") == F.col("to_id")
        return d.where(ends).unionByName(cleared(d.where(~ends), rings, ("run_id", "wp_idx")))
    w = W.partitionBy("run_id").orderBy("seq")
    lag, lead = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    d = sequence.select("run_id", "seq", "cluster_id", "lon", "lat", lag("cluster_id").alias("b"), lag("lon").alias("bx"), lag("lat").alias("by"), lead("cluster_id").alias("a"), lead("lon").alias("ax"), lead("lat").alias("ay"))
    third = lambda p, q: (F.lit(2.0) * F.col(p) + F.col(q)) / 3
    row = lambda k, x, y, f, t: F.struct(k.cast("int").alias("wp_idx"), x.alias("x"), y.alias("y"), f.alias("from_id"), t.alias("to_id"))
    j = F.col("seq") - 1
    inner = F.array(row(2 * j, third("lon", "bx"), third("lat", "by"), F.col("b"), F.col("cluster_id")), row(2 * j + 1, third("lon", "ax"), third("lat", "ay"), F.col("cluster_id"), F.col("a")))
    first = F.array(row(F.lit(1), F.col("lon"), F.col("lat"), F.col("cluster_id"), F.col("cluster_id")))
    last = F.array(row(2 * j, F.col("lon"), F.col("lat"), F.col("cluster_id"), F.col("cluster_id")))
    return d.select("run_id", F.inline(F.when(F.col("b").isNull(), first).when(F.col("a").isNull(), last).otherwise(inner)))


def waypoints_from(sequence: DataFrame, current: DataFrame) -> DataFrame:
    """As ``waypoints``, but the tour starts where the vessel is now: ``current`` (run_id, x, y) takes the place of the
    first row, and the first pair of ids is that of the first two clusters of the sequence."""
    first = sequence.groupBy("run_id").agg(F.min("seq").alias("seq"), F.sort_array(F.collect_list(F.struct("seq", "cluster_id"))).alias("ids"))
    ids = F.transform(F.slice("ids", 1, 2), lambda s: s["cluster_id"])
    head = first.join(current, "run_id").select("run_id", "seq", F.get(ids, F.lit(0)).alias("f"), F.get(ids, F.lit(1)).alias("t"), "x", "y")
    moved = sequence.join(head.select("run_id", "seq", F.col("x").alias("hx"), F.col("y").alias("hy")), ["run_id", "seq"], "left")
    moved = moved.select("run_id", "seq", "cluster_id", F.coalesce("hx", "lon").alias("lon"), F.coalesce("hy", "lat").alias("lat"))
    out = waypoints(moved).join(head.select("run_id", "f", "t"), "run_id", "left")
    lead = F.col("wp_idx") == 1
    return out.select("run_id", "wp_idx", "x", "y", F.when(lead, F.coalesce("f", "from_id")).otherwise(F.col("from_id")).alias("from_id"), F.when(lead, F.coalesce("t", "to_id")).otherwise(F.col("to_id")).alias("to_id"))


def tender_ends(points: DataFrame) -> DataFrame:
    """(run_id, cluster_id, entry and exit): the last waypoint that leads to a cluster and the first that leaves it."""
    p = F.struct("wp_idx", "x", "y")
    to = points.where("to_id <> 0").groupBy("run_id", F.col("to_id").alias("cluster_id")).agg(F.max(p).alias("entry"))
    out = points.where("from_id <> 0").groupBy("run_id", F.col("from_id").alias("cluster_id")).agg(F.min(p).alias("leave"))
    return to.join(out, ["run_id", "cluster_id"]).select("run_id", "cluster_id", F.col("entry.x").alias("ex"), F.col("entry.y").alias("ey"), F.col("leave.x").alias("lx"), F.col("leave.y").alias("ly"))


def sortie_stops(sorties: DataFrame, ends: DataFrame, seq: DataFrame) -> DataFrame:
    """Every sortie with its cluster's entry and exit at the ends: (run_id, cluster_seq, cluster_id, sortie_id, stop_idx, x, y)."""
    s = sorties.select("run_id", "cluster_id", "sortie_id", "stop_idx", "x", "y")
    last = s.groupBy("run_id", "cluster_id", "sortie_id").agg(F.max("stop_idx").alias("n")).join(ends, ["run_id", "cluster_id"])
    a = last.select("run_id", "cluster_id", "sortie_id", F.lit(0).alias("stop_idx"), F.col("ex").alias("x"), F.col("ey").alias("y"))
    b = last.select("run_id", "cluster_id", "sortie_id", (F.col("n") + 1).alias("stop_idx"), F.col("lx").alias("x"), F.col("ly").alias("y"))
    q = seq.where("cluster_id <> 0").select("run_id", "cluster_id", (F.col("seq") - 1).alias("cluster_seq"))
    return s.union(a).union(b).join(q, ["run_id", "cluster_id"])


def rebuilt_ends(legs: DataFrame, ends: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """Sortie legs whose first leg starts at a new entry and whose last ends at a new exit; the others stay as they are.

    Only legs whose ends have changed are measured again, round the zones where ``rings`` are given.
    """
    w = W.partitionBy("run_id", "cluster_id", "sortie_id")
    d = legs.withColumn("_last", F.max("leg_idx").over(w)).join(ends, ["run_id", "cluster_id"], "left")
    ax = F.when(F.col("leg_idx") == 1, F.coalesce("ex", "ax")).otherwise(F.col("ax"))
    ay = F.when(F.col("leg_idx") == 1, F.coalesce("ey", "ay")).otherwise(F.col("ay"))
    bx = F.when(F.col("leg_idx") == F.col("_last"), F.coalesce("lx", "bx")).otherwise(F.col("bx"))
    by = F.when(F.col("leg_idx") == F.col("_last"), F.coalesce("ly", "by")).otherwise(F.col("by"))
    same = (ax == F.col("ax")) & (ay == F.col("ay")) & (bx == F.col("bx")) & (by == F.col("by"))
    d = d.select("run_id", "cluster_id", "sortie_id", "leg_idx", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), "dist_m", same.alias("_same"))
    kept, changed = d.where("_same").drop("_same"), d.where("not _same").drop("_same", "dist_m")
    if rings is not None:
        return kept.unionByName(feasible_paths(changed, rings, path=False))
    return kept.unionByName(changed.withColumn("dist_m", haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))))
