"""End to end: many fleets, restarts and chains are rows; one row is one plan.

A plan travels as one row (order, nodes, points, sorties); ``tables`` spreads plans over the tables of the schema.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron.functions.session import checkpointed, dealt
from squadron.kernel import solution as s
from squadron.kernel.paths import Zones
from squadron.operators.clustering import cluster_reached
from squadron.operators.paths import bounded, zone_array
from squadron.operators.regions import as_array
from squadron.schemas import Problem, Solution

PT = "struct<x: double, y: double>"
PLAN = f"`order` array<bigint>, nodes array<struct<cluster_id: bigint, node_id: bigint, x: double, y: double>>, points array<{PT}>, sorties array<struct<cluster_id: bigint, stops: array<bigint>>>"
SCORE = "hours double, total double, trace array<struct<iter: int, best: double, current: double, proposed: double, temp: double>>"
STATE = f"run_id bigint, chain int, event_idx int, {PLAN}, {SCORE}"
#: Searches that a task runs side by side.
SIDE_BY_SIDE = 64
_cache: dict[bytes, Zones] = {}


def zones_from(rings) -> Zones:
    """Zones of a worker, kept with their visibility graph and paths while it lives."""
    arrays = [as_array(r) for r in (rings if rings is not None else [])]
    key = b"|".join(a.tobytes() for a in arrays)
    if key not in _cache:
        if len(_cache) > 8:
            _cache.clear()
        _cache[key] = Zones(arrays)
    return _cache[key]


def fleet_of(row) -> s.Fleet:
    return s.Fleet((row.depot_x, row.depot_y), row.w_ms, row.w_t, int(row.n_tenders), int(row.t_cap), zones_from(row.ms_zones), zones_from(row.t_zones))


def plan_of(row) -> s.Plan:
    nodes: dict[int, dict[int, tuple[float, float]]] = {}
    for n in row.nodes:
        nodes.setdefault(int(n["cluster_id"]), {})[int(n["node_id"])] = (float(n["x"]), float(n["y"]))
    if getattr(row, "order", None) is None:
        return s.Plan((), nodes, ())
    sorties: dict[int, list] = {int(c): [] for c in row.order}
    for x in row.sorties:
        sorties[int(x["cluster_id"])].append(tuple(int(k) for k in x["stops"]))
    return s.Plan(tuple(int(c) for c in row.order), nodes, tuple((float(p["x"]), float(p["y"])) for p in row.points), {c: tuple(v) for c, v in sorties.items()})


def row_of(run_id, chain, event_idx, plan: s.Plan, fleet: s.Fleet, trace) -> dict:
    hours, total = s.score(plan, fleet) if plan.order else (0.0, 0.0)
    return {
        "run_id": int(run_id), "chain": int(chain), "event_idx": int(event_idx), "order": list(plan.order),
        "nodes": [{"cluster_id": c, "node_id": n, "x": p[0], "y": p[1]} for c in plan.order for n, p in plan.nodes[c].items()],
        "points": [{"x": x, "y": y} for x, y in plan.points], "sorties": [{"cluster_id": c, "stops": list(t)} for c in plan.order for t in plan.sorties[c]],
        "hours": hours, "total": total, "trace": [dict(zip(("iter", "best", "current", "proposed", "temp"), t, strict=True)) for t in trace],
    }


def fleets(problem: Problem) -> DataFrame:
    """One row for each run with its zones as arrays: those of its own run_id, and those whose run_id is null."""
    z = problem.zones
    z = z if "run_id" in z.columns else z.withColumn("run_id", F.lit(None).cast("bigint"))
    out = problem.fleet
    for name, kind in (("ms_zones", "ms"), ("t_zones", "tender")):
        own = z.where(F.col("zone_set") == kind)
        shared = zone_array(own.where("run_id is null")).select(F.col("zones").alias("shared"))
        rings = F.transform(F.array_sort(F.collect_list(F.struct("poly_idx", "ring"))), lambda r: r["ring"])
        per = own.where("run_id is not null").groupBy("run_id").agg(bounded(rings, F.sum(F.size("ring"))).alias("own"))
        out = out.join(per, "run_id", "left").crossJoin(F.broadcast(shared))
        out = out.withColumn(name, F.when(F.col("own").isNull(), F.col("shared")).otherwise(F.concat("own", "shared"))).drop("own", "shared")
    return out


def rows_in(batches: Iterator[pd.DataFrame], each) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [each(r) for r in pdf.itertuples(index=False)]
        if out:
            yield pd.DataFrame(out)


def some_rows(batches: Iterator[pd.DataFrame], n: int = SIDE_BY_SIDE) -> Iterator[list]:
    """The rows of all batches, up to ``n`` at a time."""
    rows = (r for pdf in batches for r in pdf.itertuples(index=False))
    while some := list(islice(rows, n)):
        yield some


def reached(problem: Problem) -> DataFrame:
    """(run_id, node_id, x, y, dist_m, cap): each run's targets with the way from its depot round its boats' zones, and the
    nodes that a cluster of the run holds at most (boats times stops). Targets without a way are left out."""
    t = problem.targets.points.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "x", "y"))).alias("nodes"))

    def each(r):
        zones, depot = zones_from(r.t_zones), (r.depot_x, r.depot_y)
        at = [(float(n["x"]), float(n["y"])) for n in r.nodes]
        zones.learn([(depot, p) for p in at])
        found = [(n, zones.metres([depot, p])[0]) for n, p in zip(r.nodes, at, strict=True)]
        return {"run_id": int(r.run_id), "cap": int(r.n_tenders) * int(r.t_cap), "nodes": [{"node_id": int(n["node_id"]), "x": float(n["x"]), "y": float(n["y"]), "dist_m": d} for n, d in found if d < float("inf")]}

    made = dealt(t.join(fleets(problem), "run_id"), "run_id").mapInPandas(lambda b: rows_in(b, each), "run_id bigint, cap int, nodes array<struct<node_id: bigint, x: double, y: double, dist_m: double>>")
    return made.select("run_id", "cap", F.inline("nodes"))


def clustered(problem: Problem, k: int, seed: int, restarts: int, iterations: int) -> DataFrame:
    """(run_id, nodes): each run's clusters, from its own depot, zones, boats and stops."""
    d = cluster_reached(reached(problem), "cap", k_spec=0, min_k=k, seed=seed, n_restarts=restarts, max_iter=iterations)
    return d.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("cluster_id", "node_id", "x", "y"))).alias("nodes"))


def initial_solution(problem: Problem, k: int = 1, seed: int = 0, restarts: int = 20, iterations: int = 1000, clusters: DataFrame | None = None) -> DataFrame:
    """One plan for each run: clusters, mothership tour (nearest neighbour, 2-opt), waypoints, sorties."""
    rows = (clusters if clusters is not None else clustered(problem, k, seed, restarts, iterations)).join(fleets(problem), "run_id")
    rows = dealt(rows, "run_id")

    def each(r):
        fleet = fleet_of(r)
        plan = s.first_plan(fleet, plan_of(r).nodes)
        return row_of(r.run_id, 0, 0, plan, fleet, [])

    return rows.mapInPandas(lambda b: rows_in(b, each), STATE)


def best(plans: DataFrame) -> DataFrame:
    """The chain of least hours, then least distance, of each run and event."""
    cols = [c for c in plans.columns if c not in ("run_id", "event_idx")]
    g = plans.groupBy("run_id", "event_idx").agg(F.min_by(F.struct(*cols), F.struct("hours", "total", "chain")).alias("b"))
    return g.select("run_id", "b.chain", "event_idx", *[F.col(f"b.{c}").alias(c) for c in cols if c != "chain"])


def improve_solution(plans: DataFrame, problem: Problem, low: int = 1, high: int | None = None, chains: int = 4, seed: int = 0, temp: float = 0.25, cooling: float = 0.9, min_iters: int = 1000, static_limit: int = 1, max_iters: int = 1 << 31) -> DataFrame:
    """Annealing of the clusters at places low to high: ``chains`` rows for each plan, the best kept.

    A chain's generator is seeded by (seed, run, chain). An empty range gives the plan back.
    """
    many = plans.drop("chain").withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    many = dealt(many.join(fleets(problem), "run_id"))

    def each(batches):
        for rows in some_rows(batches):
            fleets, searches = [fleet_of(r) for r in rows], []
            for r, fleet in zip(rows, fleets, strict=True):
                plan = plan_of(r)
                top = len(plan.order) if high is None else min(high, len(plan.order))
                searches.append(s.annealing(plan, fleet, np.random.default_rng([seed, int(r.run_id), int(r.chain)]), low, top, temp, cooling, min_iters, static_limit, max_iters))
            found = s.together(searches)
            yield pd.DataFrame([row_of(r.run_id, r.chain, r.event_idx, new, fleet, trace) for r, fleet, (new, trace) in zip(rows, fleets, found, strict=True)])

    return best(many.mapInPandas(each, STATE))


def optimise_waypoints(plans: DataFrame, problem: Problem, low: int = 1, chains: int = 2, seed: int = 0, particles: int = 5, generations: int = 20, reach: float = 0.05) -> DataFrame:
    """Particle swarms on the waypoints from place ``low``: ``chains`` swarms for each plan, the best kept."""
    many = plans.drop("chain").withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    many = dealt(many.join(fleets(problem), "run_id"), "run_id", "chain", per_core=8)

    def each(r):
        fleet, plan = fleet_of(r), plan_of(r)
        new, trace = s.swarm(plan, fleet, np.random.default_rng([seed, 7, int(r.run_id), int(r.chain)]), low, particles, generations, reach)
        return row_of(r.run_id, r.chain, r.event_idx, new, fleet, [(g, b, b, b, 0.0) for g, b in trace])

    return best(many.mapInPandas(lambda b: rows_in(b, each), STATE))


def replan(plans: DataFrame, problem: Problem, d: int, event_idx: int, seed: int = 0) -> DataFrame:
    """The plans after an event at the d-th cluster, as version ``event_idx``."""
    values = problem.targets.disturbance
    rows = dealt(plans.join(fleets(problem), "run_id"), "run_id")
    if values is not None:
        v = values.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "disturbance_value"))).alias("values"))
        rows = rows.join(v, "run_id", "left")
    else:
        rows = rows.withColumn("values", F.lit(None).cast("map<bigint, double>"))

    def each(r):
        fleet = fleet_of(r)
        known = dict(r.values) if r.values is not None else {}
        new = s.after_event(plan_of(r), fleet, d, known, np.random.default_rng([seed, int(r.run_id), event_idx, d]))
        return row_of(r.run_id, r.chain, event_idx, new, fleet, [])

    return rows.mapInPandas(lambda b: rows_in(b, each), STATE)


def solve(problem: Problem, k: int = 1, events: list[int] | None = None, do_improve: bool = True, waypoint_search: bool = False, seed: int = 0, restarts: int = 20, iterations: int = 1000, chains: int = 4, clusters: DataFrame | None = None, **annealing) -> DataFrame:
    """All versions of each run's plan: 0 before any event, then one for each event in ascending order.

    Events name the place of the next cluster to visit. Those beyond the last cluster change nothing. After an event at
    d, annealing runs over the places d to the one before the next event.
    """
    now = checkpointed(initial_solution(problem, k, seed, restarts, iterations, clusters))
    marks = sorted({e for e in events or [] if e >= 1})
    upto = [*(m - 1 for m in marks), None]
    if do_improve:
        now = checkpointed(improve_solution(now, problem, 1, upto[0], chains, seed, **annealing))
    if waypoint_search:
        now = checkpointed(optimise_waypoints(now, problem, 1, seed=seed))
    history = now
    for n, d in enumerate(marks, 1):
        now = checkpointed(replan(now, problem, d, n, seed))
        if do_improve:
            now = checkpointed(improve_solution(now, problem, d, upto[n], chains, seed + n, **annealing))
        if waypoint_search:
            now = checkpointed(optimise_waypoints(now, problem, 2 * (d - 1) + 1, seed=seed + n))
        history = history.unionByName(now)
    return history


def tables(plans: DataFrame, problem: Problem) -> Solution:
    """The tables of the schema, keyed by run and event, with legs measured round the zones."""
    key = ["run_id", "event_idx"]
    nodes = plans.select(*key, F.inline("nodes"))
    mean = F.struct(F.avg("x").alias("x"), F.avg("y").alias("y"))
    seq = plans.select(*key, F.posexplode("order").alias("p", "cluster_id")).withColumn("seq", F.col("p") + 2).drop("p")
    at = nodes.groupBy(*key, "cluster_id").agg(mean.alias("c"))
    depot = problem.fleet.select("run_id", "depot_x", "depot_y")
    inner = seq.join(at, [*key, "cluster_id"]).select(*key, "seq", "cluster_id", F.col("c.x").alias("lon"), F.col("c.y").alias("lat"))
    ends = plans.join(depot, "run_id").select(*key, F.explode(F.array(F.lit(1), F.size("order") + 2)).alias("seq"), F.lit(0).cast("bigint").alias("cluster_id"), F.col("depot_x").alias("lon"), F.col("depot_y").alias("lat"))
    points = plans.select(*key, F.posexplode("points").alias("p", "pt"), F.expr("concat(array(0L), `order`, array(0L))").alias("ids"))
    j = F.floor((F.col("p") + 1) / 2).cast("int")
    own, near = F.get("ids", j), F.get("ids", F.when(F.col("p") % 2 == 1, j - 1).otherwise(j + 1))
    edge = (F.col("p") == 0) | (F.col("p") == 2 * F.size("ids") - 3)
    wps = points.select(*key, (F.col("p") + 1).alias("wp_idx"), "pt.x", "pt.y", F.when(edge, F.lit(0)).when(F.col("p") % 2 == 1, near).otherwise(own).cast("bigint").alias("from_id"), F.when(edge, F.lit(0)).when(F.col("p") % 2 == 1, own).otherwise(near).cast("bigint").alias("to_id"))
    stops = plans.select(*key, F.posexplode("sorties").alias("k", "s")).select(*key, "k", F.col("s.cluster_id").alias("cluster_id"), F.posexplode("s.stops").alias("i", "node_id"))
    place = F.expr("array_position(`order`, cluster_id)")
    sort = stops.join(plans.select(*key, "order"), key).select(*key, place.cast("int").alias("cluster_seq"), "cluster_id", F.dense_rank().over(_by("run_id", "event_idx", "cluster_id", "k")).alias("sortie_id"), (F.col("i") + 1).alias("stop_idx"), "node_id")

    def legs(r) -> dict:
        fleet, plan = fleet_of(r), plan_of(r)
        out = [(0, 0, 0, i, d, p) for i, (d, p) in enumerate(fleet.ms.legs(list(plan.points)), 1)]
        for q, c in enumerate(plan.order, 1):
            a, b = plan.ends(q)
            for n, t in enumerate(plan.sorties[c], 1):
                out += [(q, c, n, i, d, p) for i, (d, p) in enumerate(fleet.tender.legs([a, *(plan.nodes[c][x] for x in t), b]), 1)]
        names = ("cluster_seq", "cluster_id", "sortie_id", "leg_idx", "dist_m", "path")
        return {"run_id": r.run_id, "event_idx": r.event_idx, "legs": [dict(zip(names, (*x[:5], [{"x": u, "y": v} for u, v in x[5]]), strict=True)) for x in out]}

    made = plans.join(fleets(problem), "run_id").mapInPandas(lambda b: rows_in(b, legs), f"run_id bigint, event_idx int, legs array<struct<cluster_seq: int, cluster_id: bigint, sortie_id: int, leg_idx: int, dist_m: double, path: array<{PT}>>>")
    made = checkpointed(made.select(*key, F.inline("legs")))
    return Solution(nodes, inner.unionByName(ends), wps, made.where("sortie_id = 0").select(*key, "leg_idx", "dist_m", "path"), sort, made.where("sortie_id > 0"), plans.select(*key, F.inline("trace")))


def _by(*keys: str):
    from pyspark.sql.window import Window as W

    return W.partitionBy(*keys[:-1]).orderBy(keys[-1])
