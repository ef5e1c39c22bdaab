"""Capacity-limited clustering: restarts are groups, the best is an aggregation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron.functions.session import dealt
from squadron.kernel import cluster as k
from squadron.operators.metrics import centroids
from squadron.operators.paths import feasible_paths


def capped_kmeans(points: DataFrame, cap: int | str, seed: int = 0, k_spec: int | str = 0, min_k: int = 0, n_restarts: int = 20, max_iter: int = 1000, tol: float = 0.01, max_split: float = np.inf, extra: str | None = None) -> DataFrame:
    """(run_id, node_id, cluster_id) of the best of ``n_restarts`` for each run; ``extra`` is a third feature.

    ``cap`` and ``k_spec`` are numbers, or columns that hold one for each run. A restart is a group of its own with a seed
    from (seed, run, restart), so the result does not depend on partitions. The best has the least sum of sphere
    distances to the clusters' mean points. Cluster ids run from 1.
    """
    cols = ["x", "y"] + ([extra] if extra else [])
    of = lambda v: F.col(v) if isinstance(v, str) else F.lit(v)
    # A run is one row of arrays, which its restarts share; so many rows as points would be dealt once for each.
    rows = points.select("run_id", "node_id", *cols, of(cap).cast("long").alias("_cap"), of(k_spec).cast("long").alias("_k"))
    runs = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("node_id", *cols))).alias("_p"), F.first("_cap").alias("_cap"), F.first("_k").alias("_k"))
    runs = runs.select("run_id", *(F.col(f"_p.{c}").alias(c) for c in ("node_id", *cols)), "_cap", "_k")
    runs = runs.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(n_restarts - 1))))

    def each(batches):
        for b in batches:
            for r in range(b.num_rows):
                run, restart, most, least = (b.column(c)[r].as_py() for c in ("run_id", "restart", "_cap", "_k"))
                x = np.column_stack([b.column(c)[r].values.to_numpy(zero_copy_only=False).astype(float) for c in cols])
                label = k.capped_kmeans(x, most, np.random.default_rng([seed, run, restart]), least, min_k, max_split, max_iter, tol)
                _, label = np.unique(label, return_inverse=True)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), v) for v in (b.column("node_id")[r].values, pa.array(label + 1, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([restart], pa.int32()), pa.array([round(k.score(x, label), 6)]), *lists], ["run_id", "restart", "score", "node_id", "cluster_id"])

    made = dealt(runs, per_core=16).mapInArrow(each, "run_id bigint, restart int, score double, node_id array<bigint>, cluster_id array<bigint>")
    best = made.groupBy("run_id").agg(F.min_by(F.struct("node_id", "cluster_id"), F.struct("score", "restart")).alias("_b"))
    return best.select("run_id", F.inline(F.arrays_zip("_b.node_id", "_b.cluster_id"))).toDF("run_id", "node_id", "cluster_id")


def cluster_reached(reached: DataFrame, cap: int | str, k_spec: int = 0, dist_weighting: float = 5e-6, **options) -> DataFrame:
    """(run_id, node_id, x, y, cluster_id): clusters on place and weighted feasible distance, from targets with dist_m."""
    d = reached.withColumn("far", F.col("dist_m") * dist_weighting)
    return reached.select("run_id", "node_id", "x", "y").join(capped_kmeans(d, cap, k_spec=k_spec, extra="far", **options), ["run_id", "node_id"])


def cluster_problem(targets: DataFrame, rings: DataFrame, depot: tuple[float, float], cap: int, k_spec: int = 0, dist_weighting: float = 5e-6, **options) -> DataFrame:
    """(run_id, node_id, x, y, cluster_id) of runs that share a depot and zones: clusters on place and weighted feasible
    distance from the depot.

    Nodes that cannot be reached round the boats' zones are left out.
    """
    pairs = targets.select("run_id", "node_id", F.lit(depot[0]).alias("ax"), F.lit(depot[1]).alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = feasible_paths(pairs, rings, path=False).where(F.col("dist_m") < float("inf"))
    return cluster_reached(d.select("run_id", "node_id", F.col("bx").alias("x"), F.col("by").alias("y"), "dist_m"), cap, k_spec, dist_weighting, **options)


def relabelled(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes (or raster cells) with cluster ids replaced by ``mapping`` (run_id, cluster_id, new_id); unmapped ids stay."""
    d = nodes.join(mapping, ["run_id", "cluster_id"], "left")
    return d.withColumn("cluster_id", F.coalesce("new_id", "cluster_id")).drop("new_id").select(*nodes.columns)


def hungarian(costs: DataFrame) -> DataFrame:
    """(run_id, a, b): one-to-one assignment of least cost from long costs (run_id, a, b, cost), per run.

    An ``a`` beyond the number of ``b`` gets a new id after all old ones.
    """

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="cost").sort_index().sort_index(axis=1)
        col = np.array(k.hungarian(m.to_numpy(float)), np.int64)
        old = m.columns.to_numpy(np.int64)
        b = np.where(col >= 0, old[col], old.max() + np.cumsum(col < 0))
        return pd.DataFrame({"run_id": int(pdf.run_id.iloc[0]), "a": m.index.to_numpy(np.int64), "b": b})

    return costs.groupBy("run_id").applyInPandas(assign, "run_id bigint, a bigint, b bigint")


def cluster_mapping(nodes: DataFrame, previous: DataFrame) -> DataFrame:
    """(run_id, cluster_id, new_id): new clusters matched with the previous centroids by plane distance."""
    new = centroids(nodes).select("run_id", F.col("cluster_id").alias("a"), "cx", "cy")
    old = previous.select("run_id", F.col("cluster_id").alias("b"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    cost = F.sqrt(F.pow(F.col("cx") - F.col("px"), 2) + F.pow(F.col("cy") - F.col("py"), 2))
    return hungarian(new.join(old, "run_id").select("run_id", "a", "b", cost.alias("cost"))).select("run_id", F.col("a").alias("cluster_id"), F.col("b").alias("new_id"))


def values_of(nodes: DataFrame, disturbance: DataFrame) -> DataFrame:
    """``nodes`` with their disturbance as ``far``, 0 where none is known; by run where the values have one."""
    on = [c for c in ("run_id", "node_id") if c in disturbance.columns]
    d = nodes.join(disturbance.select(*on, "disturbance_value"), on, "left")
    return d.withColumn("far", F.coalesce("disturbance_value", F.lit(0.0))).drop("disturbance_value")


def worst_cluster(nodes: DataFrame, disturbance: DataFrame, seed: int) -> DataFrame:
    """(run_id, cluster_id) with the largest mean disturbance plus noise in [-1, 1] hashed from seed, run and cluster."""
    noise = F.pmod(F.xxhash64(F.lit(seed), "run_id", "cluster_id"), F.lit(1 << 30)) / float(1 << 29) - 1
    g = values_of(nodes, disturbance).groupBy("run_id", "cluster_id").agg(F.avg("far").alias("m")).withColumn("s", F.col("m") + noise)
    return g.groupBy("run_id").agg(F.max_by("cluster_id", F.struct("s", "cluster_id")).alias("cluster_id"))


def disturbed(nodes: DataFrame, disturbance: DataFrame, k_spec: int, cap: int, seed: int = 0, k_d_upper: float = 0.4, tol: float = 0.01, n_restarts: int = 20) -> DataFrame:
    """Remaining nodes of every run after an event: clusters on place and disturbance, the worst one's nodes given up, the
    rest clustered to exactly ``k_spec``. A run with fewer nodes than clusters, or too many for them, keeps its clusters."""
    columns = ["run_id", "node_id", "x", "y", "cluster_id"]
    n = nodes.groupBy("run_id").agg(F.count("*").alias("n"))
    high = F.greatest(F.ceil(F.col("n") * k_d_upper).cast("long"), F.lit(k_spec + 1))
    drawn = k_spec + 1 + F.pmod(F.xxhash64(F.lit(seed), "run_id", "n"), high - k_spec)
    d = values_of(nodes.drop("cluster_id"), disturbance).join(n.where(F.col("n") > k_spec).withColumn("k_d", F.least("n", drawn)), "run_id")
    first = capped_kmeans(d, "n", seed=seed, k_spec="k_d", extra="far", n_restarts=n_restarts, tol=tol)
    lost = first.join(worst_cluster(first, disturbance, seed), ["run_id", "cluster_id"], "left_semi").select("run_id", "node_id")
    kept = d.select("run_id", "node_id", "x", "y").join(lost, ["run_id", "node_id"], "left_anti")
    runs = kept.groupBy("run_id").agg(F.count("*").alias("m")).where((F.col("m") > k_spec) & (F.col("m") <= k_spec * cap)).select("run_id")
    kept = kept.join(runs, "run_id", "left_semi")
    again = capped_kmeans(kept, cap, seed=seed + 1, k_spec=k_spec, n_restarts=n_restarts, tol=tol)
    return kept.join(again, ["run_id", "node_id"]).select(*columns).union(nodes.join(runs, "run_id", "left_anti").select(*columns))
