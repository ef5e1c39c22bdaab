"""Local search on tables: each tour, sortie or cluster is a group of its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron.functions.session import dealt
from squadron.kernel import tours as t
from squadron.kernel.paths import Zones
from squadron.operators.paths import zone_array
from squadron.operators.regions import as_array


def path_order(points: np.ndarray, zones) -> list[int]:
    """2-opt of an open path, or a closed one with its first point at both ends: on ways round the zones, or straight ones
    where there are none."""
    rings = [as_array(r) for r in zones] if zones is not None else []
    return t.two_opt(list(range(len(points))), Zones(rings).matrix([tuple(p) for p in points])) if rings else t.two_opt_path(points)


def with_zones(rows: DataFrame, rings: DataFrame | None) -> DataFrame:
    """``rows`` with all zones in a column, null without any; the set has a checked size."""
    if rings is None:
        return rows.withColumn("zones", F.lit(None).cast("array<array<struct<x: double, y: double>>>"))
    return rows.crossJoin(F.broadcast(zone_array(rings)))


def two_opt_tour(sequence: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """Closed tours (run_id, seq, cluster_id, lon, lat) improved by 2-opt to a local optimum; the depot stays at both ends."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        order = path_order(pdf[["lon", "lat"]].to_numpy(float), pdf.zones.iloc[0])
        return pdf.iloc[order][["run_id", "cluster_id", "lon", "lat"]].assign(seq=range(1, len(pdf) + 1))[["run_id", "seq", "cluster_id", "lon", "lat"]]

    d = with_zones(sequence.select("run_id", "seq", "cluster_id", "lon", "lat"), rings)
    return d.groupBy("run_id").applyInPandas(each, "run_id bigint, seq int, cluster_id bigint, lon double, lat double")


def two_opt_sorties(stops: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """Open paths (run_id, cluster_id, sortie_id, stop_idx, x, y) improved by 2-opt with both ends fixed.

    Sorties of one stop stay as they are. The ends are the first and the last stop_idx of each.
    """
    keys = ["run_id", "cluster_id", "sortie_id"]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stop_idx").reset_index(drop=True)
        order = path_order(pdf[["x", "y"]].to_numpy(float), pdf.zones.iloc[0])
        return pdf.iloc[order][[*keys, "x", "y"]].assign(stop_idx=pdf.stop_idx.to_numpy())[[*keys, "stop_idx", "x", "y"]]

    d = with_zones(stops.select(*keys, "stop_idx", "x", "y"), rings)
    return dealt(d, *keys).groupBy(*keys).applyInPandas(each, "run_id bigint, cluster_id bigint, sortie_id int, stop_idx int, x double, y double")


def tender_sorties(nodes: DataFrame, ends: DataFrame, n_tenders: int, cap: int, rings: DataFrame | None = None) -> DataFrame:
    """(run_id, cluster_id, sortie_id, stop_idx, node_id): round-robin greedy sorties of each cluster, then 2-opt.

    At each of ``cap`` stops every boat takes its nearest node left. Nodes out of reach, and those beyond what the boats
    can take, get no row.
    """

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id").reset_index(drop=True)
        a = pdf.iloc[0]
        p = np.vstack([[a.ex, a.ey], pdf[["x", "y"]].to_numpy(float), [a.lx, a.ly]])
        rings = [as_array(r) for r in a.zones] if a.zones is not None else []
        if rings:
            found = t.sorties(Zones(rings).matrix([tuple(q) for q in p]), 0, len(p) - 1, list(range(1, len(p) - 1)), n_tenders, cap)
        else:
            found = t.sorties_on_points(p, n_tenders, cap)
        out = [(int(a.run_id), int(a.cluster_id), s, i, int(pdf.node_id[k - 1])) for s, stops in enumerate(found, 1) for i, k in enumerate(stops, 1)]
        return pd.DataFrame(out, columns=["run_id", "cluster_id", "sortie_id", "stop_idx", "node_id"])

    d = nodes.select("run_id", "cluster_id", "node_id", "x", "y").join(ends, ["run_id", "cluster_id"])
    return dealt(with_zones(d, rings), "run_id", "cluster_id").groupBy("run_id", "cluster_id").applyInPandas(each, "run_id bigint, cluster_id bigint, sortie_id int, stop_idx int, node_id bigint")
