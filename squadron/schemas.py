"""Schemas of the tables, and the records that hold them together. Every table has the key ``run_id``."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)


# As DDL, which readers and Arrow functions take; parsing it needs a session, and modules are imported without one.
TARGETS = "run_id bigint, node_id bigint, x double, y double"
DISTURBANCE = "run_id bigint, node_id bigint, disturbance_value double"
ZONES = "run_id bigint, zone_set string, poly_idx int, ring array<struct<x: double, y: double>>"
FLEET = "run_id bigint, depot_x double, depot_y double, w_ms double, w_t double, n_tenders tinyint, t_cap smallint"
CLUSTER_NODES = "run_id bigint, event_idx int, cluster_id bigint, node_id bigint, x double, y double"
CLUSTERS = "run_id bigint, event_idx int, cluster_id bigint, cx double, cy double"
MS_SEQUENCE = "run_id bigint, event_idx int, seq int, cluster_id bigint, lon double, lat double"
MS_WAYPOINTS = "run_id bigint, event_idx int, wp_idx int, x double, y double, from_id bigint, to_id bigint"
MS_LEGS = "run_id bigint, event_idx int, leg_idx int, dist_m double, path array<struct<x: double, y: double>>"
SORTIES = "run_id bigint, event_idx int, cluster_seq int, cluster_id bigint, sortie_id int, stop_idx int, node_id bigint"
SORTIE_LEGS = "run_id bigint, event_idx int, cluster_seq int, cluster_id bigint, sortie_id int, leg_idx int, dist_m double, path array<struct<x: double, y: double>>"


def half(weight: float) -> float:
    """Vessel weights are kept as half-precision numbers: rounded once, here."""
    return float(np.float16(weight))


@dataclass(frozen=True)
class Vessel:
    """A kind of vessel: zones it keeps out of, sites per trip, number, and hours per kilometre by its weight."""

    exclusion: DataFrame | None = None
    capacity: int = 32767
    number: int = 1
    weighting: float = 1.0

    def __post_init__(self):
        wrong = [k for k in ("weighting", "capacity", "number") if not getattr(self, k) > 0]
        if wrong:
            raise ValueError(f"must be more than 0: {', '.join(wrong)}")
        object.__setattr__(self, "weighting", half(self.weighting))


@dataclass(frozen=True)
class Targets:
    points: DataFrame
    disturbance: DataFrame | None = None
    path: str = ""


@dataclass(frozen=True)
class Problem:
    """Tables of one or many fleets, keyed by run_id. ``zones`` has both zone sets, 'ms' and 'tender'; a zone with a null
    run_id is every run's."""

    fleet: DataFrame
    targets: Targets
    zones: DataFrame


@dataclass(frozen=True)
class Solution:
    """Tables of a solution's whole history; the current one has the largest ``event_idx``."""

    cluster_nodes: DataFrame
    sequence: DataFrame
    waypoints: DataFrame
    legs: DataFrame
    sorties: DataFrame
    sortie_legs: DataFrame
    trace: DataFrame | None = field(default=None)
