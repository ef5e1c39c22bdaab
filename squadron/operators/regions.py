"""Raster regions to polygons, and polygon algebra per overlap group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron.functions import geo
from squadron.functions.session import checkpointed
from squadron.kernel import geometry as g
from squadron.schemas import RING

RINGS = "poly_idx int, ring array<struct<x: double, y: double>>"


def as_array(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float)


def as_rows(ring: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def linked_labels(nodes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, label): the smallest key reachable over ``links`` (a, b); each round is checkpointed and jumps over labels."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    label = nodes.select(F.col(key).alias("k"), F.col(key).alias("label"))
    n, changed = 0, 1
    while changed:
        near = both.join(label, both.b == label.k).groupBy("a").agg(F.min("label").alias("m"))
        new = label.join(near, label.k == near.a, "left").select("k", F.least("label", F.coalesce("m", "label")).alias("low"), "label")
        jump = new.select(F.col("k").alias("low"), F.col("low").alias("far"))
        new = new.join(jump, "low", "left").select("k", F.coalesce("far", "low").alias("low"), "label")
        new = checkpointed(new)
        changed = new.where("low <> label").count()
        label = new.select("k", F.col("low").alias("label"))
        n += 1
    return label.withColumnRenamed("k", key)


def cell_regions(cells: DataFrame) -> DataFrame:
    """(ix, iy, label) of the 4-connected regions of a cell set; a label is the region's smallest cell number.

    Runs of cells in a row are found by a window; runs that touch in the next row are linked, so the iteration is over
    runs, not cells.
    """
    from pyspark.sql.window import Window as W

    c = cells.select("ix", "iy").distinct()
    c = c.withColumn("grp", F.col("ix") - F.row_number().over(W.partitionBy("iy").orderBy("ix")))
    runs = c.groupBy("iy", "grp").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1")).withColumn("run", F.col("iy").cast("bigint") * F.lit(1 << 31) + F.col("x0"))
    a, b = runs.select("run", "iy", "x0", "x1").alias("a"), runs.select("run", (F.col("iy") - 1).alias("iy"), "x0", "x1").alias("b")
    links = a.join(b, (F.col("a.iy") == F.col("b.iy")) & (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1"))).select(F.col("a.run").alias("a"), F.col("b.run").alias("b"))
    label = linked_labels(runs, links, "run")
    return c.join(runs.select("iy", "grp", "run"), ["iy", "grp"]).join(label, "run").select("ix", "iy", "label")


def polygonise(cells: DataFrame, size: float = 1.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Rings of the regions of a cell set: (label, ring_no, ring); ring 0 is the outline, the others are holes."""
    regions = cell_regions(cells)

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = g.trace_cells(set(zip(pdf.ix.tolist(), pdf.iy.tolist(), strict=True)))
        rings.sort(key=lambda r: -g.signed_area(r))
        rows = [as_rows(r * size + [x0, y0]) for r in rings]
        return pd.DataFrame({"label": int(pdf.label.iloc[0]), "ring_no": range(len(rows)), "ring": rows})

    return regions.groupBy("label").applyInPandas(trace, "label bigint, ring_no int, ring array<struct<x: double, y: double>>")


@F.pandas_udf(RING)
def simplified(ring: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series([as_rows(g.simplify(as_array(r), float(t))) for r, t in zip(ring, tolerance, strict=True)])


@F.pandas_udf(RING)
def hull_of(ring: pd.Series) -> pd.Series:
    return pd.Series([as_rows(g.hull(as_array(r))) for r in ring])


@F.pandas_udf(RING)
def offset_of(ring: pd.Series, distance: pd.Series) -> pd.Series:
    return pd.Series([as_rows(g.offset(as_array(r), float(d))) for r, d in zip(ring, distance, strict=True)])


def exploded(polygons: DataFrame) -> DataFrame:
    """Polygons (poly_idx, rings) as a solid ring each; further rings, holes too, go to the end with numbers of their own."""
    n = polygons.agg(F.coalesce(F.max("poly_idx"), F.lit(0)).alias("n"))
    d = polygons.select("poly_idx", F.posexplode("rings").alias("k", "ring"))
    from pyspark.sql.window import Window as W

    more = d.where("k > 0").crossJoin(F.broadcast(n)).select((F.col("n") + F.row_number().over(W.orderBy("poly_idx", "k"))).cast("int").alias("poly_idx"), "ring")
    return d.where("k = 0").select("poly_idx", "ring").unionByName(more)


def simplify_and_filter(rings: DataFrame, min_area: float = 0.0, tolerance: float = 5e-4) -> DataFrame:
    """Simplified rings that keep ``min_area``."""
    d = rings.withColumn("ring", simplified("ring", F.lit(tolerance)))
    return d.where((F.size("ring") > 3) & (geo.area(F.col("ring")) >= min_area))


def buffered(rings: DataFrame, distance: float) -> DataFrame:
    """Convex outline of each ring moved out by ``distance``; 0 leaves rings as they are. Cell sets have ``dilated``."""
    return rings if distance <= 0 else rings.withColumn("ring", offset_of("ring", F.lit(distance)))


def unioned(rings: DataFrame) -> DataFrame:
    """Overlapping rings merged: overlap pairs by grid cell, their connected groups, one union per group.

    One pass: groups are whole, so the result overlaps no more. poly_idx numbers the rings of the result.
    """
    from pyspark.sql.window import Window as W

    from squadron.operators.spatial import by_cell

    r = rings.select("poly_idx", "ring").where(F.size("ring") > 3)
    cells = by_cell(r)
    pairs = cells.alias("a").join(cells.alias("b"), (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j")) & (F.col("a.poly_idx") < F.col("b.poly_idx")))
    pairs = pairs.select(F.col("a.poly_idx").alias("a"), F.col("b.poly_idx").alias("b"), F.col("a.ring").alias("ra"), F.col("b.ring").alias("rb")).dropDuplicates(["a", "b"])

    @F.pandas_udf("boolean")
    def meets(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([g.overlap(as_array(p), as_array(q)) for p, q in zip(x, y, strict=True)], dtype=bool)

    links = checkpointed(pairs.where(meets("ra", "rb")).select("a", "b"))
    label = linked_labels(r, links, "poly_idx")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [as_array(x) for x in pdf.sort_values("poly_idx").ring]
        out = [g.closed(own[0])] if len(own) == 1 else g.union(own)
        return pd.DataFrame({"label": int(pdf.label.iloc[0]), "k": range(len(out)), "ring": [as_rows(x) for x in out]})

    d = r.join(label, "poly_idx").groupBy("label").applyInPandas(merge, "label int, k int, ring array<struct<x: double, y: double>>")
    return d.select(F.row_number().over(W.orderBy("label", "k")).alias("poly_idx"), "ring")


def prepared(rings: DataFrame, buffer: float = 0.0, min_area: float = 3e-5, tolerance: float = 5e-4) -> DataFrame:
    """Simplify and filter, buffer, union, and once more."""
    d = unioned(buffered(simplify_and_filter(rings, min_area, tolerance), buffer))
    return unioned(simplify_and_filter(d, min_area, tolerance))


def adjusted(rings: DataFrame, points: DataFrame) -> DataFrame:
    """Rings with each contained point put in as a vertex of its first containing ring, so that it lies on the boundary.

    A point goes between the neighbours of least summed Manhattan distance, ties to the first; points of one ring go in
    one after the other, in id order.
    """
    from squadron.operators.spatial import containing

    own = containing(points, rings).where("poly_idx > 0").groupBy("poly_idx").agg(F.sort_array(F.collect_list(F.struct("node_id", "x", "y"))).alias("pts"))

    @F.pandas_udf(RING)
    def put_in(ring: pd.Series, pts: pd.Series) -> pd.Series:
        out = []
        for r, ps in zip(ring, pts, strict=True):
            a = as_array(r)
            for p in [] if ps is None else ps:
                q = np.array([p["x"], p["y"]])
                d = np.abs(a - q).sum(1)
                k = int(np.argmin(d[:-1] + d[1:]))
                a = np.insert(a, k + 1, q, axis=0)
            out.append(as_rows(a))
        return pd.Series(out)

    return rings.join(own, "poly_idx", "left").withColumn("ring", put_in("ring", "pts")).drop("pts")
