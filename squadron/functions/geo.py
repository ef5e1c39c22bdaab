"""Geometry as Column expressions. Points are (x, y) in degrees; a ring is a closed ARRAY<STRUCT<x, y>>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the sphere's radius in metres.
RADIUS_M = 6_371_000.0


def point(x, y) -> Column:
    return F.struct(F.col(x).alias("x") if isinstance(x, str) else x.alias("x"), F.col(y).alias("y") if isinstance(y, str) else y.alias("y"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it in its own lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def haversine(ax, ay, bx, by) -> Column:
    """Great-circle distance in metres."""
    ax, ay, bx, by = (F.radians(c) for c in (ax, ay, bx, by))
    h = F.pow(F.sin((by - ay) / 2), 2) + F.cos(ay) * F.cos(by) * F.pow(F.sin((bx - ax) / 2), 2)
    return F.lit(2 * RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def between(p: Column, q: Column) -> Column:
    return haversine(p["x"], p["y"], q["x"], q["y"])


def point_in_bbox(x: Column, y: Column, x0, x1, y0, y1) -> Column:
    """Inclusive; on plain columns, so it reaches the Parquet scan."""
    return x.between(x0, x1) & y.between(y0, y1)


def envelope(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def ring_in_bbox(ring: Column, x0, x1, y0, y1) -> Column:
    """The whole envelope lies inside, edges included."""
    return F.forall(ring, lambda p: point_in_bbox(p["x"], p["y"], x0, x1, y0, y1))


def close_ring(points: Column) -> Column:
    """Adds the first point at the end of an open ring."""
    return F.when(F.element_at(points, 1) != F.element_at(points, -1), F.concat(points, F.slice(points, 1, 1))).otherwise(points)


def edges(ring: Column) -> Column:
    """Array of (a, b) of the ring's edges."""
    return F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def on_boundary(x: Column, y: Column, ring: Column) -> Column:
    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        flat = F.abs(cross(b["x"] - a["x"], b["y"] - a["y"], x - a["x"], y - a["y"])) <= 1e-15
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(edges(ring), touches)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """The point lies in the interior: points on the boundary are outside."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans, x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).otherwise(False)

    odd = F.size(F.filter(edges(ring), crossed)) % 2 == 1
    return odd & ~on_boundary(x, y, ring)


def blocks(p: Column, q: Column, ring: Column) -> Column:
    """The segment p-q runs through the ring's interior; contact with the boundary does not count.

    The segment is cut where it meets the ring's edges; it is blocked if the middle of a piece lies in the interior.
    """
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]

    def meets(e: Column) -> Column:
        ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        d = cross(dx, dy, ex, ey)
        t = cross(e["a"]["x"] - p["x"], e["a"]["y"] - p["y"], ex, ey) / d
        u = cross(e["a"]["x"] - p["x"], e["a"]["y"] - p["y"], dx, dy) / d
        return F.when((d != 0) & t.between(0, 1) & u.between(-1e-12, 1 + 1e-12), t)

    cuts = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.transform(edges(ring), meets)))))

    def inside(ts: Column) -> Column:
        middles = F.zip_with(F.slice(ts, F.lit(1), F.size(ts) - 1), F.slice(ts, F.lit(2), F.size(ts) - 1), lambda a, b: F.when(b - a > 1e-9, (a + b) / 2))
        return F.exists(F.array_compact(middles), lambda m: contains(ring, p["x"] + m * dx, p["y"] + m * dy))

    return bound(cuts, inside)


def is_visible(p: Column, q: Column, ring: Column) -> Column:
    return ~blocks(p, q, ring)


def signed_angle(bx, by, vx, vy) -> Column:
    """Angle from the base vector to the other, positive to the left."""
    return F.atan2(cross(bx, by, vx, vy), bx * vx + by * vy)


def area(ring: Column) -> Column:
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + cross(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))) / 2


def centroid(ring: Column) -> Column:
    """Shoelace centroid; of a ring without area, the mean of its points."""

    def of(r: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        o = F.element_at(r, 1)

        def add(acc: Column, e: Column) -> Column:
            ax, ay, bx, by = e["a"]["x"] - o["x"], e["a"]["y"] - o["y"], e["b"]["x"] - o["x"], e["b"]["y"] - o["y"]
            c = cross(ax, ay, bx, by)
            return F.struct((acc["s"] + c).alias("s"), (acc["x"] + (ax + bx) * c).alias("x"), (acc["y"] + (ay + by) * c).alias("y"))

        n = F.size(r).cast("double")
        mean = lambda k: F.aggregate(r, F.lit(0.0), lambda s, p: s + p[k]) / n
        done = lambda a: F.when(a["s"] != 0, F.struct((o["x"] + a["x"] / (3 * a["s"])).alias("x"), (o["y"] + a["y"] / (3 * a["s"])).alias("y"))).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y")))
        return F.aggregate(edges(r), zero, add, done)

    return bound(ring, of)


def vertices(ring: Column) -> Column:
    """Distinct vertices in the order in which they come first."""
    return F.array_distinct(ring)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))


def letter_id(n: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA, 53 is BA; null and numbers below 1 raise."""

    def step(acc: Column, _: Column) -> Column:
        left = acc["n"] - 1
        more = acc["n"] > 0
        digit = F.char(F.lit(65) + left % 26)
        return F.struct(F.when(more, F.floor(left / 26)).otherwise(F.lit(0)).cast("bigint").alias("n"), F.when(more, F.concat(digit, acc["s"])).otherwise(acc["s"]).alias("s"))

    start = F.struct(n.cast("bigint").alias("n"), F.lit("").alias("s"))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["s"])
    return F.when(n >= 1, made).otherwise(F.raise_error(F.lit("a letter id needs a number of 1 or more")))


def suffix_from(path: Column, p: Column) -> Column:
    """The part of a polyline that starts at the point ``p``; null if it is no vertex of it."""
    at = F.array_position(path, p)
    return F.when(at > 0, F.slice(path, at.cast("int"), F.size(path)))


def prefix_to(path: Column, p: Column) -> Column:
    """The part of a polyline that ends at the point ``p``; null if it is no vertex of it."""
    at = F.array_position(path, p)
    return F.when(at > 0, F.slice(path, F.lit(1), at.cast("int")))


def pairs_of(flat: Column) -> Column:
    """Points of a flat list x1, y1, x2, y2, ..."""
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1), lambda i: F.struct(F.get(flat, 2 * i).alias("x"), F.get(flat, 2 * i + 1).alias("y")))
