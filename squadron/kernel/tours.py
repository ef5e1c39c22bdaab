"""Tours on a distance matrix: nearest neighbour, 2-opt, round-robin sorties, waypoints."""

from __future__ import annotations

import math
from collections import deque

import numpy as np

from squadron.functions.geo import RADIUS_M
from squadron.kernel.geometry import haversine

#: Points up to which a path has a matrix; longer ones are searched by near points, in memory that grows with the points.
MATRIX_POINTS = 300
#: Near points of each that are tried first, and the least gain of a longer path's exchange in metres.
NEAR, LEAST_M = 12, 1e-6


def nearest_neighbour(m: np.ndarray, start: int = 0) -> list[int]:
    """Greedy closed tour from ``start``; ties go to the lowest index; points out of reach are left out."""
    left, tour = [k for k in range(len(m)) if k != start], [start]
    while left:
        k = min(left, key=lambda j: (m[tour[-1], j], j))
        if not np.isfinite(m[tour[-1], k]):
            break
        left.remove(k)
        tour.append(k)
    return [*tour, start]


def length(order: list[int], m: np.ndarray) -> float:
    return float(sum(m[a, b] for a, b in zip(order[:-1], order[1:], strict=True)))


def two_opt(order: list[int], m: np.ndarray | list[list[float]], fixed: int = 1) -> list[int]:
    """First-improvement 2-opt with the first ``fixed`` places and the last one fixed, to a local optimum."""
    order, m = list(order), m.tolist() if isinstance(m, np.ndarray) else m
    better = True
    while better:
        better = False
        for i in range(fixed, len(order) - 2):
            for j in range(i + 1, len(order) - 1):
                a, b, c, d = order[i - 1], order[i], order[j], order[j + 1]
                if m[a][c] + m[b][d] < m[a][b] + m[c][d] - 1e-9:
                    order[i : j + 1] = order[i : j + 1][::-1]
                    better = True
    return order


def on_sphere(points: np.ndarray) -> np.ndarray:
    """Places (3 x n) on the sphere of diameter 1: the straight way between two is the sine of half the angle."""
    lon, lat = np.radians(np.asarray(points, float)).T
    return np.array([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]) / 2


def near_points(u: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` points nearest to each, nearest first, and their straight ways squared."""
    n, step = u.shape[1], max(1, 250_000 // u.shape[1])
    who, far = np.zeros((n, k), np.int64), np.zeros((n, k))
    for i in range(0, n, step):
        d = sum((a[i : i + step, None] - a) ** 2 for a in u)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        some = np.argpartition(d, k - 1, 1)[:, :k]
        value = np.take_along_axis(d, some, 1)
        order = value.argsort(1, kind="stable")
        who[i : i + step], far[i : i + step] = np.take_along_axis(some, order, 1), np.take_along_axis(value, order, 1)
    return who, far


def two_opt_path(points: np.ndarray) -> list[int]:
    """2-opt of the path over ``points`` (n x 2) with both ends fixed, to a local optimum: places in their new order.

    A long path has no matrix. Of two new ways one is shorter than the old one at its point, so each point looks for ends
    nearer than its neighbours on the path: first among its nearest points, then, where the old way is longer than those
    reach, among all. Points at a changed way look again; it ends after a round of all points without an exchange.
    """
    n = len(points)
    if n <= MATRIX_POINTS:
        p = np.asarray(points, float)
        return two_opt(list(range(n)), haversine(p[:, None], p[None]))
    u, full = on_sphere(points), 2 * RADIUS_M
    x, y, z = (a.tolist() for a in u)
    near, reach = near_points(u, NEAR)
    ways = (full * np.arcsin(np.minimum(1.0, np.sqrt(reach)))).tolist()
    near = near.tolist()
    order, pos = np.arange(n), np.arange(n)

    def way(a: int, b: int) -> float:
        return full * math.asin(min(1.0, math.sqrt((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 + (z[a] - z[b]) ** 2)))

    def exchange(a: int) -> tuple[int, ...] | None:
        """The best exchange at a point; its four ends if one was made."""
        best, found, i = LEAST_M, None, int(pos[a])
        for side in (1, -1):
            if not 0 <= i + side < n:
                continue
            b = int(order[i + side])
            old = way(a, b)
            for c, d in zip(near[a], ways[a], strict=True):
                if d >= old:
                    break
                k = int(pos[c]) + side
                if 0 <= k < n:
                    e = int(order[k])
                    gain = old - d + way(c, e) - way(b, e)
                    if gain > best:
                        best, found = gain, (side, b, c, e)
            if found is None and ways[a][-1] < old:
                # All points in the order of the path; each meets its neighbour on the same side.
                whole = u[:, order]
                step = lambda v, w: full * np.arcsin(np.minimum(1.0, np.sqrt(((v - w) ** 2).sum(0))))
                here, there = (whole[:, :-1], whole[:, 1:]) if side == 1 else (whole[:, 1:], whole[:, :-1])
                gain = old + step(here, there) - step(here, u[:, a : a + 1]) - step(there, u[:, b : b + 1])
                gain[i if side == 1 else i - 1] = 0.0  # the old way itself
                k = int(gain.argmax())
                if gain[k] > best:
                    c, e = (k, k + 1) if side == 1 else (k + 1, k)
                    best, found = float(gain[k]), (side, b, int(order[c]), int(order[e]))
        if found is None:
            return None
        side, b, c, e = found
        low, high = sorted((i, int(pos[c])))
        low, high = (low + 1, high) if side == 1 else (low, high - 1)
        order[low : high + 1] = order[low : high + 1][::-1].copy()
        pos[order[low : high + 1]] = np.arange(low, high + 1)
        return a, b, c, e

    while True:
        todo, waits, changed = deque(range(n)), np.ones(n, bool).tolist(), False
        while todo:
            a = todo.popleft()
            waits[a] = False
            while ends := exchange(a):
                changed = True
                for e in ends:
                    if e != a and not waits[e]:
                        waits[e] = True
                        todo.append(e)
        if not changed:
            return order.tolist()


def swap(order: list, i: int, j: int) -> list:
    """The order with the places i to j (from 0, both included) reversed."""
    return [*order[:i], *order[i : j + 1][::-1], *order[j + 1 :]]


def sorties(m: np.ndarray, start: int, finish: int, nodes: list[int], n_tenders: int, cap: int) -> list[list[int]]:
    """Round-robin greedy: at each of ``cap`` stops every boat takes its nearest node left; then 2-opt of each sortie.

    Nodes out of reach from ``start`` are left out, and so are boats without a node.
    """
    m = m.tolist()
    left = [k for k in nodes if math.isfinite(m[start][k]) and math.isfinite(m[k][finish])]
    tours: list[list[int]] = [[] for _ in range(n_tenders)]
    for _ in range(cap):
        for t in tours:
            if left:
                way = m[t[-1] if t else start]
                k = min(left, key=lambda j: (way[j], j))
                left.remove(k)
                t.append(k)
    return [two_opt([start, *t, finish], m)[1:-1] for t in tours if t]


def sorties_on_points(points: np.ndarray, n_tenders: int, cap: int) -> list[list[int]]:
    """As ``sorties`` from the first point to the last over all others, with straight ways, in memory that grows with the points."""
    n = len(points)
    u, at = on_sphere(points), np.arange(1, n - 1)
    left = u[:, 1 : n - 1].copy()
    tours: list[list[int]] = [[] for _ in range(n_tenders)]
    for _ in range(cap):
        for t in tours:
            m = left.shape[1]
            if m:
                a = t[-1] if t else 0
                d = (left[0] - u[0, a]) ** 2 + (left[1] - u[1, a]) ** 2 + (left[2] - u[2, a]) ** 2
                # Those as near as the nearest, but for rounding, are told apart by metres, then by place.
                some = np.flatnonzero(d <= d.min() * (1 + 1e-9) + 1e-24)
                k = int(some[0]) if len(some) == 1 else int(min(some, key=lambda j: (float(haversine(points[a], points[at[j]])), at[j])))
                t.append(int(at[k]))
                # The last one takes the place of the one that is gone.
                left[:, k], at[k] = left[:, m - 1], at[m - 1]
                left, at = left[:, : m - 1], at[: m - 1]
    whole = [np.array([0, *t, n - 1]) for t in tours if t]
    return [w[two_opt_path(points[w])][1:-1].tolist() for w in whole]


def waypoints(depot, centroids: list, end=None) -> list[tuple[float, float]]:
    """Depot, an entry and an exit for each centroid a third of the way to its neighbours, and the depot."""
    chain = [tuple(map(float, p)) for p in (depot, *centroids, depot if end is None else end)]
    out = [chain[0]]
    for before, c, after in zip(chain[:-2], chain[1:-1], chain[2:], strict=True):
        out += between(c, before), between(c, after)
    return [*out, chain[-1]]


def between(c: tuple[float, float], near: tuple[float, float]) -> tuple[float, float]:
    """The point a third of the way from a centroid to a neighbour."""
    return (2 * c[0] + near[0]) / 3, (2 * c[1] + near[1]) / 3
