"""Shortest feasible paths round polygons: the visibility graph and Dijkstra with sphere distances."""

from __future__ import annotations

import heapq
from itertools import combinations

import numpy as np

from squadron.functions.geo import RADIUS_M
from squadron.kernel.geometry import blocked, blocked_pairs, closed, haversine, inside, inside_pairs

#: Points whose visible vertices a worker keeps, and ways that it keeps.
KEPT_POINTS = 100_000
KEPT_WAYS = 200_000
#: How far beyond a ring's box a point may lie that rounding takes for one inside.
EDGE = 1e-9
#: Pairs of segments or points and rings that are compared at a time.
PAIRS = 1_000_000
#: Ways between each of some points and each of others that are worked out at a time.
MESH = 65_536
#: Corners up to which the ways between all of them are kept as one matrix.
DENSE = 128
#: Part of the extent within which rounding might decide whether a segment meets a ring; there each is looked at exactly.
SURE = 1e-8


def sides(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Unit normals (inwards) and offsets of the sides of a convex ring without sharp corners, else None."""
    r = ring[:-1][(np.diff(ring, axis=0) != 0).any(1)]
    e = np.roll(r, -1, 0) - r
    on = np.roll(e, -1, 0)
    turn = np.arctan2(e[:, 0] * on[:, 1] - e[:, 1] * on[:, 0], (e * on).sum(1))
    way = np.sign(turn.sum())
    if not 3 <= len(r) <= 64 or (turn * way < 0).any() or (turn * way > 2.9).any() or abs(abs(turn.sum()) - 2 * np.pi) > 1e-6:
        return None
    normal = np.column_stack([-e[:, 1], e[:, 0]]) * way / np.hypot(e[:, 0], e[:, 1])[:, None]
    return normal, (normal * r).sum(1)


def flags(bits: np.ndarray) -> np.ndarray:
    """Each row of up to 64 truth values as the bits of one number."""
    kind = np.uint8 if bits.shape[1] <= 8 else np.uint64
    return np.bitwise_or.reduce(bits.astype(kind) << np.arange(bits.shape[1], dtype=kind), 1)


class Zones:
    """A zone set with the visibility edges between its vertices, worked out once and used for every pair."""

    def __init__(self, rings: list):
        self.rings = [closed(r) for r in rings if len(r) > 2]
        self.low = np.array([r.min(0) for r in self.rings]).reshape(-1, 2)
        self.high = np.array([r.max(0) for r in self.rings]).reshape(-1, 2)
        #: Rings by the power of two of their corners, each filled up with its last one: (ring, its group and place in it).
        group = np.array([(len(r) - 2).bit_length() for r in self.rings], np.int64)
        self.groups = []
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            most = max(len(self.rings[k]) for k in own)
            self.groups.append((own, np.array([np.vstack([self.rings[k], np.repeat(self.rings[k][-1:], most - len(self.rings[k]), 0)]) for k in own])))
        v = [p for r in self.rings for p in r[:-1]]
        self.points = np.unique(np.array(v).reshape(-1, 2), axis=0)
        if len(self.points):
            self.points = self.points[~self.covered(self.points)]
        self._edges: list[list[tuple[int, float]]] | None = None
        self._paths: dict[tuple, tuple[float, list]] = {}
        self._seen: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self._trees: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._between: np.ndarray | None = None
        self._far: dict[tuple, float] = {}
        self._lengths: dict[tuple, float] = {}
        self._hidden: dict[tuple, bool] = {}
        self._sides: list | None = None

    def covered(self, points) -> np.ndarray:
        p = np.atleast_2d(np.asarray(points, float))
        out = np.zeros(len(p), bool)
        for own, rings in self.groups:
            for i, k in self.pairs(p, p, own, EDGE):
                out[i[inside_pairs(p[i], rings[k])]] = True
        return out

    def hidden(self, points: list[tuple[float, float]]) -> list[bool]:
        """As ``covered``, kept for the next time; new points are looked at together."""
        if len(self._hidden) > KEPT_POINTS:
            self._hidden.clear()
        new = [p for p in dict.fromkeys(points) if p not in self._hidden]
        if new:
            self._hidden.update(zip(new, self.covered(new).tolist(), strict=True))
        return [self._hidden[p] for p in points]

    def pairs(self, low: np.ndarray, high: np.ndarray, own: np.ndarray, edge: float = 0.0):
        """(boxes, places in ``own``) of the boxes that meet a ring's, many at a time."""
        step = max(1, PAIRS // max(1, len(own)))
        at, to = self.low[own] - edge, self.high[own] + edge
        for i in range(0, len(low), step):
            a, b = low[i : i + step], high[i : i + step]
            meet = (b[:, :1] >= at[:, 0]) & (a[:, :1] <= to[:, 0]) & (b[:, 1:] >= at[:, 1]) & (a[:, 1:] <= to[:, 1])
            n, k = np.nonzero(meet)
            if len(n):
                yield n + i, k

    def first_containing(self, point) -> int:
        """1-based place of the first zone with the point in its interior, else 0."""
        return next((k for k, r in enumerate(self.rings, 1) if inside(point, r)[0]), 0)

    def visible(self, p, q) -> bool:
        p, q = np.asarray(p, float), np.asarray(q, float)
        near = np.flatnonzero(((np.maximum(p, q) >= self.low) & (np.minimum(p, q) <= self.high)).all(1))
        return not any(blocked(p, q, self.rings[k]) for k in near)

    def sight(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """As ``visible``, for many segments (n x 2 each)."""
        free, low, high = np.ones(len(p), bool), np.minimum(p, q), np.maximum(p, q)
        for own, rings in self.groups:
            for i, k in self.pairs(low, high, own):
                # A ring whose box lies on one side of the line is not met.
                d, at, to = q[i] - p[i], self.low[own[k]] - p[i], self.high[own[k]] - p[i]
                (y, v), (x, u) = d[:, 0] * (at[:, 1], to[:, 1]), d[:, 1] * (at[:, 0], to[:, 0])
                edge = EDGE * np.abs(d).sum(1)
                meet = (np.maximum(y, v) - np.minimum(x, u) >= -edge) & (np.minimum(y, v) - np.maximum(x, u) <= edge)
                i, k = i[meet], k[meet]
                free[i[blocked_pairs(p[i], q[i], rings, k)]] = False
        return free

    def sights(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """As ``sight``, of each of ``p`` with each of ``q``. A segment has a convex ring beside it if both ends lie beyond one
        side, or all corners on one hand of it, and meets it if neither holds; what is too close to tell, and other rings,
        are looked at exactly."""
        free = np.ones((len(p), len(q)), bool)
        if not len(p) or not len(q):
            return free
        if self._sides is None:
            self._sides = [sides(r) for r in self.rings]
        low, high = np.minimum(p.min(0), q.min(0)), np.maximum(p.max(0), q.max(0))
        edge = SURE * max(1.0, float((high - low).max()))
        for k in np.flatnonzero(((high >= self.low) & (low <= self.high)).all(1)):
            ring, known = self.rings[k], self._sides[k]
            if known is None:
                i, j = np.nonzero(free)
                meet = ((np.maximum(p[i], q[j]) >= self.low[k]) & (np.minimum(p[i], q[j]) <= self.high[k])).all(1)
                i, j = i[meet], j[meet]
            else:
                a, b = (at @ known[0].T - known[1] for at in (p, q))
                i, j = np.nonzero(free & ((flags(a < -edge)[:, None] & flags(b < -edge)) == 0))
                x, y = p[i, 0], p[i, 1]
                dx, dy = q[j, 0] - x, q[j, 1] - y
                least, most = np.full(len(i), np.inf), np.full(len(i), -np.inf)
                for vx, vy in ring[:-1]:
                    hand = dx * (vy - y) - dy * (vx - x)
                    np.minimum(least, hand, out=least)
                    np.maximum(most, hand, out=most)
                reach = 10 * edge * (np.abs(dx) + np.abs(dy))
                met = (least < -reach) & (most > reach) & ((flags(a <= edge)[i] & flags(b <= edge)[j]) == 0)
                free[i[met], j[met]] = False
                open_ = ~(met | (least > reach) | (most < -reach))
                i, j = i[open_], j[open_]
            hit = blocked_pairs(p[i], q[j], ring[None], np.zeros(len(i), np.int64))
            free[i[hit], j[hit]] = False
        return free

    def spread(self, p: np.ndarray) -> np.ndarray:
        """Metres from each point to each corner, Infinity where it is out of sight."""
        return np.where(self.sights(p, self.points), haversine(p[:, None], self.points), np.inf)

    def meshes(self, p: np.ndarray, q: np.ndarray):
        """``ways``, metres only, from each of ``p`` to each of ``q``: (first of p, metres) of some of ``p`` at a time."""
        bad_p, bad_q, n = self.covered(p), self.covered(q), len(self.points)
        dense = 0 < n <= DENSE
        if dense:
            there, back = self.spread(p), self.spread(q)
            back = np.column_stack([(back + row).min(1) for row in self.between])
        step = max(1, MESH // max(1, len(q)))
        (px, py), (qx, qy) = np.radians(p).T, np.radians(q).T
        for at in range(0, len(p), step):
            own = slice(at, at + step)
            free = self.sights(p[own], q)
            # As ``haversine``, axis by axis.
            far = np.sin((qy - py[own, None]) / 2) ** 2
            far += np.cos(py[own, None]) * np.cos(qy) * np.sin((qx - px[own, None]) / 2) ** 2
            far = 2 * RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(far)))
            round_ = ~free
            round_[bad_p[own]] = False
            round_[:, bad_q] = False
            if dense:
                over, sum_ = np.full(far.shape, np.inf), np.empty(far.shape)
                for k in np.flatnonzero(np.isfinite(there[own]).any(0) & np.isfinite(back).any(0)):
                    np.add(there[own, k, None], back[:, k], out=sum_)
                    np.minimum(over, sum_, out=over)
                np.copyto(far, over, where=round_)
            else:
                i, j = np.nonzero(round_)
                ends = [(tuple(a), tuple(b)) for a, b in zip(p[own][i].tolist(), q[j].tolist(), strict=True)]
                self.look([e for both in ends for e in both], open_=True)
                far[i, j] = self.over(ends, False)
            far[bad_p[own]] = np.inf
            far[:, bad_q] = np.inf
            far[(p[own, None] == q).all(2)] = 0.0
            yield at, far

    @property
    def edges(self) -> list[list[tuple[int, float]]]:
        if self._edges is None:
            n = len(self.points)
            self._edges = [[] for _ in range(n)]
            for i in range(n):
                on = self.points[i + 1 :]
                seen = np.flatnonzero(self.sight(np.broadcast_to(self.points[i], on.shape), on))
                for j, d in zip((seen + i + 1).tolist(), haversine(self.points[i], on[seen]).tolist(), strict=True):
                    self._edges[i].append((j, d))
                    self._edges[j].append((i, d))
        return self._edges

    def path(self, p, q) -> tuple[float, list[tuple[float, float]]]:
        """(metres, points) of the shortest path; (inf, []) if an end lies inside a zone or no way leads there."""
        a, b = tuple(map(float, p)), tuple(map(float, q))
        if a == b:
            return 0.0, [a]
        self.keep([(a, b)], self._paths, True)
        return self._paths[a, b]

    def learn(self, pairs: list[tuple[tuple[float, float], tuple[float, float]]]) -> None:
        """Keeps the metres of all ``pairs``; those not known yet are looked at together."""
        self.keep(pairs, self._far, False)

    def keep(self, pairs: list[tuple], kept: dict[tuple, object], points: bool) -> None:
        """Fills ``kept`` with the ways of ``pairs`` in both directions. A way is worked out from its smaller end, so that it
        does not depend on what was asked for before."""
        if len(kept) >= KEPT_WAYS:
            kept.clear()
        new = {w if w[0] <= w[1] else w[::-1]: None for w in pairs if w not in kept}
        if new:
            ends = list(zip(*new, strict=True))
            bad = np.array([self.hidden(e) for e in ends]).any(0)
            for (a, b), found in zip(new, self.ways(*(np.array(e, float) for e in ends), bad, points), strict=True):
                kept[a, b] = found
                kept[b, a] = (found[0], found[1][::-1]) if points else found

    def ways(self, p: np.ndarray, q: np.ndarray, bad: np.ndarray | None = None, points: bool = True) -> list:
        """``path`` of many pairs (n x 2 each), none of them kept, or only the metres; ``bad``, if known, are those with an end
        in a zone."""
        bad = self.covered(p) | self.covered(q) if bad is None else bad
        free = self.sight(p, q) & ~bad
        far, round_ = haversine(p, q), np.flatnonzero(~free & ~bad)
        ends = [(tuple(a), tuple(b)) for a, b in zip(p[round_].tolist(), q[round_].tolist(), strict=True)]
        self.look([e for both in ends for e in both], open_=True)
        over = self.over(ends, points)
        far[bad] = np.inf
        far[(p == q).all(1)] = 0.0
        if not points:
            far[round_] = over
            return far.tolist()
        out = [(d, [] if d == float("inf") else [tuple(a)] if a == b else [tuple(a), tuple(b)]) for a, b, d in zip(p.tolist(), q.tolist(), far.tolist(), strict=True)]
        for i, way in zip(round_.tolist(), over, strict=True):
            out[i] = way
        return out

    @property
    def between(self) -> np.ndarray:
        """Metres of the ways between all corners."""
        if self._between is None:
            self._between = np.array([self.tree(k)[0] for k in range(len(self.points))])
        return self._between

    def over(self, ends: list[tuple], points: bool = True) -> list:
        """``around`` of many pairs, or only the metres; with few corners in whole arrays, some of them at a time."""
        n = len(self.points)
        if not n or n > DENSE:
            return [w if points else w[0] for w in (self.around(a, b) for a, b in ends)]
        out, step = [], max(1, PAIRS // (n * n))
        for i in range(0, len(ends), step):
            some = ends[i : i + step]
            far = np.full((2, len(some), n), np.inf)
            for q, (a, b) in enumerate(some):
                for side, p in enumerate((a, b)):
                    k, d = self.seen(p)
                    far[side, q, k] = d
            # The sums of ``around`` in their order; the first of equal ones is taken as there.
            on = self.between[None] + far[1][:, None, :]
            last = on.argmin(2)
            whole = far[0] + np.take_along_axis(on, last[:, :, None], 2)[:, :, 0]
            first = whole.argmin(1)
            at = np.arange(len(some))
            if not points:
                out += whole[at, first].tolist()
                continue
            for (a, b), k, e, d in zip(some, first.tolist(), last[at, first].tolist(), whole[at, first].tolist(), strict=True):
                out.append((d, self.corners(a, b, k, e)) if d < float("inf") else (d, []))
        return out

    def look(self, points: list[tuple[float, float]], open_: bool = False) -> None:
        """Finds what the points see, many at a time; ``open_``: none of them lies in a zone."""
        new = [p for p in dict.fromkeys(points) if p not in self._seen]
        if not new:
            return
        if len(self._seen) > KEPT_POINTS:
            self._seen.clear()
            new = list(dict.fromkeys(points))
        n, step = len(self.points), max(1, 100_000 // max(1, len(self.points)))
        hidden = np.zeros(len(new), bool) if open_ else self.covered(new)
        for i in range(0, len(new), step):
            at = np.array(new[i : i + step], float)
            clear = self.sight(np.repeat(at, n, 0), np.tile(self.points, (len(at), 1))).reshape(len(at), n) & ~hidden[i : i + step, None]
            far = haversine(at[:, None], self.points)
            for p, own, d in zip(new[i : i + step], clear, far, strict=True):
                k = np.flatnonzero(own)
                self._seen[p] = k, d[k]

    def seen(self, p: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        """Vertices in sight of a point and the metres to them, none from inside a zone; kept for the point's other ways."""
        if p not in self._seen:
            self.look([p])
        return self._seen[p]

    def tree(self, root: int) -> tuple[np.ndarray, np.ndarray]:
        """Shortest ways from a vertex to all others by Dijkstra: metres, and the vertex before each."""
        if root not in self._trees:
            far, came = np.full(len(self.points), np.inf), np.full(len(self.points), -1)
            far[root], heap = 0.0, [(0.0, root)]
            while heap:
                d, k = heapq.heappop(heap)
                if d > far[k]:
                    continue
                for j, w in self.edges[k]:
                    if d + w < far[j]:
                        far[j], came[j] = d + w, k
                        heapq.heappush(heap, (d + w, j))
            self._trees[root] = far, came
        return self._trees[root]

    def around(self, a: tuple[float, float], b: tuple[float, float]) -> tuple[float, list[tuple[float, float]]]:
        """The shortest way over vertices, for two points that do not see each other."""
        (ka, da), (kb, db) = self.seen(a), self.seen(b)
        end, first, last = float("inf"), -1, -1
        if len(kb):
            for k, d in zip(ka.tolist(), da.tolist(), strict=True):
                if d >= end:
                    continue
                on = self.tree(k)[0][kb] + db
                i = int(on.argmin())
                if d + on[i] < end:
                    end, first, last = d + float(on[i]), k, int(kb[i])
        return (float("inf"), []) if first < 0 else (end, self.corners(a, b, first, last))

    def corners(self, a: tuple[float, float], b: tuple[float, float], first: int, last: int) -> list[tuple[float, float]]:
        """The points of the way from a to b whose first and last vertices are these."""
        points, k, came = [b], last, self.tree(first)[1]
        while k >= 0:
            points.append(tuple(self.points[k].tolist()))
            k = int(came[k])
        # An end that is itself a vertex stands once.
        inner = [p for p in points[:0:-1] if p not in (a, b)]
        return [a, *inner, b]

    def table(self, at: list[tuple[float, float]]) -> list[list[float]]:
        """Metres between all of some points, as lists."""
        n = len(at)
        ways = list(combinations(at, 2))
        if not all(w in self._far for w in ways):
            self.learn(ways)
        far = iter([self._far[w] for w in ways])
        m = [[0.0] * n for _ in range(n)]
        for i in range(n):
            for j in range(i + 1, n):
                m[i][j] = m[j][i] = next(far)
        return m

    def matrix(self, points) -> np.ndarray:
        return np.array(self.table([tuple(map(float, p)) for p in points])).reshape(len(points), len(points))

    def length(self, points: tuple) -> float:
        """Metres of the way over points, kept for the next time."""
        found = self._lengths.get(points)
        if found is None:
            if len(self._lengths) > KEPT_WAYS:
                self._lengths.clear()
            found = self._lengths[points] = sum(self.metres(points))
        return found

    def metres(self, points) -> list[float]:
        """Metres of each leg of the way over points."""
        ways = list(zip(points[:-1], points[1:], strict=True))
        try:
            return [self._far[w] for w in ways]
        except KeyError:
            self.learn(ways)
            return [self._far[w] for w in ways]

    def legs(self, points) -> list[tuple[float, list]]:
        at = [tuple(map(float, p)) for p in points]
        ways = list(zip(at[:-1], at[1:], strict=True))
        self.keep(ways, self._paths, True)
        return [self._paths[w] for w in ways]
