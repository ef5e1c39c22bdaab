"""Plane geometry on rings (closed n x 2 arrays) and distances on the sphere."""

from __future__ import annotations

import numpy as np

from squadron.functions.geo import RADIUS_M

EPS = 1e-12


def haversine(a, b) -> np.ndarray:
    """Metres between points or arrays of points (..., 2) in degrees."""
    a, b = np.radians(np.asarray(a, float)), np.radians(np.asarray(b, float))
    d = (b - a) / 2
    h = np.sin(d[..., 1]) ** 2 + np.cos(a[..., 1]) * np.cos(b[..., 1]) * np.sin(d[..., 0]) ** 2
    return 2 * RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def closed(ring) -> np.ndarray:
    r = np.asarray(ring, float).reshape(-1, 2)
    return r if len(r) and (r[0] == r[-1]).all() else np.vstack([r, r[:1]])


def cross(a, b):
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def signed_area(ring) -> float:
    r = closed(ring)
    return float(cross(r[:-1] - r[0], r[1:] - r[0]).sum() / 2)


def inside(points, ring) -> np.ndarray:
    """Which points lie in the interior; the boundary is outside."""
    p, r = np.atleast_2d(np.asarray(points, float)), closed(ring)
    a, b = r[:-1], r[1:]
    x, y = p[:, :1], p[:, 1:]
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        right = x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    odd = (spans & right).sum(1) % 2 == 1
    scale = EPS * max(1.0, float(np.abs(b - a).max(initial=0.0)))
    flat = np.abs((b - a)[:, 0] * (y - a[:, 1]) - (b - a)[:, 1] * (x - a[:, 0])) <= scale
    low, high = np.minimum(a, b) - EPS, np.maximum(a, b) + EPS
    on = flat & (x >= low[:, 0]) & (x <= high[:, 0]) & (y >= low[:, 1]) & (y <= high[:, 1])
    return odd & ~on.any(1)


def blocked(p, q, ring) -> bool:
    """The segment p-q runs through the interior; contact with the boundary does not count."""
    r = closed(ring)
    p, q = np.asarray(p, float), np.asarray(q, float)
    if (np.maximum(p, q) < r.min(0)).any() or (np.minimum(p, q) > r.max(0)).any():
        return False
    d, e, w = q - p, r[1:] - r[:-1], r[:-1] - p
    with np.errstate(divide="ignore", invalid="ignore"):
        den = d[0] * e[:, 1] - d[1] * e[:, 0]
        t, u = cross(w, e) / den, (w[:, 0] * d[1] - w[:, 1] * d[0]) / den
    hit = (np.abs(den) > 0) & (t >= 0) & (t <= 1) & (u >= -EPS) & (u <= 1 + EPS)
    ts = np.unique(np.concatenate([[0.0, 1.0], t[hit]]))
    mids = (ts[1:] + ts[:-1])[ts[1:] - ts[:-1] > 1e-9] / 2
    return bool(len(mids)) and bool(inside(p + mids[:, None] * d, r).any())


def blocked_many(p: np.ndarray, q: np.ndarray, ring) -> np.ndarray:
    """As ``blocked``, for many segments (n x 2 each) in whole arrays, some of them at a time."""
    return blocked_pairs(p, q, closed(ring)[None], np.zeros(len(p), np.int64))


def inside_pairs(p: np.ndarray, rings: np.ndarray) -> np.ndarray:
    """As ``inside``, each point (n x 2) with a closed ring of its own (n x corners x 2); repeated corners change nothing."""
    a, b = rings[:, :-1], rings[:, 1:]
    x, y, ax, ay, bx, by = p[:, :1], p[:, 1:], a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    dx, dy = bx - ax, by - ay
    spans = (ay > y) != (by > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        right = x < dx * (y - ay) / dy + ax
    odd = (spans & right).sum(1) % 2 == 1
    out = np.flatnonzero(odd)
    x, y, ax, ay, bx, by, dx, dy = (v[out] for v in (x, y, ax, ay, bx, by, dx, dy))
    scale = EPS * np.maximum(1.0, np.maximum(np.abs(dx), np.abs(dy)).max(1, initial=0.0))[:, None]
    on = (np.abs(dx * (y - ay) - dy * (x - ax)) <= scale) & (x >= np.minimum(ax, bx) - EPS) & (x <= np.maximum(ax, bx) + EPS) & (y >= np.minimum(ay, by) - EPS) & (y <= np.maximum(ay, by) + EPS)
    odd[out[on.any(1)]] = False
    return odd


def blocked_pairs(p: np.ndarray, q: np.ndarray, rings: np.ndarray, k: np.ndarray) -> np.ndarray:
    """As ``blocked``, each segment (n x 2 each) with the ring of place ``k`` among ``rings`` (all x corners x 2), some of them
    at a time."""
    step = max(1, 200_000 // rings.shape[1])
    if len(p) > step:
        return np.concatenate([blocked_pairs(p[i : i + step], q[i : i + step], rings, k[i : i + step]) for i in range(0, len(p), step)])
    own, d = rings[k], q - p
    e, w = own[:, 1:] - own[:, :-1], own[:, :-1] - p[:, None]
    dx, dy, ex, ey, wx, wy = d[:, :1], d[:, 1:], e[..., 0], e[..., 1], w[..., 0], w[..., 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        den = dx * ey - dy * ex
        t, u = (wx * ey - wy * ex) / den, (wx * dy - wy * dx) / den
        hit = (np.abs(den) > 0) & (t >= 0) & (t <= 1) & (u >= -EPS) & (u <= 1 + EPS)
    ts = np.empty((len(p), e.shape[1] + 2))
    ts[:, 0], ts[:, 1] = 0.0, 1.0
    ts[:, 2:] = np.where(hit, t, 1.0)
    ts.sort(1)
    i, j = np.nonzero(ts[:, 1:] - ts[:, :-1] > 1e-9)
    out = np.zeros(len(p), bool)
    out[i[inside_pairs(p[i] + ((ts[i, j + 1] + ts[i, j]) / 2)[:, None] * d[i], own[i])]] = True
    return out


def hull(points) -> np.ndarray:
    """Convex hull as a closed ring, anticlockwise."""
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return closed(p)

    def chain(seq):
        out: list[np.ndarray] = []
        for c in seq:
            while len(out) > 1 and cross(out[-1] - out[-2], c - out[-2]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    return closed(chain(p) + chain(p[::-1]))


def simplify(ring, tolerance: float) -> np.ndarray:
    """Drops vertices no farther than ``tolerance`` from the chord of those kept; the ring's first point stays."""
    r = closed(ring)
    if len(r) < 5 or tolerance <= 0:
        return r
    far = int(np.argmax(((r - r[0]) ** 2).sum(1)))
    keep = np.zeros(len(r), bool)
    keep[[0, far, len(r) - 1]] = True
    todo = [(0, far), (far, len(r) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d, w = r[j] - r[i], r[i + 1 : j] - r[i]
        length = float(np.hypot(*d))
        gap = np.abs(cross(w, d)) / length if length else np.hypot(w[:, 0], w[:, 1])
        k = int(np.argmax(gap))
        if gap[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return r[keep]


def offset(ring, distance: float) -> np.ndarray:
    """Buffer of a convex outline: the hull of circles (16 sides, drawn outside) about the vertices."""
    if distance <= 0:
        return closed(ring)
    turn = np.arange(16) * np.pi / 8
    circle = np.column_stack([np.cos(turn), np.sin(turn)]) * distance / np.cos(np.pi / 16)
    return hull((closed(ring)[:-1, None, :] + circle[None]).reshape(-1, 2))


def overlap(a, b) -> bool:
    """The interiors meet."""
    a, b = closed(a), closed(b)
    if (a.max(0) <= b.min(0)).any() or (b.max(0) <= a.min(0)).any():
        return False
    if inside(a[:-1], b).any() or inside(b[:-1], a).any():
        return True
    return any(blocked(a[i], a[i + 1], b) for i in range(len(a) - 1)) or any(blocked(b[i], b[i + 1], a) for i in range(len(b) - 1)) or bool(inside(interior_point(a)[None], b)[0])


def interior_point(ring) -> np.ndarray:
    r = closed(ring)
    ys = np.unique(r[:, 1])
    for y in (ys[1:] + ys[:-1]) / 2:
        a, b = r[:-1], r[1:]
        on = (a[:, 1] > y) != (b[:, 1] > y)
        xs = np.sort((b - a)[on, 0] * (y - a[on, 1]) / (b - a)[on, 1] + a[on, 0])
        if len(xs) > 1 and xs[1] > xs[0]:
            return np.array([(xs[0] + xs[1]) / 2, y])
    return r.mean(0)


def union(rings: list) -> list[np.ndarray]:
    """Outer rings of the union of rings whose interiors overlap: the edges' pieces outside all others, joined up."""
    rings = [closed(r) if signed_area(r) > 0 else closed(r)[::-1] for r in rings if abs(signed_area(r)) > 0]
    pieces: dict[tuple, list[tuple]] = {}
    kept: set[tuple] = set()
    for i, r in enumerate(rings):
        for p, q in zip(r[:-1], r[1:], strict=True):
            ts = [0.0, 1.0]
            d = q - p
            for j, s in enumerate(rings):
                if i == j:
                    continue
                e, w = s[1:] - s[:-1], s[:-1] - p
                den = d[0] * e[:, 1] - d[1] * e[:, 0]
                with np.errstate(divide="ignore", invalid="ignore"):
                    t, u = cross(w, e) / den, (w[:, 0] * d[1] - w[:, 1] * d[0]) / den
                ts += t[(den != 0) & (t > EPS) & (t < 1 - EPS) & (u > -EPS) & (u < 1 + EPS)].tolist()
                along = cross(s[:-1] - p, np.broadcast_to(d, s[:-1].shape))
                t = ((s[:-1] - p) @ d) / (d @ d) if d @ d else np.zeros(0)
                ts += [float(x) for x, c in zip(t, along, strict=False) if abs(c) < EPS and EPS < x < 1 - EPS]
            cut = np.unique(np.round(ts, 12))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a < 1e-10:
                    continue
                m = p + (a + b) / 2 * d
                if any(inside(m[None], s)[0] for j, s in enumerate(rings) if j != i):
                    continue
                x, y = (tuple(np.round(p + t * d, 10)) for t in (a, b))
                if x == y or (x, y) in kept:
                    continue
                if (y, x) in kept:  # two rings side by side: their common edge goes
                    kept.discard((y, x))
                    continue
                kept.add((x, y))
    for x, y in sorted(kept):
        pieces.setdefault(x, []).append(y)
    out = []
    while pieces:
        start = min(pieces)
        loop, at, came = [start], start, None
        while True:
            options = pieces[at]
            nxt = options[0] if len(options) == 1 or came is None else min(options, key=lambda o: turn_of(came, at, o))
            options.remove(nxt)
            if not options:
                del pieces[at]
            came, at = at, nxt
            loop.append(at)
            if at == start or at not in pieces:
                break
        if at == start and len(loop) > 3 and signed_area(loop) > 0:
            out.append(straight(np.array(loop)))
    return out


def turn_of(a, b, c) -> float:
    """Angle at b from the way back to a, clockwise: the smallest keeps an outer ring simple."""
    back, on = np.arctan2(a[1] - b[1], a[0] - b[0]), np.arctan2(c[1] - b[1], c[0] - b[0])
    return float((back - on) % (2 * np.pi)) or 2 * np.pi


def straight(ring) -> np.ndarray:
    """Without vertices on the line between their neighbours."""
    r = closed(ring)[:-1]
    before, after = np.roll(r, 1, 0), np.roll(r, -1, 0)
    keep = np.abs(cross(r - before, after - r)) > 1e-14
    return closed(r[keep]) if keep.sum() >= 3 else closed(r)


def trace_cells(cells: set[tuple[int, int]]) -> list[np.ndarray]:
    """Outer rings and holes of 4-connected cells, on the cells' corners; outer rings run anticlockwise, holes the other way."""
    nxt: dict[tuple, list[tuple]] = {}
    for i, j in sorted(cells):
        for near, a, b in (((i, j - 1), (i, j), (i + 1, j)), ((i + 1, j), (i + 1, j), (i + 1, j + 1)), ((i, j + 1), (i + 1, j + 1), (i, j + 1)), ((i - 1, j), (i, j + 1), (i, j))):
            if near not in cells:
                nxt.setdefault(a, []).append(b)
    out = []
    while nxt:
        start = min(nxt)
        loop, at, came = [start], start, None
        while True:
            options = nxt[at]
            # At a corner that two cells share crosswise, turn left: the cells are not connected there.
            b = options[0] if len(options) == 1 or came is None else max(options, key=lambda o: cross(np.subtract(at, came), np.subtract(o, at)))
            options.remove(b)
            if not options:
                del nxt[at]
            came, at = at, b
            loop.append(at)
            if at == start:
                break
        out.append(straight(np.array(loop, float)))
    return out
