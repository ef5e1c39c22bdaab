"""Capacity-limited k-means and one-to-one assignment."""

from __future__ import annotations

import heapq
import math

import numpy as np

from squadron.kernel.geometry import haversine


#: Distances between points and centres that are worked out in one go, and points that are not parted any more.
LEAF, FEW = 20_000, 16
#: Centres from which on a grid is made, and centres about a point up to which they are looked at one by one.
GRID, ABOUT = 256, 64


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point its nearest centre, the first of equals, and the squared distance; for some points at a time.

    Many centres lie in a grid: a point looks at its cell and those around, and where none of them is nearer than the edge
    of these, or too many lie there, it is sought among all.
    """
    if len(c) < GRID:
        return nearest_of_all(x, c)
    label, near = np.full(len(x), len(c)), np.full(len(x), np.inf)
    low, side, g = c[:, :2].min(0), max(float(np.ptp(c[:, :2], axis=0).max()), 1e-300) / np.sqrt(len(c) / 2), int(np.sqrt(len(c) / 2)) + 3
    # Cells from 1 on, with an empty one on each side; points beyond stand in these.
    cell = lambda v: np.clip(np.floor((v - low) / side) + 1, 0, g - 1).astype(np.int64)
    code = cell(c[:, :2]) @ [1, g]
    order = np.argsort(code, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=g * g))])
    at = cell(x[:, :2])
    rows = [(row * g + np.maximum(at[:, 0] - 1, 0), row * g + np.minimum(at[:, 0] + 2, g)) for row in (np.clip(at[:, 1] + k, 0, g - 1) for k in (-1, 0, 1))]
    rows = [(first[a], first[b]) for a, b in rows]
    own = np.flatnonzero(sum(b - a for a, b in rows) <= ABOUT)
    for a, b in rows:
        left, to, end = own, a[own], b[own]
        while len(left := left[more := to < end]):
            to, end = to[more], end[more]
            k = order[to]
            d = (x[left, 0] - c[k, 0]) ** 2
            for axis in range(1, x.shape[1]):
                d += (x[left, axis] - c[k, axis]) ** 2
            less = (d < near[left]) | (d == near[left]) & (k < label[left])
            label[left[less]], near[left[less]] = k[less], d[less]
            to = to + 1
    # The edge of the cells around is a side away at least; a little less for rounding, also of a point's cell.
    rest = np.flatnonzero(~(near < (side * (1 - 1e-6)) ** 2))
    if len(rest):
        label[rest], near[rest] = nearest_by_halves(x[rest], c)
    return label, near


def nearest_by_halves(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``: points are halved across their longest side, each half with the centres that can be the nearest of one
    of its points."""
    label, near = np.zeros(len(x), np.int64), np.zeros(len(x))
    todo = [(np.arange(len(x)), np.arange(len(c)))]
    while todo:
        own, to = todo.pop()
        if len(own) * len(to) <= LEAF or len(own) <= FEW:
            at, far = nearest_of_all(x[own], c[to])
            label[own], near[own] = to[at], far
            continue
        at = x[own]
        middle = len(own) // 2
        half = np.argpartition(at[:, int(np.ptp(at, axis=0).argmax())], middle)
        for part in (half[:middle], half[middle:]):
            k = c[to]
            below, above = at[part].min(0) - k, k - at[part].max(0)
            least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
            # Beyond the farthest that some centre can be from a point of the half; a little more for rounding.
            most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1).min()
            todo.append((own[part], to[least <= most * (1 + 1e-9)]))
    return label, near


def nearest_of_all(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``, each point with each centre."""
    label, near = np.zeros(len(x), np.int64), np.zeros(len(x))
    step = max(1, 500_000 // len(c))
    for i in range(0, len(x), step):
        d = (x[i : i + step, :1] - c[:, 0]) ** 2
        for axis in range(1, x.shape[1]):
            d += (x[i : i + step, axis, None] - c[:, axis]) ** 2
        label[i : i + step] = d.argmin(1)
        near[i : i + step] = d[np.arange(len(d)), label[i : i + step]]
    return label, near


def means(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean points of clusters 0 to k - 1, the origin for those without points, and numbers of points."""
    size = np.bincount(label, minlength=k)
    return np.column_stack([np.bincount(label, v, k) for v in x.T]) / np.maximum(size, 1)[:, None], size


def seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Places of k-means++ seeds. A draw takes sums over runs of points, and a seed looks only at points in the grid cells
    that it may be the nearest seed of."""
    n = len(x)
    chosen, wide, axes = [int(rng.integers(n))], int(np.ceil(np.sqrt(n / 8))), np.ascontiguousarray(x.T)

    def away(at: int, some: np.ndarray) -> np.ndarray:
        gap = some - axes[:, at : at + 1]
        gap *= gap
        for more in gap[1:]:
            gap[0] += more
        return gap[0]

    # Squared distances to the nearest seed, as a table with a run of points in each row.
    d = np.zeros(-(-n // wide) * wide)
    d[:n] = away(chosen[0], axes)
    table = d.reshape(-1, wide)
    total, top = table.sum(1), table.max(1)
    g = max(1, int(np.sqrt(n / 4)))
    low = x[:, :2].min(0)
    side = max(float(np.ptp(x[:, :2], axis=0).max()), 1e-300) / g
    cell = lambda v: np.clip(np.floor((v - low) / side), 0, g - 1).astype(np.int64)
    code = cell(x[:, :2]) @ [1, g]
    order = np.argsort(code, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=g * g))]).tolist()
    (left, under), most = low.tolist(), g - 1
    while len(chosen) < k:
        u, upto = rng.random(), total.cumsum()
        whole = float(upto[-1])
        if whole <= 0:
            chosen.append(min(int(u * n), n - 1))
            continue
        row = int(upto.searchsorted(u * whole, "right"))
        row = row if row < len(total) and total[row] > 0 else int(np.flatnonzero(total)[-1])
        i = int(table[row].cumsum().searchsorted(u * whole - (upto[row - 1] if row else 0.0), "right"))
        at = row * wide + (i if i < wide and table[row, i] > 0 else int(np.flatnonzero(table[row])[-1]))
        chosen.append(at)
        reach, (sx, sy) = math.sqrt(top.max()) * (1 + 1e-9), axes[:2, at].tolist()
        x0, x1, y0, y1 = (min(max(math.floor(v / side), 0), most) for v in (sx - reach - left, sx + reach - left, sy - reach - under, sy + reach - under))
        if 4 * (x1 - x0 + 1) * (y1 - y0 + 1) > g * g:
            np.minimum(d[:n], away(at, axes), out=d[:n])
            total, top = table.sum(1), table.max(1)
            continue
        own = np.concatenate([order[first[y + x0] : first[y + x1 + 1]] for y in range(y0 * g, y1 * g + 1, g)])
        far = away(at, axes.take(own, 1))
        less = (far < d[own]).nonzero()[0]
        own = own[less]
        d[own] = far[less]
        rows = list(set((own // wide).tolist()))
        part = table[rows]
        total[rows], top[rows] = part.sum(1), part.max(1)
    return np.array(chosen)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, max_iter: int = 1000, tol: float = 0.01) -> np.ndarray:
    """Labels of Lloyd's k-means from k-means++ seeds; an empty cluster takes the farthest point."""
    c, before = x[seeds(x, k, rng)], np.inf
    for _ in range(max_iter):
        label, near = nearest(x, c)
        cost = float(near.sum())
        mean, size = means(x, label, k)
        # In the order of labels: a cluster that loses a point to an empty one before it has its mean without that point.
        again = np.flatnonzero(size == 0).tolist()
        mean[again] = c[again]
        while again:
            j = heapq.heappop(again)
            own = label == j
            if own.any():
                mean[j] = x[own].mean(0)
                continue
            far = int(near.argmax())
            near[far] = ((x[far] - c[j]) ** 2).sum()
            if label[far] > j and label[far] not in again:
                heapq.heappush(again, int(label[far]))
            mean[j], label[far] = x[far], j
        c = mean
        if before - cost <= tol * max(cost, 1e-300) and np.isfinite(before):
            break
        before = cost
    return label


def capped_kmeans(x: np.ndarray, cap: int, rng: np.random.Generator, k: int = 0, min_k: int = 0, max_split: float = np.inf, max_iter: int = 1000, tol: float = 0.01) -> np.ndarray:
    """k-means whose clusters hold ``cap`` points at most.

    Over-full clusters, in the order of their labels, give their farthest point to the nearest cluster with room within
    ``max_split`` metres; centroids stay as k-means left them. If no cluster has room, one more cluster is tried, or with
    a given ``k`` an error is raised.
    """
    n = len(x)
    tries = k or max(-(-n // cap), min_k, 1)
    while True:
        tries = min(tries, n)
        label = kmeans(x, tries, rng, max_iter, tol)
        c, size = means(x, label, tries)
        c[size == 0] = x.mean(0)
        ok = True
        for j in np.flatnonzero(size > cap):
            while ok and size[j] > cap:
                own = np.flatnonzero(label == j)
                far = own[int(haversine(x[own, :2], c[j, :2]).argmax())]
                to = haversine(c[:, :2], x[far, :2])
                to = np.where((size < cap) & (to <= max_split), to, np.inf)
                to[j] = np.inf
                if not np.isfinite(to).any():
                    ok = False
                    break
                label[far] = int(to.argmin())
                size[j] -= 1
                size[label[far]] += 1
        if ok:
            return label
        if k:
            raise ValueError(f"{n} points do not fit {k} clusters of {cap}")
        tries += 1


def score(x: np.ndarray, label: np.ndarray) -> float:
    """Sum of sphere distances from the points to their clusters' mean points."""
    order = np.argsort(label, kind="stable")
    mean, size = means(x[:, :2], label, int(label.max()) + 1)
    far, last = haversine(x[order, :2], mean[label[order]]), np.cumsum(size)
    return float(sum(far[b - n : b].sum() for b, n in zip(last.tolist(), size.tolist(), strict=True) if n))


def hungarian(cost: np.ndarray) -> list[int]:
    """For each row its column in a one-to-one assignment of least cost; -1 for rows beyond the number of columns."""
    cost = np.asarray(cost, float)
    rows, cols = cost.shape
    if rows > cols:
        # From the side of the fewer: a round for each column, whatever the number of rows.
        out = [-1] * rows
        for b, a in enumerate(hungarian(cost.T)):
            out[a] = b
        return out
    n = cols
    c = np.zeros((rows + 1, n + 1))
    c[1:, 1:] = cost
    u, v, match = np.zeros(rows + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, rows + 1):
        match[0], j = i, 0
        least, way, seen = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[j]:
            seen[j] = True
            r = match[j]
            now = c[r] - u[r] - v
            now[0] = np.inf
            lower = ~seen & (now < least)
            least[lower], way[lower] = now[lower], j
            free = np.where(seen, np.inf, least)
            free[0] = np.inf
            to = int(free.argmin())
            step = free[to]
            u[match[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            j = to
        while j:
            match[j], j = match[way[j]], way[j]
    out = [-1] * rows
    for j in range(1, cols + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out
