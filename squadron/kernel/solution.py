"""A plan of one fleet, its score, and the searches that improve it."""

from __future__ import annotations

import math
from collections.abc import Generator
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import combinations

import numpy as np

from squadron.kernel import tours
from squadron.kernel.paths import KEPT_POINTS, Zones

HOURS = 3.6


@dataclass(frozen=True)
class Fleet:
    depot: tuple[float, float]
    w_ms: float
    w_t: float
    n_tenders: int
    cap: int
    ms: Zones
    tender: Zones
    #: Waypoints by their cluster's centroid and the neighbour's, out of zones.
    spots: dict[tuple, tuple[float, float]] = field(default_factory=dict, compare=False, repr=False)

    def covered(self, points) -> np.ndarray:
        """Points in a zone of either vessel."""
        out = self.ms.covered(points)
        return out if self.tender is self.ms else out | self.tender.covered(points)

    @cached_property
    def corners(self) -> np.ndarray:
        """Vertices of the zones' hulls that lie in no hull."""
        from squadron.kernel.geometry import hull, inside

        hulls = [hull(r) for r in [*self.ms.rings, *self.tender.rings]]
        free = np.array([p for h in hulls for p in h[:-1]]).reshape(-1, 2)
        for h in hulls:
            free = free[~inside(free, h)] if len(free) else free
        return free


@dataclass(frozen=True)
class Plan:
    """Cluster ids in the order of the tour, nodes (id, x, y) of each, 2n + 2 waypoints, and node ids of each sortie."""

    order: tuple[int, ...]
    nodes: dict[int, dict[int, tuple[float, float]]]
    points: tuple[tuple[float, float], ...]
    sorties: dict[int, tuple[tuple[int, ...], ...]] = field(default_factory=dict)
    #: Of each cluster what its sorties' lengths were measured from, and these; plans made from this one take what still holds.
    known: dict[int, tuple] = field(default_factory=dict, compare=False, repr=False)
    means: dict[int, tuple] = field(default_factory=dict, compare=False, repr=False)

    def centroid(self, c: int) -> tuple[float, float]:
        nodes, mean = self.means.get(c, (None, None))
        if nodes is not self.nodes[c]:
            # The sums of numpy's mean in their order.
            (x, y), *rest = self.nodes[c].values()
            for u, v in rest:
                x, y = x + u, y + v
            mean = x / (1 + len(rest)), y / (1 + len(rest))
            self.means[c] = self.nodes[c], mean
        return mean

    def ends(self, j: int):
        """Entry and exit of the j-th cluster (from 1): waypoints 2j and 2j + 1."""
        return self.points[2 * j - 1], self.points[2 * j]


def sortie_length(plan: Plan, fleet: Fleet, j: int, stops) -> float:
    c = plan.order[j - 1]
    a, b = plan.ends(j)
    return fleet.tender.length((a, *(plan.nodes[c][s] for s in stops), b))


def measured(plan: Plan, fleet: Fleet) -> dict[int | None, tuple]:
    """``known`` of the plan's clusters as far as it still holds: same zones, nodes, sorties and ends. Under None the
    mothership's zones, points and legs."""
    out, points, known = {}, plan.points, plan.known
    was = known.get(None)
    same = was is not None and was[1] is points
    if same and was[0] is fleet.ms:
        out[None] = was
    for j, c in enumerate(plan.order, 1):
        was = known.get(c)
        if was and was[2] is plan.sorties[c] and was[1] is plan.nodes[c] and was[0] is fleet.tender and was[3] == (points[2 * j - 1], points[2 * j]):
            out[c] = was
    return out


def sortie_ways(plan: Plan, fleet: Fleet, held, without=()) -> list[tuple]:
    """The ways of the sorties that have no length yet, of clusters neither in ``held`` nor at the places ``without``."""
    out = []
    for j, c in enumerate(plan.order, 1):
        if c not in held and j not in without:
            a, b = plan.ends(j)
            for s in plan.sorties[c]:
                p = (a, *(plan.nodes[c][n] for n in s), b)
                if p not in fleet.tender._lengths:
                    out += zip(p[:-1], p[1:], strict=True)
    return out


def score(plan: Plan, fleet: Fleet, asked: bool = False) -> tuple[float, float]:
    """(hours on the critical path, weighted distance): per cluster the slower of boats and mothership, plus the way between.

    All ways of the plan are looked at together before they are summed; ``asked``: they have been.
    """
    held = measured(plan, fleet)
    if not asked and (ways := unknown(sortie_ways(plan, fleet, held), fleet.tender)):
        fleet.tender.learn(ways)
    if None not in held:
        held[None] = fleet.ms, plan.points, fleet.ms.metres(plan.points)
    legs = held[None][2]
    hours, total = sum(legs[0::2]) / 1000 * fleet.w_ms / HOURS, sum(legs) * fleet.w_ms
    for j, c in enumerate(plan.order, 1):
        if c not in held:
            held[c] = fleet.tender, plan.nodes[c], plan.sorties[c], plan.ends(j), [sortie_length(plan, fleet, j, s) for s in plan.sorties[c]]
        lengths = held[c][4]
        hours += max(max(lengths, default=0.0) / 1000 * fleet.w_t, legs[2 * j - 1] / 1000 * fleet.w_ms) / HOURS
        total += sum(lengths) * fleet.w_t
    # Each plan has a table of its own, so a proposal that is dropped takes nothing from the plan it was made from.
    object.__setattr__(plan, "known", held)
    return hours, total


def adjusted(points, fleet: Fleet) -> tuple:
    """Waypoints moved out of zones: one inside a hull of a zone goes to the nearest hull vertex in no hull."""
    from squadron.kernel.geometry import haversine

    out = [tuple(map(float, p)) for p in points]
    if out and len(fleet.corners):
        zones = [fleet.ms] if fleet.tender is fleet.ms else [fleet.ms, fleet.tender]
        bad = [k for k, no in enumerate(zip(*[z.hidden(out) for z in zones], strict=True)) if any(no)]
        if bad:
            near = haversine(fleet.corners, np.array([out[k] for k in bad])[:, None]).argmin(1)
            for k, p in zip(bad, fleet.corners[near].tolist(), strict=True):
                out[k] = tuple(p)
    return tuple(out)


def waypoint_keys(plan: Plan, fleet: Fleet) -> list[tuple]:
    """Under what ``Fleet.spots`` has the waypoints of the plan; its first and last are the depot."""
    chain = [fleet.depot, *(plan.centroid(c) for c in plan.order), fleet.depot]
    out = [(fleet.depot, None)]
    for before, c, after in zip(chain[:-2], chain[1:-1], chain[2:], strict=True):
        out += (c, before), (c, after)
    return [*out, out[0]]


def new_spots(keys: list[tuple], fleet: Fleet) -> dict[tuple, tuple[float, float]]:
    """Where those waypoints lie that the fleet has no place of yet, before they are moved out of zones."""
    if len(fleet.spots) > KEPT_POINTS:
        fleet.spots.clear()
    return {k: tours.between(*k) if k[1] else k[0] for k in keys if k not in fleet.spots}


def with_waypoints(plan: Plan, fleet: Fleet, fixed: int = 0) -> Plan:
    """New waypoints in the order of the plan; the first ``fixed`` stay as they are."""
    keys = waypoint_keys(plan, fleet)
    if new := new_spots(keys, fleet):
        fleet.spots.update(zip(new, adjusted(list(new.values()), fleet), strict=True))
    return replace(plan, points=(*plan.points[:fixed], *[fleet.spots[k] for k in keys[fixed:]]))


def serve(plan: Plan, fleet: Fleet, j: int) -> tuple[tuple[int, ...], ...]:
    """Sorties of the j-th cluster, built anew."""
    c = plan.order[j - 1]
    ids = list(plan.nodes[c])
    a, b = plan.ends(j)
    m = fleet.tender.matrix([a, *(plan.nodes[c][i] for i in ids), b])
    found = tours.sorties(m, 0, len(ids) + 1, list(range(1, len(ids) + 1)), fleet.n_tenders, fleet.cap)
    return tuple(tuple(ids[k - 1] for k in s) for s in found)


def tidy_ways(plan: Plan, j: int, sorties) -> list[tuple]:
    """All ways that ``tidy`` and the lengths of what it returns ask for, for some sorties of the j-th cluster."""
    nodes, (a, b) = plan.nodes[plan.order[j - 1]], plan.ends(j)
    return [w for s in sorties for w in combinations((a, *(nodes[n] for n in s), b), 2)]


def tidy(plan: Plan, fleet: Fleet, j: int, stops) -> tuple[int, ...]:
    """2-opt of one sortie with its ends fixed."""
    if len(stops) < 2:
        return tuple(stops)
    c = plan.order[j - 1]
    a, b = plan.ends(j)
    m = fleet.tender.table([a, *(plan.nodes[c][s] for s in stops), b])
    order = tours.two_opt(list(range(len(stops) + 2)), m)
    return tuple(stops[k - 1] for k in order[1:-1])


def mothership_tour(fleet: Fleet, clusters: dict[int, tuple[float, float]]) -> list[int]:
    ids = sorted(clusters)
    m = fleet.ms.matrix([fleet.depot, *adjusted([clusters[c] for c in ids], fleet)])
    order = tours.two_opt(tours.nearest_neighbour(m), m)
    return [ids[k - 1] for k in order[1:-1]]


def first_plan(fleet: Fleet, nodes: dict[int, dict[int, tuple[float, float]]]) -> Plan:
    mean = {c: tuple(map(float, np.mean(list(v.values()), axis=0))) for c, v in nodes.items()}
    plan = with_waypoints(Plan(tuple(mothership_tour(fleet, mean)), nodes, ()), fleet)
    return replace(plan, sorties={c: serve(plan, fleet, j) for j, c in enumerate(plan.order, 1)})


def replaced(plan: Plan, c: int, sorties: list) -> Plan:
    return replace(plan, sorties=plan.sorties | {c: tuple(tuple(s) for s in sorties if s)})


#: What a search asks for before it goes on: (zones, points, ways).
Asked = list[tuple[Zones, list, list]]


def together(searches: list[Generator]) -> list:
    """The results of searches that run side by side: what all of them ask for at a time is looked at in one go."""
    out, live = [None] * len(searches), dict(enumerate(searches))
    while live:
        points, ways = {}, {}
        for i, search in list(live.items()):
            try:
                asked = next(search)
            except StopIteration as end:
                out[i] = end.value
                del live[i]
                continue
            for zones, p, w in asked:
                points.setdefault(zones, []).extend(p)
                ways.setdefault(zones, []).extend(w)
        for zones in points:
            if points[zones]:
                zones.hidden(points[zones])
            if ways[zones]:
                zones.learn(ways[zones])
    return out


def unknown(ways: list[tuple], zones: Zones) -> list[tuple]:
    return [w for w in ways if w not in zones._far]


def perturbed_within(plan: Plan, fleet: Fleet, j: int, rng: np.random.Generator) -> Plan:
    return together([within(plan, fleet, j, rng)])[0]


def within(plan: Plan, fleet: Fleet, j: int, rng: np.random.Generator) -> Generator[Asked, None, Plan]:
    """Swaps two stops of different sorties of a cluster, or moves one to a sortie with room."""
    c = plan.order[j - 1]
    s = [list(x) for x in plan.sorties[c]]
    if len(s) < 2:
        return plan
    a, b = rng.choice(len(s), 2, replace=False)
    if rng.random() < 0.5:
        x, y = rng.integers(len(s[a])), rng.integers(len(s[b]))
        s[a][x], s[b][y] = s[b][y], s[a][x]
    else:
        able = [k for k in range(len(s)) if len(s[k]) >= 2]
        room = [k for k in range(len(s)) if len(s[k]) < fleet.cap]
        if not able or not (room := [k for k in room if k != (a := able[rng.integers(len(able))])]):
            return plan
        b = room[rng.integers(len(room))]
        s[b].insert(rng.integers(len(s[b]) + 1), s[a].pop(rng.integers(len(s[a]))))
    if ways := unknown(tidy_ways(plan, j, [s[k] for k in {int(a), int(b)}]), fleet.tender):
        yield [(fleet.tender, [], ways)]
    for k in {int(a), int(b)}:
        s[k] = tidy(plan, fleet, j, s[k])
    return replaced(plan, c, s)


def perturbed_across(plan: Plan, fleet: Fleet, low: int, high: int, rng: np.random.Generator) -> Plan:
    return together([across(plan, fleet, low, high, rng)])[0]


def across(plan: Plan, fleet: Fleet, low: int, high: int, rng: np.random.Generator) -> Generator[Asked, None, Plan]:
    """Swaps or moves a stop between two clusters of the places low to high; centroids, waypoints and ends follow."""
    if high <= low:
        return plan
    i, j = (int(k) for k in rng.choice(np.arange(low, high + 1), 2, replace=False))
    a, b = plan.order[i - 1], plan.order[j - 1]
    sa, sb = [list(x) for x in plan.sorties[a]], [list(x) for x in plan.sorties[b]]
    if not sa or not sb:
        return plan
    p, q = sa[rng.integers(len(sa))], sb[rng.integers(len(sb))]
    na, nb = dict(plan.nodes[a]), dict(plan.nodes[b])
    x = p[rng.integers(len(p))]
    if rng.random() < 0.5:
        y = q[rng.integers(len(q))]
        p[p.index(x)], q[q.index(y)] = y, x
        nb[x], na[y] = na.pop(x), nb.pop(y)
    else:
        if len(q) >= fleet.cap or len(na) < 2:
            return plan
        p.remove(x)
        q.insert(rng.integers(len(q) + 1), x)
        nb[x] = na.pop(x)
    sorties = plan.sorties | {c: tuple(tuple(s) for s in own if s) for c, own in ((a, sa), (b, sb))}
    # A proposal that is dropped leaves the means of the plan as they are.
    new = Plan(plan.order, plan.nodes | {a: na, b: nb}, plan.points, sorties, plan.known, dict(plan.means))
    if spots := list(new_spots(waypoint_keys(new, fleet), fleet).values()):
        yield [(z, spots, []) for z in {fleet.ms: 0, fleet.tender: 0}]
    new = with_waypoints(new, fleet, fixed=2 * (low - 1) + 1 if low > 1 else 0)
    # What the sorties of both, and then the score of the plan, ask for is looked at together.
    ways = [w for k in {i, j} for w in tidy_ways(new, k, new.sorties[new.order[k - 1]])]
    ways += sortie_ways(new, fleet, measured(new, fleet), {i, j})
    legs = list(zip(new.points[:-1], new.points[1:], strict=True))
    asked = [(fleet.tender, [], unknown(ways + legs, fleet.tender))] if fleet.ms is fleet.tender else [(fleet.tender, [], unknown(ways, fleet.tender)), (fleet.ms, [], unknown(legs, fleet.ms))]
    if any(w for _, _, w in asked):
        yield asked
    tidied = {c: tuple(t for s in new.sorties[c] if (t := tidy(new, fleet, k, s))) for k in (i, j) for c in (new.order[k - 1],)}
    return Plan(new.order, new.nodes, new.points, new.sorties | tidied, new.known, new.means)


def anneal(plan: Plan, fleet: Fleet, rng: np.random.Generator, low: int = 1, high: int | None = None, temp: float = 0.25, cooling: float = 0.9, min_iters: int = 1000, static_limit: int = 1, max_iters: int = 1 << 31) -> tuple[Plan, list[tuple]]:
    """Simulated annealing of the places low to high of the tour; returns the best plan and the trace.

    Trace rows: (iteration, best, current, proposed, temperature). Equal scores are decided by weighted distance. It ends
    after ``min_iters`` steps once ``static_limit`` of them running brought no new best.
    """
    return together([annealing(plan, fleet, rng, low, high, temp, cooling, min_iters, static_limit, max_iters)])[0]


def annealing(plan: Plan, fleet: Fleet, rng: np.random.Generator, low: int, high: int | None, temp: float, cooling: float, min_iters: int, static_limit: int, max_iters: int) -> Generator[Asked, None, tuple[Plan, list[tuple]]]:
    """``anneal`` as a search among others; see ``together``."""
    high = len(plan.order) if high is None else high
    if high < low:
        return plan, []
    now = best = plan
    now_score = best_score = score(plan, fleet)
    trace, still, step = [], 0, 0
    while step < max_iters and not (step >= min_iters and still >= static_limit):
        step += 1
        # The place is drawn after the kind of the step.
        new = yield from (within(now, fleet, int(rng.integers(low, high + 1)), rng) if rng.random() < 0.5 else across(now, fleet, low, high, rng))
        new_score = now_score if new is now else score(new, fleet, asked=True)
        delta = new_score[0] - now_score[0]
        if delta < 0 or delta == 0 and new_score[1] < now_score[1] or delta > 0 and np.isfinite(delta) and rng.random() < math.exp(-delta / temp):
            now, now_score = new, new_score
        if now_score < best_score:
            best, best_score, still = now, now_score, 0
        else:
            still += 1
        trace.append((step, best_score[0], now_score[0], new_score[0], temp))
        temp = max(temp * cooling, 1e-300)
    return best, trace


def waypoint_objective(plan: Plan, fleet: Fleet, x: np.ndarray, low: int) -> float:
    """Hours with the waypoints from place ``low`` (0-based) on set to x; waypoints inside a zone cost a penalty."""
    points = (*plan.points[:low], *map(tuple, x.reshape(-1, 2).tolist()), *plan.points[low + len(x) // 2 :])
    bad = int(fleet.covered(points).sum())
    if bad:
        from squadron.kernel.geometry import haversine

        p = np.array(points)
        return max(fleet.w_ms, fleet.w_t) * float(haversine(p[:-1], p[1:]).sum()) * (bad + 1) ** 2
    return score(replace(plan, points=points), fleet)[0]


def swarm(plan: Plan, fleet: Fleet, rng: np.random.Generator, low: int = 1, particles: int = 5, generations: int = 20, reach: float = 0.05) -> tuple[Plan, list[tuple]]:
    """Particle swarm on the waypoints from place ``low`` to the last but one, in boxes of ``reach`` degrees.

    Every evaluated point counts for the best, so the result is never worse than the start. Trace rows: (generation, best).
    """
    start = np.array(plan.points[low:-1], float).reshape(-1)
    if not len(start):
        return plan, []
    box = start - reach, start + reach
    x = np.vstack([start, rng.uniform(*box, (particles - 1, len(start)))])
    v = np.zeros_like(x)
    f = np.array([waypoint_objective(plan, fleet, p, low) for p in x])
    own, own_f, trace = x.copy(), f.copy(), []
    for g in range(generations):
        lead = own[own_f.argmin()]
        r = rng.random((2, *x.shape))
        v = 0.7 * v + 1.4 * r[0] * (own - x) + 1.4 * r[1] * (lead - x)
        x = np.clip(x + v, *box)
        f = np.array([waypoint_objective(plan, fleet, p, low) for p in x])
        better = f < own_f
        own[better], own_f[better] = x[better], f[better]
        trace.append((g + 1, float(own_f.min())))
    best = own[own_f.argmin()].reshape(-1, 2)
    new = replace(plan, points=(*plan.points[:low], *map(tuple, best.tolist()), plan.points[-1]))
    return new, trace


def after_event(plan: Plan, fleet: Fleet, d: int, values: dict[int, float], rng: np.random.Generator, upper: float = 0.4) -> Plan:
    """Replans from the d-th cluster on; what lies before, with its last exit, stays.

    The remaining nodes are grouped by place and disturbance; the group of largest mean disturbance (plus noise in
    [-1, 1]) is given up; the rest is clustered to as many clusters as are left, which take the nearest old ids. With
    fewer nodes than that the clusters stay. An event beyond the last cluster changes nothing.
    """
    from squadron.kernel import cluster as k

    n, cap = len(plan.order), fleet.n_tenders * fleet.cap
    if not 1 <= d <= n:
        return plan
    old = list(plan.order[d - 1 :])
    ids = [i for c in old for i in plan.nodes[c]]
    at = {i: p for c in old for i, p in plan.nodes[c].items()}
    left = len(old)
    nodes = {c: plan.nodes[c] for c in plan.order[: d - 1]}
    if len(ids) > left:
        x = np.array([(*at[i], values.get(i, 0.0)) for i in ids])
        groups = min(len(ids), int(rng.integers(left + 1, max(math.ceil(upper * len(ids)), left + 1) + 1)))
        label = k.kmeans(x, groups, rng)
        risk = {g: x[label == g, 2].mean() + rng.uniform(-1, 1) for g in np.unique(label)}
        kept = [i for i, g in zip(ids, label, strict=True) if g != max(risk, key=risk.get)]
        if left <= len(kept) <= left * cap:
            y = np.array([at[i] for i in kept])
            label = k.capped_kmeans(y, cap, rng, k=left)
            found = [np.flatnonzero(label == g) for g in np.unique(label)]
            mean = np.array([y[f].mean(0) for f in found])
            was = np.array([plan.centroid(c) for c in old])
            match = k.hungarian(np.hypot(*(mean[:, None] - was[None]).transpose(2, 0, 1)))
            nodes |= {old[m]: {kept[q]: at[kept[q]] for q in f} for f, m in zip(found, match, strict=True)}
        else:
            nodes |= {c: plan.nodes[c] for c in old}
    else:
        nodes |= {c: plan.nodes[c] for c in old}
    order = tuple(c for c in plan.order if c in nodes)
    new = with_waypoints(replace(plan, order=order, nodes=nodes), fleet, fixed=2 * (d - 1) + 1)
    fresh = {c: serve(new, fleet, j) if j >= d else plan.sorties[c] for j, c in enumerate(order, 1)}
    return replace(new, sorties=fresh)
