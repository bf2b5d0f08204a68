"""Dual-tree kernels: points near points, and points inside regions, as array operations on two trees.

A tree is implicit: points sorted by Morton code, leaves of LEAF consecutive points, and levels above that hold
the boxes of FAN nodes below each.  A frontier of (query node, reference node) pairs starts at the tops; each
round drops pairs that cannot match, accepts pairs that must match wholesale, and opens the rest.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 16, 4
RADIUS_KM = 6371.0088


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])


def haversine_km(lat1, lon1, lat2, lon2):
    a1, a2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _spread(v: np.ndarray, gap: int) -> np.ndarray:
    out = np.zeros_like(v)
    for bit in range(10):
        out |= ((v >> np.uint64(bit)) & np.uint64(1)) << np.uint64(bit * gap)
    return out


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 0, 3]: owners [0, 0, 2, 2, 2] and ranks [0, 1, 0, 1, 2]."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Tree:
    """Boxes over points of any dimension; order[i] is the input row of the i-th point along the curve."""

    def __init__(self, points: np.ndarray, boxes: np.ndarray | None = None):
        n, dim = points.shape
        span = np.ptp(points, axis=0) if n else np.ones(dim)
        grid = ((points - points.min(axis=0)) / np.where(span > 0, span, 1) * 1023).astype(np.uint64) if n else np.zeros((0, dim), np.uint64)
        code = np.zeros(n, np.uint64)
        for k in range(dim):
            code |= _spread(grid[:, k], dim) << np.uint64(k)
        self.order = np.argsort(code, kind="stable")
        self.n = n
        low = (points if boxes is None else boxes[:, :dim])[self.order]
        high = (points if boxes is None else boxes[:, dim:])[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        size = LEAF
        while n:
            at = np.arange(0, len(low), size)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((low, high))
            if len(low) <= FAN:
                break
            size = FAN

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and children of nodes: nodes of the level below, at level 0 points."""
        fan, below = (FAN, len(self.levels[level - 1][0])) if level else (LEAF, self.n)
        owner, rank = ragged(np.minimum(node * fan + fan, below) - node * fan)
        return owner, node[owner] * fan + rank

    def points_under(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = LEAF * FAN**level
        owner, rank = ragged(np.minimum(node * width + width, self.n) - node * width)
        return owner, node[owner] * width + rank


def _open(a: Tree, la: int, na: np.ndarray, b: Tree, lb: int, nb: np.ndarray):
    """Pairs of the children of both nodes of each pair; a tree whose leaves are reached earlier waits there."""
    if la >= lb and la > 0:
        owner, na = a.children(la, na)
        nb, la2 = nb[owner], la - 1
    else:
        la2 = la
    if lb >= la and lb > 0:
        owner, nb = b.children(lb, nb)
        na, lb2 = na[owner], lb - 1
    else:
        lb2 = lb
    return la2, na, lb2, nb


def near_pairs(lat, lon, ref_lat, ref_lon, km: float, ref: Tree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query, reference) at most km apart on the sphere, poles and date line included."""
    lat, lon, ref_lat, ref_lon = (np.asarray(x, float) for x in (lat, lon, ref_lat, ref_lon))
    none = np.zeros(0, np.int64)
    if not len(lat) or not len(ref_lat):
        return none, none
    q, r = Tree(unit(lat, lon)), ref or Tree(unit(ref_lat, ref_lon))
    chord = 2 * np.sin(min(km / RADIUS_KM, np.pi) / 2)
    far, sure = (chord * (1 + 1e-9) + 1e-12) ** 2, max(chord * (1 - 1e-9) - 1e-12, 0) ** 2
    lq, lr = len(q.levels) - 1, len(r.levels) - 1
    nq, nr = (x.ravel() for x in np.meshgrid(np.arange(len(q.levels[lq][0])), np.arange(len(r.levels[lr][0])), indexing="ij"))
    got_q, got_r = [], []
    while len(nq):
        (ql, qh), (rl, rh) = q.levels[lq], r.levels[lr]
        gap = np.maximum(0, np.maximum(rl[nr] - qh[nq], ql[nq] - rh[nr]))
        keep = (gap**2).sum(1) <= far
        nq, nr = nq[keep], nr[keep]
        reach = np.maximum(rh[nr] - ql[nq], qh[nq] - rl[nr])
        whole = (reach**2).sum(1) <= sure
        for accepted in (True, False):
            a, b = (nq[whole], nr[whole]) if accepted else (nq[~whole], nr[~whole])
            if accepted or lq == lr == 0:
                owner, i = q.points_under(lq, a)
                owner2, j = r.points_under(lr, b[owner])
                i, j = q.order[i[owner2]], r.order[j]
                if not accepted:
                    ok = haversine_km(lat[i], lon[i], ref_lat[j], ref_lon[j]) <= km
                    i, j = i[ok], j[ok]
                got_q.append(i)
                got_r.append(j)
        nq, nr = nq[~whole], nr[~whole]
        if lq == lr == 0:
            break
        lq, nq, lr, nr = _open(q, lq, nq, r, lr, nr)
    return (np.concatenate(got_q), np.concatenate(got_r)) if got_q else (none, none)


class Regions:
    """Regions as rings of straight edges in longitude/latitude; a point is inside an odd number of rings."""

    def __init__(self, rings: list[list[np.ndarray]]):
        e, owner = [], []
        for k, polygon in enumerate(rings):
            for ring in polygon:
                if len(ring) >= 3:
                    e.append(np.hstack([ring, np.roll(ring, -1, axis=0)]))
                    owner.append(np.full(len(ring), k))
        self.edges = np.concatenate(e) if e else np.zeros((0, 4))
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        n = len(rings)
        self.first = np.searchsorted(owner, np.arange(n))
        self.count = np.searchsorted(owner, np.arange(n), "right") - self.first
        ids = np.flatnonzero(self.count)
        self.ids = ids
        e = self.edges
        self.low, self.high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
        boxes = np.hstack([np.minimum.reduceat(self.low, self.first[ids]), np.maximum.reduceat(self.high, self.first[ids])]) if len(ids) else np.zeros((0, 4))
        self.tree = Tree((boxes[:, :2] + boxes[:, 2:]) / 2, boxes) if len(ids) else None

    def inside(self, lon: np.ndarray, lat: np.ndarray, region: np.ndarray) -> np.ndarray:
        """Parity of the edges east of each point of its region."""
        owner, rank = ragged(self.count[region])
        e = self.edges[self.first[region][owner] + rank]
        x, y = lon[owner], lat[owner]
        cross = (e[:, 1] > y) != (e[:, 3] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = e[:, 0] + (y - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])
        return np.bincount(owner, weights=cross & (x < at), minlength=len(region)).astype(np.int64) % 2 == 1

    def crossed(self, low: np.ndarray, high: np.ndarray, region: np.ndarray) -> np.ndarray:
        """Whether an edge's box of the region meets the box."""
        owner, rank = ragged(self.count[region])
        k = self.first[region][owner] + rank
        meet = ((self.low[k] <= high[owner]) & (self.high[k] >= low[owner])).all(1)
        return np.bincount(owner, weights=meet, minlength=len(region)) > 0


def inside_pairs(lat, lon, regions: Regions) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query, region) where the region contains the point."""
    lat, lon = np.asarray(lat, float), np.asarray(lon, float)
    none = np.zeros(0, np.int64)
    if not len(lat) or regions.tree is None:
        return none, none
    q, r = Tree(np.column_stack([lon, lat])), regions.tree
    lq, lr = len(q.levels) - 1, len(r.levels) - 1
    nq, nr = (x.ravel() for x in np.meshgrid(np.arange(len(q.levels[lq][0])), np.arange(len(r.levels[lr][0])), indexing="ij"))

    def meeting(lq, nq, lr, nr):
        (ql, qh), (rl, rh) = q.levels[lq], r.levels[lr]
        keep = ((rl[nr] <= qh[nq]) & (rh[nr] >= ql[nq])).all(1)
        return nq[keep], nr[keep]

    nq, nr = meeting(lq, nq, lr, nr)
    while lr > 0 and len(nq):  # down to single regions first
        lq, nq, lr, nr = _open(q, lq, nq, r, lr, nr)
        nq, nr = meeting(lq, nq, lr, nr)
    owner, child = r.children(0, nr)
    nq, region = nq[owner], regions.ids[r.order[child]]
    got_q, got_r = [], []
    while len(nq):
        low, high = q.levels[lq][0][nq], q.levels[lq][1][nq]
        split = regions.crossed(low, high, region)
        whole, one = nq[~split], region[~split]  # no edge meets the node: all points in, or none
        first = q.order[whole * (LEAF * FAN**lq)]
        ok = regions.inside(lon[first], lat[first], one)
        o, i = q.points_under(lq, whole[ok])
        got_q.append(q.order[i])
        got_r.append(one[ok][o])
        nq, region = nq[split], region[split]
        if lq == 0:
            o, i = q.points_under(0, nq)
            i, k = q.order[i], region[o]
            ok = regions.inside(lon[i], lat[i], k)
            got_q.append(i[ok])
            got_r.append(k[ok])
            break
        o, nq = q.children(lq, nq)
        region, lq = region[o], lq - 1
    return (np.concatenate(got_q), np.concatenate(got_r)) if got_q else (none, none)

