"""Small planar helpers for one shape at a time, used inside tasks. Rings are lists of (x, y), open, counter-clockwise."""

from __future__ import annotations

import math

import numpy as np

Ring = list[tuple[float, float]]
#: Rounds in which points that make no turn go, before one pass does the rest.
ROUNDS = 32


def cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def area(ring: Ring) -> float:
    return sum(cross(ring[0], a, b) for a, b in zip(ring[1:], ring[2:])) / 2


def hull(points: Ring) -> Ring:
    """Convex hull (monotone chain)."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    chains = []
    for run in (pts, pts[::-1]):
        chain: Ring = []
        for p in run:
            while len(chain) > 1 and cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return chains[0] + chains[1]


def hulls(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Convex hulls of the points of each group, in one go: group, x, y of their corners by group, counter-clockwise from the least
    point. Points that make no turn go in rounds; what a few rounds leave undecided is done in one pass."""
    order = np.lexsort((y, x, group))
    g, x, y = group[order], x[order], y[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    g, x, y = g[new], x[new], y[new]
    if not len(g):
        return g, x, y
    out = []
    for sign in (1, -1):  # the lower chain, then the upper one from the right
        a, b, c = g, x, y
        for _ in range(ROUNDS):
            keep = np.ones(len(a), bool)
            if len(a) > 2:
                inner = (a[:-2] == a[1:-1]) & (a[1:-1] == a[2:])
                turn = (b[1:-1] - b[:-2]) * (c[2:] - c[:-2]) - (c[1:-1] - c[:-2]) * (b[2:] - b[:-2])
                bad = np.concatenate([[False], inner & (sign * turn <= 0), [False]])
                if bad.any():
                    keep = ~_spread(bad)
            if keep.all():
                break
            a, b, c = a[keep], b[keep], c[keep]
        else:
            keep = _chain(a, b, c, sign)
            a, b, c = a[keep], b[keep], c[keep]
        out.append((a, b, c))
    (g0, x0, y0), (g1, x1, y1) = out
    # the upper chain backwards, without its ends
    first = np.concatenate([[True], g1[1:] != g1[:-1]])
    last = np.concatenate([g1[1:] != g1[:-1], [True]])
    mid = ~first & ~last
    g1, x1, y1 = g1[mid][::-1], x1[mid][::-1], y1[mid][::-1]
    gs, xs, ys = np.concatenate([g0, g1]), np.concatenate([x0, x1]), np.concatenate([y0, y1])
    order = np.argsort(gs, kind="stable")
    return gs[order], xs[order], ys[order]


def _chain(group: np.ndarray, x: np.ndarray, y: np.ndarray, sign: int) -> np.ndarray:
    """Places of the corners of one chain of each group, by a stack."""
    points, of, line, start = list(zip(x.tolist(), y.tolist())), group.tolist(), [], 0
    for k, p in enumerate(points):
        if k and of[k] != of[k - 1]:
            start = len(line)
        while len(line) - start > 1 and sign * cross(points[line[-2]], points[line[-1]], p) <= 0:
            line.pop()
        line.append(k)
    return np.array(line)


def _spread(bad: np.ndarray) -> np.ndarray:
    """Every other one of points in a row that are to go: a point's neighbours stay while it is judged."""
    at = np.arange(len(bad))
    begin = np.maximum.accumulate(np.where(bad & ~np.concatenate([[False], bad[:-1]]), at, 0))
    return bad & ((at - begin) % 2 == 0)


def is_convex(ring: Ring) -> bool:
    n = len(ring)
    return n >= 3 and all(cross(ring[i], ring[(i + 1) % n], ring[(i + 2) % n]) >= 0 for i in range(n)) and area(ring) > 0


def circle(x: float, y: float, r: float, segments: int) -> Ring:
    n = 4 * segments
    return [(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)]


def simplify(line: Ring, tolerance: float) -> Ring:
    """Douglas-Peucker."""
    keep, stack = {0, len(line) - 1}, [(0, len(line) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, b = line[i], line[j]
        base = math.hypot(b[0] - a[0], b[1] - a[1])
        far = [abs(cross(a, b, p)) / base if base else math.hypot(p[0] - a[0], p[1] - a[1]) for p in line[i + 1 : j]]
        k = max(range(len(far)), key=far.__getitem__)
        if far[k] > tolerance:
            keep.add(i + 1 + k)
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return [line[i] for i in sorted(keep)]
