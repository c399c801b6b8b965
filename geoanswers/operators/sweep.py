"""An index over sides: which boxes meet, and where points lie, without comparing everything with everything.

Boxes go into horizontal strips; there are so many strips that the entries stay below four a box. Within a strip, entries are
in order of their left ends, so those that begin within another's extent are one run of them: what is enumerated is what
overlaps in x within a strip. Pairs come in blocks, so memory follows a block and not their number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs (or points with sides) looked at in one block.
BLOCK = 1 << 20


def boxes_of(sides: np.ndarray) -> np.ndarray:
    """x0, y0, x1, y1 of sides (n x 4: from, to)."""
    return np.concatenate([np.minimum(sides[:, :2], sides[:, 2:]), np.maximum(sides[:, :2], sides[:, 2:])], axis=1)


def runs(first: np.ndarray, last: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which range, member) of the ranges [first, last), in blocks of about ``block``."""
    n = np.maximum(last - first, 0)
    upto = np.cumsum(n)
    at, total = 0, int(upto[-1]) if len(upto) else 0
    done = 0
    while done < total:
        to = max(at + 1, int(np.searchsorted(upto, done + block, side="right")))
        mine = np.arange(at, to)
        here = n[mine]
        which = np.repeat(mine, here)
        member = np.arange(len(which)) - np.repeat(np.cumsum(here) - here, here) + first[which]
        yield which, member
        at, done = to, int(upto[to - 1])


def listed(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, whole."""
    found = list(runs(first, last, max(1, int(np.maximum(last - first, 0).sum()))))
    return found[0] if found else (np.zeros(0, np.int64),) * 2


class Strips:
    """The strips of y for these boxes (and others that will be held against them)."""

    def __init__(self, *layers: np.ndarray):
        low = min((b[:, 1].min() for b in layers if len(b)), default=0.0)
        high = max((b[:, 3].max() for b in layers if len(b)), default=0.0)
        n = sum(map(len, layers))
        tall = sum(float((b[:, 3] - b[:, 1]).sum()) for b in layers)
        span = high - low
        self.low, self.count = low, max(1, min(n, int(3 * n * span / tall) if tall > 0 else n)) if span > 0 else 1
        self.height = span / self.count or 1.0

    def at(self, y: np.ndarray) -> np.ndarray:
        return np.clip(((y - self.low) / self.height).astype(np.int64), 0, self.count - 1)

    def entries(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, strip) for each strip that a box reaches."""
        first, last = self.at(boxes[:, 1]), self.at(boxes[:, 3])
        found = list(runs(first, last + 1))
        return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros(0, np.int64),) * 2


def meeting(a: np.ndarray, b: np.ndarray, keys: tuple[np.ndarray, np.ndarray] | None = None, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of places (i, j) of the boxes of a and b that meet, each pair once; with keys (a number for each box), only where
    they are equal."""
    if not len(a) or not len(b):
        return
    strips = Strips(a, b)
    ranks = np.unique(np.concatenate([a[:, 0], b[:, 0]]))
    wide = len(ranks) + 1
    key_a, key_b = keys if keys is not None else (np.zeros(len(a), np.int64), np.zeros(len(b), np.int64))

    def line(boxes: np.ndarray, key: np.ndarray):
        at, strip = strips.entries(boxes)
        cell = key[at] * strips.count + strip
        place = cell * wide + np.searchsorted(ranks, boxes[at, 0])
        order = np.argsort(place, kind="stable")
        return at[order], strip[order], cell[order], place[order]

    one, two = line(a, key_a), line(b, key_b)
    for mine, other, box, others, swapped in ((one, two, a, b, False), (two, one, b, a, True)):
        at, strip, cell, _ = mine
        # others that begin at or behind my left end and not behind my right one; equal left ends count once
        low = cell * wide + np.searchsorted(ranks, box[at, 0], side="right" if swapped else "left")
        high = cell * wide + np.searchsorted(ranks, box[at, 2], side="right")
        first, last = np.searchsorted(other[3], low), np.searchsorted(other[3], high)
        for which, member in runs(first, last, block):
            i, j = at[which], other[0][member]
            p, q = box[i], others[j]
            keep = (p[:, 1] <= q[:, 3]) & (q[:, 1] <= p[:, 3])
            keep &= strip[which] == np.maximum(strips.at(p[:, 1]), strips.at(q[:, 1]))
            if keep.any():
                yield (j[keep], i[keep]) if swapped else (i[keep], j[keep])


class Heights:
    """Sides by strips of y: those that a point's height may meet."""

    def __init__(self, sides: np.ndarray, slack: float = 0.0):
        boxes = boxes_of(sides) + np.array([-slack, -slack, slack, slack])
        self.strips, self.sides = Strips(boxes), sides
        at, strip = self.strips.entries(boxes)
        order = np.argsort(strip, kind="stable")
        self.at = at[order]
        self.first = np.searchsorted(strip[order], np.arange(self.strips.count + 1))
        self.low, self.high = (float(boxes[:, 1].min()), float(boxes[:, 3].max())) if len(sides) else (np.inf, -np.inf)

    def near(self, points: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (point, side) whose heights may meet."""
        strip = self.strips.at(points[:, 1])
        inside = (points[:, 1] >= self.low) & (points[:, 1] <= self.high)
        for which, member in runs(self.first[strip], np.where(inside, self.first[strip + 1], self.first[strip]), block):
            yield which, self.at[member]


def crossings(points: np.ndarray, sides: np.ndarray, index: Heights | None = None, weights: np.ndarray | None = None, block: int = BLOCK) -> np.ndarray:
    """For each point the sides that its ray to the right crosses, half open (a side's lower end counts, its upper one does
    not), counted or with the weights of the sides added up."""
    index = index or Heights(sides)
    out = np.zeros(len(points))
    for i, j in index.near(points, block):
        x, y = points[i].T
        ax, ay, bx, by = sides[j].T
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        out += np.bincount(i[crossed], None if weights is None else weights[j[crossed]], minlength=len(points))
    return out
