"""A packed tree of line segments, for the nearest segment of many points at a time."""

from __future__ import annotations

import numpy as np

LEAF, FAN = 8, 8


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places along a curve whose neighbours are neighbours in the plane: the bits of both coordinates in turn."""
    out = np.zeros(len(x), np.int64)
    for k, v in enumerate((x, y)):
        span = max(float(np.ptp(v)), 1e-300) if len(v) else 1.0
        cell = np.minimum((v - v.min()) / span * 65536, 65535).astype(np.int64) if len(v) else out
        for b in range(16):
            out |= (cell >> b & 1) << (2 * b + k)
    return out


class SegmentTree:
    """Segments packed into leaves along a curve through the plane; each node holds the box of its ``FAN`` children.

    A batch of points goes down a level at a time, twice: first by the nearest box alone, which gives each point a distance, then through all boxes
    no farther than that or than the far corner of another box. So a point passes few nodes of each level, whatever the number of segments.
    """

    def __init__(self, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray):
        self.order = np.argsort(_curve((ax + bx) / 2, (ay + by) / 2), kind="stable")
        self.ends = tuple(v[self.order] for v in (ax, ay, bx, by))
        ax, ay, bx, by = self.ends
        box = np.stack([np.minimum(ax, bx), np.minimum(ay, by), np.maximum(ax, bx), np.maximum(ay, by)])
        self.levels, size = [], LEAF
        while True:
            at = np.arange(0, box.shape[1], size)
            box = np.concatenate([np.minimum.reduceat(box[:2], at, axis=1), np.maximum.reduceat(box[2:], at, axis=1)])
            self.levels.append(box)
            if box.shape[1] <= FAN:
                break
            size = FAN
        self.levels.reverse()

    def nearest(self, px: np.ndarray, py: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place (in the order given to the tree) and distance of each point's nearest segment; of equal distances the smallest rank."""
        n = len(px)
        most = self._reached(px, py) * (1 + 1e-12)
        top = self.levels[0].shape[1]
        point, node = np.repeat(np.arange(n), top), np.tile(np.arange(top), n)
        for k, box in enumerate(self.levels):
            x0, y0, x1, y1 = box[:, node]
            x, y = px[point], py[point]
            # some segment of a box is no farther than its far corner
            np.minimum.at(most, point, np.hypot(np.maximum(x - x0, x1 - x), np.maximum(y - y0, y1 - y)) * (1 + 1e-12))
            near = self._least(box, node, x, y) <= most[point]
            point, node = point[near], node[near]
            fan, below = self._under(k)
            node = (node[:, None] * fan + np.arange(fan)).ravel()
            point = np.repeat(point, fan)
            point, node = point[node < below], node[node < below]
        d = self._distance(node, px[point], py[point])
        best = np.lexsort((rank[self.order[node]], d, point))
        first = best[np.flatnonzero(np.concatenate([[True], point[best][1:] != point[best][:-1]]))] if len(best) else best
        return self.order[node[first]], d[first]

    def _under(self, k: int) -> tuple[int, int]:
        """Children of a node of level k, and how many there are on the level below."""
        return (FAN, self.levels[k + 1].shape[1]) if k + 1 < len(self.levels) else (LEAF, len(self.order))

    @staticmethod
    def _least(box: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x0, y0, x1, y1 = box[:, node]
        return np.hypot(np.maximum(0, np.maximum(x0 - x, x - x1)), np.maximum(0, np.maximum(y0 - y, y - y1))) * (1 - 1e-12)

    def _distance(self, segment: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ax, ay, bx, by = (v[segment] for v in self.ends)
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = np.where(size > 0, np.clip(((x - ax) * dx + (y - ay) * dy) / np.where(size > 0, size, 1), 0, 1), 0.0)
        return np.hypot(x - ax - t * dx, y - ay - t * dy)

    def _reached(self, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """The distance that each point reaches by the nearest box of each level alone: no nearest segment is farther."""
        x, y, at = px[:, None], py[:, None], np.zeros(len(px), np.int64)
        nodes = np.broadcast_to(np.arange(self.levels[0].shape[1]), (len(px), self.levels[0].shape[1]))
        for k, box in enumerate(self.levels):
            at = nodes[np.arange(len(px)), self._least(box, nodes, x, y).argmin(axis=1)]
            fan, below = self._under(k)
            nodes = np.minimum(at[:, None] * fan + np.arange(fan), below - 1)
        return self._distance(nodes, x, y).min(axis=1)
