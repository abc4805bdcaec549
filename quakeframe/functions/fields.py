"""Sums of weights over distance from many places at a time, by a tree with far fields."""

from __future__ import annotations

import numpy as np

from .trees import _curve

LEAF, FAN = 16, 4
#: a node farther than 1 / OPEN of its radius is summed by its far field of TERMS orders
OPEN, TERMS = 0.25, 16


def _legendre(n: int) -> list[tuple[int, float]]:
    """(m, factor) so that the Legendre polynomial of order n at cos(t) is the sum of factor * cos(m t)."""
    half = [1.0]
    for k in range(1, n + 1):
        half.append(half[-1] * (2 * k - 1) / (2 * k))
    return [(n - 2 * k, half[k] * half[n - k] * (1.0 if 2 * k == n else 2.0)) for k in range(n // 2 + 1)]


class WeightTree:
    """Places with weights, packed into nodes along a curve through the plane.

    ``sums`` gives the sum of weight / max(floor, distance). A node whose places all lie within r of its centre, seen from D with r <= OPEN * D, is
    summed by moments about the centre: 1 / |p - q| is the sum over n of r^n / D^(n+1) times the Legendre polynomial of order n, none of which
    exceeds 1. The orders left out are at most |weights| / D * OPEN^TERMS / (1 - OPEN), so a sum of weights of one sign is off by a share of at most
    OPEN^TERMS * (1 + OPEN) / (1 - OPEN), here 4e-10. Nearer nodes are opened, leaves are summed one by one. A place passes a
    bounded number of nodes of each level, so n places take n log m steps for m weights.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        order = np.argsort(_curve(x, y), kind="stable")
        self.x, self.y, self.w = x[order], y[order], w[order]
        self.levels, size, n = [], LEAF, len(x)
        while True:
            at = np.arange(0, n, size)
            self.levels.append((at, self._node(at, np.append(at[1:], n))))
            if len(at) <= FAN:
                break
            size *= FAN
        self.levels.reverse()

    def _node(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Centres, radii and moments: for each order n the (m, sum of weight * r^n * exp(-i m t) * factor)."""
        middle = [(np.minimum.reduceat(v, start) + np.maximum.reduceat(v, start)) / 2 for v in (self.x, self.y)]
        own = np.repeat(np.arange(len(start)), stop - start)
        u = (self.x - middle[0][own]) + 1j * (self.y - middle[1][own])
        r = np.abs(u)
        turn = np.where(r > 0, np.conj(u) / np.where(r > 0, r, 1), 1)
        moments = [[(m, f * np.add.reduceat(self.w * r**n * turn**m, start)) for m, f in _legendre(n)] for n in range(TERMS)]
        return middle[0], middle[1], np.maximum.reduceat(r, start) * (1 + 1e-12), moments

    def sums(self, px: np.ndarray, py: np.ndarray, floor: float) -> np.ndarray:
        out = np.zeros(len(px))
        top = len(self.levels[0][0])
        point, node = np.repeat(np.arange(len(px)), top), np.tile(np.arange(top), len(px))
        for k, (_, (cx, cy, radius, moments)) in enumerate(self.levels):
            v = (px[point] - cx[node]) + 1j * (py[point] - cy[node])
            d = np.abs(v)
            far = (radius[node] <= OPEN * d) & (d - radius[node] >= floor)
            out += np.bincount(point[far], self._far(moments, node[far], v[far], d[far]), len(px))
            point, node = point[~far], node[~far]
            last = k + 1 == len(self.levels)
            fan, below = (LEAF, len(self.x)) if last else (FAN, len(self.levels[k + 1][0]))
            node = (node[:, None] * fan + np.arange(fan)).ravel()
            point = np.repeat(point, fan)
            point, node = point[node < below], node[node < below]
        d = np.maximum(floor, np.hypot(px[point] - self.x[node], py[point] - self.y[node]))
        return out + np.bincount(point, self.w[node] / d, len(px))

    @staticmethod
    def _far(moments: list, node: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
        turn = v / d
        powers = [np.ones(len(d), complex)]
        for _ in range(TERMS):
            powers.append(powers[-1] * turn)
        total, scale = np.zeros(len(d)), 1 / d
        for orders in moments:
            total += scale * sum((powers[m] * moment[node]).real for m, moment in orders)
            scale = scale / d
        return total
