"""Pairing the boxes of two frames: a grid index for those that may overlap enough, and the assignment of the
largest total weight."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np

Box = Sequence[float]


def overlap(a: Box, b: Box) -> float:
    """Intersection over union, 0 if the union is empty."""
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def near_pairs(left: list[Box], right: list[Box], least: float) -> list[tuple[int, int, float]]:
    """(left, right, overlap) of all pairs that overlap by `least` (over 0) or more. Boxes on the left lie in the
    cells of a grid as wide and high as their own size to the next power of two; one on the right looks into the
    cells it reaches, of sizes that allow such an overlap: neither side may be over 1 / least times the other's."""
    cells: dict[tuple, list[int]] = defaultdict(list)
    size = lambda x: math.frexp(x)[1]  # noqa: E731  2 ** (size - 1) <= x < 2 ** size
    for k, (x1, y1, x2, y2) in enumerate(left):
        if x2 > x1 and y2 > y1:
            w, h = size(x2 - x1), size(y2 - y1)
            cells[w, h, math.floor(x1 / 2.0**w), math.floor(y1 / 2.0**h)].append(k)
    sizes = {key[:2] for key in cells}
    out = []
    for k, b in enumerate(right):
        w, h = b[2] - b[0], b[3] - b[1]
        if w <= 0 or h <= 0:
            continue
        for sw, sh in sizes:
            cw, ch = 2.0**sw, 2.0**sh
            if cw < w * least or cw / 2 > w / least or ch < h * least or ch / 2 > h / least:
                continue
            for i in range(math.floor((b[0] - cw) / cw), math.floor(b[2] / cw) + 1):
                for j in range(math.floor((b[1] - ch) / ch), math.floor(b[3] / ch) + 1):
                    for other in cells.get((sw, sh, i, j), ()):
                        if (o := overlap(left[other], b)) >= least:
                            out.append((other, k, o))
    return out


def assigned(cost: np.ndarray) -> np.ndarray:
    """The column of each row at the least total cost; at least as many columns as rows. Shortest augmenting
    paths with prices of rows and columns, a row at a time."""
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    row_of, before = np.full(m + 1, -1), np.zeros(m + 1, dtype=np.int64)  # column m stands for the new row's start
    for row in range(n):
        row_of[m], at = row, m
        least, seen = np.full(m, np.inf), np.zeros(m + 1, dtype=bool)
        while row_of[at] >= 0:
            seen[at] = True
            way = cost[row_of[at]] - row_price[row_of[at]] - col_price[:m]
            closer = ~seen[:m] & (way < least)
            least[closer], before[:m][closer] = way[closer], at
            to = int(np.argmin(np.where(seen[:m], np.inf, least)))
            step = least[to]
            row_price[row_of[seen]] += step
            col_price[seen] -= step
            least[~seen[:m]] -= step
            at = to
        while at != m:
            row_of[at], at = row_of[before[at]], before[at]
    out = np.empty(n, dtype=np.int64)
    out[row_of[:m][row_of[:m] >= 0]] = np.flatnonzero(row_of[:m] >= 0)
    return out


def best_pairs(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Pairs (left, right), each side once, of the largest total weight; pairs of weight 0 or less never. What is
    connected by pairs is solved together."""
    up: dict[tuple, tuple] = {}

    def root(x: tuple) -> tuple:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    pairs = [p for p in pairs if p[2] > 0]
    for a, b, _ in pairs:
        up[root((0, a))] = root((1, b))
    groups = defaultdict(list)
    for p in pairs:
        groups[root((0, p[0]))].append(p)
    out = []
    for group in groups.values():
        if len(group) == 1:
            out.append(group[0][:2])
            continue
        rows, cols = sorted({a for a, _, _ in group}), sorted({b for _, b, _ in group})
        cost = np.zeros((len(rows), len(cols) + len(rows)))  # a column for each row that stays alone
        for a, b, w in group:
            cost[rows.index(a), cols.index(b)] = -w
        weight = {(a, b) for a, b, _ in group}
        out += [(a, cols[c]) for a, c in zip(rows, assigned(cost)) if c < len(cols) and (a, cols[c]) in weight]
    return out
