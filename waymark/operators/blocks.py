"""Spatial joins by blocks of a grid: points meet the shapes of their block in one Arrow task, which decides in numpy.

Both sides go by plain exchanges, as nothing bounds either of them; estimates would have either broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spans(low: Column, high: Column, reach: float, side: float) -> Column:
    """The blocks from the least to the greatest coordinate, widened by the reach."""
    return F.sequence(F.floor((F.least(low, high) - reach) / side), F.floor((F.greatest(low, high) + reach) / side))


def meet(points: DataFrame, shapes: DataFrame, side: float, most: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """(points, shapes) with bx, by, part: points (point, x, y, ...) in their block, shapes (bx, by, ...) in the blocks that
    they list. A block of more than `most` points is dealt into parts, and its shapes are repeated in each."""
    at = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").withColumn("bx", F.floor(F.col("x") / side)).withColumn("by", F.floor(F.col("y") / side))
    load = at.groupBy("bx", "by").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")).hint("merge")
    own = at.join(load, ["bx", "by"]).withColumn("part", F.pmod(F.xxhash64("point", "x", "y"), "parts")).drop("parts")
    their = shapes.join(load, ["bx", "by"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return own, their


def gaps(px: np.ndarray, py: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, x, y) from points to segments (rows x1, y1, x2, y2), broadcast against each other."""
    x1, y1, dx, dy = seg[0], seg[1], seg[2] - seg[0], seg[3] - seg[1]
    u = np.clip(((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy), 0.0, 1.0)
    qx, qy = x1 + u * dx, y1 + u * dy
    return np.sqrt((qx - px) ** 2 + (qy - py) ** 2), qx, qy


def nearest_segments(px: np.ndarray, py: np.ndarray, seg: np.ndarray, rank: np.ndarray, reach: float, work: int = 1 << 15) -> tuple[np.ndarray, ...]:
    """(segment or -1, distance, x, y) for each point: the least (distance, rank, x, y) within reach.

    Points are halved both ways until few pairs are left; a box of points keeps the segments that can be nearest to one of
    them, by their distance to its middle.
    """
    best, out = np.full(len(px), -1), np.full((3, len(px)), np.nan)
    slack = 1e-9 * (1 + reach + max(np.abs(px).max(initial=0), np.abs(py).max(initial=0)))
    todo = [(np.arange(len(px)), np.arange(seg.shape[1]))]
    while todo:
        p, s = todo.pop()
        west, east, south, north = px[p].min(), px[p].max(), py[p].min(), py[p].max()
        cx, cy, half = (west + east) / 2, (south + north) / 2, np.hypot(east - west, north - south) / 2
        off = gaps(cx, cy, seg[:, s])[0]
        off = np.where(off <= reach + half + slack, off, np.inf)
        s = s[off <= min(reach, off.min(initial=np.inf) + half) + half + slack]
        if not len(s):
            continue
        if len(p) * len(s) > work:
            quarter = (px[p] > cx) * 2 + (py[p] > cy)
            parts = [p[quarter == q] for q in np.unique(quarter)]
            if len(parts) > 1:
                todo += [(q, s) for q in parts]
                continue
        step = max(1, work // len(s))
        for lo in range(0, len(p), step):
            own = p[lo : lo + step]
            d, qx, qy = gaps(px[own, None], py[own, None], seg[:, None, s])
            least = np.where(d <= reach, d, np.inf).min(1)
            row, col = np.nonzero((d == least[:, None]) & (d <= reach))
            order = np.lexsort((qy[row, col], qx[row, col], rank[s[col]], row))
            row, first = np.unique(row[order], return_index=True)
            col = col[order][first]
            best[own[row]] = s[col]
            out[:, own[row]] = d[row, col], qx[row, col], qy[row, col]
    return best, *out


def ring_areas(x: np.ndarray, y: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Areas of rings laid end to end, to nine digits, so that equal shapes at different places have equal ones."""
    own = np.repeat(np.arange(len(size)), size)
    after = np.arange(len(x)) + 1
    after[start + size - 1] = start
    u, v = x - x[start][own], y - y[start][own]
    area = np.abs(np.add.reduceat(u * v[after] - u[after] * v, start)) / 2
    digits = 9 - np.ceil(np.log10(np.where(area > 0, area, 1.0)))
    return np.round(area * 10.0**digits) / 10.0**digits


def smallest_around(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, start: np.ndarray, size: np.ndarray, some: int = 64, work: int = 1 << 18) -> np.ndarray:
    """For each point the first of the rings (x, y from start, of a size, in order) that holds it, or -1, by ray casting.

    Rings are tried some at a time, on the points that none before them holds, by their boxes first.
    """
    after = np.arange(len(x)) + 1
    after[start + size - 1] = start
    west, east, south, north = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start), np.minimum.reduceat(y, start), np.maximum.reduceat(y, start)
    found = np.full(len(px), -1)

    def inside(p: np.ndarray, r: np.ndarray) -> np.ndarray:
        k = size[r]
        begin = np.cumsum(k) - k
        a = np.repeat(start[r] - begin, k) + np.arange(k.sum())
        b, u, v = after[a], np.repeat(px[p], k), np.repeat(py[p], k)
        with np.errstate(divide="ignore", invalid="ignore"):
            crosses = ((y[a] > v) != (y[b] > v)) & (u < (x[b] - x[a]) * (v - y[a]) / (y[b] - y[a]) + x[a])
        return np.add.reduceat(crosses.astype(int), begin) % 2 == 1

    for lo in range(0, len(px), work // some):
        left = np.arange(lo, min(lo + work // some, len(px)))
        for first in range(0, len(start), some):
            box = slice(first, first + some)
            u, v = px[left, None], py[left, None]
            row, ring = np.nonzero((u >= west[box]) & (u <= east[box]) & (v >= south[box]) & (v <= north[box]))
            if len(row):
                parts = np.array_split(np.arange(len(row)), max(1, int(size[first + ring].sum()) // work))
                held = np.concatenate([inside(left[row[s]], first + ring[s]) for s in parts if len(s)])
                row, at = np.unique(row[held], return_index=True)
                found[left[row]] = first + ring[held][at]
                left = np.delete(left, row)
            if not len(left):
                break
    return found
