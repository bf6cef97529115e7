"""Ways on foot from doors to roads, round buildings: a grid of free cells, the shortest ways in it, pulled tight."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.footprints import boundary, cells

LINK = "array<struct<x:double,y:double>>"
STEPS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


class Yard:
    """Square cells around a door, of which those in a building are shut; the door's own surroundings are open."""

    def __init__(self, x: float, y: float, reach: float, cell: float, walls: list[np.ndarray], opening: float) -> None:
        self.cell, self.n = cell, 2 * int(np.ceil(reach / cell)) + 1
        self.origin = np.array([x, y]) - self.n // 2 * cell
        at = self.origin[:, None, None] + np.stack(np.meshgrid(np.arange(self.n), np.arange(self.n), indexing="ij")) * cell
        self.shut = np.zeros((self.n, self.n), bool)
        for ring in walls:
            self.shut |= self._inside(at, np.asarray(ring, float))
        self.shut &= np.hypot(at[0] - x, at[1] - y) > opening

    @staticmethod
    def _inside(at: np.ndarray, ring: np.ndarray) -> np.ndarray:
        out = np.zeros(at.shape[1:], bool)
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
            if ay != by:
                out ^= ((ay > at[1]) != (by > at[1])) & (at[0] < (bx - ax) * (at[1] - ay) / (by - ay) + ax)
        return out

    def place(self, x: float, y: float) -> tuple[int, int]:
        i, j = np.rint((np.array([x, y]) - self.origin) / self.cell).astype(int)
        return int(i), int(j)

    def point(self, c: tuple[int, int]) -> tuple[float, float]:
        return tuple((self.origin + np.array(c) * self.cell).tolist())

    def free(self, c: tuple[int, int]) -> bool:
        return 0 <= c[0] < self.n and 0 <= c[1] < self.n and not self.shut[c]

    def ways(self, start: tuple[int, int]) -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, int]]]:
        """(metres to every cell, the cell before it). A diagonal step needs both cells beside it to be free."""
        far = np.full((self.n, self.n), np.inf)
        far[start], back, heap = 0.0, {}, [(0.0, start)]
        while heap:
            d, c = heapq.heappop(heap)
            if d > far[c]:
                continue
            for i, j in STEPS:
                to = (c[0] + i, c[1] + j)
                if not self.free(to) or (i and j and not (self.free((c[0] + i, c[1])) and self.free((c[0], c[1] + j)))):
                    continue
                more = d + self.cell * (i * i + j * j) ** 0.5
                if more < far[to] - 1e-12:
                    far[to], back[to] = more, c
                    heapq.heappush(heap, (more, to))
        return far, back

    def sees(self, a: tuple[float, float], b: tuple[float, float]) -> bool:
        """Whether the straight line between two places is free, looked at four times a cell."""
        n = max(1, int(np.ceil(np.hypot(b[0] - a[0], b[1] - a[1]) / self.cell * 4)))
        t = np.linspace(0, 1, n + 1)[:, None]
        c = np.rint((np.array(a) * (1 - t) + np.array(b) * t - self.origin) / self.cell).astype(int)
        return bool(((c >= 0) & (c < self.n)).all() and not self.shut[c[:, 0], c[:, 1]].any())

    def tight(self, line: list[tuple[float, float]]) -> list[tuple[float, float]]:
        """The line with every point left out that a straight line can pass by: from each point on to the last it sees."""
        out, at = [line[0]], 0
        while at < len(line) - 1:
            at = next(k for k in range(len(line) - 1, at, -1) if k == at + 1 or self.sees(line[at], line[k]))
            out.append(line[at])
        return out


def door_links(doors: DataFrame, footprints: DataFrame, roads: DataFrame, reach: float = 60.0, cell: float = 1.0, opening: float = 2.0) -> DataFrame:
    """(door, rank, edge, length, line): ways from each door to the roads around it, the nearest first.

    doors: door, x, y, max_links, slack, spacing. Of the places on roads (edge, x1, y1, x2, y2) within `reach` that can be
    walked to, the nearest counts, and then others at most `slack` metres further, `spacing` metres from those taken, up to
    max_links. Ways go round footprints (fid, ring), but for `opening` metres about the door itself. A door's surroundings
    are found by grid cells; each door is worked on by itself. A door that reaches no road has no row.
    """
    own = doors.select("door", F.col("x").alias("dx"), F.col("y").alias("dy")).withColumn("cx", F.floor(F.col("dx") / reach)).withColumn("cy", F.floor(F.col("dy") / reach))

    def around(rows: DataFrame, *keep: str) -> DataFrame:
        boxed = rows.withColumn("cx", F.explode(cells(F.col("x1"), F.col("x2"), reach, reach))).withColumn("cy", F.explode(cells(F.col("y1"), F.col("y2"), reach, reach)))
        return own.join(boxed, ["cx", "cy"]).select("door", *keep).distinct()

    near = around(boundary(footprints), "fid").join(footprints.select("fid", "ring"), "fid").groupBy("door").agg(F.collect_list("ring").alias("walls"))
    paths = around(roads, "edge", "x1", "y1", "x2", "y2").groupBy("door").agg(F.collect_list(F.struct("edge", "x1", "y1", "x2", "y2")).alias("roads"))
    rows = doors.join(near, "door", "left").join(paths, "door")

    def link(row) -> list[dict]:
        walls = [np.array([(p["x"], p["y"]) for p in ring]) for ring in (row.walls if row.walls is not None else [])]
        yard = Yard(row.x, row.y, reach, cell, walls, opening)
        far, back = yard.ways(yard.place(row.x, row.y))
        found = []
        for s in row.roads:
            n = max(1, int(np.ceil(np.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]) / cell)))
            for t in np.linspace(0, 1, n + 1):
                p = (s["x1"] + t * (s["x2"] - s["x1"]), s["y1"] + t * (s["y2"] - s["y1"]))
                c = yard.place(*p)
                if yard.free(c) and far[c] <= reach:
                    found.append((float(far[c]), s["edge"], p, c))
        taken: list[dict] = []
        for d, edge, p, c in sorted(found, key=lambda f: (f[0], f[1], f[2])):
            if len(taken) == row.max_links or (taken and d > taken[0]["_grid"] + row.slack):
                break
            if all(np.hypot(p[0] - t["line"][-1]["x"], p[1] - t["line"][-1]["y"]) >= row.spacing for t in taken):
                steps = [c]
                while steps[-1] in back:
                    steps.append(back[steps[-1]])
                line = yard.tight([(row.x, row.y), *(yard.point(s) for s in steps[::-1][1:-1]), p])
                size = sum(float(np.hypot(b[0] - a[0], b[1] - a[1])) for a, b in zip(line, line[1:], strict=False))
                taken.append({"door": row.door, "rank": len(taken) + 1, "edge": edge, "length": size, "line": [{"x": x, "y": y} for x, y in line], "_grid": d})
        return taken

    def run(batches):
        for pdf in batches:
            out = [x for row in pdf.itertuples() for x in link(row)]
            if out:
                yield pd.DataFrame(out).drop(columns="_grid")

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return rows.mapInPandas(run, f"door {kind(doors, 'door')}, rank long, edge {kind(roads, 'edge')}, length double, line {LINK}")
