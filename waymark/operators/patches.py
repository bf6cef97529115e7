"""Paths that a map lacks, joined to a graph. What one path adds the next may join, so a graph is one task's work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NODE = "array<struct<node:long,x:double,y:double>>"
EDGE = "array<struct<a:long,b:long,length:double,kind:string,path:long,from_a:long,from_b:long>>"


class Patch:
    """A graph that grows: nodes by number, edges as pairs of them, and which edge a piece comes from."""

    def __init__(self, nodes: dict[int, tuple[float, float]], edges: Iterator[tuple[int, int, str]]) -> None:
        self.xy = {int(n): (float(x), float(y)) for n, (x, y) in nodes.items()}
        self.fresh = max(self.xy, default=-1) + 1
        self.segments = [(int(a), int(b), kind, int(a), int(b)) for a, b, kind in edges]
        self.added: list[tuple[int, int, str, int | None, int | None, int | None]] = []

    def node(self, x: float, y: float) -> int:
        self.xy[self.fresh] = (x, y)
        self.fresh += 1
        return self.fresh - 1

    def nearest_node(self, x: float, y: float, but: set[int]) -> tuple[float, int]:
        ids = np.array([n for n in self.xy if n not in but], int)
        if not len(ids):
            return np.inf, -1
        off = np.hypot(*(np.array([self.xy[n] for n in ids]) - (x, y)).T)
        return float(off.min()), int(ids[off.argmin()])

    def nearest_edge(self, x: float, y: float, but: set[int]) -> tuple[float, int, float]:
        """(distance, which, how far along it: 0..1)"""
        which = [i for i, s in enumerate(self.segments) if s[0] not in but and s[1] not in but]
        if not which:
            return np.inf, -1, 0.0
        a, b = (np.array([self.xy[self.segments[i][k]] for i in which]) for k in (0, 1))
        d, p = b - a, np.array([x, y])
        u = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-18), 0, 1)
        off = np.hypot(*(a + d * u[:, None] - p).T)
        k = int(off.argmin())
        return float(off[k]), which[k], float(u[k])

    def split(self, which: int, u: float, end: float = 0.5) -> int:
        """The node at a place of an edge: an end within `end` metres, else a new one, which cuts the edge for all to come."""
        a, b, kind, from_a, from_b = self.segments[which]
        (ax, ay), (bx, by) = self.xy[a], self.xy[b]
        size = float(np.hypot(bx - ax, by - ay))
        if min(u, 1 - u) * size < end:
            return a if u < 0.5 else b
        foot = self.node(ax + u * (bx - ax), ay + u * (by - ay))
        self.segments[which] = (a, foot, kind, from_a, from_b)
        self.segments.append((foot, b, kind, from_a, from_b))
        for n in (a, b):
            self.added.append((foot, n, kind, None, from_a, from_b))
        return foot

    def join(self, here: int, snap: float, link: float, kind: str, path: int, but: set[int]) -> bool:
        """Connects a node to the nearest other one within `snap`, else to the nearest edge within `link`."""
        off, other = self.nearest_node(*self.xy[here], but | {here})
        if off > snap:
            off, which, u = self.nearest_edge(*self.xy[here], but | {here})
            if off > link:
                return False
            other = self.split(which, u)
        self.added.append((here, other, kind, path, None, None))
        return True

    def lay(self, paths: dict[int, tuple[str, np.ndarray]], merge: float, snap: float, link: float) -> list[int]:
        """Adds paths, whose points merge where they lie within `merge` metres, and joins their ends; ends that nothing is
        near to are tried again once all paths lie. Returns the paths with an end that stays free."""
        laid: list[int] = []
        lines: dict[int, list[int]] = {}
        for path, (kind, points) in paths.items():
            line: list[int] = []
            for x, y in points:
                off = [np.hypot(self.xy[n][0] - x, self.xy[n][1] - y) for n in laid]
                n = laid[int(np.argmin(off))] if off and min(off) <= merge else self.node(x, y)
                if n not in laid:
                    laid.append(n)
                if not line or line[-1] != n:
                    line.append(n)
            lines[path] = line
            self.added += [(a, b, kind, path, None, None) for a, b in zip(line, line[1:], strict=False)]
        shared = {n for n in laid if sum(n in line for line in lines.values()) > 1}
        free = [(path, n) for path, line in lines.items() for n in {line[0], line[-1]} if n not in shared]
        for _ in range(2):
            free = [(path, n) for path, n in free if not self.join(n, snap, link, paths[path][0], path, set(lines[path]))]
            for path, line in lines.items():
                known = {(s[0], s[1]) for s in self.segments}
                self.segments += [(a, b, paths[path][0], a, b) for a, b in zip(line, line[1:], strict=False) if (a, b) not in known]
        return sorted({path for path, _ in free})


def apply_patches(nodes: DataFrame, edges: DataFrame, points: DataFrame, merge: float = 0.3, snap: float = 1.0, link: float = 15.0) -> DataFrame:
    """(graph, nodes, edges, free): what the paths add to each graph, one task a graph.

    nodes (graph, node, x, y), edges (graph, a, b, kind), points (graph, path, i, x, y, kind). New edges have their path, or,
    where they are pieces of an edge that a path's end was joined to, that edge's ends (from_a, from_b); the edge itself
    stays. free: paths with an end that could not be joined. A graph without paths gets nothing.
    """
    kind = nodes.schema["graph"].dataType.simpleString()
    rows = nodes.selectExpr("graph", "'node' AS what", "node AS a", "cast(null AS long) AS b", "x", "y", "cast(null AS string) AS kind")
    rows = rows.unionByName(edges.selectExpr("graph", "'edge' AS what", "a", "b", "cast(null AS double) AS x", "cast(null AS double) AS y", "kind"))
    rows = rows.unionByName(points.selectExpr("graph", "'path' AS what", "path AS a", "cast(i AS long) AS b", "x", "y", "kind"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {w: g for w, g in pdf.groupby("what")}
        if "path" not in part:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("graph", "nodes", "edges", "free")})
        old = part.get("node", pdf.iloc[:0]).sort_values("a")
        lines = part.get("edge", pdf.iloc[:0]).sort_values(["a", "b"])
        patch = Patch({n: (x, y) for n, x, y in zip(old["a"], old["x"], old["y"], strict=True)}, zip(lines["a"], lines["b"], lines["kind"], strict=True))
        known = set(patch.xy)
        paths = {int(k): (g["kind"].iloc[0], g.sort_values("b")[["x", "y"]].to_numpy(float)) for k, g in part["path"].groupby("a")}
        free = patch.lay(paths, merge, snap, link)
        new = [{"node": n, "x": x, "y": y} for n, (x, y) in patch.xy.items() if n not in known]
        size = lambda a, b: float(np.hypot(patch.xy[a][0] - patch.xy[b][0], patch.xy[a][1] - patch.xy[b][1]))
        made = [{"a": a, "b": b, "length": size(a, b), "kind": k, "path": p, "from_a": fa, "from_b": fb} for a, b, k, p, fa, fb in patch.added]
        return pd.DataFrame([{"graph": pdf["graph"].iloc[0], "nodes": new, "edges": made, "free": free}])

    return rows.groupBy("graph").applyInPandas(run, f"graph {kind}, nodes {NODE}, edges {EDGE}, free array<long>")
