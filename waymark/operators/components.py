"""Connected components of an edge table: in one task up to a bound, by alternating large-star and small-star steps beyond it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.plans.store import Store

#: So many edges, of two longs each, fit a task with ease (32 MB, and about 200 MB while they are sorted).
MOST_EDGES = 1 << 21


def component_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u[i], v[i]), ascending, and of each the least node reachable."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # The root of either side hangs below the lesser one; then every node goes up to its root.
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def _solved(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for batch in rows:
        u.append(batch.column("u").to_numpy())
        v.append(batch.column("v").to_numpy())
    if u:
        nodes, root = component_roots(np.concatenate(u), np.concatenate(v))
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)], pa.int64()), pa.array(root[i : i + (1 << 16)], pa.int64())], ["node", "root"])


def _star(edges: DataFrame, small: bool, store: Store, name: str) -> DataFrame:
    """edges: (u, v), u > v. Each node's larger (or, for small, smaller) neighbours and itself link to its least neighbour.

    The least neighbours are written first, so that both sides of the join are plain exchanges: where a hub holds a large
    share of all edges, adaptive execution deals its edges to several tasks.
    """
    if small:
        least = store.put(edges.groupBy("u").agg(F.min("v").alias("m")), name)
        near = edges.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = near.unionByName(least.select("u", F.col("m").alias("v")))
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        # (v, u) with u < v: the larger neighbours v of u.
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("far"))
        linked = larger.join(least.hint("merge"), "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def connected_components(edges: DataFrame, store: Store, name: str, most: int = 0) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node reachable. No edges, no rows.

    A round's tables are deleted once the next one is written; the result reads only the last. Where there are `most`
    edges or fewer, of longs in a stored table (they are read twice), one task finds all roots instead.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    if most and now.count() <= most:
        return now.repartition(1).mapInArrow(_solved, "node long, root long")
    now, last, k = store.put(now.distinct(), f"{name}0"), None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
        last, k = mark, k + 1
        half = store.put(_star(now, False, store, f"{name}{k}-above"), f"{name}{k}-large")
        now = store.put(_star(half, True, store, f"{name}{k}-below"), f"{name}{k}")
        for old in (f"{name}{k - 1}", f"{name}{k}-above", f"{name}{k}-large", f"{name}{k}-below"):
            store.drop(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
