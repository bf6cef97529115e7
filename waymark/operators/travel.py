"""The travel matrix: lookup with fallbacks, closure, triangle check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import haversine_m, walk_minutes
from waymark.plans.campus import MatrixParams


def pair_grid(travel: DataFrame, buildings: DataFrame, params: MatrixParams = MatrixParams()) -> DataFrame:
    """a, b, minutes, source for every pair of buildings: same, table, reverse, estimate or default.

    The grid is quadratic in the campus's buildings, which are few (its use is a dense matrix).
    """
    ids = buildings.select("building", "lat", "lon")
    grid = ids.select(F.col("building").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).crossJoin(ids.select(F.col("building").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")))
    grid = grid.join(travel.select("a", "b", F.col("minutes").alias("there")), ["a", "b"], "left")
    grid = grid.join(travel.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("minutes").alias("back")), ["a", "b"], "left")
    back = F.col("back") if params.symmetric else F.lit(None).cast("double")
    guess = walk_minutes(haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), params.walk_km_h, params.detour)
    same = F.when(F.col("a") == F.col("b"), F.lit(0.0))
    source = F.when(same.isNotNull(), "same").when(F.col("there").isNotNull(), "table").when(back.isNotNull(), "reverse").when(guess.isNotNull(), "estimate").otherwise("default")
    return grid.select("a", "b", F.coalesce(same, "there", back, guess, F.lit(params.default)).alias("minutes"), source.alias("source"))


def shortest_matrix(table: np.ndarray) -> np.ndarray:
    """Shortest ways over a square table of direct ones (inf where there is none), through any of its places."""
    out = table.copy()
    np.fill_diagonal(out, np.minimum(np.diagonal(out), 0.0))
    for k in range(len(out)):
        np.minimum(out, out[:, k, None] + out[None, k, :], out=out)
    return out


def closure(grid: DataFrame, ids: list[int]) -> DataFrame:
    """a, b, minutes: shortest over all ways through `ids`, in one Arrow task: ids are one campus's buildings, and the
    table has their square. Pairs without a way don't appear."""

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches)
        names = np.unique(np.concatenate([rows["a"], rows["b"]]))
        table = np.full((len(names), len(names)), np.inf)
        table[np.searchsorted(names, rows["a"]), np.searchsorted(names, rows["b"])] = rows["minutes"]
        table = shortest_matrix(table)
        a, b = np.nonzero(np.isfinite(table))
        yield pd.DataFrame({"a": names[a], "b": names[b], "minutes": table[a, b]})

    own = grid.where(F.col("a").isin(ids) & F.col("b").isin(ids)).select("a", "b", "minutes")
    return own.repartition(1).mapInPandas(close, own.schema)


def triangle_violations(grid: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """a, b, c, excess where going from a to c by b is shorter by more than the tolerance."""
    direct = grid.select("a", "c", F.col("minutes").alias("direct")) if "c" in grid.columns else grid.select("a", F.col("b").alias("c"), F.col("minutes").alias("direct"))
    x = grid.select("a", "b", F.col("minutes").alias("x"))
    y = grid.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("minutes").alias("y"))
    both = x.join(y, "b").where("a <> b AND b <> c AND a <> c").join(direct, ["a", "c"])
    return both.where(F.col("direct") > F.col("x") + F.col("y") + tolerance).select("a", "b", "c", (F.col("direct") - F.col("x") - F.col("y")).alias("excess"))
