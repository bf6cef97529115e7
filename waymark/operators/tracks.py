"""Time series of a walker: gaps, sessions, stops, smoothing, interpolation, slopes, speed fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def gaps(rows: DataFrame, who: str, at: str, longest: float) -> DataFrame:
    """who, from, to, seconds: neighbouring points further apart than `longest` seconds. `at` is seconds."""
    w = W.partitionBy(who).orderBy(at)
    each = rows.withColumn("prev", F.lag(at).over(w)).where(F.col(at) - F.col("prev") > longest)
    return each.select(who, F.col("prev").alias("from_s"), F.col(at).alias("to_s"), (F.col(at) - F.col("prev")).alias("seconds"))


def sessions(rows: DataFrame, who: str, at: str, longest: float) -> DataFrame:
    """who, session (from 1), begin, end, n: runs of points without a gap."""
    w = W.partitionBy(who).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > longest).cast("int"), F.lit(1))
    each = rows.withColumn("new", new).withColumn("session", F.sum("new").over(w).cast("long"))
    return each.groupBy(who, "session").agg(F.min(at).alias("begin_s"), F.max(at).alias("end_s"), F.count(F.lit(1)).alias("n"))


def stop_islands(rows: DataFrame, who: str, at: str, speed: str, slow: float, least: float, longest: float, points: int = 0, missing: float = 1.0) -> DataFrame:
    """who, begin, end: runs of points slower than `slow`, at least `least` seconds long, broken by gaps over `longest`.

    Tracks of fewer than `points` points, or with more than the share `missing` of speeds null, have none; a null speed
    ends a run.
    """
    w, whole = W.partitionBy(who).orderBy(at), W.partitionBy(who)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_known", F.count(speed).over(whole))
    rows = rows.where((F.col("_n") >= points) & (F.col("_n") - F.col("_known") <= missing * F.col("_n"))).drop("_n", "_known")
    stopped = F.coalesce((F.col(speed) < slow).cast("int"), F.lit(0))
    each = rows.withColumn("stop", stopped)
    turn = (F.col("stop") != F.lag("stop").over(w)) | (F.col(at) - F.lag(at).over(w) > longest)
    each = each.withColumn("run", F.sum(F.coalesce(turn.cast("int"), F.lit(1))).over(w))
    runs = each.where("stop = 1").groupBy(who, "run").agg(F.min(at).alias("begin_s"), F.max(at).alias("end_s"))
    return runs.where(F.col("end_s") - F.col("begin_s") >= least).select(who, "begin_s", "end_s")


def moving_average(rows: DataFrame, who: str, at: str, value: Column, weight: Column, half: int) -> DataFrame:
    """Weighted mean over the points within `half` seconds of each."""
    w = W.partitionBy(who).orderBy(at).rangeBetween(-half, half)
    return rows.withColumn("smooth", F.sum(value * weight).over(w) / F.sum(weight).over(w))


def running_max(rows: DataFrame, who: str, at: list[str], value: str) -> DataFrame:
    w = W.partitionBy(who).orderBy(*at).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("running_max", F.max(value).over(w))


def median5(rows: DataFrame, who: str, at: list[str], value: str) -> DataFrame:
    w = W.partitionBy(who).orderBy(*at).rowsBetween(-2, 2)
    near = F.array_sort(F.collect_list(value).over(w))
    n = F.size("near")
    mid = (F.element_at("near", F.floor((n + 1) / 2).cast("int")) + F.element_at("near", F.floor(n / 2 + 1).cast("int"))) / 2
    return rows.withColumn("near", near).withColumn("median5", mid).drop("near")


def interpolate_at(points: DataFrame, asks: DataFrame, who: str, at: str, value: str) -> DataFrame:
    """asks (who, at) with the value between the points around it; outside of them the nearest point's.

    An as-of join without a range join: both sides in one ordered window, the last point before and the first after.
    """
    both = points.select(who, at, F.col(value).alias("v"), F.lit(0).alias("kind")).unionByName(asks.select(who, at, F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind")))
    back = W.partitionBy(who).orderBy(at, "kind").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(who).orderBy(at, F.desc("kind")).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col("kind") == 0, F.struct(F.col(at).cast("double").alias("t"), F.col("v").alias("v")))
    each = both.withColumn("lo", F.last(known, ignorenulls=True).over(back)).withColumn("hi", F.first(known, ignorenulls=True).over(ahead)).where("kind = 1")
    line = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * (F.col(at) - F.col("lo.t")) / F.nullif(F.col("hi.t") - F.col("lo.t"), F.lit(0.0))
    return each.select(who, at, F.coalesce(line, "lo.v", "hi.v").alias("value"))


def overlap_lengths(spans: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """key, seconds of spans (key, a, b) inside each window (key, x, y)."""
    met = windows.join(spans, key, "left")
    part = F.greatest(F.lit(0), F.least("b", "y") - F.greatest("a", "x"))
    return met.groupBy(key, "x", "y").agg(F.sum(F.coalesce(part, F.lit(0))).alias("seconds"))


def ascent_descent(rows: DataFrame, who: str, at: list[str], height: str) -> DataFrame:
    step = rows.withColumn("dz", F.col(height) - F.lag(height).over(W.partitionBy(who).orderBy(*at)))
    return step.groupBy(who).agg(F.sum(F.greatest("dz", F.lit(0.0))).alias("ascent"), F.sum(F.greatest(-F.col("dz"), F.lit(0.0))).alias("descent"))


def attempts(rows: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    return rows.withColumn("attempt", F.row_number().over(W.partitionBy(*keys).orderBy(*at)).cast("long"))


def median_of(value: str, exact: bool) -> Column:
    """The median of a group: exact (a group's distinct values are held), or within a ten-thousandth of its ranks."""
    return F.percentile(value, 0.5) if exact else F.percentile_approx(value, 0.5, 10000)


def grade_bins(rows: DataFrame, grade: Column, value: str, edges: list[float], stairs: Column | None = None, exact: bool = True) -> DataFrame:
    """Median of value in each class of grade; the first and the last class are open. With `stairs`, rows on them are two
    classes of their own, behind the others: up and down. Where groups are large, exact=False holds a sketch only."""
    label = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        label = F.when(grade < edges[i], i).otherwise(label)
    if stairs is not None:
        label = F.when(stairs, F.when(grade >= 0, len(edges) + 1).otherwise(len(edges) + 2)).otherwise(label)
    return rows.withColumn("bin", label.cast("int")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), median_of(value, exact).alias("median"))


def fit_slope_factor(rows: DataFrame, walker: str, ks: list[float], exact: bool = True) -> DataFrame:
    """k, sse for each k: how well exp(k * |grade|) explains the pace, with each walker's own median level."""
    grid = rows.sparkSession.createDataFrame([(float(k),) for k in ks], "k double")
    each = rows.crossJoin(F.broadcast(grid)).withColumn("r", F.log("pace") - F.col("k") * F.abs("grade"))
    level = each.groupBy(walker, "k").agg(median_of("r", exact).alias("level"))
    return each.join(level, [walker, "k"]).groupBy("k").agg(F.sum((F.col("r") - F.col("level")) ** 2).alias("sse"))


def isotonic(rows: DataFrame, who: str, at: str, value: str, weight: str) -> DataFrame:
    """Per walk the nondecreasing series nearest in weighted squares; weights are positive.

    It is the slope of the lower hull of the cumulative sums: a boundary between blocks goes where the block before it
    has the greater mean, all such boundaries at once, until none is left.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        mass = np.concatenate([[0], np.cumsum(pdf["w"].to_numpy(float))])
        total = np.concatenate([[0], np.cumsum((pdf["w"] * pdf["v"]).to_numpy(float))])
        edge = np.arange(len(mass))
        while True:
            mean = np.diff(total[edge]) / np.diff(mass[edge])
            falls = np.flatnonzero(mean[:-1] > mean[1:]) + 1
            if not len(falls):
                return pdf.assign(fitted=np.repeat(mean, np.diff(edge)))[["who", "t", "fitted"]]
            edge = np.delete(edge, falls)

    own = rows.select(F.col(who).alias("who"), F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    return own.groupBy("who").applyInPandas(fit, f"who {own.schema['who'].dataType.simpleString()}, t double, fitted double")


def line_places(x: Column, y: Column, line: np.ndarray, slack: float) -> Column:
    """array<struct<off, s>>, nearest first: for each segment of a polyline not more than `slack` further from (x, y) than
    the nearest, the distance and the place along the line."""
    size = np.hypot(*np.diff(line, axis=0).T)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    parts = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("ax", "ay", "bx", "by", "size", "begin"), (*a, *b, w, s), strict=True)]) for a, b, w, s in zip(line[:-1], line[1:], size, begin, strict=True)])

    def along(g: Column) -> Column:
        dot = (x - g["ax"]) * (g["bx"] - g["ax"]) + (y - g["ay"]) * (g["by"] - g["ay"])
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot / F.nullif(g["size"] * g["size"], F.lit(0.0)), F.lit(0.0))))
        return F.struct(g["ax"].alias("ax"), g["ay"].alias("ay"), g["bx"].alias("bx"), g["by"].alias("by"), u.alias("u"), (g["begin"] + u * g["size"]).alias("s"))

    def place(p: Column) -> Column:
        off = F.hypot(p["ax"] + p["u"] * (p["bx"] - p["ax"]) - x, p["ay"] + p["u"] * (p["by"] - p["ay"]) - y)
        return F.struct(off.alias("off"), p["s"].alias("s"))

    every = F.array_sort(F.transform(F.transform(parts, along), place))
    return F.transform(F.array(every), lambda ps: F.filter(ps, lambda p: p["off"] <= F.get(ps, F.lit(0))["off"] + slack))[0]


def map_match(points: DataFrame, line: np.ndarray, slack: float = 8.0) -> DataFrame:
    """(walk, t, x, y) with s, the place along a polyline (metres), and off, the distance from it.

    A point's places are made by row (see line_places); a walk then goes from place to place in order of time, each time
    to the one nearest to where it is; it begins at the nearest to its first point.
    """

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, here, taken = pdf.sort_values("t", kind="stable"), None, []
        for offs, places in zip(pdf["offs"], pdf["places"], strict=True):
            k = 0 if here is None else int(np.abs(places - here).argmin())
            here = places[k]
            taken.append((here, offs[k]))
        return pdf[["walk", "t"]].assign(s=[s for s, _ in taken], off=[off for _, off in taken])

    near = points.select("walk", F.col("t").cast("double").alias("t"), line_places(F.col("x"), F.col("y"), line, slack).alias("p"))
    near = near.select("walk", "t", F.col("p.off").alias("offs"), F.col("p.s").alias("places"))
    return near.groupBy("walk").applyInPandas(follow, f"walk {points.schema['walk'].dataType.simpleString()}, t double, s double, off double")
