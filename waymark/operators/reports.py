"""Numbers that go into reports: shares, baselines, extremes, and lists in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def spread_by_period(rows: DataFrame) -> DataFrame:
    """(period, courses, spread, mean_buildings) over courses with two sections or more; rows are sections (period, course, building)."""
    per = rows.groupBy("period", "course").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("building").alias("nb")).where("n >= 2")
    return per.groupBy("period").agg(F.count(F.lit(1)).alias("courses"), F.count_if(F.col("nb") >= 2).alias("spread"), F.avg("nb").alias("mean_buildings"))


def combination_counts(sizes: DataFrame) -> DataFrame:
    """(request, n): the product of each request's section counts (request, n_sections), to 38 digits; null beyond."""
    counts = sizes.groupBy("request").agg(F.array_sort(F.collect_list(F.col("n_sections").cast("decimal(38,0)"))).alias("ns"))
    return counts.select("request", F.expr("aggregate(ns, cast(1 as decimal(38,0)), (a, x) -> cast(try_multiply(a, x) as decimal(38,0)))").alias("n"))


def random_baseline(rows: DataFrame, group: str, cost: str, late: Column) -> DataFrame:
    """(group, n, mean, median, most, late_share, mean_late): what a random choice of the group costs; late in minutes."""
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(cost).alias("mean"), F.percentile(cost, 0.5).alias("median"), F.max(cost).alias("most"),
        F.avg((late > 0).cast("int")).alias("late_share"), F.avg(F.greatest(late, F.lit(0.0))).alias("mean_late"),
    )


def route_stats(rows: DataFrame, route: str, value: str, at: list[str]) -> DataFrame:
    """(route, n, mean, sd, seen): per route, numbered in the order in which routes are first seen (ties by route)."""
    g = rows.groupBy(route).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(F.struct(*at)).alias("first"))
    return g.select(route, "n", "mean", "sd", F.row_number().over(W.orderBy("first", route)).alias("seen"))


def merged_points(points: DataFrame, decimals: int = 2) -> DataFrame:
    """(x, y, z): heights of points that share a place to so many decimals, averaged."""
    return points.groupBy(F.round("x", decimals).alias("x"), F.round("y", decimals).alias("y")).agg(F.avg("z").alias("z"))


def share_by_kind(rows: DataFrame, kind: str, length: str) -> DataFrame:
    """(kind, n, share): how many of each kind, and their share of the whole length."""
    g = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("length"))
    total = rows.agg(F.sum(length).alias("all"))
    return g.crossJoin(F.broadcast(total)).select(kind, "n", (F.col("length") / F.nullif(F.col("all"), F.lit(0.0))).alias("share"))


def best_per_key(rows: DataFrame, key: str, rank: list[Column], *columns: str) -> DataFrame:
    """(key, columns): of each key the row whose tuple of ranks is greatest."""
    order = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)])
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("best"))
    return best.select(key, *[F.col(f"best.{c}").alias(c) for c in columns])


def cohorts(people: DataFrame, keys: list[str], enrolled: Column, least: int = 2) -> DataFrame:
    """(keys, members, weight): groups of at least `least`, with how many of them enrol."""
    return people.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.sum(F.when(enrolled, 1).otherwise(0)).alias("weight")).where(F.col("members") >= least)


def arc_length(rows: DataFrame, key: str, at: str, step: str) -> DataFrame:
    """Rows with `s`, the sum of all steps of the line up to here; rows at the same place share it."""
    return rows.withColumn("s", F.sum(step).over(W.partitionBy(key).orderBy(at).rangeBetween(W.unboundedPreceding, 0)))


def largest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n keys with most rows (enrolled), ties by key: what a stress test begins with."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("enrolled")).orderBy(F.desc("enrolled"), key).limit(n)


def extremes(rows: DataFrame, value: Column, n: int, *ties: str) -> DataFrame:
    """The n rows of greatest value, with it as `gap`; ties by the given columns."""
    return rows.withColumn("gap", value).orderBy(F.desc("gap"), *ties).limit(n)


def spread_order(rows: DataFrame) -> DataFrame:
    """(course, ..., place): most buildings first, then the farthest pair, then the name."""
    from waymark.operators.catalog import ranked

    return ranked(rows, [-F.col("n_buildings"), -F.coalesce(F.col("max_minutes"), F.lit(-1.0)), F.col("course")], "place")


def difference_report(rows: DataFrame, a: Column, b: Column, thresholds: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """One row over pairs with both values: n, median difference, median and 90 % of the absolute one, least and most, and
    for each threshold how many differ by more, and how many of them upwards and downwards."""
    d = rows.select((a - b).alias("d")).where("d IS NOT NULL")
    over = [x for i, t in enumerate(thresholds) for x in (F.count_if(F.abs("d") > t).alias(f"over{i}"), F.count_if(F.col("d") > t).alias(f"above{i}"), F.count_if(F.col("d") < -t).alias(f"below{i}"))]
    return d.agg(F.count(F.lit(1)).alias("n"), F.median("d").alias("median"), F.median(F.abs("d")).alias("median_abs"), F.percentile(F.abs("d"), 0.9).alias("p90_abs"), F.min("d").alias("least"), F.max("d").alias("most"), *over)


def checkpoint_errors(points: DataFrame) -> DataFrame:
    """One row over independent points (z, measured): n, mean error, mean absolute error, 95 % and most of it."""
    e = points.select((F.col("z") - F.col("measured")).alias("e")).where("e IS NOT NULL")
    return e.agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"), F.avg(F.abs("e")).alias("mae"), F.percentile(F.abs("e"), 0.95).alias("p95"), F.max(F.abs("e")).alias("most"))
