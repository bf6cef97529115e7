"""Catalogue statistics, spread, quantiles, intervals and error measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.plans.store import Store


def location_stats(cat: DataFrame) -> DataFrame:
    """One row over sections (course, ord, buildings, unknown): how many have places, and courses in several buildings."""
    per = cat.groupBy("course").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("unknown") == 0).alias("located"), F.array_distinct(F.flatten(F.collect_set("buildings"))).alias("bs"),
    )
    many, spread = F.col("n") >= 2, (F.col("n") >= 2) & (F.size("bs") >= 2)
    out = per.agg(
        F.sum("n").alias("sections"), F.sum("located").alias("located"), F.round(F.sum("located") / F.sum("n"), 3).alias("ratio"), F.count(F.lit(1)).alias("courses"),
        F.count_if(many).alias("multi_section"), F.count_if(spread).alias("multi_building"), F.round(F.count_if(spread) / F.nullif(F.count_if(many), F.lit(0)), 3).alias("multi_ratio"),
    )
    return out.crossJoin(F.broadcast(cat.select(F.explode("buildings").alias("b")).agg(F.countDistinct("b").alias("buildings"))))


def building_spread(cat: DataFrame, pairs: DataFrame) -> DataFrame:
    """Courses of two sections or more: located sections, distinct buildings, the farthest pair (mean of both ways)."""
    per = cat.groupBy("course").agg(F.count(F.lit(1)).alias("n_sections"), F.count_if(F.col("unknown") == 0).alias("located"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("buildings")))).alias("bs")).where("n_sections >= 2")
    x = per.select("course", F.explode("bs").alias("a"))
    y = per.select("course", F.explode("bs").alias("b"))
    ways = pairs.join(pairs.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("minutes").alias("back")), ["a", "b"]).select("a", "b", ((F.col("minutes") + F.col("back")) / 2).alias("mean"))
    far = x.join(y, "course").where("a < b").join(ways, ["a", "b"]).groupBy("course").agg(F.max("mean").alias("max_minutes"))
    return per.join(far, "course", "left").select("course", "n_sections", "located", F.size("bs").cast("long").alias("n_buildings"), F.array_join("bs", ",").alias("buildings"), "max_minutes")


def spread_summary(spread: DataFrame) -> DataFrame:
    """By class and over all: courses with a located section, and the share in several buildings, plain and weighted."""
    rows = spread.where("located > 0").groupingSets([[], ["class"]], "class")
    several = F.col("n_buildings") >= 2
    return rows.agg(
        F.count(F.lit(1)).alias("courses"), F.count_if(several).alias("spread"), F.round(F.count_if(several) / F.count(F.lit(1)), 6).alias("ratio"),
        F.round(F.sum(F.when(several, F.col("n_sections"))) / F.sum("n_sections"), 6).alias("weighted_ratio"), F.percentile("n_buildings", 0.5).alias("median_buildings"),
    ).withColumn("class", F.coalesce("class", F.lit("all")))


def midrank_percentile(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(below + ties / 2) / n of each row within its group, from the two ranks of a window."""
    w = W.partitionBy(group)
    ranked = rows.withColumn("below", F.rank().over(w.orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("ties", F.count(F.lit(1)).over(W.partitionBy(group, value)))
    return ranked.select(group, key, F.round((F.col("below") + F.col("ties") / 2) / F.col("n"), 6).alias("percentile"))


def value_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, c, before): each distinct value, how often it occurs, and how many rows are below it. Values are dealt by
    ranges, so no task sorts or holds all of them; the dealt values are written, as ranges come from a sample."""
    spark = rows.sparkSession
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    dealt = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "value").select("*", F.spark_partition_id().alias("part"))
    dealt = Store(spark, "ranks").put(dealt, "values")
    within = dealt.withColumn("low", F.sum("c").over(W.partitionBy("part").orderBy("value")) - F.col("c"))
    sizes = dealt.groupBy("part").agg(F.sum("c").alias("n"))
    sizes = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    return within.join(sizes, "part").select("value", "c", (F.col("low") + F.col("base")).alias("before"))


def bundle_summary(rows: DataFrame, value: str) -> DataFrame:
    """n, mean, median, q90 and the mean of the top tenth (one row at least); quantiles are interpolated between ranks."""
    ranks = value_ranks(rows, value)
    ranks = ranks.crossJoin(F.broadcast(rows.agg(F.count(value).alias("n"))))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col("value")))

    def quantile(q: float) -> Column:
        place = (F.col("n") - 1) * q
        return at(F.floor(place)) + (at(F.ceil(place)) - at(F.floor(place))) * F.max(place - F.floor(place))

    top = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    share = F.greatest(F.lit(0), F.least(F.col("c"), F.col("before") + F.col("c") - (F.col("n") - top)))
    return ranks.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.round(F.sum(F.col("value") * F.col("c")) / F.max("n"), 4).alias("mean"), F.round(quantile(0.5), 4).alias("median"), F.round(quantile(0.9), 4).alias("q90"),
        F.round(F.sum(F.col("value") * share) / F.max(top), 4).alias("top_decile"),
    )


def ci95(rows: DataFrame, group: str, value: str) -> DataFrame:
    half = F.coalesce(1.96 * F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
    return rows.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.avg(value) - half, 6).alias("low"), F.round(F.avg(value) + half, 6).alias("high"))


def error_metrics(rows: DataFrame, group: str, error: str) -> DataFrame:
    e = F.col(error)
    return rows.groupBy(group).agg(F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(e), 6).alias("bias"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


def variation(rows: DataFrame, group: str, value: str) -> DataFrame:
    cv = F.when(F.count(value) > 1, F.round(F.stddev_samp(value) / F.avg(value), 6))
    return rows.groupBy(group).agg(F.count(value).alias("n"), cv.alias("cv"))


def calibration(rows: DataFrame, walker: str, key: str, measured: Column, predicted: Column) -> DataFrame:
    """Each row with its walker's median ratio, and what it measures at that pace."""
    per = rows.groupBy(walker).agg(F.percentile(measured / predicted, 0.5).alias("factor"))
    return rows.join(per, walker).select(key, walker, F.round("factor", 6).alias("factor"), F.round(measured / F.col("factor"), 6).alias("calibrated"))


def recent_distinct(rows: DataFrame, key: str, at: str, n: int) -> DataFrame:
    return rows.groupBy(key).agg(F.max(at).alias("at")).orderBy(F.desc("at")).limit(n)
