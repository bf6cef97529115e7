"""Ground levels of buildings: from heights along the boundary and at the entrances to floors and the lobby."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.footprints import perimeter_samples


def ground_samples(buildings: DataFrame, picked: DataFrame, footprints: DataFrame, step: float = 2.0, radius: float = 15.0, around: int = 24) -> DataFrame:
    """(building, x, y, w): places whose heights make a building's ground: along its footprint's boundary in stretches of at
    most `step`, or on a circle of `radius` where it has none. buildings: building, x, y; picked: building, fid."""
    own = buildings.select("building", F.col("x").alias("bx"), F.col("y").alias("by")).join(picked.select("building", "fid"), "building", "left")
    along = own.where("fid IS NOT NULL").join(perimeter_samples(footprints, step), "fid").select("building", "x", "y", "w")
    turn = F.col("i") * (2 * math.pi / around)
    ring = own.where("fid IS NULL").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(around - 1))))
    return along.unionByName(ring.select("building", (F.col("bx") + radius * F.cos(turn)).alias("x"), (F.col("by") + radius * F.sin(turn)).alias("y"), F.lit(1.0).alias("w")))


def ground_levels(samples: DataFrame, slope: float = 3.0) -> DataFrame:
    """(building, mean, low, high, span, sloped, samples, covered) of samples (building, w, z): z null where there is no
    height; mean by stretch length; sloped from a span of `slope` metres; covered is the share with a height."""
    known = F.col("z").isNotNull()
    g = samples.groupBy("building").agg(
        (F.sum(F.when(known, F.col("z") * F.col("w"))) / F.sum(F.when(known, F.col("w")))).alias("mean"), F.min("z").alias("low"), F.max("z").alias("high"), F.count("z").alias("samples"),
        (F.count("z") / F.count(F.lit(1))).alias("covered"),
    )
    return g.withColumn("span", F.col("high") - F.col("low")).withColumn("sloped", F.col("span") >= slope)


def floor_label(rel: Column, storey: float = 4.0) -> Column:
    """'1층', '2층', '지하1층': the storey at a height above the first floor's, rounded half up; there is no floor 0."""
    n = F.floor(rel / storey + 0.5).cast("int")
    return F.when(n >= 0, F.concat((n + 1).cast("string"), F.lit("층"))).otherwise(F.concat(F.lit("지하"), (-n).cast("string"), F.lit("층")))


def entrance_floors(entrances: DataFrame, levels: DataFrame, storey: float = 4.0) -> DataFrame:
    """Entrances (building, ..., ground, checked) with `rel`, their height above the building's level, and `floor`: the one
    that was checked on site, else the estimate; null without either."""
    both = entrances.join(levels.select("building", "mean"), "building", "left").withColumn("rel", F.col("ground") - F.col("mean"))
    return both.withColumn("floor", F.coalesce(F.nullif(F.trim("checked"), F.lit("")), floor_label(F.col("rel"), storey))).drop("mean")


def estimates(buildings: DataFrame, levels: DataFrame, entrances: DataFrame, even: float = 1.5) -> DataFrame:
    """One row per building: its level, its entrances' heights and floors, the lobby and where that comes from, and notes.

    The lobby is where the main entrances are, if they lie within `even` metres; without main entrances where all are, on
    the same condition; without any height of an entrance the level itself, on flat ground. Otherwise it is open.
    entrances: building, kind ('main' or other), ground, floor.
    """
    main = F.col("kind") == "main"
    per = entrances.groupBy("building").agg(
        F.count(F.lit(1)).alias("entrances"), F.count("ground").alias("heights"), F.min("ground").alias("entrance_min"), F.max("ground").alias("entrance_max"), F.avg("ground").alias("entrance_mean"),
        F.count(F.when(main, F.col("ground"))).alias("mains"), F.min(F.when(main, F.col("ground"))).alias("main_min"), F.max(F.when(main, F.col("ground"))).alias("main_max"),
        F.avg(F.when(main, F.col("ground"))).alias("main_mean"), F.array_sort(F.collect_set("floor")).alias("floors"),
    )
    all_ = buildings.join(levels, "building", "left").join(per, "building", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    by_main = (zero("mains") > 0) & (F.col("main_max") - F.col("main_min") < even)
    by_all = (zero("mains") == 0) & (zero("heights") > 0) & (F.col("entrance_max") - F.col("entrance_min") < even)
    by_level = (zero("heights") == 0) & ~F.coalesce("sloped", F.lit(True))
    source = F.when(by_main, "main").when(by_all, "entrances").when(by_level, "level")
    lobby = F.when(by_main, F.col("main_mean")).when(by_all, F.col("entrance_mean")).when(by_level, F.col("mean"))
    notes = F.array_compact(F.array(
        F.when(F.col("mean").isNull(), "no_height"), F.when(F.col("mean").isNotNull() & (F.col("covered") < 0.8), "partly_covered"), F.when(zero(F.size("floors")) >= 2, "several_floors"),
        F.when(source.isNull() & F.col("mean").isNotNull(), F.when(zero("heights") > 0, "lobby_open_heights_differ").otherwise("lobby_open_slope")),
    ))
    return all_.select(*buildings.columns, "mean", "low", "high", "span", "sloped", "samples", zero("entrances").alias("entrances"), "entrance_min", "entrance_max", "floors", (zero(F.size("floors")) >= 2).alias("multi_level"), lobby.alias("lobby"), source.alias("lobby_source"), notes.alias("notes"))
