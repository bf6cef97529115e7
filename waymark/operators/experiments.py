"""Samples of the space of choices, and synthetic cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.operators.requests import choices, count_schedules
from waymark.operators.schedule import cost_key, evaluate, feasible_combos


def rejection_sample(sec: DataFrame, conflicts: DataFrame, tries: int, want: int, seed: int = 1) -> DataFrame:
    """(request, combo): independent uniform choices per course, those with a conflict dropped, `want` per request at most.

    sec is (request, course, ord). A try is a row; its choice in a course is a hash of (seed, request, try, course) modulo
    the course's sections. A request with a course without a section (a null ord) has no sample.
    """
    course = W.partitionBy("request", "course")
    numbered = sec.withColumn("i", F.row_number().over(course.orderBy("ord")) - 1).withColumn("n", F.count("ord").over(course))
    sizes = numbered.groupBy("request", "course").agg(F.max("n").alias("n"))
    whole = sizes.groupBy("request").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("courses")).where("least > 0")
    order = W.partitionBy("request").orderBy("n", "course")
    draws = sizes.withColumn("pos", F.row_number().over(order)).join(whole, "request").withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    draws = draws.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "request", "try", "course"), F.col("n")).cast("int"))
    both = conflicts.select("request", F.col("a").alias("ord"), F.col("b").alias("other")).unionByName(conflicts.select("request", F.col("b").alias("ord"), F.col("a").alias("other")))
    against = both.groupBy("request", "ord").agg(F.collect_set("other").alias("others"))
    options = numbered.select("request", "course", "i", "ord").join(against, ["request", "ord"], "left")
    met = draws.join(options, ["request", "course", "i"]).groupBy("request", "try").agg(F.array_sort(F.collect_list(F.struct("pos", "ord"))).alias("chosen"), F.flatten(F.collect_list("others")).alias("shut"))
    kept = met.select("request", "try", F.col("chosen.ord").alias("combo"), "shut").where(~F.arrays_overlap("combo", "shut"))
    first = F.row_number().over(W.partitionBy("request").orderBy("try"))
    return kept.withColumn("k", first).where(F.col("k") <= want).select("request", "combo")


def choice_space(sec: DataFrame, mt: DataFrame, conflicts: DataFrame, whole: int = 20000, part: int = 50000, sample: int = 4000, tries: int = 3000000) -> DataFrame:
    """(request, combo, complete): all of a request's combinations if few, a hash sample of a middling number, rejection
    sampling beyond. The exact number of each request decides."""
    sized = count_schedules(choices(sec, mt)).select("request", "n")
    few, rest = sized.where(F.col("n") <= part), sized.where(F.col("n").isNull() | (F.col("n") > part))
    every = feasible_combos(sec.join(few, "request", "left_semi"), conflicts).join(few, "request")
    place = F.row_number().over(W.partitionBy("request").orderBy(F.xxhash64("combo"), "combo"))
    every = every.withColumn("place", place).where((F.col("n") <= whole) | (F.col("place") <= sample)).select("request", "combo", (F.col("n") <= whole).alias("complete"))
    drawn = rejection_sample(sec.join(rest, "request", "left_semi"), conflicts, tries, sample)
    return every.unionByName(drawn.withColumn("complete", F.lit(False)))


def weighted_draw(items: DataFrame, group: str, key: str, weight: str, n: int, seed: int = 1) -> DataFrame:
    """n items per group without replacement, each next one with probability in proportion to its weight.

    The n least of exponential times with these rates; the uniform number is a hash, so reruns agree.
    """
    u = (F.xxhash64(F.lit(seed), group, key).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    timed = items.where(F.col(weight) > 0).withColumn("at", -F.log(u) / F.col(weight))
    w = W.partitionBy(group).orderBy("at", key)
    return timed.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n).drop("at")


def cohorts(people: DataFrame, least: int = 2) -> DataFrame:
    """college, dept, year, members of cohorts with at least `least` members."""
    return people.groupBy("college", "dept", "year").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)


def candidates(sections: DataFrame, chosen: DataFrame) -> DataFrame:
    """Usable and eligible sections, and the chosen ones whether or not they are."""
    kept = sections.where("usable AND eligible").unionByName(sections.join(chosen, "ord", "left_semi"))
    return kept.dropDuplicates(["ord"])


def choice_loss(combos: DataFrame, mt: DataFrame, chosen_on: DataFrame, priced_on: DataFrame, home: int) -> DataFrame:
    """(request, priced, best, loss) in micro-minutes: each request's cheapest combination on one travel table, priced on
    another, against the other's own cheapest."""
    a = evaluate(combos, mt, chosen_on, home).select("request", "combo", cost_key(F.col("cost")).alias("k1"))
    b = evaluate(combos, mt, priced_on, home).select("request", "combo", cost_key(F.col("cost")).alias("k2"))
    picked = a.join(b, ["request", "combo"]).groupBy("request").agg(F.min_by("k2", F.struct("k1", "combo")).alias("priced"), F.min("k2").alias("best"))
    return picked.withColumn("loss", F.col("priced") - F.col("best"))
