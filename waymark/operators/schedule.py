"""Conflicts, feasible combinations, their evaluation, hard rules and the best K, as joins over many requests at once.

Sections are (request, course, ord, ...): what is wanted together, of which course, and a number unique over all
requests. Combinations grow course by course; each step joins the next course's sections and removes the pairs in
conflict, so no infeasible prefix is kept. A combination carries its sections' numbers in order, which is also its
tie-break. `operators/requests.py` searches and counts without making combinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.plans.campus import Rules, Weights


def conflict_pairs(mt: DataFrame) -> DataFrame:
    """(request, a, b), a < b: sections of different courses of a request with overlapping meetings (half-open, same day).

    Meetings meet in buckets of request, day and hour. A pair is made once: in the first hour that its first two
    overlapping meetings share, so nothing needs to be made distinct.
    """
    own = mt.groupBy("request", "ord").agg(F.first("course").alias("course"), F.sort_array(F.collect_list(F.struct("mpos", "day", "s", "e"))).alias("ms"))
    each = own.select("*", F.explode("ms").alias("m")).select("request", "course", "ord", "ms", "m.*")
    each = each.withColumn("hour", F.explode(F.sequence(F.floor(F.col("s") / 60), F.floor((F.col("e") - 1) / 60))))
    x, y = [each.select("request", "day", "hour", *[F.col(c).alias(f"{c}{k}") for c in ("course", "ord", "ms", "mpos", "s", "e")]) for k in (1, 2)]
    met = x.join(y, ["request", "day", "hour"]).where("ord1 < ord2 AND course1 <> course2 AND s1 < e2 AND s2 < e1 AND hour = greatest(s1, s2) div 60")
    overlap = lambda p, q: (p["day"] == q["day"]) & (p["s"] < q["e"]) & (q["s"] < p["e"])
    before = lambda p, q: (p["mpos"] < F.col("mpos1")) | ((p["mpos"] == F.col("mpos1")) & (q["mpos"] < F.col("mpos2")))
    again = F.exists("ms1", lambda p: F.exists("ms2", lambda q: overlap(p, q) & before(p, q)))
    return met.where(~again).select("request", F.col("ord1").alias("a"), F.col("ord2").alias("b"))


def mrv_order(sec: DataFrame) -> DataFrame:
    """request, course, n_sections, pos: courses with the fewest sections first, ties by course."""
    counts = sec.groupBy("request", "course").agg(F.count(F.lit(1)).alias("n_sections"))
    return counts.withColumn("pos", F.row_number().over(W.partitionBy("request").orderBy("n_sections", "course")).cast("long"))


def feasible_combos(sec: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(request, combo): arrays of one section per course of the request, fewest sections first, without a conflict."""
    both = conflicts.select("request", F.col("a").alias("ord"), F.col("b").alias("other")).unionByName(conflicts.select("request", F.col("b").alias("ord"), F.col("a").alias("other")))
    against = both.groupBy("request", "ord").agg(F.collect_set("other").alias("others"))
    order = mrv_order(sec).withColumn("courses", F.max("pos").over(W.partitionBy("request")))
    options = sec.select("request", "course", "ord").join(order, ["request", "course"]).join(against, ["request", "ord"], "left")
    options = options.select("request", "ord", "pos", "courses", "others")
    most = options.agg(F.max("pos")).first()[0] or 0
    grown = options.where("pos = 1").select("request", "courses", F.array("ord").alias("combo"))
    done = grown.where("courses = 1")
    for pos in range(2, most + 1):
        here = options.where(F.col("pos") == pos).select("request", "ord", "others")
        clash = F.coalesce(F.arrays_overlap("combo", "others"), F.lit(False))
        grown = grown.where(F.col("courses") >= pos).join(here, "request").where(~clash).select("request", "courses", F.concat("combo", F.array("ord")).alias("combo"))
        done = done.unionByName(grown.where(F.col("courses") == pos))
    return done.select("request", "combo")


def day_rows(combos: DataFrame, mt: DataFrame, pairs: DataFrame, home: int) -> DataFrame:
    """One row per meeting of each combination, with what the day's route needs.

    prev: last known building of the day before this meeting, else home; spare: idle minutes since then; slack: spare
    less the way, null for the first located meeting and for unknown rooms.
    """
    each = combos.select("request", "combo", F.posexplode("combo").alias("cpos", "ord")).join(mt.drop("request", "course"), "ord")
    day = W.partitionBy("request", "combo", "day").orderBy("s", "e", "cpos", "mpos")
    before = day.rowsBetween(W.unboundedPreceding, -1)
    known = F.when(F.col("building") >= 0, F.col("building"))
    each = each.withColumn("last", F.last(known, ignorenulls=True).over(before)).withColumn("idle", F.coalesce(F.col("s") - F.lag("e").over(day), F.lit(0)))
    each = each.withColumn("g", F.coalesce(F.count(known).over(before), F.lit(0)))
    each = each.withColumn("spare", F.sum("idle").over(W.partitionBy("request", "combo", "day", "g").orderBy("s", "e", "cpos", "mpos").rowsBetween(W.unboundedPreceding, 0)))
    way = pairs.select(F.col("a").alias("prev"), F.col("b").alias("building"), F.col("minutes").alias("way"))
    each = each.withColumn("prev", F.coalesce("last", F.lit(home))).join(way, ["prev", "building"], "left")
    return each.withColumn("slack", F.when(known.isNotNull() & F.col("last").isNotNull(), F.col("spare") - F.col("way")))


def legs(combos: DataFrame, mt: DataFrame, pairs: DataFrame, home: int) -> DataFrame:
    """request, combo, day, leg, from_b, to_b, minutes, slack: the way to each located meeting, then home."""
    rows = day_rows(combos, mt, pairs, home).where("building >= 0")
    number = F.row_number().over(W.partitionBy("request", "combo", "day").orderBy("s", "e", "cpos", "mpos")).cast("long")
    out = rows.select("request", "combo", "day", number.alias("leg"), F.col("prev").alias("from_b"), F.col("building").alias("to_b"), F.col("way").alias("minutes"), "slack")
    ends = out.groupBy("request", "combo", "day").agg((F.max("leg") + 1).alias("leg"), F.max_by("to_b", "leg").alias("from_b"))
    back = ends.join(pairs.where(F.col("b") == home).select(F.col("a").alias("from_b"), "minutes"), "from_b", "left")
    return out.unionByName(back.select("request", "combo", "day", "leg", "from_b", F.lit(home).alias("to_b"), "minutes", F.lit(None).cast("double").alias("slack")))


def evaluate(combos: DataFrame, mt: DataFrame, pairs: DataFrame, home: int, weights: Weights = Weights()) -> DataFrame:
    """request, combo, travel, late, gap, days, cost: each day from home through its known rooms and back.

    A combination whose sections have no meetings costs nothing.
    """
    rows = day_rows(combos, mt, pairs, home)
    located = F.col("building") >= 0
    per_day = rows.groupBy("request", "combo", "day").agg(
        F.sum(F.when(located, F.col("way"))).alias("way"), F.sum(F.greatest(-F.col("slack"), F.lit(0.0))).alias("late"), F.sum(F.greatest("slack", F.lit(0.0))).alias("gap"),
        F.max_by(F.when(located, F.col("building")), F.when(located, F.struct("s", "e", "cpos", "mpos"))).alias("end"),
    )
    back = pairs.where(F.col("b") == home).select(F.col("a").alias("end"), F.col("minutes").alias("back"))
    per_day = per_day.join(back, "end", "left")
    total = per_day.groupBy("request", "combo").agg(
        F.sum(F.coalesce("way", F.lit(0.0)) + F.coalesce("back", F.lit(0.0))).alias("travel"), F.sum(F.coalesce("late", F.lit(0.0))).alias("late"),
        F.sum(F.coalesce("gap", F.lit(0.0))).alias("gap"), F.count(F.lit(1)).alias("days"),
    )
    total = combos.select("request", "combo").join(total, ["request", "combo"], "left")
    total = total.select("request", "combo", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("travel", "late", "gap")], F.coalesce("days", F.lit(0)).cast("long").alias("days"))
    w = weights
    return total.withColumn("cost", w.travel * F.col("travel") + w.late * F.col("late") + w.day * F.col("days") + w.gap * F.col("gap"))


def cost_key(cost: Column) -> Column:
    """Micro-minutes, rounded half up: what ranks compare."""
    return F.floor(cost * 1000000 + 0.5).cast("long")


def top_k(evaluated: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """The K cheapest of each request, ties in order of the sections' numbers; rank from 1. A larger K only appends."""
    best = evaluated.withColumn("cost_key", cost_key(F.col("cost")))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("request").orderBy("cost_key", "combo")).cast("long"))
    return best.where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def page_size(shown: int, first: int = 24) -> int:
    """How many schedules to fetch when more than `shown` are asked for: first 24, then twice as many and 24 more (72, 168,
    360, ...). What was fetched before keeps its order."""
    n = first
    while n <= shown:
        n = 2 * n + first
    return n


def admitted_sections(options: DataFrame, rules: Rules) -> DataFrame:
    """Rows of choices (request, course, ord, meetings) whose section keeps the rules by itself; of a request with a course
    that no section is left of, none."""
    kept = options.where("ord IS NOT NULL").where(F.col("meetings").isNull() | obeys(F.col("meetings"), rules))
    left = kept.select("request", "course").distinct()
    lost = options.select("request", "course").distinct().join(left, ["request", "course"], "left_anti").select("request").distinct()
    return kept.join(lost, "request", "left_anti")


def lunch_gap(busy: Column, lunch: tuple[int, int, int]) -> Column:
    """True where array<struct<s, e>> leaves `minutes` free inside [start, end): from its start or the end of a meeting."""
    start, end, minutes = lunch
    minutes = min(minutes, end - start)
    starts = F.concat(F.array(F.lit(start)), F.transform(busy, lambda m: m.e))
    return F.exists(starts, lambda t: (t >= start) & (t <= end - minutes) & F.forall(busy, lambda m: (m.s >= t + minutes) | (m.e <= t)))


def obeys(days: Column, rules: Rules) -> Column:
    """Whether array<struct<day, s, e>> keeps the rules."""
    out = F.lit(True)
    if rules.free_days:
        out = out & ~F.exists(days, lambda m: m.day.isin(*rules.free_days))
    if rules.lunch:
        for d in range(7):
            out = out & lunch_gap(_of_day(days, d), rules.lunch)
    return out


def _of_day(days: Column, day: int) -> Column:
    return F.filter(days, lambda m: m.day == day)


def admitted(combos: DataFrame, mt: DataFrame, rules: Rules) -> DataFrame:
    """Combinations that keep the rules; one without meetings keeps them all."""
    each = combos.select("request", "combo", F.explode("combo").alias("ord")).join(mt.select("ord", "day", "s", "e"), "ord", "left")
    days = each.groupBy("request", "combo").agg(F.collect_list(F.when(F.col("day").isNotNull(), F.struct("day", "s", "e"))).alias("days"))
    return days.where(obeys(F.col("days"), rules)).select("request", "combo")


def twin_groups(mt: DataFrame) -> DataFrame:
    """course, first, twins: sections of a course with equal day, time and place; the first stands for the others."""
    sign = mt.groupBy("course", "ord").agg(F.array_sort(F.collect_list(F.struct("day", "s", "e", "building"))).alias("sig"))
    groups = sign.groupBy("course", "sig").agg(F.array_sort(F.collect_list("ord")).alias("all"))
    return groups.select("course", F.col("all")[0].alias("first"), F.slice("all", F.lit(2), F.size("all")).alias("twins"))
