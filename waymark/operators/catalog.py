"""A course catalogue: what may be taken, where it is held, and lists of places that complete each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.plans.store import Store

#: The campus's box in degrees (south, north, west, east), programs and states of sections that can be taken.
CAMPUS_BOX = (37.40, 37.52, 126.90, 127.02)
OPEN_PROGRAMS, OPEN_STATES = ("", "학사"), ("", "설강")


# Sections


def of_campus(campuses: Column, wanted: int) -> Column:
    """A section stays where it has no campus at all (no time yet) or only the wanted one."""
    return (F.size(campuses) == 0) | (F.array_distinct(campuses) == F.array(F.lit(wanted)))


def has_location(buildings: Column) -> Column:
    """Some meeting, and the building of each is known (not null, not negative)."""
    return (F.size(buildings) > 0) & F.forall(buildings, lambda b: F.coalesce(b >= 0, F.lit(False)))


def timed(program: Column, status: Column, meetings: Column) -> Column:
    """An undergraduate section that is open and has meetings; null texts are empty."""
    return F.coalesce(program, F.lit("")).isin(*OPEN_PROGRAMS) & F.coalesce(status, F.lit("")).isin(*OPEN_STATES) & (F.coalesce(F.size(meetings), F.lit(0)) > 0)


def usable(program: Column, status: Column, meetings: Column, buildings: Column) -> Column:
    return timed(program, status, meetings) & has_location(buildings)


def section_label(number: Column, instructor: Column) -> Column:
    """'001 (name)'; '미정' without an instructor."""
    return F.concat(number, F.lit(" ("), F.coalesce(F.nullif(F.trim(instructor), F.lit("")), F.lit("미정")), F.lit(")"))


def contains_keyword(keyword: str, *fields: Column) -> Column:
    """Whether any field contains the keyword, whatever the case."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(keyword.lower())), F.lit(False))
    return hit


def requested(sections: DataFrame, wanted: DataFrame, excluded: DataFrame, located: Column | None = None) -> DataFrame:
    """Sections of the wanted courses (course, pos) with their place in the request, without excluded ones (ord), and
    where `located` is given only those that have a place. See missing_courses for those that nothing is left of."""
    kept = sections if located is None else sections.where(located)
    return kept.join(wanted, "course").join(excluded.select("ord").distinct(), "ord", "left_anti")


def missing_courses(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted courses without any section, in the request's order."""
    return wanted.join(sections.select("course").distinct(), "course", "left_anti")


def with_meta(sections: DataFrame, meta: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Sections with their metadata by key; what has none gets the defaults."""
    out = sections.join(meta.select(*keys, *defaults), keys, "left")
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def apply_overrides(meetings: DataFrame, overrides: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """Meetings with `building` and `moved`: a room set by hand (ord, mine, base) wins, unless the catalogue's meeting
    has moved since (its start is not `base` any more). With `picks` (ord) only picked sections stay."""
    own = meetings if picks is None else meetings.join(picks.select("ord").distinct(), "ord", "left_semi")
    both = own.join(overrides.select("ord", "mine", "base"), "ord", "left")
    held = F.col("base") == F.col("s")
    return both.withColumn("moved", F.coalesce(~held, F.lit(False))).withColumn("building", F.when(held, F.col("mine")).otherwise(F.col("building"))).drop("mine", "base")


def browse(courses: DataFrame, keep: Column, rank: Column, name: str, key: str) -> DataFrame:
    """Courses of a browse list with `place`: by class rank, then collated name, then id."""
    return ranked(courses.where(keep), [rank, F.collate(F.col(name), "ko"), F.col(key)], "place")


def ranked(rows: DataFrame, order: list[Column], place: str, parts: int | None = None) -> DataFrame:
    """Rows with their place (from 1) in a total order, without gathering them in one task: dealt by ranges of the order,
    numbered within each, and moved up by the numbers of the ranges before. The dealt rows are written, as ranges come
    from a sample and may differ when they are dealt again."""
    spark = rows.sparkSession
    keyed = rows.select(F.struct(*rows.columns).alias("row"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("order"))
    dealt = keyed.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "order").withColumn("part", F.spark_partition_id())
    dealt = Store(spark, "ranked").put(dealt, "dealt")
    within = dealt.withColumn("i", F.row_number().over(W.partitionBy("part").orderBy("order")))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return within.join(before, "part").select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns], (F.col("before") + F.col("i")).alias(place))


def meetings_overlap(a: Column, b: Column) -> Column:
    """Whether two arrays of meetings (day, s, e) overlap anywhere; half-open."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["day"] == y["day"]) & (x["s"] < y["e"]) & (y["s"] < x["e"])))


def meeting_signature(meetings: Column) -> Column:
    """'day:s:e;...' in order: sections with equal times have equal signatures."""
    return F.array_join(F.array_sort(F.transform(meetings, lambda m: F.concat_ws(":", m["day"], m["s"], m["e"]))), ";")


def meeting_groups(meetings: DataFrame, keys: list[str]) -> DataFrame:
    """One row per begin, end and place of a section or course, with its days as a list."""
    return meetings.groupBy(*keys, "s", "e", "building").agg(F.array_sort(F.collect_set("day")).alias("days"))


def week_window(meetings: DataFrame, key: str, least: int = 4) -> DataFrame:
    """(key, days, from_h, to_h): the days to show, and whole hours around all meetings, at least `least`, within 0..24."""
    g = meetings.groupBy(key).agg(F.array_sort(F.collect_set("day")).alias("days"), F.floor(F.min("s") / 60).alias("lo"), F.ceil(F.max("e") / 60).alias("hi"))
    return g.select(key, "days", F.least("lo", F.greatest(F.lit(0), F.col("hi") - least)).alias("from_h"), F.greatest("hi", F.least(F.lit(24), F.col("lo") + least)).alias("to_h"))


def late_minutes(legs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, minutes, days): how late, to the minute (half up), and on which days; legs have day and slack."""
    late = legs.where("slack < 0").groupBy(*keys, "day").agg(F.floor(F.sum(-F.col("slack")) + 0.5).cast("long").alias("minutes"))
    return late.where("minutes > 0").groupBy(*keys, "minutes").agg(F.array_sort(F.collect_set("day")).alias("days"))


def personal_timetables(rows: DataFrame, person: str, semester: str | None, course: str, current: str) -> DataFrame:
    """(person, semester, courses): trimmed, blank courses left out, a blank semester is the current one."""
    own = rows.select(F.trim(F.col(person).cast("string")).alias("person"), F.coalesce(F.nullif(F.trim(F.col(semester)), F.lit("")), F.lit(current)).alias("semester") if semester else F.lit(current).alias("semester"), F.trim(F.col(course).cast("string")).alias("course"))
    return own.where("course <> '' AND person <> ''").groupBy("person", "semester").agg(F.array_sort(F.collect_set("course")).alias("courses"))


def resolve_names(courses: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, id, problem): a course by its id, else by a name that only one course has, with or without its subtitle in
    brackets; problem is 'ambiguous' or 'unknown'."""
    by_name = courses.select(F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", r"\s*\([^()]*\)\s*$", "")))).alias("asked"), "id")
    found = asked.select("asked").distinct().join(by_name.groupBy("asked").agg(F.countDistinct("id").alias("n"), F.min("id").alias("named")), "asked", "left")
    found = found.join(courses.select(F.col("id").alias("exact")).distinct(), F.col("asked") == F.col("exact"), "left")
    one = F.coalesce("exact", F.when(F.col("n") == 1, F.col("named")))
    return found.select("asked", one.alias("id"), F.when(one.isNull(), F.when(F.col("n") > 1, "ambiguous").otherwise("unknown")).alias("problem"))


def unique_names(courses: DataFrame) -> DataFrame:
    """(name, id, ambiguous): a name stands for its course only where it is the one course of that name."""
    g = courses.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return g.select("name", F.when(F.col("n") == 1, F.col("id")).alias("id"), (F.col("n") > 1).alias("ambiguous"))


# Places


def in_campus(lat: Column, lon: Column, box: tuple[float, float, float, float] = CAMPUS_BOX) -> Column:
    south, north, west, east = box
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def place_within(lat: Column, lon: Column, other_lat: Column, other_lon: Column, box: tuple[float, float, float, float] = CAMPUS_BOX) -> Column:
    """The coordinates that lie in the box: the first, else the fallback; null where neither does."""
    pair = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    return F.when(in_campus(lat, lon, box), pair(lat, lon)).when(in_campus(other_lat, other_lon, box), pair(other_lat, other_lon))


def best_lookup(hits: DataFrame, key: str, preference: Column, name: str, tie: str) -> DataFrame:
    """Of each key's hits the most preferred kind, then the shortest name, then the least tie."""
    first = F.row_number().over(W.partitionBy(key).orderBy(preference, F.length(name), tie))
    return hits.withColumn("_place", first).where("_place = 1").drop("_place")


def merged_lists(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, fields, sources): of each field the value of the earliest list that has one; later lists fill holes."""
    filled = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return rows.groupBy(key).agg(*filled, F.count(F.lit(1)).alias("sources"))


def remaining_pairs(ids: DataFrame, done: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of ids that are not done yet, in this direction. ids are one campus's buildings."""
    todo = ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    return todo.join(done.select("a", "b"), ["a", "b"], "left_anti")


def between_hubs(pairs: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with both ends in hubs (hub)."""
    return pairs.join(hubs, F.col("a") == F.col("hub"), "left_semi").join(hubs, F.col("b") == F.col("hub"), "left_semi")


def return_trips(pairs: DataFrame) -> DataFrame:
    """(a, b, minutes, back, ratio, added) for pairs that are known both ways: added is what going costs over coming back."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("minutes").alias("back"))
    both = pairs.select("a", "b", "minutes").join(back, ["a", "b"])
    return both.withColumn("ratio", F.greatest("minutes", "back") / F.nullif(F.least("minutes", "back"), F.lit(0.0))).withColumn("added", F.col("minutes") - F.col("back"))


def dense_rows(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, row): each building's row of the square table as JSON, in the order of ids: null where a pair is unknown, at
    most two decimals. ids are one campus's buildings."""
    cells = ids.select(F.col("id").alias("a")).crossJoin(ids.select(F.col("id").alias("b"))).join(pairs.select("a", "b", "minutes"), ["a", "b"], "left")
    number = F.when(F.col("minutes").isNotNull(), F.regexp_replace(F.format_string("%.2f", "minutes"), r"\.?0+$", ""))
    cell = F.coalesce(F.when(F.col("a") == F.col("b"), F.lit("0")), number, F.lit("null"))
    rows = cells.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", cell.alias("v")))).alias("r"))
    return rows.select("a", F.concat(F.lit("["), F.array_join(F.col("r.v"), ","), F.lit("]")).alias("row"))


def building_set(meetings: DataFrame) -> DataFrame:
    """The known buildings of all meetings."""
    return meetings.where("building >= 0").select("building").distinct()


def lecture_load(sections: DataFrame) -> DataFrame:
    """(building, sections): a section counts once for each of its buildings."""
    return sections.select(F.explode(F.array_distinct("buildings")).alias("building")).groupBy("building").agg(F.count(F.lit(1)).alias("sections"))


def place_history(rows: DataFrame, key: Column) -> DataFrame:
    """(building, first, last, semesters, sections) of rows (building, semester); key orders the semesters."""
    return rows.groupBy("building").agg(F.min_by("semester", key).alias("first"), F.max_by("semester", key).alias("last"), F.countDistinct("semester").alias("semesters"), F.count(F.lit(1)).alias("sections"))
