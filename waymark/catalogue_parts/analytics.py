"""Catalogue statistics, cohorts, change capture, precedence joins, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.functions import geo
from waymark.functions import text as X
from waymark.operators import catalog as K
from waymark.operators import changes as D
from waymark.operators import reports as P
from waymark.operators import stats as A
from waymark.plans import campus as C

PLACES = ["301-118", "083-302", "#101-1-2", "220-1-201", "*201", "미정", "e-learning", "000-1", "E-10-1", " 43-1(무선랜제공)", "A-B", "", "1-22-3", "025"]
TIMES = [("월(09:30~10:45)/수(09:30~10:45)", "301-118/302-1"), ("화( 9:00 ~ 10:15 )", "083-302"), ("목(13:00~14:15)/금(13:00~14:15)/금(15:00~15:50)", "#101-1-2/220-1-201"), ("", "301-1"), ("토(10:00~11:50)", "nan")]


def _places(spark) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(PLACES)], "id int, place string")


def parse_building(spark, sf):
    return _places(spark).select("id", X.place_building(F.col("place")).alias("building"), X.place_campus(F.col("place")).alias("campus"))


def parse_meetings(spark, sf):
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(TIMES)], "id int, time string, rooms string")
    return rows.select("id", F.posexplode(X.parse_meetings(F.col("time"), F.col("rooms"))).alias("pos", "m")).select("id", "pos", "m.day", "m.s", "m.e", "m.room", "m.building", "m.campus")


def time_codec(spark, sf):
    ev = C.table(spark, sf, "events").select("event_id", (F.hour("ts") * 60 + F.minute("ts")).alias("t"))
    return ev.select("event_id", X.min_to_hm(F.col("t")).alias("hm"), X.hm_to_min(X.min_to_hm(F.col("t"))).alias("back"))


def natural_sort(spark, sf):
    names = F.concat((F.col("p_partkey") % 30).cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-"), (F.col("p_size") % 12).cast("string"))).when(F.col("p_partkey") % 5 == 0, F.lit("A")).otherwise(F.lit("")))
    parts = C.table(spark, sf, "part").select(names.alias("name")).distinct()
    return K.ranked(parts, [X.natural_key(F.col("name"))], "place").withColumn("place", F.col("place").cast("int"))


def section_numbers(spark, sf):
    n = F.col("p_size")
    raw = F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit(".0"))).when(n % 3 == 1, n.cast("string")).otherwise(F.concat(F.lit("L"), n.cast("string")))
    return C.table(spark, sf, "part").select("p_partkey", X.section_no(raw).alias("section_no"))


def count_label(spark, sf):
    o = C.table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("decimal(19,0)")  # the product passes a long's range once the keys pass a million
    n = k * k * (F.col("o_custkey") + 1)
    return o.select("o_orderkey", X.count_label(n).alias("label"))


def _catalogue(spark, sf) -> DataFrame:
    """Sections as rows of a catalogue: course, ord, buildings, timed, class."""
    mt = C.meetings(C.sections(spark, sf, 60))
    return mt.groupBy("course", "ord").agg(F.collect_set(F.when(F.col("building") >= 0, F.col("building"))).alias("buildings"), F.count_if(F.col("building") < 0).alias("unknown"))


def location_stats(spark, sf):
    return A.location_stats(_catalogue(spark, sf))


def building_spread(spark, sf):
    pairs = C.travel(spark, sf)
    return A.building_spread(_catalogue(spark, sf), pairs)


def spread_summary(spark, sf):
    spread = A.building_spread(_catalogue(spark, sf), C.travel(spark, sf)).withColumn("class", F.concat(F.lit("c"), F.col("course") % 4))
    return A.spread_summary(spread)


def spread_by_period(spark, sf):
    ev = C.table(spark, sf, "events").select(F.weekday("ts").alias("period"), (F.col("user_id") % 60).alias("course"), F.when(F.col("event_id") % 11 != 0, (F.col("event_id") * 7) % 25).cast("int").alias("building"))
    return P.spread_by_period(ev).withColumn("mean_buildings", F.round("mean_buildings", 6))


def building_history(spark, sf):
    o = C.table(spark, sf, "orders")
    label = F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.element_at(F.array(*map(F.lit, "1S2W")), F.quarter("o_orderdate").cast("int")))
    rows = o.select((F.col("o_custkey") % 200).alias("building"), label.alias("semester"))
    return K.place_history(rows, X.semester_key(F.col("semester")))


def _walks(spark, sf) -> DataFrame:
    """Bundles with the costs of many choices: a customer and the prices of its orders."""
    return C.table(spark, sf, "orders").select(F.col("o_custkey").alias("bundle"), F.col("o_orderkey").alias("choice"), F.col("o_totalprice").alias("cost"))


def choice_percentile(spark, sf):
    return A.midrank_percentile(_walks(spark, sf), "bundle", "choice", "cost")


def random_baseline(spark, sf):
    out = P.random_baseline(_walks(spark, sf), "bundle", "cost", F.col("cost") - 200000)
    return out.select("bundle", "n", F.round("mean", 8).alias("mean"), F.round("median", 4).alias("median"), "most", F.round("late_share", 6).alias("late_share"), F.round("mean_late", 8).alias("mean_late"))


def bundle_quantiles(spark, sf):
    return A.bundle_summary(_walks(spark, sf), "cost")


def ci95(spark, sf):
    return A.ci95(C.table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


def error_metrics(spark, sf):
    li = C.table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity") - 1000).alias("err"))
    return A.error_metrics(li, "l_returnflag", "err")


def cv_by_group(spark, sf):
    return A.variation(C.table(spark, sf, "orders"), "o_custkey", "o_totalprice")


def walker_calibration(spark, sf):
    ev = C.table(spark, sf, "events").where("value > 0")
    return A.calibration(ev, "user_id", "event_id", F.col("value"), F.lit(10.0))


def ci_cohorts(spark, sf):
    o, c, n = C.table(spark, sf, "orders"), C.table(spark, sf, "customer"), C.table(spark, sf, "nation")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    people = rows.select(F.col("n_regionkey").alias("college"), F.col("n_nationkey").alias("dept"), (F.month("o_orderdate") % 4 + 1).alias("year"), "o_orderstatus")
    return P.cohorts(people, ["college", "dept", "year"], F.col("o_orderstatus") == "F")


def return_trip_ratio(spark, sf):
    return K.return_trips(C.travel(spark, sf)).where("a < b").select("a", "b", "minutes", "back", F.round("ratio", 6).alias("ratio"))


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = C.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").cast("string").alias("instructor"), F.col("o_orderstatus").alias("status"))
    old = o.where("key % 13 <> 0")
    new = o.where("key % 11 <> 0").withColumn("instructor", F.when(F.col("key") % 7 == 0, F.concat("instructor", F.lit("x"))).otherwise(F.col("instructor"))).withColumn("name", F.when(F.col("key") % 21 == 0, F.lit("new")).otherwise(F.col("name"))).withColumn("status", F.lit("Z"))
    return old, new


def snapshot_diff(spark, sf):
    old, new = _snapshots(spark, sf)
    return D.snapshot_diff(old, new, "key", ["name", "instructor"]).select("key", "op", F.array_join("fields", ",").alias("fields"))


def changed_fields(spark, sf):
    old, new = _snapshots(spark, sf)
    return D.changed_fields(D.snapshot_diff(old, new, "key", ["name", "instructor"]))


def interval_policy(spark, sf):
    o = C.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("now"))
    return o.select("o_orderkey", D.poll_hours(F.col("now"), F.lit("1995-03-01").cast("timestamp"), F.lit("1996-02-01").cast("timestamp"), F.lit("1996-02-20").cast("timestamp")).alias("hours"))


def boost_window(spark, sf):
    o = C.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").cast("date").alias("starts"), F.date_add(F.col("o_orderdate").cast("date"), 5).alias("ends"))
    return D.boost_window(o, ["URGENT", "HIGH"])


def priority_coalesce(spark, sf):
    return D.priority_coalesce(_lists(spark, sf), "id", first=["name"], last=["lat"])


def _lists(spark, sf) -> DataFrame:
    c, s = C.table(spark, sf, "customer"), C.table(spark, sf, "supplier")
    one = c.select((F.col("c_custkey") % 400).alias("id"), F.lit(1).alias("prio"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal")).alias("lat")).where("id = pmod(id, 400)")
    one = one.groupBy("id", "prio").agg(F.min("name").alias("name"), F.max("lat").alias("lat"))
    two = s.select((F.col("s_suppkey") % 400).alias("id"), F.lit(2).alias("prio"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("lat"))
    two = two.groupBy("id", "prio").agg(F.min("name").alias("name"), F.max("lat").alias("lat"))
    return one.unionByName(two)


def point_precedence(spark, sf):
    return D.best_source(_lists(spark, sf), "id", "prio")


def source_precedence(spark, sf):
    t = C.travel(spark, sf).withColumn("source", F.when((F.col("a") + F.col("b")) % 4 == 0, "measured").when((F.col("a") + F.col("b")) % 4 == 1, "route").otherwise("tmap"))
    fresh = C.travel(spark, sf).where("a % 2 = 0").select("a", "b", (F.col("minutes") + 1).alias("minutes"))
    return D.merge_sources(t, fresh, ["a", "b"], replace=["route", "estimate"], source="route")


def anti_done_pairs(spark, sf):
    return K.remaining_pairs(C.buildings(spark, sf).select(F.col("building").alias("id")), C.travel(spark, sf))


def semi_hubs(spark, sf):
    t = C.travel(spark, sf)
    return K.between_hubs(t, t.groupBy("a").agg(F.sum("minutes").alias("m")).where("m < 190").select(F.col("a").alias("hub")))


def topn_report(spark, sf):
    return P.extremes(K.return_trips(C.travel(spark, sf)), F.col("added"), 10, "a", "b").select("a", "b", "gap")


def recent_distinct(spark, sf):
    ev = C.table(spark, sf, "events").select(F.lower("event_type").alias("key"), F.col("user_id") % 40, "event_id", F.col("user_id").alias("u"))
    return A.recent_distinct(ev.select(F.concat_ws("-", "key", (F.col("u") % 40).cast("string")).alias("key"), "event_id"), "key", "event_id", 10)


def set_union(spark, sf):
    return C.table(spark, sf, "customer").select(F.col("c_nationkey").alias("id")).union(C.table(spark, sf, "supplier").select("s_nationkey")).distinct()


def set_intersect(spark, sf):
    return C.table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")).intersect(C.table(spark, sf, "lineitem").where("l_discount > 0.08").select("l_partkey"))


def set_except(spark, sf):
    return C.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).subtract(C.table(spark, sf, "orders").select("o_custkey"))


def json_props(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return C.table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.sum("k").alias("total"))


def keyword_find(spark, sf):
    p = C.table(spark, sf, "part").where(K.contains_keyword("RING", F.col("p_name")) | K.contains_keyword("#1", F.col("p_brand")))
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("name"))


def lecture_load(spark, sf):
    return K.lecture_load(_catalogue(spark, sf))


def meeting_groups(spark, sf):
    return K.meeting_groups(C.meetings(C.sections(spark, sf, 60)), ["course"]).withColumn("days", F.array_join("days", ","))


def eligibility_years(spark, sf):
    """Year codes from texts: the digit at the start."""
    text = F.concat(F.lit(" "), (F.col("p_size") % 7).cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit("학년")).otherwise(F.lit("-")))
    return C.table(spark, sf, "part").select("p_partkey", X.year_of(text).alias("year"))


def stress_courses(spark, sf):
    return P.largest(_catalogue(spark, sf), "course", 8)


def spread_report(spark, sf):
    """Courses in the order of a report: most buildings, then the farthest pair, then the course."""
    spread = A.building_spread(_catalogue(spark, sf), C.travel(spark, sf))
    return P.spread_order(spread).select("course", F.col("place").cast("long").alias("place"))


def matrix_difference(spark, sf):
    """How the travel table differs from the way back's."""
    t = K.return_trips(C.travel(spark, sf))
    return P.difference_report(t, F.col("minutes"), F.col("back")).select("n", *[F.round(c, 6).alias(c) for c in ("median", "median_abs", "p90_abs", "least", "most")], "over0", "above0", "below0", "over1", "above1", "below1")


def checkpoint_errors(spark, sf):
    li = C.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("z"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity") + F.col("l_tax") * 10 - 0.3).alias("measured"))
    return P.checkpoint_errors(li).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "mae", "p95", "most")])


def text_pairs(spark, sf):
    """Pairs of places as they are typed."""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("R"), k, F.lit(":GATE-"), k % 90)).when(k % 4 == 1, F.concat(k % 70, F.lit("-1>"), k % 90)).when(k % 4 == 2, F.concat(k % 70, F.lit("-1-"), k % 90)).otherwise(F.concat(F.lit("GATE-"), k % 90))
    return C.table(spark, sf, "part").select("p_partkey", X.parse_pair(text).alias("p")).select("p_partkey", "p.name", "p.a", "p.b")


def rough_counts(spark, sf):
    return C.table(spark, sf, "orders").select("o_orderkey", X.rough_count(F.col("o_orderkey") * F.col("o_custkey")).alias("rough"))


def cleaned_cells(spark, sf):
    """Titles, credits and search names from raw cells."""
    k = F.col("p_partkey")
    sub = F.when(k % 3 == 0, F.lit(" nan ")).when(k % 3 == 1, F.concat(F.lit("part "), F.col("p_size")))
    credit = F.when(k % 4 == 0, F.lit("3")).when(k % 4 == 1, F.lit("1.5 ")).when(k % 4 == 2, F.lit("two"))
    name = F.concat("p_name", F.lit(": theory (2)"))
    return C.table(spark, sf, "part").select("p_partkey", X.titled(F.col("p_name"), sub).alias("title"), X.credits(credit).alias("credits"), X.name_before_colon(name).alias("searched"))


def built_ids(spark, sf):
    return C.table(spark, sf, "part").select("p_partkey", X.content_id(F.array(F.col("p_name").cast("binary"), F.col("p_brand").cast("binary"))).alias("id"))


def slope_model(spark, sf):
    e = F.col("event_id")
    return C.table(spark, sf, "events").select("event_id", F.round(geo.unit_time(e % 90 + 10.0, (e % 81 - 40) / 50, 2.5, e % 7 == 0), 6).alias("seconds"))


NAMES = """parse_building parse_meetings time_codec natural_sort section_numbers count_label location_stats building_spread spread_summary spread_by_period building_history choice_percentile random_baseline
bundle_quantiles ci95 error_metrics cv_by_group walker_calibration ci_cohorts return_trip_ratio snapshot_diff changed_fields interval_policy boost_window priority_coalesce point_precedence source_precedence
anti_done_pairs semi_hubs topn_report recent_distinct set_union set_intersect set_except json_props keyword_find lecture_load meeting_groups eligibility_years stress_courses
spread_report matrix_difference checkpoint_errors text_pairs rough_counts cleaned_cells built_ids slope_model""".split()
QUERIES = {n: globals()[n] for n in NAMES}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_PLACE = """replace(regexp_replace(trim(place), '^[#*]', ''), '(무선랜제공)', '')"""
_NOWHERE = " OR ".join(f"contains(p, '{w}')" for w in X.NO_LOCATION)


def _building(p: str) -> str:
    parts = f"list_filter(string_split({p}, '-'), lambda x: x <> '' AND NOT regexp_full_match(x, '[A-Za-z]+'))"
    joined = f"CASE WHEN len({parts}) = 3 AND length({parts}[2]) = 1 THEN {parts}[1] || '-' || {parts}[2] ELSE {parts}[1] END"
    nowhere = " OR ".join([f"{p} = ''", *(f"contains({p}, '{w}')" for w in X.NO_LOCATION)])
    return f"CASE WHEN {nowhere} OR len({parts}) = 0 THEN '' WHEN ltrim({joined}, '0') = '' THEN '0' ELSE ltrim({joined}, '0') END"


_CAT = f"""{C.sql_sections(60)}, cat AS (SELECT course, ord, list_distinct(list(building) FILTER (building >= 0)) AS bs, count(*) FILTER (building < 0) AS unknown FROM mt GROUP BY course, ord)"""
_SPREAD = """sp AS (SELECT course, count(*) AS n_sections, count(*) FILTER (unknown = 0) AS located FROM cat GROUP BY course HAVING count(*) >= 2),
        cb AS (SELECT DISTINCT course, unnest(bs) AS building FROM cat), nb AS (SELECT course, count(*) AS buildings, string_agg(building::VARCHAR, ',' ORDER BY building) AS list FROM cb GROUP BY course),
        far AS (SELECT x.course, max((t.minutes + r.minutes) / 2) AS most FROM cb x JOIN cb y ON x.course = y.course AND x.building < y.building JOIN travel t ON t.a = x.building AND t.b = y.building JOIN travel r ON r.a = y.building AND r.b = x.building GROUP BY 1),
        spread AS (SELECT course, n_sections, located, coalesce(buildings, 0) AS n_buildings, coalesce(list, '') AS buildings, most AS max_minutes FROM sp LEFT JOIN nb USING (course) LEFT JOIN far USING (course))"""
_SNAP = """o AS (SELECT o_orderkey AS key, o_orderpriority AS name, o_custkey::VARCHAR AS instructor FROM orders), old AS (SELECT * FROM o WHERE key % 13 <> 0),
        new AS (SELECT key, CASE WHEN key % 21 = 0 THEN 'new' ELSE name END AS name, CASE WHEN key % 7 = 0 THEN instructor || 'x' ELSE instructor END AS instructor FROM o WHERE key % 11 <> 0)"""
_LISTS = """l AS (SELECT c_custkey % 400 AS id, 1 AS prio, min(CASE WHEN c_custkey % 3 <> 0 THEN c_name END) AS name, max(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END) AS lat FROM customer GROUP BY 1
        UNION ALL SELECT s_suppkey % 400, 2, min(s_name), max(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END) FROM supplier GROUP BY 1)"""
_UNITS = [(10**16, "경"), (10**12, "조"), (10**8, "억"), (10**4, "만")]
_LABEL = "CASE " + " ".join(f"WHEN n >= {u} THEN CASE WHEN n // {u // 10} < 1000 AND n // {u // 10} % 10 <> 0 THEN (n // {u})::VARCHAR || '.' || (n // {u // 10} % 10)::VARCHAR ELSE (n // {u})::VARCHAR END || '{w}'" for u, w in _UNITS) + " ELSE n::VARCHAR END"

ORACLE_SQL = {
    "parse_building": f"""WITH v(id, place) AS (VALUES {_values(enumerate(PLACES))}), q AS (SELECT id, place, trim({_PLACE}) AS p FROM v)
        SELECT id, {_building("p")} AS building, (CASE WHEN starts_with(trim(place), '#') THEN 2 WHEN starts_with(trim(place), '*') THEN 3 ELSE 1 END)::INTEGER AS campus FROM q""",
    "parse_meetings": f"""WITH v(id, time, rooms) AS (VALUES {_values((i, *t) for i, t in enumerate(TIMES))}),
        g AS (SELECT *, regexp_extract_all(time, '[월화수목금토일]\\s*\\([^)]*\\)') AS ms, CASE WHEN lower(trim(rooms)) IN ('', 'nan', 'none') THEN [] ELSE string_split(rooms, '/') END AS rs FROM v),
        x AS (SELECT id, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS pos, len(ms) AS n, rs FROM g),
        y AS (SELECT id, pos, m, trim(coalesce(CASE WHEN len(rs) = n THEN rs[pos + 1] ELSE rs[1] END, '')) AS room FROM x),
        z AS (SELECT *, trim({_PLACE.replace("(place)", "(room)")}) AS p, regexp_extract_all(m, '\\d+') AS d FROM y)
        SELECT id, pos::INTEGER AS pos, (instr('월화수목금토일', m[1]) - 1)::INTEGER AS day, (d[1]::INTEGER * 60 + d[2]::INTEGER)::INTEGER AS s, (d[3]::INTEGER * 60 + d[4]::INTEGER)::INTEGER AS e, room, {_building("p")} AS building,
               (CASE WHEN starts_with(room, '#') THEN 2 WHEN starts_with(room, '*') THEN 3 ELSE 1 END)::INTEGER AS campus FROM z""",
    "time_codec": "SELECT event_id, strftime(ts, '%H:%M') AS hm, (hour(ts) * 60 + minute(ts))::INTEGER AS back FROM events",
    "natural_sort": """WITH n AS (SELECT DISTINCT (p_partkey % 30)::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN '-' || (p_size % 12)::VARCHAR WHEN p_partkey % 5 = 0 THEN 'A' ELSE '' END AS name FROM part)
        SELECT name, row_number() OVER (ORDER BY regexp_extract(name, '^\\d+')::INTEGER, coalesce(TRY_CAST(regexp_extract(name, '^\\d+-(\\d+)', 1) AS INTEGER), 0), name)::INTEGER AS place FROM n""",
    "section_numbers": "SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN 'L' || p_size ELSE lpad(p_size::VARCHAR, greatest(3, length(p_size::VARCHAR))::INTEGER, '0') END AS section_no FROM part",
    "count_label": f"SELECT o_orderkey, {_LABEL} AS label FROM (SELECT o_orderkey, o_orderkey * o_orderkey * (o_custkey + 1) AS n FROM orders)",
    "location_stats": f"""WITH {_CAT}, c AS (SELECT course, count(*) AS n, len(list_distinct(flatten(list(bs)))) AS nb FROM cat GROUP BY course)
        SELECT (SELECT count(*) FROM cat) AS sections, (SELECT count(*) FROM cat WHERE unknown = 0) AS located, (SELECT round(count(*) FILTER (unknown = 0) / count(*), 3) FROM cat) AS ratio, count(*) AS courses, count(*) FILTER (n >= 2) AS multi_section,
               count(*) FILTER (n >= 2 AND nb >= 2) AS multi_building, round(count(*) FILTER (n >= 2 AND nb >= 2) / nullif(count(*) FILTER (n >= 2), 0), 3) AS multi_ratio, (SELECT count(DISTINCT building) FROM mt WHERE building >= 0) AS buildings FROM c""",
    "building_spread": f"WITH {_CAT}, {_SPREAD} SELECT course, n_sections, located, n_buildings, buildings, max_minutes FROM spread",
    "spread_summary": f"""WITH {_CAT}, {_SPREAD}, k AS (SELECT *, 'c' || (course % 4) AS class FROM spread WHERE located > 0)
        SELECT coalesce(class, 'all') AS class, count(*) AS courses, count(*) FILTER (n_buildings >= 2) AS spread, round(count(*) FILTER (n_buildings >= 2) / count(*), 6) AS ratio, round(sum(CASE WHEN n_buildings >= 2 THEN n_sections END) / sum(n_sections), 6) AS weighted_ratio, quantile_cont(n_buildings, 0.5)::DOUBLE AS median_buildings
        FROM k GROUP BY GROUPING SETS ((), (class))""",
    "spread_by_period": """WITH e AS (SELECT (isodow(ts) - 1)::INTEGER AS period, user_id % 60 AS course, count(*) AS n, count(DISTINCT CASE WHEN event_id % 11 <> 0 THEN event_id * 7 % 25 END) AS nb FROM events GROUP BY 1, 2)
        SELECT period, count(*) AS courses, count(*) FILTER (nb >= 2) AS spread, round(avg(nb), 6) AS mean_buildings FROM e WHERE n >= 2 GROUP BY period""",
    "building_history": """WITH r AS (SELECT o_custkey % 200 AS building, year(o_orderdate)::VARCHAR || '-' || '1S2W'[quarter(o_orderdate)] AS semester, year(o_orderdate) * 10 + quarter(o_orderdate) AS k FROM orders)
        SELECT building, arg_min(semester, k) AS first, arg_max(semester, k) AS last, count(DISTINCT semester) AS semesters, count(*) AS sections FROM r GROUP BY building""",
    "choice_percentile": """SELECT a.o_custkey AS bundle, a.o_orderkey AS choice, round(sum(CASE WHEN b.o_totalprice < a.o_totalprice THEN 1 WHEN b.o_totalprice = a.o_totalprice THEN 0.5 ELSE 0 END) / count(*), 6)::DOUBLE AS percentile
        FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey GROUP BY 1, 2""",
    "random_baseline": "SELECT o_custkey AS bundle, count(*) AS n, round(avg(o_totalprice), 8) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, max(o_totalprice) AS most, round(avg(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END), 6) AS late_share, round(avg(greatest(0, o_totalprice - 200000)), 8) AS mean_late FROM orders GROUP BY 1",
    "bundle_quantiles": """SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS q90,
        (SELECT round(avg(o_totalprice), 4) FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT (SELECT greatest(1, count(*) // 10) FROM orders))) AS top_decile FROM orders""",
    "ci95": """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(avg(l_quantity) - 1.96::DOUBLE * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS low, round(avg(l_quantity) + 1.96::DOUBLE * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS high FROM lineitem GROUP BY 1""",
    "error_metrics": """SELECT l_returnflag, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, round(sqrt(avg(e * e)), 6) AS rmse FROM (SELECT l_returnflag, l_extendedprice / l_quantity - 1000 AS e FROM lineitem) GROUP BY 1""",
    "cv_by_group": "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) > 1 THEN round(stddev_samp(o_totalprice) / avg(o_totalprice), 6) END AS cv FROM orders GROUP BY 1",
    "walker_calibration": """WITH m AS (SELECT user_id, quantile_cont(value / 10, 0.5) AS factor FROM events WHERE value > 0 GROUP BY 1)
        SELECT event_id, e.user_id, round(factor, 6) AS factor, round(value / factor, 6) AS calibrated FROM events e JOIN m USING (user_id) WHERE value > 0""",
    "ci_cohorts": """SELECT n_regionkey AS college, n_nationkey AS dept, (month(o_orderdate) % 4 + 1)::INTEGER AS year, count(*) AS members, count(*) FILTER (o_orderstatus = 'F') AS weight
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    "return_trip_ratio": f"WITH {C.SQL_TRAVEL} SELECT t.a, t.b, t.minutes, r.minutes AS back, round(greatest(t.minutes, r.minutes) / least(t.minutes, r.minutes), 6) AS ratio FROM travel t JOIN travel r ON t.a = r.b AND t.b = r.a WHERE t.a < t.b",
    "snapshot_diff": f"""WITH {_SNAP} SELECT key, 'created' AS op, '' AS fields FROM new WHERE key NOT IN (SELECT key FROM old) UNION ALL SELECT key, 'deleted', '' FROM old WHERE key NOT IN (SELECT key FROM new)
        UNION ALL SELECT key, 'updated', concat_ws(',', CASE WHEN o.name <> n.name THEN 'name' END, CASE WHEN o.instructor <> n.instructor THEN 'instructor' END) FROM old o JOIN new n USING (key) WHERE o.name <> n.name OR o.instructor <> n.instructor""",
    "changed_fields": f"""WITH {_SNAP} SELECT key, 'name' AS field, o.name AS before, n.name AS after FROM old o JOIN new n USING (key) WHERE o.name <> n.name UNION ALL SELECT key, 'instructor', o.instructor, n.instructor FROM old o JOIN new n USING (key) WHERE o.instructor <> n.instructor""",
    "interval_policy": "SELECT o_orderkey, (CASE WHEN o_orderdate - TIMESTAMP '1995-03-01' < INTERVAL 30 DAY THEN 6 WHEN o_orderdate BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1996-02-20' THEN 6 ELSE 12 END)::INTEGER AS hours FROM orders",
    "boost_window": "SELECT min(o_orderdate)::DATE - 3 AS opens, max(o_orderdate)::DATE + 8 AS closes FROM orders WHERE contains(o_orderpriority, 'URGENT') OR contains(o_orderpriority, 'HIGH')",
    "priority_coalesce": f"WITH {_LISTS} SELECT id, arg_min(name, prio) FILTER (name IS NOT NULL) AS name, arg_max(lat, prio) FILTER (lat IS NOT NULL) AS lat FROM l GROUP BY id",
    "point_precedence": f"WITH {_LISTS} SELECT id, prio, name, lat FROM l QUALIFY dense_rank() OVER (PARTITION BY id ORDER BY prio) = 1",
    "source_precedence": f"""WITH {C.SQL_TRAVEL}, t AS (SELECT *, CASE (a + b) % 4 WHEN 0 THEN 'measured' WHEN 1 THEN 'route' ELSE 'tmap' END AS source FROM travel), f AS (SELECT a, b, minutes + 1 AS minutes FROM travel WHERE a % 2 = 0)
        SELECT a, b, minutes, source FROM t WHERE source NOT IN ('route', 'estimate') UNION ALL SELECT f.a, f.b, f.minutes, 'route' FROM f LEFT JOIN t ON t.a = f.a AND t.b = f.b WHERE t.source IS NULL OR t.source IN ('route', 'estimate')""",
    "anti_done_pairs": f"WITH {C.SQL_TRAVEL} SELECT x.building AS a, y.building AS b FROM bld x JOIN bld y ON x.building < y.building WHERE (x.building + y.building) % 9 = 0",
    "semi_hubs": f"WITH {C.SQL_TRAVEL}, h AS (SELECT a FROM travel GROUP BY a HAVING sum(minutes) < 190) SELECT a, b, minutes FROM travel WHERE a IN (SELECT a FROM h) AND b IN (SELECT a FROM h)",
    "topn_report": f"WITH {C.SQL_TRAVEL} SELECT t.a, t.b, t.minutes - r.minutes AS gap FROM travel t JOIN travel r ON t.a = r.b AND t.b = r.a ORDER BY gap DESC, t.a, t.b LIMIT 10",
    "recent_distinct": """SELECT lower(event_type) || '-' || (user_id % 40) AS key, max(event_id) AS "at" FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 10""",
    "set_union": "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08",
    "set_except": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "json_props": "SELECT event_type, count(k) AS n, min(k) AS low, max(k) AS high, sum(k)::BIGINT AS total FROM (SELECT event_type, regexp_extract(props, '\"k\":\\s*(\\d+)', 1)::INTEGER AS k FROM events) GROUP BY 1",
    "keyword_find": "SELECT p_brand, count(*) AS n, min(p_name) AS name FROM part WHERE p_name ILIKE '%ring%' OR p_brand LIKE '%#1%' GROUP BY 1",
    "lecture_load": f"WITH {_CAT} SELECT building, count(DISTINCT ord) AS sections FROM mt WHERE building >= 0 GROUP BY building",
    "meeting_groups": f"WITH {C.sql_sections(60)} SELECT course, s, e, building, string_agg(DISTINCT day::VARCHAR, ',' ORDER BY day::VARCHAR) AS days FROM mt GROUP BY 1, 2, 3, 4",
    "eligibility_years": "SELECT p_partkey, (p_size % 7)::INTEGER AS year FROM part",
    "stress_courses": f"WITH {_CAT} SELECT course, count(*) AS enrolled FROM cat GROUP BY course ORDER BY enrolled DESC, course LIMIT 8",
    "spread_report": f"WITH {_CAT}, {_SPREAD} SELECT course, row_number() OVER (ORDER BY n_buildings DESC, coalesce(max_minutes, -1) DESC, course) AS place FROM spread",
    "matrix_difference": f"""WITH {C.SQL_TRAVEL}, d AS (SELECT t.minutes - r.minutes AS d FROM travel t JOIN travel r ON t.a = r.b AND t.b = r.a)
        SELECT count(*) AS n, round(median(d), 6) AS median, round(median(abs(d)), 6) AS median_abs, round(quantile_cont(abs(d), 0.9), 6) AS p90_abs, round(min(d), 6) AS least, round(max(d), 6) AS most,
               count(*) FILTER (abs(d) > 1) AS over0, count(*) FILTER (d > 1) AS above0, count(*) FILTER (d < -1) AS below0, count(*) FILTER (abs(d) > 2) AS over1, count(*) FILTER (d > 2) AS above1, count(*) FILTER (d < -2) AS below1 FROM d""",
    "checkpoint_errors": "WITH e AS (SELECT l_quantity - (l_quantity + l_tax * 10 - 0.3::DOUBLE) AS e FROM lineitem WHERE l_linenumber <> 3) SELECT count(*) AS n, round(avg(e), 6) AS mean, round(avg(abs(e)), 6) AS mae, round(quantile_cont(abs(e), 0.95), 6) AS p95, round(max(abs(e)), 6) AS most FROM e",
    "text_pairs": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'R' || p_partkey WHEN 1 THEN (p_partkey % 70) || '-1→' || (p_partkey % 90) WHEN 3 THEN 'GATE→' || (p_partkey % 90) END AS name,
        CASE p_partkey % 4 WHEN 1 THEN (p_partkey % 70) || '-1' WHEN 2 THEN NULL ELSE 'GATE' END AS a, CASE WHEN p_partkey % 4 <> 2 THEN (p_partkey % 90)::VARCHAR END AS b FROM part""",
    "rough_counts": "SELECT o_orderkey, (left((o_orderkey * o_custkey)::VARCHAR, 1) || repeat('0', length((o_orderkey * o_custkey)::VARCHAR) - 1))::BIGINT AS rough FROM orders",
    "cleaned_cells": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_name || ' (part ' || p_size || ')' ELSE p_name END AS title, (CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1.5 ELSE 0 END)::DOUBLE AS credits, p_name AS searched FROM part""",
    "built_ids": "SELECT p_partkey, left(sha256(sha256(p_name) || sha256(p_brand)), 10) AS id FROM part",
    "slope_model": """SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN m * (1 + 2.2 * greatest(g, 0) + 1.6 * greatest(-g, 0)) ELSE m / (exp(-2.5 * abs(g + 0.05)) / exp(-2.5 * 0.05)) END, 6)::DOUBLE AS seconds
        FROM (SELECT event_id, ((event_id % 81 - 40) / 50)::DOUBLE AS g, (event_id % 90 + 10)::DOUBLE AS m FROM events)""",
}
