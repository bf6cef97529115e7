"""Schedules: conflicts, combinations, evaluation, rules, counting, matrices, bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import catalog as K
from waymark.operators import experiments as X
from waymark.operators import requests as Q
from waymark.operators import schedule as S
from waymark.operators import travel as T
from waymark.plans import campus as C
from waymark.plans.campus import Rules, Weights

COURSES, PER, HOME = 4, 24, 0


def _request(spark: SparkSession, sf: str, usable: bool = True):
    """Sections and meetings of all requests: 24 events each, in four courses."""
    sec = C.sections(spark, sf, COURSES, PER)
    if usable:
        sec = sec.where("building >= 0")
    return sec, C.meetings(sec)


def _choices(spark, sf, usable=True):
    return Q.choices(*_request(spark, sf, usable))


def _combos(spark, sf, usable=True):
    sec, mt = _request(spark, sf, usable)
    return S.feasible_combos(sec, S.conflict_pairs(mt)), mt


def _grid(spark, sf):
    return T.pair_grid(C.travel(spark, sf), C.buildings(spark, sf))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("combo", F.array_join("combo", ","))


def conflict_pairs(spark, sf):
    return S.conflict_pairs(_request(spark, sf, usable=False)[1])


def conflict_count(spark, sf):
    """Per request; those without a conflict don't appear."""
    return conflict_pairs(spark, sf).groupBy("request").agg(F.count(F.lit(1)).alias("n"))


def mrv_order(spark, sf):
    return S.mrv_order(_request(spark, sf, usable=False)[0])


def feasible_combos(spark, sf):
    return _named(_combos(spark, sf)[0])


def _priced(df: DataFrame) -> DataFrame:
    return _named(df).select("request", "rank", "combo", F.round("travel", 4).alias("travel"), F.round("late", 4).alias("late"), "days", F.round("cost", 4).alias("cost"))


def _best(spark, sf, usable, k, **more):
    found = Q.best_schedules(_choices(spark, sf, usable), _grid(spark, sf), HOME, k, **more)
    return found.select("request", F.explode("best").alias("b")).select("request", "b.*")


def topk_schedules(spark, sf):
    """The 20 cheapest schedules of every request, by branch and bound."""
    return _priced(_best(spark, sf, True, 20))


def topk_unknown_rooms(spark, sf):
    return _priced(_best(spark, sf, False, 20))


def topk_all_weights(spark, sf):
    """With a price on days and idle time, where nothing can be cut."""
    return _priced(_best(spark, sf, True, 3, weights=Weights(1.0, 2.0, 10.0, 0.1)))


def topk_with_rules(spark, sf):
    """Friday free and an hour for lunch, kept while schedules grow."""
    return _priced(_best(spark, sf, True, 5, rules=RULES))


def topk_by_joins(spark, sf):
    """The same as topk_schedules by making and evaluating all combinations."""
    combos, mt = _combos(spark, sf)
    return _priced(S.top_k(S.evaluate(combos, mt, _grid(spark, sf), HOME), 5))


def paging(spark, sf):
    """The second page of six."""
    return _priced(_best(spark, sf, True, 12).where("rank > 6"))


def search_numbers(spark, sf):
    """What the search went through: it never sees more leaves than there are feasible combinations."""
    found = Q.best_schedules(_choices(spark, sf), _grid(spark, sf), HOME, 5)
    return found.select("request", F.size("best").cast("long").alias("found"), (F.col("leaves") >= F.size("best")).alias("enough"), (F.col("nodes") > F.col("leaves")).alias("deeper"))


def daily_legs(spark, sf):
    combos, mt = _combos(spark, sf)
    out = S.legs(combos, mt, _grid(spark, sf), HOME)
    return _named(out).select("combo", "day", "leg", F.col("from_b").cast("int").alias("from_b"), F.col("to_b").cast("int").alias("to_b"), F.round("minutes", 4).alias("minutes"), F.round("slack", 4).alias("slack"))


def combo_count_product(spark, sf):
    counts = S.mrv_order(_request(spark, sf, usable=False)[0]).groupBy("request").agg(F.array_sort(F.collect_list(F.col("n_sections").cast("decimal(38,0)"))).alias("ns"))
    return counts.select("request", F.expr("aggregate(ns, cast(1 as decimal(38,0)), (a, x) -> cast(a * x as decimal(38,0)))").cast("long").alias("n"))


def count_feasible_dp(spark, sf):
    return Q.count_schedules(_choices(spark, sf, usable=False)).select("request", F.col("n").cast("long").alias("n"))


RULES = Rules(free_days=(4,), lunch=(690, 810, 60))


def count_with_rules(spark, sf):
    return Q.count_schedules(_choices(spark, sf), RULES, limit=50).select("request", F.col("n").cast("long").alias("n"), "more")


def why_none(spark, sf):
    """Three free days and a long lunch: what stands in the way of each request."""
    out = Q.explain(_choices(spark, sf), Rules(free_days=(0, 4), lunch=(600, 840, 180)))
    return out.select("request", "feasible", "cause", (F.size("courses") == 0).alias("no_blame"))


def free_day_filter(spark, sf):
    combos, mt = _combos(spark, sf)
    return _named(S.admitted(combos, mt, Rules(free_days=(0, 4))))


def lunch_gap_days(spark, sf):
    """By request, course and day: whether all the sections together leave an hour between 11:30 and 13:30."""
    days = _request(spark, sf, usable=False)[1].groupBy("request", "course", "day").agg(F.collect_list(F.struct("s", "e")).alias("busy"))
    return days.select("request", "course", "day", S.lunch_gap(F.col("busy"), (690, 810, 60)).alias("free"))


def stress_counts(spark, sf):
    """Requests of 4 to 8 courses with five sections each: how many combinations there are in all."""
    sizes = spark.range(4, 9).select(F.col("id").alias("k"))
    every = C.sections(spark, sf, 8, per=40)
    sec = every.crossJoin(F.broadcast(sizes)).where("course < k").withColumn("request", F.col("request") * 10 + F.col("k"))
    return Q.count_schedules(Q.choices(sec, C.meetings(every))).select("request", F.col("n").cast("long").alias("n"))


def twin_groups(spark, sf):
    out = S.twin_groups(C.meetings(C.sections(spark, sf, 50)))
    return out.select("course", "first", F.array_join("twins", ",").alias("twins"))


def travel_lookup(spark, sf):
    return _grid(spark, sf).select("a", "b", F.round("minutes", 6).alias("minutes"), "source")


def travel_misses(spark, sf):
    return _grid(spark, sf).where("source IN ('estimate', 'default')").select("a", "b", "source")


def closure(spark, sf):
    return T.closure(_grid(spark, sf), list(range(25))).select("a", "b", F.round("minutes", 6).alias("minutes"))


def triangle_violations(spark, sf):
    return T.triangle_violations(_grid(spark, sf)).select("a", "b", "c", F.round("excess", 6).alias("excess"))


def tsp_lower_bound(spark, sf):
    return Q.tour_bounds(_choices(spark, sf), _grid(spark, sf), HOME).select("request", F.round("bound", 6).alias("bound"))


def tree_lower_bound(spark, sf):
    """The looser bound of a spanning tree, with rooms that are unknown: at distance 0."""
    return Q.tour_bounds(_choices(spark, sf, usable=False), _grid(spark, sf), HOME, exact=0).select("request", F.round("bound", 6).alias("bound"))


def flat_vs_slope_loss(spark, sf):
    """Choose on the table, price on the closure: what each request's choice loses against the closure's own best."""
    combos, mt = _combos(spark, sf)
    grid = _grid(spark, sf)
    out = X.choice_loss(combos, mt, grid, T.closure(grid, list(range(25))), HOME)
    return out.select("request", "priced", "best", "loss", (F.col("loss") < 50000).alias("optimal"))


def haversine_estimate(spark, sf):
    x = C.buildings(spark, sf)
    y = x.select(F.col("building").alias("b2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    m = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    pairs = x.crossJoin(y).where("building < b2")
    return pairs.select(F.col("building").alias("a"), F.col("b2").alias("b"), F.round(m, 4).alias("metres"), F.round(geo.walk_minutes(m), 6).alias("minutes"))


def dense_matrix(spark, sf):
    return K.dense_rows(C.buildings(spark, sf).select(F.col("building").alias("id")), C.travel(spark, sf))


NAMES = """conflict_pairs conflict_count mrv_order feasible_combos topk_schedules topk_unknown_rooms topk_all_weights topk_with_rules topk_by_joins paging search_numbers daily_legs combo_count_product count_feasible_dp count_with_rules
why_none free_day_filter lunch_gap_days stress_counts twin_groups travel_lookup travel_misses closure triangle_violations tsp_lower_bound tree_lower_bound flat_vs_slope_loss haversine_estimate dense_matrix""".split()
QUERIES = {n: globals()[n] for n in NAMES}

_CONF = "conf AS (SELECT DISTINCT x.request, x.ord AS a, y.ord AS b FROM mt x JOIN mt y ON x.request = y.request AND x.day = y.day AND x.s < y.e AND y.s < x.e AND x.course <> y.course AND x.ord < y.ord)"
#: Lists of sections in the order of courses by number of sections, grown course by course.
SQL_COMBOS = f"""{_CONF}, mrv AS (SELECT request, course, row_number() OVER (PARTITION BY request ORDER BY count(*), course) AS pos, count(*) OVER (PARTITION BY request) AS courses FROM sec GROUP BY request, course),
        bad AS (SELECT request, ord, list(other) AS bad FROM (SELECT request, a AS ord, b AS other FROM conf UNION ALL SELECT request, b, a FROM conf) GROUP BY request, ord),
        o AS (SELECT sec.request, sec.ord, pos, courses, coalesce(bad, []) AS bad FROM sec JOIN mrv ON mrv.request = sec.request AND mrv.course = sec.course LEFT JOIN bad ON bad.request = sec.request AND bad.ord = sec.ord),
        grown(request, pos, courses, combo) AS (SELECT request, pos, courses, [ord] FROM o WHERE pos = 1 UNION ALL
          SELECT g.request, o.pos, g.courses, list_append(g.combo, o.ord) FROM grown g JOIN o ON o.request = g.request AND o.pos = g.pos + 1 WHERE NOT list_has_any(g.combo, o.bad)),
        combo AS (SELECT request, combo FROM grown WHERE pos = courses)"""
_GRID = """grid AS (SELECT x.building AS a, y.building AS b, CASE WHEN x.building = y.building THEN 0.0 ELSE coalesce(t.minutes, r.minutes,
            2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))) * 1.35::DOUBLE / (4000.0::DOUBLE / 60)) END::DOUBLE AS minutes,
            CASE WHEN x.building = y.building THEN 'same' WHEN t.minutes IS NOT NULL THEN 'table' WHEN r.minutes IS NOT NULL THEN 'reverse' ELSE 'estimate' END AS source
          FROM bld x CROSS JOIN bld y LEFT JOIN travel t ON t.a = x.building AND t.b = y.building LEFT JOIN travel r ON r.a = y.building AND r.b = x.building)"""
# A second way to evaluate: for each located meeting its last located predecessor by a self-join, idle time by sums.
_EVAL = """m AS (SELECT combo, day, s, e, building, row_number() OVER (PARTITION BY combo, day ORDER BY s, e, cpos, mpos) AS i, s - lag(e, 1, s) OVER (PARTITION BY combo, day ORDER BY s, e, cpos, mpos) AS idle
              FROM (SELECT combo, unnest(combo) AS ord, generate_subscripts(combo, 1) AS cpos FROM combo) JOIN mt USING (ord)),
        lg AS (SELECT x.combo, x.day, x.i, x.building AS to_b, coalesce(arg_max(y.building, y.i), 0) AS from_b, max(y.i) AS before FROM m x LEFT JOIN m y ON y.combo = x.combo AND y.day = x.day AND y.i < x.i AND y.building >= 0 WHERE x.building >= 0 GROUP BY ALL),
        ls AS (SELECT lg.*, g.minutes, CASE WHEN before IS NOT NULL THEN (SELECT sum(idle) FROM m z WHERE z.combo = lg.combo AND z.day = lg.day AND z.i > before AND z.i <= lg.i) - g.minutes END AS slack FROM lg JOIN {g} g ON g.a = from_b AND g.b = to_b),
        bk AS (SELECT combo, day, arg_max(to_b, i) AS from_b, count(*) + 1 AS leg FROM lg GROUP BY ALL),
        ev AS (SELECT combo, sum(t) AS travel, sum(l) AS late FROM (SELECT combo, minutes AS t, greatest(0, -coalesce(slack, 0)) AS l FROM ls UNION ALL SELECT combo, minutes, 0 FROM bk JOIN {g} g ON g.a = from_b AND g.b = 0) GROUP BY combo),
        ds AS (SELECT combo, count(DISTINCT day) AS days FROM m GROUP BY combo),
        id AS (SELECT combo, sum(greatest(0, coalesce(slack, 0))) AS gap FROM ls GROUP BY combo),
        cost AS (SELECT d.combo, coalesce(travel, 0) AS travel, coalesce(late, 0) AS late, coalesce(gap, 0) AS gap, days, coalesce(travel, 0) + 2 * coalesce(late, 0) AS cost FROM ds d LEFT JOIN ev ON ev.combo = d.combo LEFT JOIN id ON id.combo = d.combo)"""
_USABLE = C.sql_sections(COURSES, PER, "event_id % 11 <> 0")
_ALL = C.sql_sections(COURSES, PER)


def _ranked(cost: str = "cost") -> str:
    return f"""SELECT request, rank, array_to_string(combo, ',') AS combo, round(travel, 4) AS travel, round(late, 4) AS late, days, round(cost, 4) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY floor(cost * 1000000 + 0.5), combo) AS rank
        FROM (SELECT combo[1] // {PER} AS request, combo, travel, late, days, {cost} AS cost FROM cost))"""


_CLOSED = """closed AS (WITH RECURSIVE p(a, b, minutes, k) AS (SELECT a, b, minutes, 0 FROM grid UNION ALL SELECT a, b, min(minutes), k + 1 FROM (
            SELECT p.a, g.b, p.minutes + g.minutes AS minutes, p.k FROM p JOIN grid g ON g.a = p.b WHERE k < 24) GROUP BY a, b, k) SELECT a, b, min(minutes) AS minutes FROM p GROUP BY a, b)"""


def _eval(g: str = "grid") -> str:
    return _EVAL.replace("{g}", g)


_LUNCH = """x AS (SELECT combo, day, s, e FROM (SELECT combo, unnest(combo) AS ord FROM combo) JOIN mt USING (ord)),
        late AS (SELECT DISTINCT combo FROM (SELECT combo, day, t.t FROM (SELECT DISTINCT combo, day FROM x), (SELECT unnest(range({a}, {b} - {n} + 1)) AS t) t) q
          GROUP BY combo, day HAVING NOT bool_or(NOT EXISTS (SELECT 1 FROM x WHERE x.combo = q.combo AND x.day = q.day AND x.s < q.t + {n} AND x.e > q.t)))"""
_RULED = f"""{SQL_COMBOS.replace("combo AS (SELECT request, combo FROM grown", "every AS (SELECT request, combo FROM grown")}, {_LUNCH.format(a=690, b=810, n=60).replace("FROM combo) JOIN", "FROM every) JOIN")},
        combo AS (SELECT request, combo FROM every WHERE combo NOT IN (SELECT combo FROM late) AND combo NOT IN (SELECT combo FROM x WHERE day = 4))"""

ORACLE_SQL = {
    "conflict_pairs": f"WITH {_ALL}, {_CONF} SELECT request, a, b FROM conf",
    "conflict_count": f"WITH {_ALL}, {_CONF} SELECT request, count(*) AS n FROM conf GROUP BY request",
    "mrv_order": f"WITH {_ALL} SELECT request, course, count(*) AS n_sections, row_number() OVER (PARTITION BY request ORDER BY count(*), course) AS pos FROM sec GROUP BY request, course",
    "feasible_combos": f"WITH RECURSIVE {_USABLE}, {SQL_COMBOS} SELECT request, array_to_string(combo, ',') AS combo FROM combo",
    "topk_schedules": f"WITH RECURSIVE {_USABLE}, {SQL_COMBOS}, {_GRID}, {_eval()} {_ranked()} WHERE rank <= 20",
    "topk_unknown_rooms": f"WITH RECURSIVE {_ALL}, {SQL_COMBOS}, {_GRID}, {_eval()} {_ranked()} WHERE rank <= 20",
    "topk_all_weights": f"WITH RECURSIVE {_USABLE}, {SQL_COMBOS}, {_GRID}, {_eval()} {_ranked('cost + 10 * days + 0.1::DOUBLE * gap')} WHERE rank <= 3",
    "topk_with_rules": f"WITH RECURSIVE {_USABLE}, {_RULED}, {_GRID}, {_eval()} {_ranked()} WHERE rank <= 5",
    "topk_by_joins": f"WITH RECURSIVE {_USABLE}, {SQL_COMBOS}, {_GRID}, {_eval()} {_ranked()} WHERE rank <= 5",
    "paging": f"WITH RECURSIVE {_USABLE}, {SQL_COMBOS}, {_GRID}, {_eval()} {_ranked()} WHERE rank BETWEEN 7 AND 12",
    "search_numbers": f"WITH RECURSIVE {_USABLE}, {SQL_COMBOS} SELECT s.request, least(5, count(combo)) AS found, true AS enough, true AS deeper FROM (SELECT DISTINCT request FROM sec) s LEFT JOIN combo c ON c.request = s.request GROUP BY s.request",
    "daily_legs": f"""WITH RECURSIVE {_USABLE}, {SQL_COMBOS}, {_GRID}, {_eval()}
        SELECT array_to_string(combo, ',') AS combo, day, row_number() OVER (PARTITION BY combo, day ORDER BY i) AS leg, from_b::INTEGER AS from_b, to_b, round(minutes, 4) AS minutes, round(slack, 4)::DOUBLE AS slack FROM ls
        UNION ALL SELECT array_to_string(combo, ','), day, leg, from_b, 0, round(minutes, 4), NULL FROM bk JOIN grid g ON g.a = from_b AND g.b = 0""",
    "combo_count_product": f"WITH {_ALL} SELECT request, product(n)::BIGINT AS n FROM (SELECT request, course, count(*) AS n FROM sec GROUP BY ALL) GROUP BY request",
    "count_feasible_dp": f"WITH RECURSIVE {_ALL}, {SQL_COMBOS} SELECT s.request, count(combo) AS n FROM (SELECT DISTINCT request FROM sec) s LEFT JOIN combo c ON c.request = s.request GROUP BY s.request",
    "stress_counts": f"""WITH RECURSIVE {C.sql_sections(8, 40).replace("sec AS (", "all_ AS (", 1).replace("mt AS (SELECT", "sec AS (SELECT request * 10 + k AS request, ord, course, d0, start_min, len, building FROM all_, range(4, 9) r(k) WHERE course < k), mt AS (SELECT")}, {SQL_COMBOS}
        SELECT s.request, count(combo) AS n FROM (SELECT DISTINCT request FROM sec) s LEFT JOIN combo c ON c.request = s.request GROUP BY s.request""",
    "count_with_rules": f"WITH RECURSIVE {_USABLE}, {_RULED} SELECT s.request, count(combo) AS n, count(combo) > 50 AS more FROM (SELECT DISTINCT request FROM sec) s LEFT JOIN combo c ON c.request = s.request GROUP BY s.request",
    "why_none": f"""WITH RECURSIVE {_USABLE}, {SQL_COMBOS}, {_LUNCH.format(a=600, b=840, n=180)}, shut AS (SELECT DISTINCT combo FROM x WHERE day IN (0, 4)),
        k AS (SELECT s.request, count(combo) AS every, count(*) FILTER (combo IS NOT NULL AND combo NOT IN (SELECT combo FROM shut)) AS days, count(*) FILTER (combo IS NOT NULL AND combo NOT IN (SELECT combo FROM late)) AS lunch,
                count(*) FILTER (combo IS NOT NULL AND combo NOT IN (SELECT combo FROM shut UNION SELECT combo FROM late)) AS ruled FROM (SELECT DISTINCT request FROM sec) s LEFT JOIN combo c ON c.request = s.request GROUP BY s.request)
        SELECT request, ruled > 0 AS feasible, CASE WHEN ruled > 0 THEN 'none' WHEN every = 0 THEN 'overlap' WHEN days = 0 THEN 'free_days' WHEN lunch = 0 THEN 'lunch' ELSE 'rules' END AS cause, ruled > 0 AS no_blame FROM k""",
    "free_day_filter": f"WITH RECURSIVE {_USABLE}, {SQL_COMBOS}, shut AS (SELECT ord FROM mt WHERE day IN (0, 4)) SELECT request, array_to_string(combo, ',') AS combo FROM combo WHERE NOT list_has_any(combo, (SELECT list(ord) FROM shut))",
    "lunch_gap_days": f"""WITH {_ALL}, d AS (SELECT DISTINCT request, course, day FROM mt), hit AS (SELECT DISTINCT d.request, d.course, d.day FROM d, (SELECT unnest(range(690, 751)) AS t)
          WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.request = d.request AND mt.course = d.course AND mt.day = d.day AND mt.s < t + 60 AND mt.e > t))
        SELECT d.request, d.course, d.day, hit.request IS NOT NULL AS free FROM d LEFT JOIN hit ON hit.request = d.request AND hit.course = d.course AND hit.day = d.day""",
    "twin_groups": f"""WITH {C.sql_sections(50)}, g AS (SELECT course, ord, string_agg(day || ':' || s || '-' || e || '@' || building, ';' ORDER BY day, s, e, building) AS sig FROM mt GROUP BY course, ord)
        SELECT course, min(ord) AS first, array_to_string(list(ord ORDER BY ord)[2:], ',') AS twins FROM g GROUP BY course, sig""",
    "travel_lookup": f"WITH {C.SQL_TRAVEL}, {_GRID} SELECT a, b, round(minutes, 6) AS minutes, source FROM grid",
    "travel_misses": f"WITH {C.SQL_TRAVEL}, {_GRID} SELECT a, b, source FROM grid WHERE source IN ('estimate', 'default')",
    "closure": f"WITH {C.SQL_TRAVEL}, {_GRID}, {_CLOSED} SELECT a, b, round(minutes, 6) AS minutes FROM closed",
    "triangle_violations": f"""WITH {C.SQL_TRAVEL}, {_GRID} SELECT x.a, x.b, y.b AS c, round(d.minutes - x.minutes - y.minutes, 6) AS excess FROM grid x JOIN grid y ON y.a = x.b JOIN grid d ON d.a = x.a AND d.b = y.b
        WHERE x.a <> x.b AND y.a <> y.b AND x.a <> y.b AND d.minutes > x.minutes + y.minutes + 0.5""",
    "tsp_lower_bound": f"""WITH RECURSIVE {_USABLE}, {_GRID}, {_CLOSED}, rooms AS (SELECT DISTINCT request, course, building FROM sec UNION SELECT DISTINCT request, -1, 0 FROM sec),
        k AS (SELECT x.request, x.course AS c1, y.course AS c2, min(least(f.minutes, r.minutes)) AS d FROM rooms x JOIN rooms y ON x.request = y.request AND x.course <> y.course JOIN closed f ON f.a = x.building AND f.b = y.building JOIN closed r ON r.a = y.building AND r.b = x.building GROUP BY 1, 2, 3),
        n AS (SELECT request, count(DISTINCT course) AS n FROM sec GROUP BY 1),
        tour(request, here, seen, cost) AS (SELECT request, c2, [c2], d FROM k WHERE c1 = -1 UNION ALL SELECT t.request, k.c2, list_append(seen, k.c2), cost + d FROM tour t JOIN k ON k.request = t.request AND k.c1 = t.here AND k.c2 <> -1 AND NOT list_contains(seen, k.c2))
        SELECT t.request, round(min(cost + d), 6) AS bound FROM tour t JOIN n ON n.request = t.request AND len(seen) = n.n JOIN k ON k.request = t.request AND k.c1 = t.here AND k.c2 = -1 GROUP BY t.request""",
    "flat_vs_slope_loss": f"""WITH RECURSIVE {_USABLE}, {SQL_COMBOS}, {_GRID}, {_CLOSED}, {_eval()},
        {_eval("closed").replace("m AS (", "m_ AS (").replace("lg AS (", "lg_ AS (").replace("ls AS (", "ls_ AS (").replace("bk AS (", "bk_ AS (").replace("ev AS (", "ev_ AS (").replace("ds AS (", "ds_ AS (").replace("id AS (", "id_ AS (").replace("cost AS (", "cost_ AS (").replace("FROM ls UNION", "FROM ls_ UNION").replace("FROM bk JOIN", "FROM bk_ JOIN").replace("LEFT JOIN ev ON ev.", "LEFT JOIN ev_ ON ev_.")},
        z AS (SELECT x.combo[1] // {PER} AS request, floor(x.cost * 1000000 + 0.5)::BIGINT AS k1, floor(y.cost * 1000000 + 0.5)::BIGINT AS k2, x.combo FROM cost x JOIN cost_ y ON x.combo = y.combo),
        w AS (SELECT request, arg_min(k2, (k1, combo)) AS priced, min(k2) AS best FROM z GROUP BY request) SELECT request, priced, best, priced - best AS loss, priced - best < 50000 AS optimal FROM w""",
    "haversine_estimate": f"""WITH {C.SQL_TRAVEL}, h AS (SELECT x.building AS a, y.building AS b, 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2))) AS m FROM bld x, bld y WHERE x.building < y.building)
        SELECT a, b, round(m, 4) AS metres, round(m * 1.35::DOUBLE / (4000.0::DOUBLE / 60), 6) AS minutes FROM h""",
    "dense_matrix": f"WITH {C.SQL_TRAVEL} SELECT x.building AS a, '[' || string_agg(CASE WHEN x.building = y.building THEN '0' ELSE coalesce(minutes::INTEGER::VARCHAR, 'null') END, ',' ORDER BY y.building) || ']' AS row FROM bld x CROSS JOIN bld y LEFT JOIN travel ON a = x.building AND b = y.building GROUP BY x.building",
}
