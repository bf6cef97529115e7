"""Tracks, graphs, terrain and text predicates over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, polyline
from waymark.functions import hangul as H
from waymark.operators import graph as G
from waymark.operators import raster as R
from waymark.operators import search as Q
from waymark.operators import tracks as T
from waymark.operators.components import connected_components
from waymark.plans import campus as C
from waymark.plans.store import Store


def _track(spark, sf) -> DataFrame:
    """who, event_id, t (seconds), v (speed-like value), z (height-like)."""
    ev = C.table(spark, sf, "events")
    return ev.select(F.col("user_id").alias("who"), "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("t"), F.col("value").alias("v"), (F.col("event_id") % 17).cast("double").alias("z"))


def gaps(spark, sf):
    return T.gaps(_track(spark, sf), "who", "t", 36000)


def sessions(spark, sf):
    return T.sessions(_track(spark, sf), "who", "t", 7200)


def stop_islands(spark, sf):
    return T.stop_islands(_track(spark, sf), "who", "t", "v", 20.0, 600, 20000)


def moving_average(spark, sf):
    out = T.moving_average(_track(spark, sf), "who", "t", F.floor(F.col("v") * 100), F.col("event_id") % 3 + 1, 7200)
    return out.select("event_id", F.round("smooth", 6).alias("smooth"))


def running_max(spark, sf):
    return T.running_max(_track(spark, sf), "who", ["t", "event_id"], "v").select("event_id", "running_max")


def median_filter(spark, sf):
    return T.median5(_track(spark, sf), "who", ["t", "event_id"], "v").select("event_id", F.round("median5", 6).alias("median5"))


def asof_interpolate(spark, sf):
    tr = _track(spark, sf)
    points = tr.where("event_id % 4 <> 0").groupBy("who", "t").agg(F.max("v").alias("v"))
    asks = tr.where("event_id % 4 = 0").select("who", "t").distinct()
    return T.interpolate_at(points, asks, "who", "t", "v").select("who", "t", F.round("value", 6).alias("value"))


def overlap_length(spark, sf):
    tr = _track(spark, sf).select("who", (F.col("t") % 86400).alias("a"), (F.col("t") % 86400 + F.col("event_id") % 900).alias("b"))
    windows = tr.select("who").distinct().withColumn("x", F.lit(30000)).withColumn("y", F.lit(45000))
    return T.overlap_lengths(tr, windows, "who").select("who", "seconds")


def ascent_descent(spark, sf):
    return T.ascent_descent(_track(spark, sf), "who", ["t", "event_id"], "z")


def attempts(spark, sf):
    tr = _track(spark, sf).withColumn("to_b", F.col("event_id") % 5)
    return T.attempts(tr, ["who", "to_b"], ["t", "event_id"]).select("event_id", "attempt")


def grade_bins(spark, sf):
    tr = _track(spark, sf).withColumn("g", (F.col("event_id") % 41 - 20) / 100)
    out = T.grade_bins(tr, F.col("g"), "v", [-0.12, -0.07, -0.03, 0.03, 0.07, 0.12])
    return out.select("bin", "n", F.round("median", 6).alias("median"))


def k_grid_fit(spark, sf):
    tr = _track(spark, sf).where("v > 0").select("who", F.col("v").alias("pace"), ((F.col("event_id") % 41 - 20) / 100).alias("grade"))
    out = T.fit_slope_factor(tr, "who", [0.5 * i for i in range(17)])
    return out.select("k", F.round("sse", 4).alias("sse"))


def tobler_time(spark, sf):
    e = F.col("event_id")
    g, stairs = (e % 81 - 40) / 50, e % 7 == 0
    return C.table(spark, sf, "events").select("event_id", F.round(geo.pace(g, stairs) * (e % 90 + 10), 6).alias("seconds"))


def mercator(spark, sf):
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    return C.buildings(spark, sf).select("building", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))


def tumbling_counts(spark, sf):
    ev = C.table(spark, sf, "events")
    g = ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    return g.select(F.col("w.start").alias("begins"), "event_type", "n", "most")


def sliding_counts(spark, sf):
    ev = C.table(spark, sf, "events")
    return ev.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begins"), "n")


def components(spark, sf):
    edges = C.travel(spark, sf).where("minutes <= 2").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return connected_components(edges, Store(spark, "components"), "c")


def dijkstra(spark, sf):
    edges = C.travel(spark, sf).where("minutes <= 6").select("a", "b", F.col("minutes").alias("cost"))
    sources = C.buildings(spark, sf).select(F.col("building").cast("long").alias("source"))
    return G.shortest_paths(edges, sources).select("source", "node", "cost")


def _road(spark, sf) -> DataFrame:
    li = C.table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 300).alias("a"), (F.col("l_suppkey") % 300).alias("b"), F.col("l_quantity").alias("distance"),
        F.when(F.col("l_returnflag") == "R", "stairs").otherwise("path").alias("kind"), (F.col("l_linestatus") == "O").alias("walkable"),
    )


def edge_canonical(spark, sf):
    return G.canonical_edges(_road(spark, sf))


def edge_blocks(spark, sf):
    blocks = _road(spark, sf).where("id % 1000 = 7").select("a", "b")
    return G.apply_blocks(_road(spark, sf), blocks).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("length"))


def _points(spark, sf) -> DataFrame:
    return C.table(spark, sf, "customer").select(F.col("c_custkey").alias("point"), ((F.col("c_custkey") * 37) % 1009).cast("double").alias("x"), ((F.col("c_custkey") * 101) % 997).cast("double").alias("y"))


def nearest_within(spark, sf):
    targets = C.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("target"), ((F.col("s_suppkey") * 53) % 1009 + 0.5).alias("x"), ((F.col("s_suppkey") * 211) % 997 + 0.25).alias("y"))
    return G.nearest_within(_points(spark, sf), targets, 60.0)


def _footprints(spark, sf) -> DataFrame:
    """Corners are summed in the order in which the SQL sums them: distances that tie there tie here."""
    k = F.col("s_suppkey")
    x, y, r = (k * 53 % 1009).cast("double") + 0.3, (k * 211 % 997).cast("double") + 0.3, (k % 40 + 20).cast("double")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return C.table(spark, sf, "supplier").select(k.alias("fid"), F.array(corner(x - 0.8 - r, y), corner(x, y + r + 0.2), corner(x + r + 0.2, y), corner(x, y - 0.8 - r)).alias("ring"))


def point_in_polygon(spark, sf):
    return R.containing_footprint(_points(spark, sf), _footprints(spark, sf), 50.0)


def ring_area(spark, sf):
    return _footprints(spark, sf).select("fid", F.round(geo.ring_area(F.col("ring")), 6).alias("area"))


def bilinear(spark, sf):
    points = C.table(spark, sf, "customer").select(F.col("c_custkey").alias("point"), ((F.col("c_custkey") * 7) % 90 / 10).alias("x"), ((F.col("c_custkey") * 3) % 70 / 10).alias("y"))
    cells = spark.range(110).select((F.col("id") % 11).alias("col"), F.floor(F.col("id") / 11).alias("row"), F.when(F.col("id") % 13 != 0, (F.col("id") * 5 % 23).cast("double")).alias("z"))
    return R.bilinear(points, cells).select("point", F.round("z", 6).alias("z"))


def _segments(spark, sf) -> DataFrame:
    k = F.col("n_nationkey")
    return C.table(spark, sf, "nation").select(k.cast("long").alias("edge"), (k * 2 + 100000).cast("long").alias("a"), (k * 2 + 100001).cast("long").alias("b"), (k * 40).cast("double").alias("x1"), (k * 17 % 300).cast("double").alias("y1"), (k * 40 + 200).cast("double").alias("x2"), (k * 17 % 300).cast("double").alias("y2"))


def junction_healing(spark, sf):
    nodes = _points(spark, sf).select(F.col("point").alias("node"), "x", "y")
    return G.nodes_on_edges(nodes, _segments(spark, sf), 25.0, 0.3, 0.5)


def junction_pieces(spark, sf):
    nodes = _points(spark, sf).select(F.col("point").alias("node"), "x", "y")
    seg = _segments(spark, sf)
    return G.split_edges(seg, G.nodes_on_edges(nodes, seg, 25.0, 0.3, 0.5))


def directed_grades(spark, sf):
    e = G.canonical_edges(_road(spark, sf)).withColumn("ascent", (F.col("u") % 7).cast("double")).withColumn("descent", (F.col("v") % 5).cast("double"))
    return G.directed_grades(e).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("ascent").alias("up"), F.sum("descent").alias("down"))


def densify(spark, sf):
    out = R.densify(_segments(spark, sf).withColumnRenamed("edge", "line"), 30.0)
    return out.select("line", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def perimeter_level(spark, sf):
    li = C.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("fid"), F.col("l_tax").alias("z"), F.col("l_quantity").alias("w"))
    out = R.weighted_level(li, "fid")
    return out.select("fid", F.round("mean", 8).alias("mean"), "low", "high", F.round("span", 6).alias("span"))


def polyline_roundtrip(spark, sf):
    """Each region's buildings as an encoded line, decoded again."""
    b = C.buildings(spark, sf).withColumn("g", F.col("building") % 5)
    lines = b.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("building", "lat", "lon"))).alias("p")).select("g", F.transform("p", lambda p: F.struct(p.lat.alias("lat"), p.lon.alias("lon"))).alias("p"))
    back = lines.select("g", F.posexplode(polyline.decode_polyline(polyline.encode_polyline("p"))).alias("i", "q"))
    return back.select("g", "i", F.round("q.lat", 5).alias("lat"), F.round("q.lon", 5).alias("lon"))


def mask_prefilter(spark, sf):
    """Parts whose names have all letters of a query, by the search's bit masks."""
    p = C.table(spark, sf, "part").withColumn("mask", H.mask_udf(H.norm_key_udf("p_name")))
    need = F.lit(H.mask(H.norm_key("ring")))
    return p.where(F.col("mask").bitwiseAND(need) == need).select("p_partkey", "p_name")


def _search_index(spark, sf) -> DataFrame:
    p = C.table(spark, sf, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", "교양").when(F.col("p_type") == "STANDARD", "전선").otherwise("전필")
    return Q.build_index(p.select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.lit("dept").alias("dept"), F.array(F.lit("x")).alias("profs"), F.array(F.lit("001")).alias("section_nos"),
        kind.alias("cls"), F.col("p_size").cast("double").alias("credit"), F.array(F.col("p_size").cast("string")).alias("buildings"),
    ))


def multiword_search(spark, sf):
    """Parts that a search of two words finds: those with both."""
    return Q.search(_search_index(spark, sf), "in re ").select("id")


def special_words(spark, sf):
    """Words that are filters: a class, credits, a building; and one of them with a word of the name."""
    index, out = _search_index(spark, sf), None
    for text in ("전공 ", "10학점 ", "7동 ", "교양 in "):
        one = Q.search(index, text).select(F.lit(text.strip()).alias("text"), "id")
        out = one if out is None else out.unionByName(one)
    return out


NAMES = """gaps sessions stop_islands moving_average running_max median_filter asof_interpolate overlap_length ascent_descent attempts grade_bins k_grid_fit tobler_time mercator tumbling_counts sliding_counts components dijkstra
edge_canonical edge_blocks nearest_within point_in_polygon ring_area bilinear junction_healing junction_pieces directed_grades densify perimeter_level polyline_roundtrip mask_prefilter multiword_search special_words""".split()
QUERIES = {n: globals()[n] for n in NAMES}

_TR = "tr AS (SELECT user_id AS who, event_id, floor(epoch_us(ts) / 1000000)::BIGINT AS t, value AS v, (event_id % 17)::DOUBLE AS z FROM events)"
_ROAD = "road AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 300 AS a, l_suppkey % 300 AS b, l_quantity AS distance, CASE WHEN l_returnflag = 'R' THEN 'stairs' ELSE 'path' END AS kind, l_linestatus = 'O' AS walkable FROM lineitem)"
_CANON = "canon AS (SELECT least(a, b) AS u, greatest(a, b) AS v, distance, kind, id FROM road WHERE walkable AND a <> b QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY distance, id) = 1)"
_PTS = "pts AS (SELECT c_custkey AS point, (c_custkey * 37 % 1009)::DOUBLE AS x, (c_custkey * 101 % 997)::DOUBLE AS y FROM customer)"
_SEG = "seg AS (SELECT n_nationkey::BIGINT AS edge, (n_nationkey * 2 + 100000)::BIGINT AS a, (n_nationkey * 2 + 100001)::BIGINT AS b, (n_nationkey * 40)::DOUBLE AS x1, (n_nationkey * 17 % 300)::DOUBLE AS y1, (n_nationkey * 40 + 200)::DOUBLE AS x2, (n_nationkey * 17 % 300)::DOUBLE AS y2 FROM nation)"
_ON = f"{_PTS}, {_SEG}, hit AS (SELECT edge, point AS node, x - x1 AS \"at\" FROM pts, seg WHERE abs(y - y1) <= 0.3 AND x - x1 >= 0.5 AND x2 - x >= 0.5)"
_PACE = "CASE WHEN event_id % 7 = 0 THEN 1 + 2.2 * greatest(g, 0) + 1.6 * greatest(-g, 0) ELSE exp(-0.175) / exp(-3.5 * abs(greatest(-1, least(1, g)) + 0.05)) END"

ORACLE_SQL = {
    "gaps": f"WITH {_TR}, x AS (SELECT who, lag(t) OVER (PARTITION BY who ORDER BY t) AS from_s, t AS to_s FROM tr) SELECT who, from_s, to_s, to_s - from_s AS seconds FROM x WHERE to_s - from_s > 36000",
    "sessions": f"""WITH {_TR}, x AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY who ORDER BY t) <= 7200 THEN 0 ELSE 1 END AS new FROM tr),
        y AS (SELECT *, sum(new) OVER (PARTITION BY who ORDER BY t RANGE UNBOUNDED PRECEDING) AS session FROM x) SELECT who, session::BIGINT AS session, min(t) AS begin_s, max(t) AS end_s, count(*) AS n FROM y GROUP BY 1, 2""",
    "stop_islands": f"""WITH {_TR}, x AS (SELECT *, v < 20 AS stop, lag(v < 20) OVER w AS was, t - lag(t) OVER w AS d FROM tr WINDOW w AS (PARTITION BY who ORDER BY t)),
        y AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> stop OR d > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY who ORDER BY t RANGE UNBOUNDED PRECEDING) AS run FROM x)
        SELECT who, min(t) AS begin_s, max(t) AS end_s FROM y WHERE stop GROUP BY who, run HAVING max(t) - min(t) >= 600""",
    "moving_average": f"""WITH {_TR} SELECT a.event_id, round(sum(floor(b.v * 100) * (b.event_id % 3 + 1)) / sum(b.event_id % 3 + 1), 6) AS smooth FROM tr a JOIN tr b ON a.who = b.who AND b.t BETWEEN a.t - 7200 AND a.t + 7200 GROUP BY 1""",
    "running_max": f"WITH {_TR} SELECT a.event_id, max(b.v) AS running_max FROM tr a JOIN tr b ON a.who = b.who AND (b.t, b.event_id) <= (a.t, a.event_id) GROUP BY 1",
    "median_filter": f"WITH {_TR} SELECT event_id, round(quantile_cont(v, 0.5) OVER (PARTITION BY who ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median5 FROM tr",
    "asof_interpolate": f"""WITH {_TR}, p AS (SELECT who, t, max(v) AS v FROM tr WHERE event_id % 4 <> 0 GROUP BY 1, 2), q AS (SELECT DISTINCT who, t FROM tr WHERE event_id % 4 = 0),
        lo AS (SELECT q.who, q.t, p.t AS t0, p.v AS v0 FROM q ASOF LEFT JOIN p ON q.who = p.who AND q.t >= p.t), hi AS (SELECT q.who, q.t, p.t AS t1, p.v AS v1 FROM q ASOF LEFT JOIN p ON q.who = p.who AND q.t <= p.t)
        SELECT who, t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS value FROM lo JOIN hi USING (who, t)""",
    "overlap_length": f"WITH {_TR} SELECT who, sum(greatest(0, least(t % 86400 + event_id % 900, 45000) - greatest(t % 86400, 30000)))::BIGINT AS seconds FROM tr GROUP BY who",
    "ascent_descent": f"WITH {_TR}, d AS (SELECT who, z - lag(z) OVER (PARTITION BY who ORDER BY t, event_id) AS dz FROM tr) SELECT who, sum(CASE WHEN dz > 0 THEN dz ELSE 0 END) AS ascent, sum(CASE WHEN dz < 0 THEN -dz ELSE 0 END) AS descent FROM d GROUP BY who",
    "attempts": f"WITH {_TR} SELECT event_id, row_number() OVER (PARTITION BY who, event_id % 5 ORDER BY t, event_id) AS attempt FROM tr",
    "grade_bins": f"""WITH {_TR}, g AS (SELECT v, (event_id % 41 - 20) / 100 AS g FROM tr) SELECT (CASE WHEN g < -0.12 THEN 0 WHEN g < -0.07 THEN 1 WHEN g < -0.03 THEN 2 WHEN g < 0.03 THEN 3 WHEN g < 0.07 THEN 4 WHEN g < 0.12 THEN 5 ELSE 6 END)::INTEGER AS bin,
        count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median FROM g GROUP BY 1""",
    "k_grid_fit": f"""WITH {_TR}, x AS (SELECT who, k * 0.5::DOUBLE AS k, ln(v) - k * 0.5::DOUBLE * abs((event_id % 41 - 20) / 100) AS r FROM tr, range(17) r(k) WHERE v > 0), l AS (SELECT who, k, quantile_cont(r, 0.5) AS level FROM x GROUP BY 1, 2)
        SELECT k, round(sum((r - level) * (r - level)), 4) AS sse FROM x JOIN l USING (who, k) GROUP BY k""",
    "tobler_time": f"SELECT event_id, round({_PACE} * (event_id % 90 + 10), 6)::DOUBLE AS seconds FROM (SELECT event_id, ((event_id % 81 - 40) / 50)::DOUBLE AS g FROM events)",
    "mercator": f"WITH {C.SQL_TRAVEL} SELECT building, round((lon + 180) / 360 * 256, 9) AS x, round((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 256, 9) AS y FROM bld",
    "tumbling_counts": "SELECT date_trunc('hour', ts) AS begins, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2",
    "sliding_counts": "SELECT h - INTERVAL 1 HOUR * k AS begins, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS h FROM events), range(2) r(k) GROUP BY 1",
    "components": f"""WITH RECURSIVE {C.SQL_TRAVEL}, e AS (SELECT a, b FROM travel WHERE minutes <= 2 UNION SELECT b, a FROM travel WHERE minutes <= 2), r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""",
    "dijkstra": f"""WITH RECURSIVE {C.SQL_TRAVEL}, e AS (SELECT a, b, minutes FROM travel WHERE minutes <= 6), p(source, node, cost, k) AS (SELECT building, building, 0::DOUBLE, 0 FROM bld UNION ALL SELECT source, node, min(cost), k + 1 FROM (
          SELECT p.source, e.b AS node, p.cost + e.minutes AS cost, p.k FROM p JOIN e ON e.a = p.node WHERE k < 24) GROUP BY source, node, k) SELECT source::BIGINT AS source, node::BIGINT AS node, min(cost) AS cost FROM p GROUP BY 1, 2""",
    "edge_canonical": f"WITH {_ROAD}, {_CANON} SELECT u, v, distance, kind, id FROM canon",
    "edge_blocks": f"WITH {_ROAD}, k AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM road WHERE id % 1000 = 7) SELECT kind, count(*) AS n, sum(distance) AS length FROM road WHERE NOT EXISTS (SELECT 1 FROM k WHERE u = least(a, b) AND v = greatest(a, b)) GROUP BY kind",
    "nearest_within": f"""WITH {_PTS}, s AS (SELECT s_suppkey AS target, (s_suppkey * 53 % 1009)::DOUBLE + 0.5 AS x, (s_suppkey * 211 % 997)::DOUBLE + 0.25 AS y FROM supplier),
        d AS (SELECT point, target, sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)) AS d FROM pts p, s) SELECT point, target, round(d, 6) AS distance FROM d WHERE d <= 60 QUALIFY row_number() OVER (PARTITION BY point ORDER BY d, target) = 1""",
    "point_in_polygon": f"""WITH {_PTS}, f AS (SELECT s_suppkey AS fid, (s_suppkey * 53 % 1009) + 0.3 AS x0, (s_suppkey * 211 % 997) + 0.3 AS y0, (s_suppkey % 40) + 20.5 AS r FROM supplier),
        i AS (SELECT point, fid, 2 * r * r AS area FROM (SELECT point, fid, r, p.x - x0 AS dx, p.y - y0 AS dy, r + CASE WHEN p.x < x0 THEN 0.3 ELSE -0.3 END AS ex, r + CASE WHEN p.y < y0 THEN 0.3 ELSE -0.3 END AS ey FROM pts p, f) WHERE abs(dx) / ex + abs(dy) / ey < 1)
        SELECT point, fid FROM i QUALIFY row_number() OVER (PARTITION BY point ORDER BY area, fid) = 1""",
    "ring_area": "SELECT s_suppkey AS fid, round(2.0::DOUBLE * (s_suppkey % 40 + 20.5) * (s_suppkey % 40 + 20.5), 6) AS area FROM supplier",
    "bilinear": """WITH p AS (SELECT c_custkey AS point, (c_custkey * 7 % 90 / 10)::DOUBLE AS x, (c_custkey * 3 % 70 / 10)::DOUBLE AS y FROM customer), c AS (SELECT i % 11 AS col, i // 11 AS row, CASE WHEN i % 13 <> 0 THEN (i * 5 % 23)::DOUBLE END AS z FROM range(110) r(i)),
        m AS (SELECT point, z, greatest(0, 1 - abs(x - col)) * greatest(0, 1 - abs(y - row)) AS w FROM p, c WHERE z IS NOT NULL) SELECT point, round(sum(w * z) / sum(w), 6) AS z FROM m WHERE w > 1e-12 GROUP BY point""",
    "junction_healing": f"WITH {_ON} SELECT edge, node, round(\"at\", 6) AS \"at\" FROM hit",
    "junction_pieces": f"""WITH {_ON}, st AS (SELECT edge, a AS node, 0.0::DOUBLE AS p FROM seg UNION ALL SELECT edge, b, x2 - x1 FROM seg UNION ALL SELECT edge, node, "at" FROM hit),
        w AS (SELECT edge, row_number() OVER v AS piece, node AS a, lead(node) OVER v AS b, p AS from_at, lead(p) OVER v AS to_at FROM st WINDOW v AS (PARTITION BY edge ORDER BY p, node)) SELECT * FROM w WHERE b IS NOT NULL""",
    "directed_grades": f"""WITH {_ROAD}, {_CANON}, d AS (SELECT u AS a, u % 7 AS up, v % 5 AS down FROM canon UNION ALL SELECT v, v % 5, u % 7 FROM canon) SELECT a, count(*) AS n, sum(up)::DOUBLE AS up, sum(down)::DOUBLE AS down FROM d GROUP BY a""",
    "densify": f"WITH {_SEG} SELECT edge AS line, i::INTEGER AS i, round(x1 + 200 * i / 7, 6) AS x, y1 AS y FROM seg, range(8) r(i)",
    "perimeter_level": "SELECT l_suppkey % 50 AS fid, round(sum(l_tax * l_quantity) / sum(l_quantity), 8) AS mean, min(l_tax) AS low, max(l_tax) AS high, round(max(l_tax) - min(l_tax), 6) AS span FROM lineitem GROUP BY 1",
    "polyline_roundtrip": f"WITH {C.SQL_TRAVEL} SELECT building % 5 AS g, (row_number() OVER (PARTITION BY building % 5 ORDER BY building) - 1)::INTEGER AS i, round(lat, 5) AS lat, round(lon, 5) AS lon FROM bld",
    "mask_prefilter": "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%r%' AND lower(p_name) LIKE '%i%' AND lower(p_name) LIKE '%n%' AND lower(p_name) LIKE '%g%'",
    "multiword_search": "SELECT 'P' || p_partkey AS id FROM part WHERE replace(lower(p_name), ' ', '') LIKE '%in%' AND replace(lower(p_name), ' ', '') LIKE '%re%'",
    "special_words": """SELECT '전공' AS text, 'P' || p_partkey AS id FROM part WHERE p_type <> 'ECONOMY' UNION ALL SELECT '10학점', 'P' || p_partkey FROM part WHERE p_size = 10 UNION ALL SELECT '7동', 'P' || p_partkey FROM part WHERE p_size = 7
        UNION ALL SELECT '교양 in', 'P' || p_partkey FROM part WHERE p_type = 'ECONOMY' AND replace(lower(p_name), ' ', '') LIKE '%in%'""",
}
