"""Footprints, entrances, junctions and ways between buildings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.catalogue_parts.movement import _footprints, _points, _segments
from waymark.operators import footprints as B
from waymark.operators import graph as G
from waymark.plans import campus as C


def nearest_boundary(spark, sf):
    out = B.nearest_boundary(_points(spark, sf), _footprints(spark, sf), 12.0)
    return out.select("point", "fid", F.round("distance", 6).alias("distance"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _numbered(spark, sf) -> DataFrame:
    """Footprints in two layers; some bear the number of a building, some two, some none."""
    k = F.col("fid")
    refs = F.when(k % 4 == 0, F.array((k % 300).cast("string"))).when(k % 4 == 1, F.array(F.concat(k % 300, F.lit("-1")), (k % 7).cast("string"))).otherwise(F.array().cast("array<string>"))
    return _footprints(spark, sf).withColumn("layer", F.when(k % 3 == 0, "topo").otherwise("osm")).withColumn("refs", refs)


def picked_footprints(spark, sf):
    own = _points(spark, sf).where("point < 300").select(F.col("point").cast("string").alias("building"), "x", "y")
    return B.pick_footprints(own, _numbered(spark, sf))


def entrance_owners(spark, sf):
    k = F.col("point")
    doors = _points(spark, sf).select(k.alias("entrance"), (k % 700).alias("node"), "x", "y")
    prints = _footprints(spark, sf).withColumn("nodes", F.array(F.col("fid") % 50 * 10, F.col("fid") % 50 * 10 + 3))
    out = B.entrance_owners(doors, prints, 8.0)
    return out.select("entrance", "fid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _samples(spark, sf) -> DataFrame:
    k, i = F.col("c_custkey"), F.col("i")
    return C.table(spark, sf, "customer").select((k % 40).alias("edge"), k.alias("i"), (k * 37 % 1009 / 10.0).alias("x"), (k * 101 % 997 / 10.0).alias("y"), F.when(k % 97 != 0, (k % 13).cast("double")).alias("z"))


def _marks(spark, sf, rest) -> DataFrame:
    k = F.col("s_suppkey")
    return C.table(spark, sf, "supplier").where(k % 2 == rest).select((k * 53 % 1009 / 10.0 + 0.05).alias("x"), (k * 211 % 997 / 10.0 + 0.025).alias("y"))


def near_shares(spark, sf):
    return B.near_fraction(_samples(spark, sf), _marks(spark, sf, 0), 6.0).select("edge", F.round("share", 6).alias("share"))


def edge_surfaces(spark, sf):
    edges = spark.range(45).select(F.col("id").alias("edge"), (F.col("id") % 9 == 0).alias("tunnel"))
    return B.surfaces(edges, _samples(spark, sf), _marks(spark, sf, 0), _marks(spark, sf, 1), 3.0, 0.3)


def same_place_doors(spark, sf):
    k = F.col("s_suppkey")
    doors = C.table(spark, sf, "supplier").select(k.alias("id"), (F.floor(k / 3) * 7 + k % 3 * 0.02).alias("x"), (F.floor(k / 3) * 3.0).alias("y"), (k % 4).alias("max_links"), (k % 5).cast("double").alias("slack"), (k % 6).cast("double").alias("clear"))
    return B.same_place(doors).withColumn("ids", F.array_join("ids", ","))


def usable_paths(spark, sf):
    k = F.col("p_partkey")
    way = F.element_at(F.array(*map(F.lit, ("footway", "motorway", "steps", "corridor"))), (k % 4 + 1).cast("int"))
    bridge, tunnel = F.when(k % 3 == 0, "no").when(k % 3 == 1, "yes"), F.when(k % 5 == 0, "")
    return C.table(spark, sf, "part").select("p_partkey", B.usable_path(way, bridge, tunnel, F.lit(None).cast("string")).alias("usable"))


def perimeter_points(spark, sf):
    """How many samples a boundary has, their whole length and the mean place."""
    out = B.perimeter_samples(_footprints(spark, sf), 3.0)
    return out.groupBy("fid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 6).alias("length"), F.round(F.sum(F.col("x") * F.col("w")) / F.sum("w"), 6).alias("x"))


def junction_edges(spark, sf):
    nodes = _points(spark, sf).select(F.col("point").alias("node"), "x", "y")
    seg = _segments(spark, sf)
    out = G.junction_edges(G.split_edges(seg, G.nodes_on_edges(nodes, seg, 25.0, 0.3, 0.5)), seg)
    return out.select("a", "b", F.round("distance", 6).alias("distance"), "from_a", "from_b")


def piece_blocks(spark, sf):
    """Edges that stay when a block on an original closes its pieces, and one on a piece its original."""
    t = C.travel(spark, sf)
    origins = t.where("a < b AND (a + b) % 3 = 0").select("a", "b", ((F.col("a") + 1) % 25).alias("from_a"), ((F.col("b") + 2) % 25).alias("from_b"))
    blocks = t.where("minutes = 5").select("b", "a")
    return G.apply_blocks(t, blocks, origins).select("a", "b", "minutes")


def route_lines(spark, sf):
    t = C.travel(spark, sf)
    line = F.array(F.col("a"), F.lit(-1), F.col("b"))
    paths = t.where("a < b OR (a + b) % 4 = 0").select("a", "b", F.when(F.col("a") < F.col("b"), line).otherwise(F.array(F.col("a"), F.lit(-2), F.col("b"))).alias("line"))
    return G.route_lines(t.select("a", "b"), paths).select("a", "b", F.array_join("line", ",").alias("line"))


def kept_paths(spark, sf):
    t = C.travel(spark, sf)
    mid = F.when(F.col("a") % 2 == 0, 0).otherwise(F.when(F.col("a") < F.col("b"), 1).otherwise(2))
    return G.kept_paths(t.select("a", "b", F.array(F.col("a"), mid, F.col("b")).alias("line"))).select("a", "b", F.array_join("line", ",").alias("line"))


def _ways(spark, sf):
    edges = C.travel(spark, sf).where("minutes <= 6").select("a", "b", F.col("minutes").alias("cost"))
    k = F.col("n_nationkey")
    access = C.table(spark, sf, "nation").where("n_nationkey % 5 < 3").select(F.floor(k / 4).alias("place"), k.alias("node"), (k % 3).cast("double").alias("leave"), (k % 4).cast("double").alias("arrive"))
    return edges, access, C.table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(k.alias("node"))


def campus_routes(spark, sf):
    """The cheapest ways between places with several doors, none of them through a door of another place."""
    out = G.routes(*_ways(spark, sf))
    return out.select("source", "target", F.round("cost", 6).alias("cost"), (F.size("nodes") > 0).alias("way"))


def relaxed_paths(spark, sf):
    edges, _, _ = _ways(spark, sf)
    sources = C.buildings(spark, sf).where("building % 4 = 0").select(F.col("building").cast("long").alias("source"))
    return G.relaxed_paths(edges, sources).select("source", "node", "cost")


NAMES = """nearest_boundary picked_footprints entrance_owners near_shares edge_surfaces same_place_doors usable_paths perimeter_points junction_edges piece_blocks route_lines kept_paths campus_routes relaxed_paths""".split()
QUERIES = {n: globals()[n] for n in NAMES}

_PRINTS = """pts AS (SELECT c_custkey AS point, (c_custkey * 37 % 1009)::DOUBLE AS x, (c_custkey * 101 % 997)::DOUBLE AS y FROM customer),
        f AS (SELECT s_suppkey AS fid, (s_suppkey * 53 % 1009)::DOUBLE + 0.3 AS x0, (s_suppkey * 211 % 997)::DOUBLE + 0.3 AS y0, ((s_suppkey % 40) + 20)::DOUBLE AS r FROM supplier),
        c AS (SELECT fid, [[x0 - 0.8 - r + 0.0, y0], [x0, y0 + r + 0.2], [x0 + r + 0.2, y0], [x0, y0 - 0.8 - r]] AS p FROM f),
        s AS (SELECT fid, p[i + 1][1] AS x1, p[i + 1][2] AS y1, p[(i + 1) % 4 + 1][1] AS x2, p[(i + 1) % 4 + 1][2] AS y2 FROM c, range(4) r(i)),
        u AS (SELECT point, fid, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS u FROM pts, s),
        d AS (SELECT point, fid, min((sqrt(pow(x1 + u * dx - x, 2) + pow(y1 + u * dy - y, 2)), x1 + u * dx, y1 + u * dy)) AS q FROM u GROUP BY point, fid)"""
_SAMPLES = """sm AS (SELECT c_custkey % 40 AS edge, c_custkey * 37 % 1009 / 10.0::DOUBLE AS x, c_custkey * 101 % 997 / 10.0::DOUBLE AS y, CASE WHEN c_custkey % 97 <> 0 THEN 1 END AS z FROM customer),
        mk AS (SELECT s_suppkey % 2 AS side, s_suppkey * 53 % 1009 / 10.0::DOUBLE + 0.05 AS mx, s_suppkey * 211 % 997 / 10.0::DOUBLE + 0.025 AS my FROM supplier)"""
_WAYS = f"""{C.SQL_TRAVEL}, e AS (SELECT a, b, minutes AS cost FROM travel WHERE minutes <= 6)"""
ORACLE_SQL = {
    "nearest_boundary": f"WITH {_PRINTS} SELECT point, arg_min(fid, (q[1], fid)) AS fid, round(min((q[1], fid, q))[1], 6) AS distance, round(min((q[1], fid, q))[3][2], 6) AS x, round(min((q[1], fid, q))[3][3], 6) AS y FROM d WHERE q[1] <= 12 GROUP BY point",
    "picked_footprints": f"""WITH {_PRINTS.replace("FROM customer)", "FROM customer WHERE c_custkey < 300)")},
        n AS (SELECT fid, CASE WHEN fid % 3 = 0 THEN 'topo' ELSE 'osm' END AS layer, CASE fid % 4 WHEN 0 THEN [(fid % 300)::VARCHAR] WHEN 1 THEN [(fid % 300) || '-1', (fid % 7)::VARCHAR] ELSE [] END AS refs FROM f),
        m AS (SELECT point::VARCHAR AS b, d.fid, layer, refs, q[1] AS gap, (abs(p.x - (f.x0 + CASE WHEN p.x < f.x0 THEN 0 ELSE 0 END)) / CASE WHEN p.x < f.x0 THEN r + 0.8 ELSE r + 0.2 END + abs(p.y - f.y0) / CASE WHEN p.y < f.y0 THEN r + 0.8 ELSE r + 0.2 END) < 1 AS held,
                len(refs) > 0 AND len(list_filter(refs, lambda t: split_part(t, '-', 1) = point::VARCHAR)) = 0 AS conflict, (2 * r + 1) * (2 * r + 1) / 2 AS area FROM d JOIN n ON n.fid = d.fid JOIN f ON f.fid = d.fid JOIN pts p USING (point)),
        w AS (SELECT b, layer, conflict, fid, 'inside' AS how, CASE WHEN layer = 'topo' THEN 0 ELSE 1 END AS rank, area AS by_ FROM m WHERE held
              UNION ALL SELECT b, layer, conflict, fid, 'ref', CASE WHEN layer = 'topo' THEN 1 ELSE 0 END, CASE WHEN held THEN 0 ELSE gap END FROM m WHERE list_contains(refs, b) AND (held OR gap <= 80)
              UNION ALL SELECT b, layer, conflict, fid, 'near', 2, gap FROM m WHERE gap <= 20 AND NOT conflict),
        t AS (SELECT * FROM w WHERE layer = 'topo' QUALIFY row_number() OVER (PARTITION BY b ORDER BY rank, by_, fid) = 1), o AS (SELECT * FROM w WHERE layer = 'osm' QUALIFY row_number() OVER (PARTITION BY b ORDER BY rank, by_, fid) = 1),
        z AS (SELECT p.point::VARCHAR AS building, t.fid AS tf, t.how AS th, o.fid AS "of", o.how AS oh, CASE WHEN t.how IN ('inside', 'ref') AND NOT (coalesce(o.how, '') = 'ref' AND t.conflict) THEN 't' WHEN o.how IN ('inside', 'ref') THEN 'o' WHEN t.fid IS NOT NULL THEN 't' WHEN o.fid IS NOT NULL THEN 'o' END AS k
              FROM pts p LEFT JOIN t ON t.b = p.point::VARCHAR LEFT JOIN o ON o.b = p.point::VARCHAR)
        SELECT building, CASE k WHEN 't' THEN tf WHEN 'o' THEN "of" END AS fid, CASE k WHEN 't' THEN 'topo' WHEN 'o' THEN 'osm' END AS layer, CASE k WHEN 't' THEN th WHEN 'o' THEN oh END AS how FROM z""",
    "entrance_owners": f"""WITH {_PRINTS}, k AS (SELECT fid, unnest([fid % 50 * 10, fid % 50 * 10 + 3]) AS node FROM f), h AS (SELECT point, fid, x, y FROM pts JOIN k ON node = point % 700)
        SELECT point AS entrance, fid, round(x, 6) AS x, round(y, 6) AS y FROM h UNION ALL SELECT point, arg_min(fid, (q[1], fid)), round(min((q[1], fid, q))[3][2], 6), round(min((q[1], fid, q))[3][3], 6) FROM d WHERE q[1] <= 8 AND point NOT IN (SELECT point FROM h) GROUP BY point""",
    "near_shares": f"WITH {_SAMPLES} SELECT edge, round(avg(CASE WHEN EXISTS (SELECT 1 FROM mk WHERE side = 0 AND sqrt(pow(x - mx, 2) + pow(y - my, 2)) <= 6) THEN 1 ELSE 0 END), 6) AS share FROM sm GROUP BY edge",
    "edge_surfaces": f"""WITH {_SAMPLES}, h AS (SELECT edge, avg(CASE WHEN EXISTS (SELECT 1 FROM mk WHERE side = 0 AND sqrt(pow(x - mx, 2) + pow(y - my, 2)) <= 3) THEN 1 ELSE 0 END) AS under,
        avg(CASE WHEN EXISTS (SELECT 1 FROM mk WHERE side = 1 AND sqrt(pow(x - mx, 2) + pow(y - my, 2)) <= 3) THEN 1 ELSE 0 END) AS over_, count(*) FILTER (z IS NULL) AS holes FROM sm GROUP BY edge)
        SELECT e.edge, CASE WHEN e.edge % 9 = 0 THEN 'tunnel' WHEN under >= 0.3 THEN 'tunnel_osm' WHEN over_ >= 0.3 THEN 'bridge_osm' WHEN holes = 0 THEN 'ground' ELSE 'no_dem' END AS surface FROM range(45) e(edge) LEFT JOIN h ON h.edge = e.edge""",
    "same_place_doors": """SELECT min(s_suppkey) AS door, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS ids, min(s_suppkey % 4) AS max_links, min(s_suppkey % 5)::DOUBLE AS slack, max(s_suppkey % 6)::DOUBLE AS clear FROM supplier GROUP BY s_suppkey // 3""",
    "usable_paths": "SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 <> 1 AS usable FROM part",
    "perimeter_points": f"""WITH {_PRINTS.split("u AS")[0].rstrip().rstrip(",")}, l AS (SELECT fid, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS l, (x1 + x2) / 2 AS mid FROM s) SELECT fid, sum(ceil(l / 3))::BIGINT AS n, round(sum(l), 6) AS length, round(sum(l * mid) / sum(l), 6) AS x FROM l GROUP BY fid""",
    "junction_edges": """WITH pts AS (SELECT c_custkey AS point, (c_custkey * 37 % 1009)::DOUBLE AS x, (c_custkey * 101 % 997)::DOUBLE AS y FROM customer),
        seg AS (SELECT n_nationkey::BIGINT AS edge, (n_nationkey * 2 + 100000)::BIGINT AS a, (n_nationkey * 2 + 100001)::BIGINT AS b, (n_nationkey * 40)::DOUBLE AS x1, (n_nationkey * 17 % 300)::DOUBLE AS y1, (n_nationkey * 40 + 200)::DOUBLE AS x2 FROM nation),
        st AS (SELECT edge, a AS node, 0.0::DOUBLE AS p FROM seg UNION ALL SELECT edge, b, x2 - x1 FROM seg UNION ALL SELECT edge, point, x - x1 FROM pts, seg WHERE abs(y - y1) <= 0.3 AND x - x1 >= 0.5 AND x2 - x >= 0.5),
        w AS (SELECT edge, node AS a, lead(node) OVER v AS b, lead(p) OVER v - p AS distance, count(*) OVER (PARTITION BY edge) AS n FROM st WINDOW v AS (PARTITION BY edge ORDER BY p, node)),
        k AS (SELECT w.a, w.b, distance, seg.a AS from_a, seg.b AS from_b FROM w JOIN seg USING (edge) WHERE w.b IS NOT NULL AND n > 2 UNION ALL SELECT w.b, w.a, distance, seg.b, seg.a FROM w JOIN seg USING (edge) WHERE w.b IS NOT NULL AND n > 2)
        SELECT a, b, round(distance, 6) AS distance, from_a, from_b FROM k QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY distance, from_a, from_b) = 1""",
    "piece_blocks": f"""WITH {C.SQL_TRAVEL}, k AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM travel WHERE minutes = 5), g AS (SELECT a AS u, b AS v, least((a + 1) % 25, (b + 2) % 25) AS ou, greatest((a + 1) % 25, (b + 2) % 25) AS ov FROM travel WHERE a < b AND (a + b) % 3 = 0),
        z AS (SELECT u, v FROM k UNION SELECT g.u, g.v FROM g JOIN k ON k.u = ou AND k.v = ov UNION SELECT ou, ov FROM g JOIN k ON k.u = g.u AND k.v = g.v) SELECT a, b, minutes FROM travel WHERE NOT EXISTS (SELECT 1 FROM z WHERE u = least(a, b) AND v = greatest(a, b))""",
    "route_lines": f"""WITH {C.SQL_TRAVEL}, p AS (SELECT a, b FROM travel WHERE a < b OR (a + b) % 4 = 0) SELECT t.a, t.b, CASE WHEN p.a IS NOT NULL THEN t.a || CASE WHEN t.a < t.b THEN ',-1,' ELSE ',-2,' END || t.b WHEN q.a IS NOT NULL THEN t.a || CASE WHEN t.a > t.b THEN ',-1,' ELSE ',-2,' END || t.b END AS line
        FROM travel t LEFT JOIN p ON p.a = t.a AND p.b = t.b LEFT JOIN p q ON q.a = t.b AND q.b = t.a""",
    "kept_paths": f"""WITH {C.SQL_TRAVEL}, l AS (SELECT a, b, CASE WHEN a % 2 = 0 THEN 0 WHEN a < b THEN 1 ELSE 2 END AS m FROM travel)
        SELECT a, b, a || ',' || m || ',' || b AS line FROM l WHERE a < b UNION ALL SELECT y.a, y.b, y.a || ',' || y.m || ',' || y.b FROM l x JOIN l y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b AND x.m <> y.m""",
    "campus_routes": f"""WITH RECURSIVE {_WAYS}, acc AS (SELECT n_nationkey // 4 AS place, n_nationkey AS node, n_nationkey % 3 AS leave, n_nationkey % 4 AS arrive, n_nationkey % 3 = 0 AS door FROM nation WHERE n_nationkey % 5 < 3),
        p(place, node, cost, k) AS (SELECT place, node, min(leave)::DOUBLE, 0 FROM acc GROUP BY 1, 2 UNION ALL SELECT place, node, min(cost), k + 1 FROM (SELECT p.place, e.b AS node, p.cost + e.cost AS cost, p.k FROM p JOIN e ON e.a = p.node AND e.b % 3 <> 0 WHERE k < 24) GROUP BY place, node, k),
        d AS (SELECT place, node, min(cost) AS cost FROM p GROUP BY 1, 2),
        w AS (SELECT d.place AS source, acc.place AS target, d.cost + arrive AS cost FROM d JOIN acc ON acc.node = d.node WHERE d.place <> acc.place UNION ALL SELECT d.place, acc.place, d.cost + e.cost + arrive FROM d JOIN e ON e.a = d.node JOIN acc ON acc.node = e.b AND acc.door WHERE d.place <> acc.place)
        SELECT source, target, round(min(cost), 6) AS cost, true AS way FROM w GROUP BY 1, 2""",
    "relaxed_paths": f"""WITH RECURSIVE {_WAYS}, p(source, node, cost, k) AS (SELECT building, building, 0::DOUBLE, 0 FROM bld WHERE building % 4 = 0 UNION ALL SELECT source, node, min(cost), k + 1 FROM (SELECT p.source, e.b AS node, p.cost + e.cost AS cost, p.k FROM p JOIN e ON e.a = p.node WHERE k < 24) GROUP BY source, node, k)
        SELECT source::BIGINT AS source, node::BIGINT AS node, min(cost) AS cost FROM p GROUP BY 1, 2""",
}
