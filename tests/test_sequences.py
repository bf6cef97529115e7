"""Queries that SQL can't express, each against a loop over the collected rows; rings, pieces and places by hand."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.catalogue_parts import extras, schedules
from waymark.functions import geo, hangul
from waymark.functions import text as X
from waymark.operators import catalog, doorways, elevation, footprints, graph, patches, schedule, search, stats
from waymark.plans.campus import Rules
from waymark.sources import sinks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def walks(spark):
    out = {}
    for r in extras._walk(spark, SF).collect():
        out.setdefault(r.who, []).append((r.t, r.s, r.v))
    return {w: sorted(rows) for w, rows in out.items()}


def test_isotonic_speed(spark, walks):
    got = {}
    for r in extras.isotonic_speed(spark, SF).collect():
        got.setdefault(r.who, []).append((r.t, r.fitted))
    for who, rows in walks.items():
        if len({t for t, _, _ in rows}) < len(rows):
            continue
        v = [x for _, _, x in rows]
        means = np.array([[np.mean(v[j : k + 1]) if j <= k else np.nan for k in range(len(v))] for j in range(len(v))])
        want = [max(np.nanmin(means[j, i:]) for j in range(i + 1)) for i in range(len(v))]
        assert np.allclose([f for _, f in sorted(got[who])], want)


def test_matched_track(spark, walks):
    line = [(0.0, 0.0), (200.0, 10.0), (500.0, 0.0)]
    got = {}
    for r in extras.matched_track(spark, SF).collect():
        got.setdefault(r.walk, []).append((r.t, r.s, r.off))
    for who, rows in walks.items():
        if len({t for t, _, _ in rows}) < len(rows):
            continue
        here, want = None, []
        for t, s, v in rows:
            x, y, at, places = s % 500, v % 40, 0.0, []
            for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
                size = math.hypot(bx - ax, by - ay)
                u = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size**2))
                places.append((math.hypot(ax + u * (bx - ax) - x, ay + u * (by - ay) - y), at + u * size))
                at += size
            near = [p for p in places if p[0] <= min(places)[0] + 8]
            off, here = min(near) if here is None else min(near, key=lambda p: abs(p[1] - here))
            want.append((t, here, off))
        assert np.allclose(sorted(got[who]), want)


def test_dwell_spans(spark, walks):
    got = {}
    for r in extras.dwell_spans(spark, SF).collect():
        got.setdefault(r.who, []).append((r.begin_s, r.end_s))
    for who, rows in list(walks.items())[:5]:
        rows = sorted((t % 7200, s) for t, s, _ in rows)
        t, s = [r[0] for r in rows], [r[1] for r in rows]
        if len(set(t)) < len(t):
            continue
        spans = []
        for k in range(int(t[-1] - t[0] - 20) + 1):
            at = t[0] + k
            if at <= t[-1] - 20 and np.interp(at + 20, t, s) - np.interp(at, t, s) < 4:
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = at + 20
                else:
                    spans.append([at, at + 20])
        assert np.allclose(sorted(got.get(who, [])), spans)


def test_chunk_times(spark, walks):
    got = {}
    for r in extras.chunk_times(spark, SF).collect():
        got.setdefault(r.who, []).append((r.chunk, r.from_s, r.to_s, r.seconds))
    for who, rows in walks.items():
        chunks = sorted(got[who])
        top = max(s for _, s, _ in rows)
        assert math.isclose(chunks[0][1], rows[0][1]) and math.isclose(chunks[-1][2], top)
        assert all(math.isclose(a[2], b[1]) for a, b in zip(chunks, chunks[1:], strict=False))
        assert all(math.isclose(c[2] - c[1], 50) for c in chunks[:-1]) and (len(chunks) == 1 or 25 - 1e-9 <= chunks[-1][2] - chunks[-1][1] < 75)
        high, when = -1.0, {}
        for t, s, _ in rows:
            if s > high:
                high = s
                when[s] = t
        assert all(math.isclose(c[3], np.interp(c[2], list(when), list(when.values())) - np.interp(c[1], list(when), list(when.values())), abs_tol=1e-6) for c in chunks)


def test_samples_of_requests(spark):
    every = {(r.request, r.combo) for r in schedules.feasible_combos(spark, SF).collect()}
    got = [(r.request, r.combo) for r in extras.rejection_sample(spark, SF).collect()]
    assert set(got) <= {(r, c) for r, c in every} and max(sum(r == k for r, _ in got) for k in {r for r, _ in got}) <= 20
    drawn = extras.weighted_bundles(spark, SF).collect()
    for g in {r.cohort for r in drawn}:
        own = sorted(r.draw for r in drawn if r.cohort == g)
        assert own == list(range(1, len(own) + 1)) and len({r.item for r in drawn if r.cohort == g}) == len(own) <= 3


def test_tree_bound_is_no_more_than_the_tour(spark):
    tree = {r.request: r.bound for r in schedules.tree_lower_bound(spark, SF).collect()}
    tour = {r.request: r.bound for r in schedules.tsp_lower_bound(spark, SF).collect()}
    assert all(0 <= tree[r] <= tour[r] + 1e-6 for r in tour if r in tree) and set(tour) <= set(tree)


def test_name_keys(spark):
    names = dict(spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name").collect())
    for r in extras.name_keys(spark, SF).collect():
        assert r.key == hangul.norm_key(names[r.p_partkey]) and r.mask == hangul.mask(r.key) and r.typed == hangul.from_qwerty(names[r.p_partkey])


def test_ranked_search_needs_every_word(spark):
    """Its results are those whose name has both words as typed, in order, with gaps or not; a search per word has them all."""
    p = spark.read.parquet(f"{SF}/part.parquet")
    courses = p.select(F.concat(F.lit("P"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("dept"), F.array("p_brand").alias("profs"), F.array(F.lit("001")).alias("section_nos"))
    index = search.build_index(courses)
    both = {r.id for r in extras.ranked_search(spark, SF).collect()}
    assert both <= {r.id for r in search.search(index, "red ").collect()}
    plain = {r.id for r in courses.where("lower(name) LIKE '%red%' AND lower(name) LIKE '%wid%'").collect()}
    assert plain <= both
    places = [r.place for r in index.orderBy("place").collect()]
    assert places == list(range(1, len(places) + 1))


def _square(fid, x, y, r, **more):
    return {"fid": fid, "ring": [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)], **more}


def _rings(spark, rows, *more):
    return spark.createDataFrame([(d["fid"], d["ring"], *[d[m] for m, _ in more]) for d in rows], ", ".join(["fid long", "ring array<struct<x:double,y:double>>", *[f"{m} {t}" for m, t in more]]))


def test_pieces_of_sheets_are_joined(spark):
    rows = [_square(1, 0.0, 0.0, 5.0, sheet=1), _square(2, 10.1, 0.0, 5.0, sheet=2), _square(3, 20.2, 0.0, 5.0, sheet=2), _square(4, 0.0, 10.9, 5.0, sheet=2), _square(5, 9.6, 9.6, 5.0, sheet=1)]
    got = {r.fid: r.whole for r in footprints.joined_pieces(_rings(spark, rows, ("sheet", "int"))).collect()}
    # 2 touches 1 along ten metres; 3 is of 2's sheet; 4 is 0.9 m off; 5 overlaps 2's corner, of another sheet.
    assert got[1] == got[2] == 1 and got[3] == 3 and got[4] == 4


def test_rings_and_holes(spark):
    ways = spark.createDataFrame([(1, 10, [1, 2, 3]), (1, 11, [5, 4, 3]), (1, 12, [5, 6, 1]), (1, 13, [7, 8, 9, 7]), (1, 14, [20, 21]), (2, 15, [1, 2]), (2, 16, None)], "relation long, way long, nodes array<long>")
    got = sorted((r.relation, r.ring) for r in footprints.assembled_rings(ways).collect())
    assert got == [(1, [1, 2, 3, 4, 5, 6, 1]), (1, [7, 8, 9, 7])]
    outer = _rings(spark, [_square(1, 0.0, 0.0, 50.0), _square(2, 0.0, 0.0, 20.0)])
    inner = _rings(spark, [_square(8, 0.0, 0.0, 5.0), _square(9, 40.0, 40.0, 2.0), _square(10, 400.0, 40.0, 2.0)]).withColumnRenamed("fid", "hole")
    assert {r.hole: r.fid for r in footprints.holes(inner, outer, 30.0).collect()} == {8: 2, 9: 1, 10: None}


def test_number_conflicts(spark):
    rows = spark.createDataFrame([("59-1", ["59"]), ("59-1", ["60"]), ("59", []), ("59", ["60", "59-2"])], "b string, refs array<string>")
    assert [r.c for r in rows.select(footprints.number_conflict(F.col("b"), F.col("refs")).alias("c")).collect()] == [False, True, False, False]


def test_routes_begin_and_end_at_doors_but_don_t_pass_them(spark):
    """Places A and B each have doors; C's door would be a short cut between them."""
    both = [(1, 2, 1.0), (2, 9, 1.0), (9, 3, 1.0), (2, 4, 5.0), (4, 3, 5.0), (3, 5, 1.0)]
    edges = spark.createDataFrame(both + [(b, a, c) for a, b, c in both], "a long, b long, cost double")
    access = spark.createDataFrame([("A", 1, 0.0, 0.0), ("A", 4, 30.0, 30.0), ("B", 5, 0.0, 0.0), ("C", 9, 0.0, 0.0)], "place string, node long, leave double, arrive double")
    doors = spark.createDataFrame([(1,), (5,), (9,)], "node long")
    got = {(r.source, r.target): (r.cost, r.nodes) for r in graph.routes(edges, access, doors).collect()}
    assert got["A", "B"] == (12.0, [1, 2, 4, 3, 5]) and got["A", "C"] == (2.0, [1, 2, 9]) and got["C", "B"] == (2.0, [9, 3, 5]) and len(got) == 6
    with pytest.raises(ValueError, match="edges"):
        graph.network(edges, most=3)
    few = spark.createDataFrame([(1,), (77,)], "source long")
    plain, relaxed = [sorted((r.source, r.node, r.cost) for r in graph.shortest_paths(edges, few, [9], most=m).collect()) for m in (100, 3)]
    assert plain == relaxed


def test_ranks_and_quantiles(spark):
    values = [float(x % 37) for x in range(500)] + [None]
    rows = spark.createDataFrame([(x,) for x in values], "v double").repartition(7)
    s = stats.bundle_summary(rows, "v").first()
    known = sorted(v for v in values if v is not None)
    assert (s.n, s.median, s.q90, s.top_decile) == (500, np.quantile(known, 0.5), round(np.quantile(known, 0.9), 4), np.mean(known[-50:]))
    order = catalog.ranked(rows.where("v IS NOT NULL").withColumn("i", F.monotonically_increasing_id()), [F.col("v"), F.col("i")], "place").collect()
    assert [r.v for r in sorted(order, key=lambda r: r.place)] == known and sorted(r.place for r in order) == list(range(1, 501))


def test_small_texts(spark):
    row = spark.createDataFrame([("abcdef", [(3, 5), (0, 2), (1, 3), (6, 6)], "220-1>301", "R1:GATE-302", "a-b-c", "9-2", 4567, "title: part (x)")], "t string, r array<struct<a:long,b:long>>, p string, q string, n string, k string, c long, name string")
    got = row.select(
        X.merged_ranges(F.col("r")).alias("merged"), X.split_marks(F.col("t"), X.merged_ranges(F.col("r"))).alias("parts"), X.parse_pair(F.col("p")).alias("p"), X.parse_pair(F.col("q")).alias("q"), X.parse_pair(F.col("n")).alias("n"),
        X.padded_key(F.col("k"), 4).alias("k"), X.rough_count(F.col("c")).alias("c"), X.name_before_colon(F.col("name")).alias("name"), X.map_key(F.col("k")).alias("m"),
        catalog.place_within(F.lit(1.0), F.lit(2.0), F.lit(37.45), F.lit(126.95)).alias("place"), catalog.section_label(F.lit("001"), F.lit(" ")).alias("label"),
    ).first()
    assert [tuple(r) for r in got.merged] == [(0, 5)] and [tuple(r) for r in got.parts] == [("abcde", True), ("f", False)]
    assert tuple(got.p) == ("220-1→301", "220-1", "301") and tuple(got.q) == ("R1", "GATE", "302") and got.n is None
    assert got.k == "0009-0002" and got.c == 4000 and got.name == "title" and tuple(got.m) == (False, 9, "-2") and tuple(got.place) == (37.45, 126.95) and got.label == "001 (미정)"


def test_elevation_estimates(spark):
    sq = _rings(spark, [_square(1, 0.0, 0.0, 10.0)])
    buildings = spark.createDataFrame([("a", 0.0, 0.0), ("b", 100.0, 0.0), ("c", 500.0, 0.0)], "building string, x double, y double")
    picked = spark.createDataFrame([("a", 1), ("b", None), ("c", None)], "building string, fid long")
    at = elevation.ground_samples(buildings, picked, sq, step=1.0)
    assert {r["building"]: r["count"] for r in at.groupBy("building").count().collect()} == {"a": 80, "b": 24, "c": 24}
    levels = elevation.ground_levels(at.withColumn("z", F.when(F.col("x") < 300, F.col("x") * 0.2 + 50)))
    got = {r.building: r for r in levels.collect()}
    assert math.isclose(got["a"].mean, 50, abs_tol=1e-9) and got["a"].sloped and math.isclose(got["b"].mean, 70, abs_tol=1e-9) and got["c"].mean is None and got["c"].samples == 0
    doors = spark.createDataFrame([("a", "main", 50.2, None), ("a", "main", 50.9, " "), ("a", "side", 46.0, "B2"), ("b", "side", 70.0, None), ("b", "side", 75.0, None)], "building string, kind string, ground double, checked string")
    floors = elevation.entrance_floors(doors, levels)
    assert sorted((r.building, r.floor) for r in floors.collect()) == [("a", "1층"), ("a", "1층"), ("a", "B2"), ("b", "1층"), ("b", "2층")]
    out = {r.building: r for r in elevation.estimates(buildings, levels, floors).collect()}
    assert (out["a"].lobby_source, out["a"].multi_level) == ("main", True) and math.isclose(out["a"].lobby, 50.55)
    assert out["b"].lobby is None and "lobby_open_heights_differ" in out["b"].notes and out["c"].notes == ["no_height"] and out["c"].entrances == 0


def test_patches_join_graphs(spark):
    nodes = spark.createDataFrame([("g", 0, 0.0, 0.0), ("g", 1, 100.0, 0.0), ("h", 5, 0.0, 0.0)], "graph string, node long, x double, y double")
    edges = spark.createDataFrame([("g", 0, 1, "road")], "graph string, a long, b long, kind string")
    path = lambda p, *at: [("g", p, i, float(x), float(y), "foot") for i, (x, y) in enumerate(at)]
    rows = path(1, (0.4, 0.3), (20, 30), (50, 10)) + path(2, (50.1, 10.1), (60, 40)) + path(3, (60, 48), (60, 90)) + path(4, (500, 500), (510, 500))
    out = patches.apply_patches(nodes, edges, spark.createDataFrame(rows, "graph string, path long, i int, x double, y double, kind string")).collect()
    assert len(out) == 1 and out[0].free == [2, 3, 4] or out[0].free == [3, 4]
    made = [(e.a, e.b, e.path, e.from_a, e.from_b) for e in out[0].edges]
    at = {n.node: (n.x, n.y) for n in out[0].nodes} | {0: (0.0, 0.0), 1: (100.0, 0.0)}
    linked = {n: {b for a, b, *_ in made if a == n} | {a for a, b, *_ in made if b == n} for n in at}
    # Path 1 begins at node 0 (0.5 m off) and shares a point with path 2; path 3's lower end is 8 m from path 2's upper one.
    first = next(n for n, p in at.items() if p == (0.4, 0.3))
    assert 0 in linked[first] and sum(p == (50.0, 10.0) for p in at.values()) == 1 and not any(p == (50.1, 10.1) for p in at.values())
    reached, todo = set(), [0]
    while todo:
        n = todo.pop()
        if n not in reached:
            reached.add(n)
            todo += linked[n]
    assert {p for n, p in at.items() if n in reached} >= {(20.0, 30.0), (60.0, 40.0), (60.0, 48.0), (60.0, 90.0)} and not any(p[0] >= 500 for n, p in at.items() if n in reached)


def test_patch_splits_the_edge_it_joins():
    graph_ = patches.Patch({0: (0.0, 0.0), 1: (100.0, 0.0)}, iter([(0, 1, "road")]))
    assert graph_.lay({7: ("foot", np.array([[30.0, 5.0], [30.0, 60.0]])), 8: ("foot", np.array([[70.0, 4.0], [70.0, 50.0]]))}, 0.3, 1.0, 10.0) == [7, 8]
    feet = sorted(p for n, p in graph_.xy.items() if p[1] == 0.0)
    assert feet == [(0.0, 0.0), (30.0, 0.0), (70.0, 0.0), (100.0, 0.0)]
    pieces = [(a, b) for a, b, _, path, fa, fb in graph_.added if path is None]
    assert len(pieces) == 4 and all(x[4:] == (0, 1) for x in graph_.added if x[3] is None)


def test_packed_numbers_and_pages(spark):
    import base64

    got = spark.createDataFrame([([1, 258, 65535],), ([],)], "v array<long>").select(sinks.packed_numbers(F.col("v")).alias("p")).collect()
    assert np.frombuffer(base64.b64decode(got[0].p), "<u2").tolist() == [1, 258, 65535] and got[1].p == ""
    assert [schedule.page_size(n) for n in (0, 24, 30, 72, 168)] == [24, 72, 72, 168, 360]
    x, y = geo.local_xy(F.lit(37.461), F.lit(126.953), 37.46, 126.95)
    lat, lon = geo.from_local_xy(x, y, 37.46, 126.95)
    back = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert math.isclose(back.lat, 37.461, abs_tol=1e-9) and math.isclose(back.lon, 126.953, abs_tol=1e-9)


def test_request_documents(spark):
    import json

    legs = spark.createDataFrame([(1, [4, 5], 0, 1, 0, 3, 2.0), (1, [4, 5], 0, 2, 3, 0, 2.5)], "request long, combo array<long>, day int, leg long, from_b int, to_b int, minutes double")
    found = spark.createDataFrame([(1, 1, [4, 5], 4.5, 0.0, 4.5), (1, 2, [4, 6], 5.0, 0.0, 5.0)], "request long, rank long, combo array<long>, travel double, late double, cost double")
    places = spark.createDataFrame([(0, "home", 1.0, 2.0), (3, "three", 1.5, 2.5), (9, "nine", 0.0, 0.0)], "building int, name string, lat double, lon double")
    doc = json.loads(sinks.request_documents(legs, found, places, 0, {"semester": "2026-2"}).first().document)
    assert doc["home"] == 0 and doc["meta"] == {"semester": "2026-2"} and [t["rank"] for t in doc["timetables"]] == [1, 2] and [b["name"] for b in doc["buildings"]] == ["home", "three"]
    assert [leg["to_b"] for leg in doc["timetables"][0]["days"][0]["route"]] == [3, 0]


def test_sections_are_admitted_one_by_one(spark):
    ms = [{"mpos": 0, "day": 0, "s": 700, "e": 800, "building": 1}]
    rows = [(1, 0, 10, ms), (1, 0, 11, None), (1, 1, 12, ms), (2, 0, 13, ms), (2, 1, None, None)]
    options = spark.createDataFrame(rows, "request long, course long, ord long, meetings array<struct<mpos:int,day:int,s:int,e:int,building:int>>")
    keep = lambda rules: sorted(r.ord for r in schedule.admitted_sections(options, rules).collect())
    assert keep(Rules()) == [10, 11, 12] and keep(Rules(free_days=(0,))) == [] and keep(Rules(lunch=(690, 810, 60))) == []


def test_doors_reach_roads_round_buildings(spark):
    """A door in a building's south wall, a road north of it: the way goes round the corner and never through."""
    house = [{"fid": 1, "ring": [(-10.0, 0.0), (10.0, 0.0), (10.0, 8.0), (-10.0, 8.0)]}]
    doors_ = spark.createDataFrame([(1, 0.0, 0.0, 2, 30.0, 15.0), (2, 900.0, 900.0, 1, 5.0, 5.0)], "door long, x double, y double, max_links long, slack double, spacing double")
    roads = spark.createDataFrame([(7, -40.0, 20.0, 40.0, 20.0)], "edge long, x1 double, y1 double, x2 double, y2 double")
    got = sorted(doorways.door_links(doors_, _rings(spark, house), roads).collect(), key=lambda r: r.rank)
    assert [(r.door, r.rank, r.edge) for r in got] == [(1, 1, 7), (1, 2, 7)]
    yard = doorways.Yard(0.0, 0.0, 60.0, 1.0, [np.array(house[0]["ring"])], 2.0)
    shortest = math.hypot(10, 0) + math.hypot(0, 20)
    for r in got:
        line = [(p.x, p.y) for p in r.line]
        assert line[0] == (0.0, 0.0) and line[-1][1] == 20.0 and all(yard.sees(a, b) for a, b in zip(line, line[1:], strict=False))
        assert math.isclose(r.length, sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))) and r.length >= shortest - 3 and len(line) <= 5
    assert got[0].length <= got[1].length + 1e-9 and math.dist((got[0].line[-1].x, 20), (got[1].line[-1].x, 20)) >= 15
    assert not yard.free(yard.place(5.0, 4.0)) and yard.free(yard.place(0.0, 1.0)) and not yard.sees((-20.0, 4.0), (20.0, 4.0))


def test_no_squeezing_between_corners():
    """Two shut cells that touch at a corner leave no way between them."""
    yard = doorways.Yard(0.0, 0.0, 3.0, 1.0, [], 0.0)
    yard.shut[:] = True
    for c in ((3, 3), (4, 4)):
        yard.shut[c] = False
    far, _ = yard.ways((3, 3))
    assert np.isinf(far[4, 4])
    yard.shut[3, 4] = yard.shut[4, 3] = False
    assert math.isclose(yard.ways((3, 3))[0][4, 4], math.sqrt(2))
