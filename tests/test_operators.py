import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.functions import polyline
from waymark.operators import graph, requests, schedule, terrain, tracks
from waymark.operators.changes import snapshot_diff
from waymark.operators.components import connected_components
from waymark.plans.campus import Rules, Weights
from waymark.plans import store
from waymark.plans.store import Store
from waymark.streaming import streams


MT = "request long, ord long, course long, mpos int, day int, s int, e int, building int"


def _meetings(rng, requests, courses, per, step=1):
    """Rows of meetings at any minute; some sections have none, some lie at an unknown place."""
    rows, sec, ordinal = [], [], 0
    for r in range(requests):
        for c in range(courses):
            for _ in range(rng.randint(1, per)):
                sec.append((r, c, ordinal))
                for m in range(rng.choice([0, 1, 1, 2, 2])):
                    s = rng.randrange(480, 1100, step)
                    rows.append((r, ordinal, c, m, rng.randrange(5), s, s + rng.choice([11, 50, 75, 110]), rng.randrange(-1, 5)))
                ordinal += 1
    return sec, rows


def _enumerated(sec, rows, rules=Rules()):
    """request -> feasible combinations, fewest sections first; by trying all."""
    own = {o: [m for m in rows if m[1] == o] for _, _, o in sec}
    out = {}
    for r in sorted({r for r, _, _ in sec}):
        courses = {}
        for _, c, o in (x for x in sec if x[0] == r):
            courses.setdefault(c, []).append(o)
        kept = []
        for combo in itertools.product(*[sorted(courses[c]) for c in sorted(courses, key=lambda c: (len(courses[c]), c))]):
            ms = [m for o in combo for m in own[o]]
            clash = any(a[1] != b[1] and a[4] == b[4] and a[5] < b[6] and b[5] < a[6] for a, b in itertools.combinations(ms, 2))
            shut = any(m[4] in rules.free_days for m in ms)
            if rules.lunch:
                x, y, n = rules.lunch
                shut = shut or any(not any(all(m[4] != d or m[6] <= t or m[5] >= t + n for m in ms) for t in range(x, y - n + 1)) for d in range(7))
            if not clash and not shut:
                kept.append(combo)
        out[r] = kept
    return out


def _frames(spark, sec, rows):
    return spark.createDataFrame(sec, "request long, course long, ord long"), spark.createDataFrame(rows, MT)


@pytest.mark.parametrize("rules", [Rules(), Rules(free_days=(4,)), Rules(lunch=(690, 810, 60)), Rules(free_days=(0,), lunch=(600, 780, 47))])
def test_counts_and_enumeration_equal_trying_all(spark, rules):
    sec, rows = _meetings(random.Random(str(rules)), 6, 4, 4)
    want = _enumerated(sec, rows, rules)
    s, mt = _frames(spark, sec, rows)
    options = requests.choices(s, mt)
    assert {r.request: int(r.n) for r in requests.count_schedules(options, rules).collect()} == {r: len(c) for r, c in want.items()}
    got = {r.request: ([tuple(c) for c in r.combos], r.complete) for r in requests.capped_schedules(options, 7, rules).collect()}
    assert got == {r: (sorted(c)[:7], len(c) <= 7) for r, c in want.items()}
    if rules == Rules():
        conflicts = schedule.conflict_pairs(mt)
        assert conflicts.count() == conflicts.distinct().count()
        by_joins = [(r.request, tuple(r.combo)) for r in schedule.feasible_combos(s, conflicts).collect()]
        assert sorted(by_joins) == sorted((r, c) for r, cs in want.items() for c in cs)
    else:
        every = schedule.admitted(schedule.feasible_combos(s, schedule.conflict_pairs(mt)), mt, rules)
        assert sorted((r.request, tuple(r.combo)) for r in every.collect()) == sorted((r, c) for r, cs in want.items() for c in cs)


def test_meetings_off_the_grid():
    """592-603 and 603-650 touch but don't overlap."""
    rows = pd.DataFrame([(1, 0, [{"day": 0, "s": 592, "e": 603, "mpos": 0, "building": 1}]), (2, 1, [{"day": 0, "s": 603, "e": 650, "mpos": 0, "building": 1}])], columns=["course", "ord", "meetings"])
    assert requests.Request(rows).count() == 1 and requests.Request(rows).count([]) == 1
    assert requests.Request(rows.iloc[:0]).count() == 1 and requests.Request(rows.iloc[:0]).conflict_set() == []
    bare = pd.concat([rows, pd.DataFrame([(3, None, None)], columns=rows.columns)])
    assert requests.Request(bare).count() == 0 and requests.Request(bare).conflict_set() == [3] and list(requests.Request(bare).combos()) == []


@pytest.mark.parametrize("weights", [Weights(), Weights(1, 2, 10, 0), Weights(1, 0.5, 3, 0.25)])
def test_branch_and_bound_equals_joins(spark, weights):
    rng = random.Random(str(weights))
    sec, rows = _meetings(rng, 5, 4, 4)
    s, mt = _frames(spark, sec, rows)
    grid = spark.createDataFrame([(a, b, float(rng.randrange(1, 40)) if a != b else 0.0) for a in range(5) for b in range(5)], "a int, b int, minutes double")
    every = schedule.evaluate(schedule.feasible_combos(s, schedule.conflict_pairs(mt)), mt, grid, 0, weights).cache()
    want = {(r.request, r.rank): (tuple(r.combo), round(r.cost, 6), round(r.travel, 6), round(r.late, 6), round(r.gap, 6), r.days) for r in schedule.top_k(every, 4).collect()}
    found = requests.best_schedules(requests.choices(s, mt), grid, 0, 4, weights).collect()
    got = {(r.request, b.rank): (tuple(b.combo), round(b.cost, 6), round(b.travel, 6), round(b.late, 6), round(b.gap, 6), b.days) for r in found for b in r.best}
    assert got == want
    more = {(r.request, b.rank): tuple(b.combo) for r in requests.best_schedules(requests.choices(s, mt), grid, 0, 9, weights).collect() for b in r.best}
    assert all(more[k] == v[0] for k, v in got.items())
    if not weights.gap:
        assert sum(r.by_bound for r in found) > 0


def test_bounds(spark):
    """No tour is shorter than Held-Karp's, no spanning tree longer; a room that is unknown may be anywhere."""
    rng = random.Random(4)
    sec, rows = _meetings(rng, 4, 4, 3)
    rows += [(9, 900, 0, 0, 0, 500, 550, 1), (9, 901, 0, 0, 1, 500, 550, -1)]
    sec += [(9, 0, 900), (9, 0, 901)]
    s, mt = _frames(spark, sec, rows)
    minutes = {(a, b): float(rng.randrange(1, 60)) if a != b else 0.0 for a in range(5) for b in range(5)}
    for k, a, b in itertools.product(range(5), repeat=3):
        minutes[a, b] = min(minutes[a, b], minutes[a, k] + minutes[k, b])
    grid = spark.createDataFrame([(a, b, m) for (a, b), m in minutes.items()], "a int, b int, minutes double")
    exact, tree = [{r.request: r.bound for r in requests.tour_bounds(requests.choices(s, mt), grid, 0, n).collect()} for n in (12, 0)]
    for r in sorted({x[0] for x in sec}):
        rooms = [{0}]
        for c in sorted({c for q, c, _ in sec if q == r}):
            own = [[m[7] for m in rows if m[1] == o and m[7] >= 0] for q, k, o in sec if (q, k) == (r, c)]
            rooms.append({b for bs in own for b in bs} if all(own) else None)
        d = [[0.0 if i == j or x is None or y is None else min(min(minutes[a, b], minutes[b, a]) for a in x for b in y) for j, y in enumerate(rooms)] for i, x in enumerate(rooms)]
        tours = [sum(d[a][b] for a, b in zip((0, *p), (*p, 0), strict=True)) for p in itertools.permutations(range(1, len(rooms)))]
        assert abs(exact[r] - min(tours)) < 1e-9 and tree[r] <= exact[r] + 1e-9
    assert exact[9] == 0


def test_why_none(spark):
    rows = [(0, 0, 0, 0, 0, 540, 600, 1), (0, 1, 1, 0, 0, 570, 630, 1), (1, 2, 0, 0, 0, 540, 600, 1)]
    s, mt = _frames(spark, [(0, 0, 0), (0, 1, 1), (1, 0, 2)], rows)
    say = lambda rules: {r.request: (r.cause, r.courses) for r in requests.explain(requests.choices(s, mt), rules).collect()}
    assert say(Rules()) == {0: ("overlap", [0, 1]), 1: ("none", [])}
    assert say(Rules(free_days=(0,)))[1] == ("free_days", [0]) and say(Rules(lunch=(540, 600, 60)))[1] == ("lunch", [0])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    out = connected_components(spark.createDataFrame(edges, "u long, v long"), Store(spark, "t"), "c")
    assert {r.node: r.root for r in out.collect()} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Store(spark, "t"), "c").count() == 0


def test_components_in_one_task_are_those_of_the_rounds(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(5000 - i, 5001 - i) for i in range(70)] + [(9, 9)]
    frame = spark.createDataFrame(edges, "u long, v long")
    one, rounds = (sorted(map(tuple, connected_components(frame, Store(spark, "t"), "c", most=most).collect())) for most in (len(edges), 0))
    assert one == rounds and len(one) == len({x for e in edges if e[0] != e[1] for x in e})
    assert sorted(map(tuple, connected_components(frame, Store(spark, "t"), "c", most=5).collect())) == one  # beyond the bound
    assert connected_components(frame.limit(0), Store(spark, "t"), "c", most=5).count() == 0


def test_store_returns_the_drivers_freed_memory(spark, monkeypatch):
    said = []
    monkeypatch.setattr(store, "release", lambda s, release=store.release: said.append(release(s)))
    held = Store(spark, "t")
    tables = [held.put(spark.range(k + 1), f"t{k}") for k in range(2 * store.RELEASE_AFTER + 1)]
    assert [t.count() for t in tables] == [*range(1, len(tables) + 1)]
    assert len(said) == 2 and all("Trim native heap" in x for x in said)
    # Where the JVM has no such command, a store goes on.
    monkeypatch.setattr(store, "COMMAND", "noSuchCommand")
    assert store.release(spark) is None and held.put(spark.range(3), "last").count() == 3


def test_polyline_roundtrip_and_known_value():
    points = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert polyline.encode(points) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert np.allclose(polyline.decode(polyline.encode(points)), points)
    line = np.array([[0, 0], [1, 0.1], [2, 0], [3, 5]], float)
    assert polyline.simplify(line, 0.5).tolist() == [0, 2, 3]


def test_closed_nodes_end_paths(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)], "a long, b long, cost double")
    got = {r.node: r.cost for r in graph.shortest_paths(edges, spark.createDataFrame([(0,)], "source long"), closed=[1]).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 5.0}


def test_isotonic_and_matching(spark):
    rows = spark.createDataFrame([("a", float(i), v, 1.0) for i, v in enumerate([1.0, 3.0, 2.0, 4.0])], "w string, t double, v double, m double")
    assert [r.fitted for r in tracks.isotonic(rows, "w", "t", "v", "m").orderBy("t").collect()] == [1.0, 2.5, 2.5, 4.0]
    points = spark.createDataFrame([("a", float(i), float(i), 0.5) for i in range(5)], "walk string, t double, x double, y double")
    out = tracks.map_match(points, np.array([[0.0, 0.0], [10.0, 0.0]])).orderBy("t").collect()
    assert [round(r.s, 6) for r in out] == [0, 1, 2, 3, 4] and all(math.isclose(r.off, 0.5) for r in out)


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_equals_minimax(spark, seed):
    """The fit at i is the greatest over j <= i of the least over k >= i of the weighted mean of j..k."""
    rng = random.Random(seed)
    v, w = [rng.randrange(10) for _ in range(25)], [rng.choice([0.5, 1.0, 3.0]) for _ in range(25)]
    rows = spark.createDataFrame([("a", float(i), float(x), m) for i, (x, m) in enumerate(zip(v, w, strict=True))], "w string, t double, v double, m double")
    mean = lambda j, k: sum(a * b for a, b in zip(v[j : k + 1], w[j : k + 1], strict=True)) / sum(w[j : k + 1])
    want = [max(min(mean(j, k) for k in range(i, 25)) for j in range(i + 1)) for i in range(25)]
    assert np.allclose([r.fitted for r in tracks.isotonic(rows, "w", "t", "v", "m").orderBy("t").collect()], want)


def test_matching_keeps_to_the_branch(spark):
    """A line that comes back on itself: the walk goes on where it was, though the other branch is as near."""
    line = np.array([[0.0, 0.0], [100.0, 0.0], [100.0, 4.0], [0.0, 4.0]])
    points = spark.createDataFrame([("a", float(i), 10.0 * i + 5, 1.0 + i % 3) for i in range(9)], "walk string, t double, x double, y double")
    out = tracks.map_match(points, line).orderBy("t").collect()
    assert np.allclose([r.s for r in out], [10.0 * i + 5 for i in range(9)]) and np.allclose([r.off for r in out], [1.0 + i % 3 for i in range(9)])
    alone = tracks.map_match(points.where("t = 8"), line, slack=0.5).first()
    assert math.isclose(alone.s, 104 + 15) and math.isclose(alone.off, 1.0)


def _kept(points, tolerance):
    """Douglas-Peucker by recursion."""
    if len(points) < 3:
        return [True] * len(points)
    a, b = points[0], points[-1]
    d, n = b - a, np.hypot(*(b - a))
    off = [abs(d[0] * (p - a)[1] - d[1] * (p - a)[0]) / n if n else np.hypot(*(p - a)) for p in points[1:-1]]
    k = int(np.argmax(off)) + 1
    if off[k - 1] <= tolerance:
        return [True] + [False] * (len(points) - 2) + [True]
    return _kept(points[: k + 1], tolerance)[:-1] + _kept(points[k:], tolerance)


def test_simplified_lines_equal_recursion():
    rng = np.random.default_rng(3)
    lines = [rng.integers(0, 30, (n, 2)).astype(float) for n in (1, 2, 3, 40, 7, 90)] + [np.zeros((5, 2)), np.array([[0, 0], [3, 4], [0, 0.0]])]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    for tolerance in (0.0, 1.0, 6.0):
        got = polyline.simplified(np.concatenate(lines), first, tolerance)
        assert got.tolist() == [k for x in lines for k in _kept(x, tolerance)]


def test_profiles_equal_each_edge_alone():
    rng = np.random.default_rng(9)
    s = [np.sort(rng.uniform(0, length, n)) for length, n in ((5, 2), (100, 30), (70, 9), (0, 1), (300, 50))]
    z = [rng.uniform(0, 10, len(x)) for x in s]
    rows = terrain.Profiles(s, z)
    edge, wide, grade = rows.pieces(30.0, 2.0)
    for i, (a, h) in enumerate(zip(s, z, strict=True)):
        a = a - a[0]
        n = max(1, math.ceil(a[-1] / 2.0))
        assert (edge == i).sum() == n and np.allclose(wide[edge == i], a[-1] / n)
        for k, g in enumerate(grade[edge == i]):
            low, high = max(0, (k + 0.5) * a[-1] / n - 15), min(a[-1], (k + 0.5) * a[-1] / n + 15)
            assert math.isclose(g, (np.interp(high, a, h) - np.interp(low, a, h)) / (high - low) if high > low else 0.0, abs_tol=1e-9)
        far = [(j, next((k for k in range(len(a)) if a[k] >= a[j] + 30 - 1e-9), None)) for j in range(len(a))]
        steep = [abs((h[k] - h[j]) / (a[k] - a[j])) for j, k in far if k is not None] or [abs(h[-1] - h[0]) / max(a[-1], 1e-9)]
        assert math.isclose(rows.steepest(30.0)[i], max(steep), abs_tol=1e-9)
        assert math.isclose(rows.climbs()[0][i], np.maximum(np.diff(h), 0).sum(), abs_tol=1e-9)


def test_diff_of_equal_snapshots_is_empty(spark):
    a = spark.createDataFrame([(1, "x", None)], "key int, f string, g string")
    assert snapshot_diff(a, a, "key", ["f", "g"]).count() == 0


def test_change_stream_equals_batch(spark, tmp_path):
    schema = "key int, f string, semester string"
    for i, rows in enumerate([[(1, "a", "s1"), (2, "b", "s1")], [(1, "a", "s1"), (2, "c", "s1"), (3, "d", "s1")], [(1, "a", "s2")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"new{i}"))
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        part = next((tmp_path / f"new{i}").glob("*.parquet"))
        part.rename(source / f"{i}.parquet")
        q = streams.change_capture(spark.readStream.schema(schema).parquet(str(source)), "key", ["f"], str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((r.label, r.batch, r.key, r.op) for r in out.select("label", "batch", "key", "op").collect())
    assert got == [("s1", 0, 1, "created"), ("s1", 0, 2, "created"), ("s1", 1, 2, "updated"), ("s1", 1, 3, "created"), ("s2", 2, 1, "created")]


def test_streamed_windows_equal_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = streams.windowed_counts(streams.read_events(spark, str(tmp_path / "ev"), ev.schema), "1 hour", late="400 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.begins, r.n) for r in ev.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "n").toDF("begins", "n").collect()}
    assert {(r.begins, r.n) for r in spark.table("win").collect()} == want


def test_fullest_copy_stream(spark, tmp_path):
    spark.createDataFrame([("w", "x"), ("w", "y"), ("w", "y")], "walk string, file string").write.parquet(str(tmp_path / "p"))
    q = streams.fullest_copies(spark.readStream.schema("walk string, file string").parquet(str(tmp_path / "p"))).writeStream.format("memory").queryName("full").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("full").collect()] == [("w", "y", 2)]
