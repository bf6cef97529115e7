"""Joins by blocks against loops; none of them may have Spark broadcast a side that nothing bounds."""

import math
import random

import numpy as np
import pytest

from waymark.catalogue_parts import movement, places
from waymark.operators import blocks, footprints, raster

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_segments_against_a_loop():
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 60, (2, 300))
    seg = np.vstack([a, a + rng.uniform(-9, 9, (2, 300))])
    seg[:, 200:250] = seg[:, 100:150]
    rank = np.arange(300) % 250
    x, y = np.r_[rng.uniform(-20, 80, 500), np.full(40, 7.0)], np.r_[rng.uniform(-20, 80, 500), np.full(40, 9.0)]
    best, d, qx, qy = blocks.nearest_segments(x, y, seg, rank, 6.0, work=200)
    for i in range(len(x)):
        off, nx, ny = blocks.gaps(x[i], y[i], seg)
        want = min(zip(off, rank, nx, ny, strict=True))
        if want[0] <= 6.0:
            assert (d[i], rank[best[i]], qx[i], qy[i]) == want
        else:
            assert best[i] == -1 and math.isnan(d[i])


@pytest.mark.parametrize("name", ["nearest_boundary", "entrance_owners"])
def test_boundaries_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(getattr(places, name)(spark, SF))


def test_a_full_block_is_dealt_into_parts(spark):
    rng = random.Random(5)
    points = spark.createDataFrame([(i, rng.uniform(0, 8), rng.uniform(0, 8)) for i in range(90)], "point long, x double, y double")
    shapes = spark.createDataFrame([(7, 0, 0), (8, 5, 5)], "fid long, bx long, by long")
    own, their = blocks.meet(points, shapes, 8.0, most=20)
    assert own.count() == 90 and own.select("part").distinct().count() > 1
    assert sorted((r.fid, r.part) for r in their.collect()) == [(7, k) for k in range(5)]


def test_owner_of_an_entrance_by_node_or_place(spark):
    doors = spark.createDataFrame([(1, 5, 0.0, 0.0), (2, 6, 1.0, 0.0), (3, None, 90.0, 90.0)], "entrance long, node long, x double, y double")
    ring = [{"x": x, "y": y} for x, y in ((1.5, -4.0), (9.0, -4.0), (9.0, 4.0), (1.5, 4.0))]
    prints = spark.createDataFrame([(4, ring, [5, 5]), (3, ring, [])], "fid long, ring array<struct<x:double,y:double>>, nodes array<long>")
    got = {tuple(r) for r in footprints.entrance_owners(doors, prints, 2.0).collect()}
    assert got == {(1, 4, 0.0, 0.0), (2, 3, 1.5, 0.0)}


def test_equal_areas_go_by_the_lesser_fid(spark):
    """Rings of one size, whose areas differ by rounding alone."""
    rng = random.Random(11)
    places_ = [(fid, rng.randrange(1000) + 0.3, rng.randrange(1000) + 0.3) for fid in range(3000)]
    rings = [(fid, [{"x": x - 40.5, "y": y}, {"x": x, "y": y + 40.5}, {"x": x + 40.5, "y": y}, {"x": x, "y": y - 40.5}]) for fid, x, y in places_]
    prints = spark.createDataFrame(rings, "fid long, ring array<struct<x:double,y:double>>")
    asks = [(k, float(rng.randrange(1000)), float(rng.randrange(1000))) for k in range(200)]
    got = dict(raster.containing_footprint(spark.createDataFrame(asks, "point long, x double, y double"), prints, 50.0).collect())
    want = {k: min((fid for fid, u, v in places_ if abs(x - u) + abs(y - v) < 40.5), default=None) for k, x, y in asks}
    assert got == {k: fid for k, fid in want.items() if fid is not None}


def test_smallest_ring_around_against_a_loop():
    rng = np.random.default_rng(8)
    size = rng.integers(1, 9, 150)
    start = np.cumsum(size) - size
    middle = rng.uniform(0, 40, (2, 150))
    x, y = [np.repeat(m, size) + rng.uniform(-8, 8, size.sum()) for m in middle]
    px, py = rng.uniform(-5, 45, (2, 400))
    found = blocks.smallest_around(px, py, x, y, start, size, some=8, work=100)
    for i in range(400):
        holds = []
        for k in range(150):
            u, v = x[start[k] : start[k] + size[k]], y[start[k] : start[k] + size[k]]
            odd = False
            for j in range(size[k]):
                a, b = j, (j + 1) % size[k]
                if (v[a] > py[i]) != (v[b] > py[i]) and px[i] < (u[b] - u[a]) * (py[i] - v[a]) / (v[b] - v[a]) + u[a]:
                    odd = not odd
            holds.append(odd)
        assert found[i] == (holds.index(True) if True in holds else -1)


def test_footprints_around_are_not_broadcast(spark):
    assert "Broadcast" not in plan(movement.point_in_polygon(spark, SF))
