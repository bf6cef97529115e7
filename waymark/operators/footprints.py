"""Footprints of buildings: which one a point belongs to, by number, by containment and by distance to the boundary.

Spatial joins are equi-joins on grid cells: a boundary's segment lists the cells of its box, widened by the reach, and a
point is in one cell. Footprints are (fid, ring array<struct<x, y>>), rings closed or not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.functions import geo
from waymark.operators import blocks
from waymark.operators.components import connected_components
from waymark.plans.store import Store


def cells(low: Column, high: Column, reach: float, cell: float) -> Column:
    return F.sequence(F.floor((F.least(low, high) - reach) / cell), F.floor((F.greatest(low, high) + reach) / cell))


def boundary(footprints: DataFrame, *keep: str) -> DataFrame:
    """(fid, keep..., x1, y1, x2, y2): the segments of every ring, the closing one among them."""
    n = F.size("ring")
    corner = lambda i: F.get("ring", i)
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(corner(i)["x"].alias("x1"), corner(i)["y"].alias("y1"), corner((i + 1) % n)["x"].alias("x2"), corner((i + 1) % n)["y"].alias("y2")))
    return footprints.where(n > 0).select("fid", *keep, F.explode(parts).alias("s")).select("fid", *keep, "s.*").where("x1 <> x2 OR y1 <> y2")


def to_segment(x: Column, y: Column) -> Column:
    """struct<distance, x, y>: from (x, y) to the segment (x1, y1, x2, y2) of the row, and the nearest point of it."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / (dx * dx + dy * dy)))
    qx, qy = F.col("x1") + u * dx, F.col("y1") + u * dy
    return F.struct(F.hypot(qx - x, qy - y).alias("distance"), qx.alias("x"), qy.alias("y"))


def boundary_distances(points: DataFrame, footprints: DataFrame, reach: float) -> DataFrame:
    """(point, fid, distance, x, y): every footprint whose boundary is within reach of a point, and its nearest place."""
    seg = boundary(footprints).withColumn("cx", F.explode(cells(F.col("x1"), F.col("x2"), reach, reach))).withColumn("cy", F.explode(cells(F.col("y1"), F.col("y2"), reach, reach)))
    own = points.select("point", F.col("x").alias("px"), F.col("y").alias("py")).withColumn("cx", F.floor(F.col("px") / reach)).withColumn("cy", F.floor(F.col("py") / reach))
    met = own.join(seg, ["cx", "cy"]).select("point", "fid", to_segment(F.col("px"), F.col("py")).alias("q"))
    return met.where(F.col("q.distance") <= reach).groupBy("point", "fid").agg(F.min("q").alias("q")).select("point", "fid", "q.*")


def nearest_boundary(points: DataFrame, footprints: DataFrame, reach: float) -> DataFrame:
    """(point, fid, distance, x, y): the footprint whose boundary is nearest, within reach (ties: the lesser fid)."""
    side = 8 * reach
    seg = boundary(footprints).withColumn("bx", F.explode(blocks.spans(F.col("x1"), F.col("x2"), reach, side))).withColumn("by", F.explode(blocks.spans(F.col("y1"), F.col("y2"), reach, side)))
    own, their = blocks.meet(points.select("point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), seg, side)

    def find(here: pd.DataFrame, segs: pd.DataFrame) -> pd.DataFrame:
        if here.empty or segs.empty:
            return pd.DataFrame({c: [] for c in ("point", "fid", "distance", "x", "y")})
        at = segs[["x1", "y1", "x2", "y2"]].to_numpy(float).T
        rank = np.unique(segs["fid"].to_numpy(), return_inverse=True)[1]
        best, d, x, y = blocks.nearest_segments(here["x"].to_numpy(float), here["y"].to_numpy(float), at, rank, reach)
        hit = best >= 0
        return pd.DataFrame({"point": here["point"].to_numpy()[hit], "fid": segs["fid"].to_numpy()[best[hit]], "distance": d[hit], "x": x[hit], "y": y[hit]})

    kind = [f.schema[c].dataType.simpleString() for f, c in ((points, "point"), (footprints, "fid"))]
    key = ("bx", "by", "part")
    found = own.groupBy(*key).cogroup(their.groupBy(*key)).applyInPandas(find, f"point {kind[0]}, fid {kind[1]}, distance double, x double, y double")
    best = found.groupBy("point").agg(F.min(F.struct("distance", "fid", "x", "y")).alias("b"))
    return best.select("point", "b.fid", "b.distance", "b.x", "b.y")


def containing(points: DataFrame, footprints: DataFrame, cell: float) -> DataFrame:
    """(point, fid, area): every footprint that holds a point."""
    boxed = footprints.select("fid", "ring", F.array_min("ring.x").alias("x1"), F.array_max("ring.x").alias("x2"), F.array_min("ring.y").alias("y1"), F.array_max("ring.y").alias("y2"))
    boxed = boxed.withColumn("cx", F.explode(cells(F.col("x1"), F.col("x2"), 0.0, cell))).withColumn("cy", F.explode(cells(F.col("y1"), F.col("y2"), 0.0, cell)))
    own = points.select("point", F.col("x").alias("px"), F.col("y").alias("py")).withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    met = own.join(boxed, ["cx", "cy"]).where(geo.in_ring(F.col("px"), F.col("py"), F.col("ring")))
    return met.select("point", "fid", geo.ring_area(F.col("ring")).alias("area"))


def number_conflict(building: Column, refs: Column) -> Column:
    """Whether a footprint bears numbers, and none is the building's or shares its main number ('59' and '59-1' agree)."""
    main = F.substring_index(building, "-", 1)
    return (F.size(refs) > 0) & ~F.exists(refs, lambda r: (r == building) | (F.substring_index(r, "-", 1) == main))


def pick_footprints(buildings: DataFrame, footprints: DataFrame, near: float = 20.0, numbered: float = 80.0) -> DataFrame:
    """(building, fid, layer, how): the footprint of each building (building, x, y); null where there is none.

    footprints: fid, layer ('topo' or 'osm'), refs array<string>, ring. In each layer a footprint matches as 'ref' (it bears
    the building's number, within `numbered` metres), as 'inside' (it holds the point; the smallest) or as 'near' (within
    `near` metres, unless its numbers are others'). The topographic map's place is trusted before its numbers, OSM's
    numbers before its place. A match by place or number in the topographic map wins, but not if its numbers are others'
    and OSM has the number; then one in OSM; then what is near, the topographic map's first.
    """
    own = buildings.select(F.col("building").alias("point"), "x", "y")
    reach = max(near, numbered)
    off = boundary_distances(own, footprints, reach).select("point", "fid", "distance")
    held = containing(own, footprints, reach).select("point", "fid", "area")
    met = off.join(held, ["point", "fid"], "full").join(footprints.select("fid", "layer", "refs"), "fid")
    gap = F.when(F.col("area").isNotNull(), F.lit(0.0)).otherwise(F.col("distance"))
    met = met.withColumn("conflict", number_conflict(F.col("point"), F.col("refs"))).withColumn("gap", gap)
    topo = F.col("layer") == "topo"

    def way(how: str, ok: Column, rank: Column, by: Column) -> Column:
        return F.when(ok, F.struct(rank.alias("rank"), by.cast("double").alias("by"), F.col("fid"), F.lit(how).alias("how"), F.col("conflict")))

    ways = F.array_compact(F.array(
        way("inside", F.col("area").isNotNull(), F.when(topo, 0).otherwise(1), F.col("area")),
        way("ref", F.array_contains("refs", F.col("point")) & (F.col("gap") <= numbered), F.when(topo, 1).otherwise(0), F.col("gap")),
        way("near", (F.col("distance") <= near) & ~F.col("conflict"), F.lit(2), F.col("distance")),
    ))
    best = met.select("point", "layer", F.explode(ways).alias("w")).groupBy("point").agg(F.min(F.when(topo, F.col("w"))).alias("t"), F.min(F.when(~topo, F.col("w"))).alias("o"))
    sure = lambda c: F.coalesce(F.col(f"{c}.how").isin("inside", "ref"), F.lit(False))
    veto = F.coalesce((F.col("o.how") == "ref") & F.col("t.conflict"), F.lit(False))
    layer = F.when(sure("t") & ~veto, "topo").when(sure("o"), "osm").when(F.col("t").isNotNull(), "topo").when(F.col("o").isNotNull(), "osm")
    chosen = best.withColumn("layer", layer).withColumn("w", F.when(F.col("layer") == "topo", F.col("t")).otherwise(F.col("o")))
    return buildings.select("building").join(chosen.select(F.col("point").alias("building"), "w.fid", "layer", "w.how"), "building", "left")


def entrance_owners(entrances: DataFrame, footprints: DataFrame, reach: float) -> DataFrame:
    """(entrance, fid, x, y): the footprints that an entrance (entrance, node, x, y) belongs to: those whose outline has its
    node, at its own place; else the nearest boundary within reach, at the nearest place of it. footprints has `nodes`."""
    has = footprints.select("fid", F.explode(F.array_distinct("nodes")).alias("node"))
    by_node = entrances.join(has.hint("merge"), "node").select("entrance", "fid", "x", "y")
    # Which entrances have a node is asked of the nodes, not of the pairs, of which there may be many more.
    placed = entrances.join(has.select("node").distinct().hint("merge"), "node", "left_semi").select("entrance").distinct()
    rest = entrances.join(placed.hint("merge"), "entrance", "left_anti")
    near = nearest_boundary(rest.select(F.col("entrance").alias("point"), "x", "y"), footprints, reach)
    return by_node.unionByName(near.select(F.col("point").alias("entrance"), "fid", "x", "y"))


def joined_pieces(pieces: DataFrame, touch: float = 0.2, shared: float = 1.0, step: float = 0.25) -> DataFrame:
    """(fid, whole): pieces (fid, sheet, ring) of one building that sheets of a map have cut apart share the least fid.

    Two pieces of different sheets belong together where at least `shared` metres of one's boundary lie within `touch` of
    the other's: boundaries are sampled at the middles of stretches of at most `step`.
    """
    seg = boundary(pieces, "sheet")
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / step))
    at = seg.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    u = (F.col("i") + 0.5) / F.col("n")
    at = at.select(F.col("fid").alias("a"), F.col("sheet").alias("own"), (F.col("x1") + u * (F.col("x2") - F.col("x1"))).alias("px"), (F.col("y1") + u * (F.col("y2") - F.col("y1"))).alias("py"), (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / F.col("n")).alias("w"))
    cell = 4 * max(touch, step)
    near = at.withColumn("cx", F.floor(F.col("px") / cell)).withColumn("cy", F.floor(F.col("py") / cell))
    boxed = seg.withColumn("cx", F.explode(cells(F.col("x1"), F.col("x2"), touch, cell))).withColumn("cy", F.explode(cells(F.col("y1"), F.col("y2"), touch, cell)))
    met = near.join(boxed, ["cx", "cy"]).where("sheet <> own").where(to_segment(F.col("px"), F.col("py"))["distance"] <= touch)
    # A sample counts once for a neighbour, whichever of its segments it touches.
    once = met.select("a", F.col("fid").alias("b"), "px", "py", "w").distinct()
    links = once.groupBy("a", "b").agg(F.sum("w").alias("length")).where(F.col("length") >= shared - 1e-9)
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), Store(pieces.sparkSession, "pieces"), "p")
    return pieces.select("fid").join(roots.withColumnRenamed("node", "fid"), "fid", "left").select("fid", F.coalesce("root", "fid").alias("whole"))


def near_fraction(samples: DataFrame, marks: DataFrame, reach: float) -> DataFrame:
    """(edge, share): the share of an edge's samples (edge, i, x, y) that have a mark (x, y) within reach."""
    around = F.sequence(F.lit(-1), F.lit(1))
    own = samples.withColumn("cx", F.floor(F.col("x") / reach)).withColumn("cy", F.floor(F.col("y") / reach))
    there = marks.select(F.col("x").alias("mx"), F.col("y").alias("my")).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    there = there.select("mx", "my", (F.floor(F.col("mx") / reach) + F.col("dx")).alias("cx"), (F.floor(F.col("my") / reach) + F.col("dy")).alias("cy"))
    hit = own.join(there, (own["cx"] == there["cx"]) & (own["cy"] == there["cy"]) & (F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")) <= reach), "left_semi")
    counted = samples.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).join(hit.groupBy("edge").agg(F.count(F.lit(1)).alias("near")), "edge", "left")
    return counted.select("edge", (F.coalesce("near", F.lit(0)) / F.col("n")).alias("share"))


def surfaces(edges: DataFrame, samples: DataFrame, below: DataFrame, above: DataFrame, reach: float = 3.0, share: float = 0.6) -> DataFrame:
    """(edge, surface): 'tunnel' by its own flag; 'tunnel_osm' or 'bridge_osm' where most samples lie by marks below or above
    the ground; 'no_dem' where a sample or an end has no height (z null); else 'ground'. An edge without samples: 'no_dem'."""
    under, over = [near_fraction(samples, marks, reach).withColumnRenamed("share", name) for marks, name in ((below, "under"), (above, "over"))]
    holes = samples.groupBy("edge").agg(F.count_if(F.col("z").isNull()).alias("holes"))
    all_ = edges.join(under, "edge", "left").join(over, "edge", "left").join(holes, "edge", "left")
    kind = F.when(F.col("tunnel"), "tunnel").when(F.col("under") >= share, "tunnel_osm").when(F.col("over") >= share, "bridge_osm").when(F.col("holes") == 0, "ground").otherwise("no_dem")
    return all_.select("edge", kind.alias("surface"))


def same_place(doors: DataFrame, reach: float = 0.05) -> DataFrame:
    """(door, ids, max_links, slack, clear): entrances (id, x, y, max_links, slack, clear) at the same place, within `reach`,
    are one door, named by its least id: the least of their limits, the greatest of their clearances."""
    around = F.sequence(F.lit(-1), F.lit(1))
    own = doors.select("id", "x", "y").withColumn("cx", F.floor(F.col("x") / reach)).withColumn("cy", F.floor(F.col("y") / reach))
    other = own.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"), "cx", "cy").withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    other = other.select("v", "vx", "vy", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    links = own.join(other, ["cx", "cy"]).where((F.col("id") < F.col("v")) & (F.hypot(F.col("x") - F.col("vx"), F.col("y") - F.col("vy")) <= reach))
    roots = connected_components(links.select(F.col("id").alias("u"), "v"), Store(doors.sparkSession, "doors"), "d")
    keyed = doors.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("door", F.coalesce("root", "id"))
    return keyed.groupBy("door").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("max_links").alias("max_links"), F.min("slack").alias("slack"), F.max("clear").alias("clear"))


#: Kinds of ways that are walked on.
WALKED = ("footway", "path", "steps", "pedestrian", "service", "living_street", "residential", "unclassified", "tertiary", "secondary", "primary", "track", "cycleway", "road")


def usable_path(highway: Column, *covers: Column) -> Column:
    """A walked way on the ground: none of its covers (bridge, tunnel, indoor) is said, or they are 'no'."""
    open_air = F.lit(True)
    for c in covers:
        open_air = open_air & F.coalesce(c, F.lit("")).isin("", "no")
    return F.coalesce(highway.isin(*WALKED), F.lit(False)) & open_air


def perimeter_samples(footprints: DataFrame, step: float) -> DataFrame:
    """(fid, x, y, w): the middles of stretches of at most `step` along every boundary, with their lengths."""
    seg = boundary(footprints)
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    at = seg.withColumn("n", F.greatest(F.lit(1), F.ceil(size / step))).withColumn("w", size / F.col("n")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    u = (F.col("i") + 0.5) / F.col("n")
    return at.select("fid", (F.col("x1") + u * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + u * (F.col("y2") - F.col("y1"))).alias("y"), "w")


def assembled_rings(ways: DataFrame) -> DataFrame:
    """(relation, ring): closed rings of node ids from fragments (relation, way, nodes array), turned where needed.

    Each relation's fragments are few and are strung together in one task; a fragment that closes with none is left out.
    """
    import pandas as pd

    def string(pdf: pd.DataFrame) -> pd.DataFrame:
        ends: dict[int, list[int]] = {}
        rows = [list(n) for _, n in sorted(zip(pdf["way"], pdf["nodes"], strict=True), key=lambda r: r[0]) if n is not None and len(n) > 1]
        for k, nodes in enumerate(rows):
            for end in {nodes[0], nodes[-1]}:
                ends.setdefault(end, []).append(k)
        used, rings = set(), []
        for k, nodes in enumerate(rows):
            if k in used:
                continue
            ring, mine = list(nodes), {k}
            while ring[0] != ring[-1]:
                more = next((j for j in ends.get(ring[-1], ()) if j not in used and j not in mine), None)
                if more is None:
                    break
                mine.add(more)
                part = rows[more] if rows[more][0] == ring[-1] else rows[more][::-1]
                ring += part[1:]
            if ring[0] == ring[-1]:
                used |= mine
                rings.append(ring)
        own = pd.Series([pdf["relation"].iloc[0]] * len(rings), dtype=pdf["relation"].dtype)
        return pd.DataFrame({"relation": own, "ring": pd.Series(rings, dtype=object)})

    return ways.groupBy("relation").applyInPandas(string, f"relation {ways.schema['relation'].dataType.simpleString()}, ring {ways.schema['nodes'].dataType.simpleString()}")


def holes(inner: DataFrame, outer: DataFrame, cell: float) -> DataFrame:
    """(hole, fid): each inner ring (hole, ring) with the smallest outer one (fid, ring) that holds its first corner."""
    first = inner.select(F.col("hole").alias("point"), F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"))
    best = containing(first, outer, cell).groupBy("point").agg(F.min(F.struct("area", "fid")).alias("b"))
    return inner.select("hole").join(best.select(F.col("point").alias("hole"), "b.fid"), "hole", "left")
