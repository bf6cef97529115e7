"""Elevation cells, line sampling and footprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import blocks


def bilinear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(point, z): weighted mean of the four cells around (x, y) in cell units; of the known ones where some are missing."""
    x0, y0 = F.floor("x"), F.floor("y")
    fx, fy = F.col("x") - x0, F.col("y") - y0
    corner = F.array(*[F.struct((x0 + i).alias("col"), (y0 + j).alias("row"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)])
    each = points.select("point", F.explode(corner).alias("c")).select("point", "c.col", "c.row", "c.w")
    met = each.join(cells, ["col", "row"]).where("w > 0 AND z IS NOT NULL")
    return met.groupBy("point").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))


def densify(lines: DataFrame, step: float) -> DataFrame:
    """(line, i, x, y): points at most `step` apart on each segment (x1, y1)-(x2, y2), both ends included."""
    size = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    n = F.greatest(F.lit(1), F.ceil(size / step)).cast("int")
    each = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    t = F.col("i") / F.col("n")
    return each.select("line", "i", (F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("y"))


def containing_footprint(points: DataFrame, footprints: DataFrame, cell: float) -> DataFrame:
    """(point, fid): the smallest footprint (fid, ring) around each point, by grid cells of the footprints' boxes.

    Areas that agree to nine digits are equal; the lesser fid wins.
    """
    xs, ys = [F.col(f"ring.{c}").cast("array<double>") for c in ("x", "y")]
    span = lambda v: blocks.spans(F.array_min(v), F.array_max(v), 0.0, cell)
    boxed = footprints.select("fid", xs.alias("xs"), ys.alias("ys")).withColumn("bx", F.explode(span("xs"))).withColumn("by", F.explode(span("ys")))
    own, their = blocks.meet(points.select("point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), boxed, cell)

    def find(here: pd.DataFrame, rings: pd.DataFrame) -> pd.DataFrame:
        if here.empty or rings.empty:
            return pd.DataFrame({c: [] for c in ("point", "area", "fid")})
        size = rings["xs"].map(len).to_numpy(int)
        area = blocks.ring_areas(np.concatenate(rings["xs"].to_list()), np.concatenate(rings["ys"].to_list()), np.cumsum(size) - size, size)
        order = np.lexsort((np.unique(rings["fid"].to_numpy(), return_inverse=True)[1], area))
        rings, size, area = rings.iloc[order], size[order], area[order]
        found = blocks.smallest_around(here["x"].to_numpy(float), here["y"].to_numpy(float), np.concatenate(rings["xs"].to_list()), np.concatenate(rings["ys"].to_list()), np.cumsum(size) - size, size)
        hit = found >= 0
        return pd.DataFrame({"point": here["point"].to_numpy()[hit], "area": area[found[hit]], "fid": rings["fid"].to_numpy()[found[hit]]})

    kind = [f.schema[c].dataType.simpleString() for f, c in ((points, "point"), (footprints, "fid"))]
    key = ("bx", "by", "part")
    met = own.groupBy(*key).cogroup(their.groupBy(*key)).applyInPandas(find, f"point {kind[0]}, area double, fid {kind[1]}")
    return met.groupBy("point").agg(F.min(F.struct("area", "fid")).alias("m")).select("point", "m.fid")


def weighted_level(samples: DataFrame, key: str) -> DataFrame:
    """Length-weighted mean, least, greatest and span of z around each footprint."""
    return samples.groupBy(key).agg((F.sum(F.col("z") * F.col("w")) / F.sum("w")).alias("mean"), F.min("z").alias("low"), F.max("z").alias("high"), (F.max("z") - F.min("z")).alias("span"))


#: Heights beyond these are no heights, whatever a raster says.
LOWEST, HIGHEST = -100.0, 3000.0


def raster_window(cells: DataFrame, layers: DataFrame, box: tuple[float, float, float, float], margin: int = 2) -> DataFrame:
    """Cells (layer, col, row, z) within a box (west, south, east, north) and `margin` cells around it; z is null where it is
    no height. layers: layer, x0, y0 (the middle of cell 0, 0), size, in the box's units, rows running north.

    Sheets that don't meet the box have no cells. Tables of cells that are partitioned by layer are pruned by it.
    """
    west, south, east, north = box
    inside = layers.select("layer", *[f((F.lit(v) - F.col(o)) / F.col("size") + d * margin).alias(n) for n, v, o, f, d in (("c0", west, "x0", F.floor, -1), ("c1", east, "x0", F.ceil, 1), ("r0", south, "y0", F.floor, -1), ("r1", north, "y0", F.ceil, 1))])
    kept = cells.join(inside, "layer").where("col BETWEEN c0 AND c1 AND row BETWEEN r0 AND r1")
    height = F.when((F.col("z") >= LOWEST) & (F.col("z") <= HIGHEST) & ~F.isnan("z"), F.col("z"))
    return kept.select("layer", "col", "row", height.alias("z"))


def finest_heights(points: DataFrame, cells: DataFrame, layers: DataFrame) -> DataFrame:
    """(point, layer, z): each point's height between the four cells around it, in the finest layer that has all four; where
    none has, the nearest cell's of the finest layer that has it; null without any."""
    extent = cells.groupBy("layer").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    # Layers are the sheets of a map: a few rows, of which a point meets those that it lies in.
    u, v = (F.col("x") - F.col("x0")) / F.col("size"), (F.col("y") - F.col("y0")) / F.col("size")
    at = points.join(layers.join(extent, "layer"), u.between(F.col("c0") - 1, F.col("c1") + 1) & v.between(F.col("r0") - 1, F.col("r1") + 1)).select("point", "layer", "size", u.alias("u"), v.alias("v"))
    corners = F.array(*[F.struct((F.floor("u") + i).alias("col"), (F.floor("v") + j).alias("row")) for i in (0, 1) for j in (0, 1)])
    near = at.withColumn("c", F.explode(corners)).select("point", "layer", "size", "u", "v", "c.col", "c.row").join(cells, ["layer", "col", "row"])
    w = (1 - F.abs(F.col("u") - F.col("col"))) * (1 - F.abs(F.col("v") - F.col("row")))
    part = near.where("z IS NOT NULL").groupBy("point", "layer", "size").agg(F.sum(w).alias("w"), F.sum(w * F.col("z")).alias("wz"), F.max_by("z", w).alias("nearest"))
    whole = F.col("w") >= 1 - 1e-9
    best = part.groupBy("point").agg(F.min(F.struct((~whole).alias("partial"), "size", "layer", F.when(whole, F.col("wz")).otherwise(F.col("nearest")).alias("z"))).alias("b"))
    return points.select("point").join(best.select("point", "b.layer", "b.z"), "point", "left")
