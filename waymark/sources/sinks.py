"""Writers: nested JSON documents, statistics logs, map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_sections(sections: DataFrame, path: str) -> None:
    sections.write.mode("overwrite").json(path)


def append_stats(row: DataFrame, path: str) -> None:
    """One more row of the statistics log."""
    row.write.mode("append").option("header", True).csv(path)


def course_documents(sections: DataFrame, skip: tuple[str, ...] = ("논문",)) -> DataFrame:
    """(course_id, document): a course's sections by number, as JSON; skipped classes and normal status leave no trace."""
    kept = sections.where(~F.col("classification").isin(*skip))
    status = F.when(F.col("status").isin("", "설강"), "").otherwise(F.col("status"))
    each = F.struct("section_no", "instructor", status.alias("status"), "meetings")
    docs = kept.groupBy("course_id").agg(F.min_by("course_name", "section_no").alias("name"), F.array_sort(F.collect_list(each)).alias("sections"))
    return docs.select("course_id", F.to_json(F.struct("course_id", "name", "sections")).alias("document"))


def packed_numbers(values: Column, bits: int = 16) -> Column:
    """An array of numbers 0..2^bits - 1 as base64 of little-endian unsigned integers; a model's payload."""
    hexed = F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), bits // 4, "0"))
    turned = F.transform(hexed, lambda h: F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(bits // 8 - 1)), lambda i: F.substring(h, i * 2 + 1, F.lit(2)))), ""))
    return F.base64(F.unhex(F.array_join(turned, "")))


def request_documents(legs: DataFrame, evaluated: DataFrame, buildings: DataFrame, home: int, meta: dict[str, str]) -> DataFrame:
    """(request, document): a request's schedules in order of rank, with their days and routes, the buildings they visit
    with names and places, the home and the document's meta fields."""
    leg = F.struct("leg", "from_b", "to_b", F.round("minutes", 1).alias("minutes"))
    days = legs.groupBy("request", "combo", "day").agg(F.array_sort(F.collect_list(leg)).alias("route"))
    nested = days.groupBy("request", "combo").agg(F.array_sort(F.collect_list(F.struct("day", "route"))).alias("days"))
    one = F.struct("rank", "combo", *[F.round(c, 1).alias(c) for c in ("travel", "late", "cost")], "days")
    found = evaluated.join(nested, ["request", "combo"], "left").groupBy("request").agg(F.array_sort(F.collect_list(one)).alias("timetables"))
    visited = legs.join(evaluated.select("request", "combo"), ["request", "combo"], "left_semi").select("request", F.explode(F.array("from_b", "to_b")).alias("building")).distinct()
    named = visited.join(buildings, "building").groupBy("request").agg(F.array_sort(F.collect_list(F.struct("building", "name", "lat", "lon"))).alias("buildings"))
    fields = [F.lit(home).alias("home"), F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]).alias("meta")] if meta else [F.lit(home).alias("home")]
    return found.join(named, "request", "left").select("request", F.to_json(F.struct(*fields, "timetables", "buildings")).alias("document"))


def result_documents(legs: DataFrame, evaluated: DataFrame) -> DataFrame:
    """(combo, document): days with their legs, minutes to one decimal, and the totals."""
    leg = F.struct("leg", "from_b", "to_b", F.round("minutes", 1).alias("minutes"))
    days = legs.groupBy("combo", "day").agg(F.array_sort(F.collect_list(leg)).alias("route"))
    nested = days.groupBy("combo").agg(F.array_sort(F.collect_list(F.struct("day", "route"))).alias("days"))
    total = evaluated.select("combo", *[F.round(c, 1).alias(c) for c in ("travel", "late", "cost")])
    return nested.join(total, "combo").select("combo", F.to_json(F.struct("travel", "late", "cost", F.col("days"))).alias("document"))


def feature(geometry: str, coordinates: Column, properties: list[str]) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def write_twins(rows: DataFrame, path: str) -> None:
    """CSV of all rows, and GeoJSON features of those with coordinates."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    placed = rows.where("lat IS NOT NULL AND lon IS NOT NULL")
    placed.select(feature("Point", F.array("lon", "lat"), [c for c in rows.columns if c not in ("lat", "lon")])).write.mode("overwrite").text(f"{path}/geojson")


def packed_grades(edges: DataFrame, limits: tuple[float, ...] = (3, 6, 10, 15)) -> DataFrame:
    """Share of length by class of grade."""
    label = F.lit(len(limits))
    for i in range(len(limits) - 1, -1, -1):
        label = F.when(F.abs("percent") < limits[i], i).otherwise(label)
    total = edges.agg(F.sum("distance").alias("all"))
    return edges.groupBy(label.alias("grade")).agg(F.sum("distance").alias("length")).crossJoin(F.broadcast(total)).select("grade", (F.col("length") / F.col("all")).alias("share"))
