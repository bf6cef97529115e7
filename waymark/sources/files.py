"""Readers of catalogue, travel, map and track files, all with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MEETING = "struct<day:int,start:int,end:int,building:string,room:string>"
SECTION = f"course_id string, section_no string, course_name string, meetings array<{MEETING}>, instructor string, department string, credit double, classification string, program string, status string"


def sections_json(spark: SparkSession, path: str) -> DataFrame:
    """Sections of a JSON array; columns added later default to '' and 0, and repeated meetings are merged."""
    rows = spark.read.schema(SECTION).option("multiLine", True).json(path)
    texts = ("section_no", "course_name", "instructor", "department", "classification", "program", "status")
    rows = rows.select("course_id", *[F.coalesce(c, F.lit("")).alias(c) for c in texts], F.coalesce("credit", F.lit(0.0)).alias("credit"), F.coalesce("meetings", F.array().cast(f"array<{MEETING}>")).alias("meetings"))
    return rows.withColumn("meetings", merged_meetings("meetings"))


def merged_meetings(column: str):
    """Meetings equal in day, times and building become one, in the first one's place, their rooms joined by '/'."""
    same = lambda a, b: (a["day"] == b["day"]) & (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["building"] == b["building"])
    first = F.filter(column, lambda m, i: ~F.exists(F.slice(column, F.lit(1), i), lambda o: same(o, m)))

    def joined(m):
        rooms = F.array_distinct(F.filter(F.transform(F.filter(column, lambda o: same(o, m)), lambda o: o["room"]), lambda r: r != ""))
        return F.struct(m["day"].alias("day"), m["start"].alias("start"), m["end"].alias("end"), m["building"].alias("building"), F.array_join(rooms, "/").alias("room"))

    return F.transform(first, joined)


def buildings_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    return rows.select(F.trim("building").alias("building"), F.trim("name").alias("name"), F.trim("lat").try_cast("double").alias("lat"), F.trim("lon").try_cast("double").alias("lon"))


def travel_csv(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, minutes, source): of rows that repeat a pair the last stands, in the order of files by path and of rows."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    rows = spark.read.csv(path, header=True).withColumn("n", place)
    last = rows.groupBy(F.trim("from").alias("a"), F.trim("to").alias("b")).agg(F.max(F.struct("n", F.col("minutes").try_cast("double").alias("minutes"), "source")).alias("x"))
    return last.select("a", "b", "x.minutes", "x.source")


def pair_times_csv(spark: SparkSession, path: str) -> DataFrame:
    """Seconds to minutes; pairs with a blank end or with itself go."""
    rows = spark.read.csv(path, header=True).select(F.trim("from").alias("a"), F.trim("to").alias("b"), (F.col("time_s").try_cast("double") / 60).alias("minutes"))
    return rows.where("a <> '' AND b <> '' AND a <> b AND minutes IS NOT NULL")


GEOJSON = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: fid, kind, coordinates (JSON text), properties."""
    rows = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
    return rows.select(F.posexplode("features").alias("fid", "f")).select("fid", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def geojson_points(features: DataFrame) -> DataFrame:
    at = F.from_json("coordinates", "array<double>")
    return features.where("kind = 'Point'").select("fid", at[0].alias("lon"), at[1].alias("lat"), "properties")


def geojson_lines(features: DataFrame) -> DataFrame:
    at = F.from_json("coordinates", "array<array<double>>")
    return features.where("kind = 'LineString'").select("fid", F.transform(at, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("line"), "properties")


def geojson_rings(features: DataFrame) -> DataFrame:
    """Outer rings of polygons."""
    at = F.from_json("coordinates", "array<array<array<double>>>")
    return features.where("kind = 'Polygon'").select("fid", F.transform(at[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"), "properties")


TRACK = "walk string, walker string, device string, start string, t long, lat double, lon double, alt double, acc double, speed double"


def tracks_csv(spark: SparkSession, path: str) -> DataFrame:
    """GPS points of files or folders; of a walk that several files hold the one with most points counts.

    A walker's letter that several devices use is split by device. A file whose header lacks a column, or has them in
    another order, fails the read.
    """
    rows = spark.read.schema(TRACK).option("header", True).option("enforceSchema", False).csv(path).withColumn("file", F.col("_metadata.file_path"))
    size = rows.groupBy("walk", "file").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("walk").agg(F.max(F.struct("n", "file")).alias("m")).select("walk", F.col("m.file").alias("file"))
    kept = rows.join(best, ["walk", "file"], "left_semi")
    devices = kept.select("walker", "device").distinct().withColumn("place", F.dense_rank().over(W.partitionBy("walker").orderBy("device"))).withColumn("many", F.count(F.lit(1)).over(W.partitionBy("walker")))
    named = devices.select(F.col("walker").alias("w"), F.col("device").alias("d"), F.when(F.col("many") > 1, F.concat("walker", F.lit("-"), "place")).otherwise(F.col("walker")).alias("name"))
    out = kept.join(named, (F.col("walker") == F.col("w")) & F.col("device").eqNullSafe(F.col("d")))
    return out.withColumn("walker", F.col("name")).withColumn("ts", (F.unix_millis(F.to_timestamp("start")) + F.col("t")) / 1000).drop("w", "d", "name", "file")


def semester_files(spark: SparkSession, folder: str, current: str) -> DataFrame:
    """(path, semester) of the well-named files of a folder but the current semester's."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.regexp_extract("path", r"(\d{4}-[1S2W])\.json$", 1).alias("semester"))
    return files.where((F.col("semester") != "") & (F.col("semester") != current))


def courses_array_json(spark: SparkSession, path: str) -> DataFrame:
    """Courses of the compact web form: rows of arrays under a legend of fields."""
    doc = spark.read.text(path, wholetext=True)
    fields = F.from_json(F.get_json_object("value", "$.fields"), "array<string>")
    rows = F.from_json(F.get_json_object("value", "$.courses"), "array<array<string>>")
    return doc.select(F.posexplode(rows).alias("ordinal", "r"), fields.alias("fields")).select("ordinal", F.map_from_arrays("fields", F.slice("r", F.lit(1), F.size("fields"))).alias("course"))


def matches(name, words: list[str]):
    """Whether a text has one of the words, whatever its case."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(name), F.lower(w)))
