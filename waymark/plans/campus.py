"""The campus model over the star-schema test tables: sections, meetings, buildings, a directed travel table.

Integer arithmetic only, so that any engine reproduces it. Times are minutes since midnight, days 0 (Monday) to 6;
building -1 is an unknown room.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Weights:
    """Cost of a schedule: travel and late minutes, campus days, idle minutes."""

    travel: float = 1.0
    late: float = 2.0
    day: float = 0.0
    gap: float = 0.0


@dataclass(frozen=True)
class MatrixParams:
    """How a missing pair is estimated: reverse direction, then distance, then a default."""

    symmetric: bool = True
    walk_km_h: float = 4.0
    detour: float = 1.35
    default: float = 15.0


@dataclass(frozen=True)
class Rules:
    """Hard rules: days without classes, and a free stretch of `minutes` inside [start, end) on every day."""

    free_days: tuple[int, ...] = ()
    lunch: tuple[int, int, int] | None = None


def sections(spark: SparkSession, sf_dir: str, courses: int, per: int | None = None) -> DataFrame:
    """request, ord, course, d0, start_min, len, building over all events; a request is `per` events that follow each
    other, or all of them."""
    events = table(spark, sf_dir, "events")
    request = F.floor(F.col("event_id") / per) if per else F.lit(0)
    return events.select(
        request.cast("long").alias("request"), F.col("event_id").alias("ord"), (F.col("user_id") % courses).alias("course"), (F.weekday("ts") % 5).alias("d0"), (F.lit(480) + 30 * (F.minute("ts") % 20)).alias("start_min"),
        F.element_at(F.array(F.lit(50), F.lit(75), F.lit(110)), (F.col("event_id") % 3 + 1).cast("int")).alias("len"),
        F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("event_id") * 7 % 25).cast("int").alias("building"),
    )


def meetings(sec: DataFrame) -> DataFrame:
    """request, ord, course, mpos, day, s, e, building: one meeting, and a second two days later for even sections."""
    second = F.when(F.col("ord") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    each = sec.select("*", F.explode(second).alias("mpos"))
    return each.select("request", "ord", "course", "mpos", F.when(F.col("mpos") == 0, F.col("d0")).otherwise((F.col("d0") + 2) % 7).alias("day"), F.col("start_min").alias("s"), (F.col("start_min") + F.col("len")).alias("e"), "building")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """building, name, lat, lon."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("building"), F.col("n_name").alias("name"), (37.45 + k / 1000).alias("lat"), (126.95 + (k * 7 % 25) / 1000).alias("lon"))


def travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, minutes: directed, with holes, and breaking the triangle inequality."""
    ids = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    pairs = ids.join(ids.withColumnRenamed("a", "b"), (F.col("a") != F.col("b")) & ((F.col("a") + F.col("b")) % 9 != 0))
    return pairs.select("a", "b", (1 + (F.col("a") * 7 + F.col("b") * 13) % 17).cast("double").alias("minutes"))


def sql_sections(courses: int, per: int | None = None, where: str = "true") -> str:
    """The same as common table expressions of DuckDB: sec, mt, travel, bld."""
    request = f"event_id // {per}" if per else "0"
    return f"""sec AS (SELECT ({request})::BIGINT AS request, event_id AS ord, user_id % {courses} AS course, ((isodow(ts) - 1) % 5)::INTEGER AS d0, (480 + 30 * (minute(ts) % 20))::INTEGER AS start_min, [50, 75, 110][event_id % 3 + 1]::INTEGER AS len,
                CASE WHEN event_id % 11 = 0 THEN -1 ELSE event_id * 7 % 25 END::INTEGER AS building FROM events WHERE {where}),
        mt AS (SELECT request, ord, course, 0 AS mpos, d0 AS day, start_min AS s, start_min + len AS e, building FROM sec
               UNION ALL SELECT request, ord, course, 1, (d0 + 2) % 7, start_min, start_min + len, building FROM sec WHERE ord % 2 = 0),
        {SQL_TRAVEL}"""


SQL_TRAVEL = """bld AS (SELECT n_nationkey AS building, n_name AS name, 37.45::DOUBLE + n_nationkey / 1000 AS lat, 126.95::DOUBLE + (n_nationkey * 7 % 25) / 1000 AS lon FROM nation),
        travel AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, (1 + (x.n_nationkey * 7 + y.n_nationkey * 13) % 17)::DOUBLE AS minutes FROM nation x, nation y WHERE x.n_nationkey <> y.n_nationkey AND (x.n_nationkey + y.n_nationkey) % 9 <> 0)"""
