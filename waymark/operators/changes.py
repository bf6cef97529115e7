"""Snapshot changes, polling policy, and joins by precedence of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, op (created, deleted, updated), fields, before, after; rows without a change in `fields` don't appear."""
    a = old.select(F.col(key), F.struct(*fields).alias("o"))
    b = new.select(F.col(key), F.struct(*fields).alias("n"))
    both = a.join(b, key, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    op = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "deleted").when(F.size(changed) > 0, "updated")
    values = [F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f"{s}.{f}").cast("string") for f in fields])) for s in "on"]
    out = both.withColumn("op", op).where("op IS NOT NULL").withColumn("fields", F.when(F.col("op") == "updated", changed).otherwise(F.array().cast("array<string>")))
    return out.select(key, "op", "fields", F.when(F.col("o").isNotNull(), values[0]).alias("before"), F.when(F.col("n").isNotNull(), values[1]).alias("after"))


def changed_fields(diff: DataFrame) -> DataFrame:
    """One row per updated field: key, field, before, after."""
    key = diff.columns[0]
    each = diff.where("op = 'updated'").select(key, F.explode("fields").alias("field"), "before", "after")
    return each.select(key, "field", F.col("before")[F.col("field")].alias("before"), F.col("after")[F.col("field")].alias("after"))


def poll_hours(now: Column, detected: Column, opens: Column, closes: Column, quick: int = 6, slow: int = 12) -> Column:
    """Hours between polls: quick for 30 days after a new semester is seen and while registration is near."""
    return F.when(now - detected < F.expr("INTERVAL 30 DAYS"), quick).when(now.between(opens, closes), quick).otherwise(slow)


def poll_reason(now: Column, detected: Column, opens: Column, closes: Column) -> Column:
    """Why polls are as often as poll_hours says: 'new_semester', 'registration' or 'usual'."""
    return F.when(now - detected < F.expr("INTERVAL 30 DAYS"), "new_semester").when(now.between(opens, closes), "registration").otherwise("usual")


def boost_window(rows: DataFrame, keywords: list[str], margin_days: int = 3) -> DataFrame:
    """(opens, closes) around the rows whose kind has a keyword; nulls where there is none."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.col("kind").contains(k)
    return rows.where(hit).agg(F.date_sub(F.min("starts"), margin_days).alias("opens"), F.date_add(F.max("ends"), margin_days).alias("closes"))


def priority_coalesce(rows: DataFrame, key: str, first: list[str], last: list[str], prio: str = "prio") -> DataFrame:
    """Per key the first known value, by priority, of some columns and the last of others."""
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(prio))).alias(c) for c in first] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(prio))).alias(c) for c in last]
    return rows.groupBy(key).agg(*aggs)


def best_source(rows: DataFrame, key: str, prio: str) -> DataFrame:
    """All rows of each key's best source."""
    return rows.withColumn("place", F.dense_rank().over(W.partitionBy(key).orderBy(prio))).where("place = 1").drop("place")


def merge_sources(table: DataFrame, fresh: DataFrame, keys: list[str], replace: list[str], source: str) -> DataFrame:
    """table with fresh minutes where its row's source may be replaced; replaceable rows without a fresh value go."""
    both = table.join(fresh.withColumnRenamed("minutes", "fresh"), keys, "full_outer")
    keep = F.col("source").isNotNull() & ~F.col("source").isin(replace)
    out = both.select(*keys, F.when(keep, F.col("minutes")).otherwise(F.col("fresh")).alias("minutes"), F.when(keep, F.col("source")).otherwise(F.lit(source)).alias("source"))
    return out.where("minutes IS NOT NULL")


def due(now: Column, last: Column, hours: Column, tolerance_minutes: int = 30, force: Column | None = None) -> Column:
    out = last.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last) >= hours * 3600 - tolerance_minutes * 60)
    return out | force if force is not None else out
