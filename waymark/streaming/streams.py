"""Structured Streaming forms: windows, sessions, change capture, newest answers, keep-fullest copies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.operators.changes import snapshot_diff


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", key: str | None = None) -> DataFrame:
    """Counts by event-time window, tumbling or sliding, with a watermark."""
    keys = [F.window("ts", size, slide or size).alias("w"), *([key] if key else [])]
    g = events.withWatermark("ts", late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("begins"), *([key] if key else []), "n")


def session_counts(events: DataFrame, who: str, gap: str, late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(who, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(who, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")


def on_time_and_late(events: DataFrame, limit_s: float, sent: str = "sent", got: str = "got") -> tuple[DataFrame, DataFrame]:
    """Answers within the limit, and the later ones, which are stored for the next read."""
    lag = F.unix_micros(got) - F.unix_micros(sent)
    return events.where(lag <= limit_s * 1e6), events.where(lag > limit_s * 1e6)


def newest_answer(replies: DataFrame) -> DataFrame:
    """Of all replies to a client the one with the largest request number."""
    return replies.groupBy("client").agg(F.max_by("payload", "request").alias("payload"), F.max("request").alias("request"))


def change_capture(snapshots: DataFrame, key: str, fields: list[str], state: str, changes: str, checkpoint: str, label: str = "semester") -> StreamingQuery:
    """A stream of whole snapshots (batches) to change records.

    The last snapshot is a table per label; a new label starts from nothing, so all its rows are created, and the old
    label's table stays as its archive. A batch that is run again reads the table of the batch before it, so its
    records are the same.
    """
    spark = snapshots.sparkSession

    def path(name: str, batch: int) -> str:
        return f"{state}/label={name}/batch={batch}"

    def last_before(name: str, batch: int) -> str | None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/label={name}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder)]
        done = [n for n in done if n < batch and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path(name, n)}/_SUCCESS"))]
        return path(name, max(done)) if done else None

    def one(batch: DataFrame, number: int) -> None:
        for row in batch.select(label).distinct().collect():  # a snapshot has one label, rarely two
            name = row[0]
            new = batch.where(F.col(label) == name).drop(label)
            before = last_before(name, number)
            old = spark.read.schema(new.schema).parquet(before) if before else new.limit(0)
            diff = snapshot_diff(old, new, key, fields).withColumn(label, F.lit(name))
            diff.write.mode("overwrite").parquet(f"{changes}/label={name}/batch={number}")
            new.write.mode("overwrite").parquet(path(name, number))

    return snapshots.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fullest_copies(points: DataFrame) -> DataFrame:
    """(walk, file, n) whenever another file of a walk becomes its fullest: keyed state, as dropDuplicates keeps the first."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sizes = dict(zip(*map(list, state.get), strict=True)) if state.exists else {}
        best = max(sizes.items(), key=lambda x: (x[1], x[0])) if sizes else None
        for pdf in batches:
            for file, n in pdf.groupby("file").size().items():
                sizes[file] = sizes.get(file, 0) + int(n)
        state.update((list(sizes), list(sizes.values())))
        now = max(sizes.items(), key=lambda x: (x[1], x[0]))
        if best is None or now[0] != best[0]:
            yield pd.DataFrame({"walk": [key[0]], "file": [now[0]], "n": [now[1]]})

    return points.groupBy("walk").applyInPandasWithState(update, "walk string, file string, n long", "files array<string>, sizes array<long>", "append", GroupStateTimeout.NoTimeout)
