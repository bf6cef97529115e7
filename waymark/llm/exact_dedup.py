"""Exact duplicates by most-significant-digit radix partitioning.

Documents are split by successive digits of their normalised text until a group is a single document or its texts have
ended. A digit is a run of bytes (64, then 16 times as many in each round), so a text of n bytes takes O(log n)
rounds; the digit itself is the key, and no digest decides equality. Each round counts groups with map-side combine and
joins the narrow group table back; the join's two sides are plain exchanges, which adaptive execution splits where one
group holds a large share of the rows. Only documents that still share their whole prefix are carried to the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.store import Store

FIRST_DIGIT = 64
GROWTH = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. `lower` is as good, and faster, where the text is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def normal_sha256(text: Column) -> Column:
    """Hex SHA-256 of a text, A-Z lower-cased, in UTF-8; null is empty."""
    return F.sha2(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "UTF-8"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id stays; a null text
    is the empty text; a null id never wins over another, and is kept only if its whole group has null ids. Rows that
    repeat an id and a text are all equal to keep_id and are all marked kept. An empty table gives an empty result;
    other columns are ignored, whatever their names. A very long text takes a round for each 16 times of its length, and
    is compared whole. Once done, only the tables that the result reads are left.
    """
    store = Store(docs.sparkSession, "exact")
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rest = docs.select(F.col(id_col).alias("doc_id"), F.encode(text, "UTF-8").alias("rest"))
    active = rest.select("doc_id", F.sha2("rest", 256).alias("text_sha256"), F.lit(0).cast("long").alias("gid"), "rest")
    done, width, k = [], first_digit, 0
    while True:
        # The digit and what follows it; a text is over where its digit is not full.
        split = active.select("doc_id", "text_sha256", "gid", F.substring("rest", 1, width).alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        groups = split.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        groups = store.put(groups.where("n > 1").select("*", F.monotonically_increasing_id().alias("next")), f"groups{k}")
        over = F.col("n").isNull() | (F.octet_length("digit") < width)
        # Never a broadcast: the groups grow with the documents.
        joined = split.join(groups.hint("merge"), ["gid", "digit"], "left").select(
            "doc_id", "text_sha256", F.col("next").alias("gid"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"), F.when(~over, F.col("rest")).alias("rest"),
        )
        # What is over is written apart from what goes on, so that the texts of a round go once the next is written.
        joined = store.put(joined, f"level{k}")
        done.append(store.put(joined.where("rest is null").drop("rest", "gid"), f"done{k}"))
        active = joined.where("rest is not null").select("doc_id", "text_sha256", "gid", "rest")
        store.drop(f"groups{k}")
        if k:
            store.drop(f"level{k - 1}")
        if active.isEmpty():
            break
        width, k = width * GROWTH, k + 1
    store.keep(*[f"done{i}" for i in range(k + 1)])
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
