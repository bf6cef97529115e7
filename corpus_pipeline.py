"""The corpus pipeline: toxicity, exact and near duplicates, mixing to target weights, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; stages are written as Parquet and
read again. All but the last return the columns of documents. Decisions belong to rows, not to ids: where ids repeat,
each row goes by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.exact_dedup import exact_dedup, normal_sha256
from waymark.llm.minhash import near_duplicates
from waymark.llm.mixing import mixed_documents
from waymark.llm.packing import pack_documents
from waymark.llm.queries import table, tokenizer_path
from waymark.llm.toxicity import fit_toxicity, without_toxic
from waymark.plans.store import Store


def _key() -> Column:
    """What tells a document from others: its id and its normalised text."""
    return F.struct(F.col("doc_id").alias("id"), normal_sha256(F.col("text")).alias("sha"))


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of docs for each of the keys; of rows that repeat id and text the first by a hash of all columns."""
    rows = docs.select(_key().alias("key"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(keys.select("key").distinct().hint("merge"), "key", "left_semi")
    rows = rows.withColumn("turn", F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("row")))).where("turn = 1")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup(docs).where("kept")
    return _only(docs, kept.select(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias("key")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each cluster the row with the least id stays, and every row without shingles."""
    key = next(name for name in ("key", "_key", "__key") if name not in docs.columns)
    rows = near_duplicates(docs.withColumn(key, _key()), carry=[key])
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key))
    best = rows.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min_by(key, order).alias("key"))
    return _only(docs, best.select("key").unionByName(rows.where("cluster IS NULL").select(F.col(key).alias("key"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and pass, its text cut to the words that the mix takes."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_duplicates", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: A trained classifier decides the first stage, and the last needs a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
        if last:
            store.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
