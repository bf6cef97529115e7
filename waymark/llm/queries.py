"""The registered queries of the training-data operators, each over its whole table, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.exact_dedup import exact_dedup
from waymark.llm.licenses import scan_licenses
from waymark.llm.media import media_column
from waymark.llm.minhash import near_duplicates
from waymark.llm.mixing import mix_sources
from waymark.llm.packing import pack_documents
from waymark.llm.quality import fit_quality, score_quality
from waymark.llm.token_counts import token_counts
from waymark.llm.toxicity import fit_toxicity, score_toxicity
from waymark.llm.url_filters import PATH, host_of, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of their labelled part."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; taken is summed from its pieces in the shards."""
    members, _ = mix_sources(table(spark, sf_dir, "documents"))
    return members.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of similarity 0.75 or more, over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("cluster")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of their labelled part."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the base phrases and labels of all detections, over all documents."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", "detections.label")))
    return found.select(
        "doc_id", "n_words", F.size("base_starts").cast("long").alias("n_base"), F.array_min("base_starts").alias("first_word"), F.array_max("base_starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score",
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_media_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored form, of the payload read back from it, and of its RGB tensor."""
    return media_column(table(spark, sf_dir, "documents"), media=False, tensor=False).drop("height", "width")


#: The dated log of two block lists and an allow list: list_name, action, pattern, op, listed_at.
URL_LIST = [
    ("spam", "block", "spam-farm.example.org", "add", "2024-01-15"),
    ("spam", "block", "spam-farm.example.org", "remove", "2024-03-01"),
    ("spam", "block", "spam-farm.example.org", "add", "2024-04-10"),
    ("spam", "block", "example.net", "add", "2024-02-01"),
    ("spam", "block", "example.net", "remove", "2024-05-20"),
    ("adult", "block", "ththth.example.net", "add", "2023-12-01"),
    ("adult", "block", "m.thther.example.org", "add", "2024-03-12"),
    ("adult", "block", "ththan.example.net/en", "add", "2024-01-01"),
    ("adult", "block", "blog.ththre.example.org/en", "add", "2024-02-20"),
    ("adult", "block", "blog.ththre.example.org/en", "remove", "2024-02-25"),
    ("trusted", "allow", "m.ththth.example.net", "add", "2024-01-20"),
    ("trusted", "allow", "tionsh.example.net", "add", "2024-02-10"),
    ("trusted", "allow", "tionsh.example.net", "remove", "2024-04-01"),
    ("trusted", "allow", "tionsh.example.net/en", "add", "2024-04-15"),
    ("trusted", "allow", "spam-farm.example.org/en", "add", "2024-04-20"),
]


def url_log(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The log: the entries above, and a feed that lists every page's own address on one day and takes it off on another."""
    rows = ", ".join(f"('{a}', '{b}', '{c}', '{d}', date'{e}')" for a, b, c, d, e in URL_LIST)
    fixed = spark.sql(f"select * from values {rows} as t(list_name, action, pattern, op, listed_at)")
    k, day = F.col("page_id"), F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 7, 170) as int))")
    turns = F.array(F.struct(F.lit("add").alias("op"), day.alias("at")), F.struct(F.lit("remove").alias("op"), F.date_add(day, (F.lit(10) + k % 90).cast("int")).alias("at")))
    fed = pages.select(F.concat(F.lit("feed"), (k % 3).cast("string")).alias("list_name"), F.when(k % 5 == 0, "allow").otherwise("block").alias("action"), F.concat(host_of(F.col("url")), F.regexp_extract("url", PATH, 1)).alias("pattern"), F.explode(turns).alias("t"))
    return fixed.unionByName(fed.select("list_name", "action", "pattern", "t.op", F.col("t.at").alias("listed_at")))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch time: page p counts as fetched p mod 180 days after 2024-01-01."""
    pages = table(spark, sf_dir, "pages")
    fetched = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 180) as int))").alias("fetched_at"))
    return url_filters(fetched, url_log(spark, pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pack_documents": op2_pack_documents,
    "op3_mix_sources": op3_mix_sources,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_license_scans": op7_license_scans,
    "op8_token_counts": op8_token_counts,
    "op9_media_column": op9_media_column,
    "op10_url_filters": op10_url_filters,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('20240601:' || doc_id) AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS src FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][src % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS full_size FROM s),
        c AS (SELECT *, coalesce(sum(full_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight, row_number() OVER o AS k
              FROM w WINDOW o AS (ORDER BY full_size / weight, src)),
        l AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - before) / left_weight AS level FROM c),
        t AS (SELECT source, src, source_size, least(full_size, weight * (SELECT arg_min(level, k) FROM l WHERE level <= full_size / weight)) AS target FROM l),
        p AS (SELECT doc_id, d.source, src, size, source_size, target, round(target)::BIGINT AS goal, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN goal % source_size ELSE 0 END AS part, start // 4096 AS block FROM p),
        b AS (SELECT src, block, any_value(part) AS part, sum(size) AS words, min(start) AS first, md5('20240601:' || src || ':' || any_value(whole) || ':' || block) AS turn FROM q WHERE size > 0 GROUP BY src, block),
        k AS (SELECT src, block, first, least(words, part - (sum(words) OVER (PARTITION BY src ORDER BY turn, block ROWS UNBOUNDED PRECEDING) - words)) AS most FROM b)
        SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN size > 0 THEN least(size, greatest(0, most - (start - first))) ELSE 0 END)::BIGINT AS taken, source FROM q LEFT JOIN k ON k.src = q.src AND k.block = q.block""",
    "op4_near_duplicates": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(node, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
        t AS (SELECT node, min(root) AS root FROM r GROUP BY node)
        SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id, w.doc_id = root AS kept FROM w LEFT JOIN n USING (doc_id) JOIN t ON t.node = w.doc_id""",
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLD} AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op10_url_filters": f"""
        WITH p AS (SELECT page_id, lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, regexp_replace(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS path,
                     (DATE '2024-01-01' + (page_id % 180)::INTEGER) AS fetched_at, (DATE '2024-01-01' + (page_id * 7 % 170)::INTEGER) AS day FROM pages),
        fixed(list_name, action, pattern, op, listed_at) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in URL_LIST)}),
        fed AS (SELECT 'feed' || (page_id % 3) AS list_name, CASE WHEN page_id % 5 = 0 THEN 'allow' ELSE 'block' END AS action, host || rtrim(path, '/') AS pattern, day, (day + (10 + page_id % 90)::INTEGER) AS off FROM p WHERE host <> ''),
        e AS (SELECT * FROM fixed UNION ALL SELECT list_name, action, pattern, 'add', day FROM fed UNION ALL SELECT list_name, action, pattern, 'remove', off FROM fed),
        m AS (SELECT page_id, host, fetched_at, e.*, row_number() OVER (PARTITION BY page_id, list_name, action, pattern ORDER BY listed_at DESC, op DESC) AS latest
              FROM p JOIN e ON listed_at <= fetched_at AND (host = pattern OR host LIKE '%.' || pattern OR (contains(pattern, '/') AND starts_with(host || path || '/', pattern || '/')))),
        a AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, action, list_name) AS best FROM m WHERE latest = 1 AND op = 'add')
        SELECT p.page_id, nullif(p.host, '') AS host, p.fetched_at, coalesce(n, 0) AS n_active, coalesce(action, 'none') AS decision, pattern, list_name, listed_at
        FROM p LEFT JOIN a ON p.page_id = a.page_id AND best = 1""",
}
