"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks. DataFrame functions only.

Every source is a stream of words: its documents in the order of a hash of their id, cut into blocks of block_words
words (a document belongs to the block its first word is in). A draw takes a block in one pass over the source. A
source's target is whole passes, in which every block is drawn, and a part of one more: there blocks are drawn in a
permuted order (by a hash of source, pass and block) until the target is met, and the last one drawn is cut, so that a
source gives exactly its rounded target.

The draws of all sources are dealt to 2^d output shards by a binary tree. A node splits its exact quotas between two
equal halves by hypergeometric draws, source after source, so each shard's counts have the law of a uniform permutation
of all draws and sum to its capacity. A shard takes the next run of each source's draws in permuted order, and orders
its pieces by a hash. What the mix takes of a document is the sum of its pieces in the shards.

Running sums and ranks over a source go in two steps, by a prefix of the hash and then within it, so a source with a
third of all rows is spread over many tasks. The tree holds one row per shard and, in it, one number per source: sources
are a mixture's components, and their number is taken to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.plans.store import Store

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null: 0."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "[\\x20\\x09-\\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, store: Store, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, n_rows, src (rank by code point from 0, null last), target.

    target = least(most * size, weight * level), where level makes the targets sum to share * all sizes. The level is
    found by resharing: a pass over the sources gives two sums, and stops when no further source is above its bound.
    """
    spark = sizes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    per = per.repartitionByRange(parts, F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("pid"))
    per = store.put(per, "sources_dealt")
    before = per.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).select("pid", (F.sum("n").over(W.orderBy("pid")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("within", rank).join(before, "pid").withColumn("src", F.col("before") + F.col("within"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    per = store.put(per.select("source", "source_size", "n_rows", "src", weight.alias("weight")), "sources")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        above = F.col("source_size") * float(most) <= F.col("weight") * F.lit(level)
        row = per.agg(F.sum(F.when(above, F.col("source_size") * float(most))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if row[2] == capped or not row[1]:
            level = level if row[1] else None
            break
        level, capped = (total - (row[0] or 0.0)) / row[1], row[2]
    full = F.col("source_size") * float(most)
    return per.select("source", "source_size", "n_rows", "src", (full if level is None else F.least(full, F.col("weight") * F.lit(level))).alias("target"))


#: A hypergeometric draw: x of n taken from N hold the mark that K of N have; u is uniform. Weights relative to the
#: window's first value, by the ratio of neighbours; the window is the support within 8 deviations and 30 of the mean.
def _draw(n: str, big: str, marked: str, u: str) -> str:
    mean = f"({n} * ({marked} / greatest({big}, 1.0D)))"
    reach = f"(30 + 8 * sqrt({mean} * (1 - {marked} / greatest({big}, 1.0D)) + 1))"
    lo = f"cast(greatest(0, {n} - ({big} - {marked}), floor({mean} - {reach})) as bigint)"
    hi = f"cast(least({n}, {marked}, ceil({mean} + {reach})) as bigint)"
    ratio = f"((cast({marked} as double) - k) * ({n} - k) / ((k + 1.0D) * ({big} - {marked} - {n} + k + 1.0D)))"
    steps = f"sequence({lo}, {hi})"
    total = f"aggregate({steps}, struct(1.0D as w, 0.0D as s), (z, k) -> struct(z.w * {ratio} as w, z.s + z.w as s), z -> z.s)"
    return f"aggregate({steps}, struct(1.0D as w, {u} * {total} as left, {hi} as x, false as found), (z, k) -> struct(z.w * {ratio} as w, z.left - z.w as left, if(z.found, z.x, if(z.left <= z.w, k, z.x)) as x, z.found or z.left <= z.w as found), z -> z.x)"


def splitting_tree(sources: DataFrame, depth: int, seed: int, store: Store) -> DataFrame:
    """(shard, src, quota): exact quotas of every source in each of 2^depth shards. sources: src, draws."""
    node = sources.where("draws > 0").agg(F.array_sort(F.collect_list(F.struct("src", F.col("draws").alias("q")))).alias("counts")).select(F.lit(0).cast("long").alias("shard"), "counts")
    for level in range(depth):
        node = node.withColumn("total", F.expr("aggregate(counts, 0L, (a, c) -> a + c.q)"))
        u = f"((xxhash64({seed}L, {level}L, shard, c.src) & 4503599627370495L) + 0.5D) / 4503599627370496.0D"
        # Left half: a draw for each source from what is left of the node and of the half's capacity.
        fold = (
            "aggregate(counts, struct(total div 2 as n, total as big, cast(array() as array<bigint>) as xs), "
            f"(a, c) -> transform(array({_draw('a.n', 'a.big', 'c.q', u)}), x -> struct(a.n - x as n, a.big - c.q as big, concat(a.xs, array(x)) as xs))[0], a -> a.xs)"
        )
        node = node.withColumn("xs", F.expr(fold))
        left = F.expr("transform(counts, (c, i) -> struct(c.src as src, xs[i] as q))")
        right = F.expr("transform(counts, (c, i) -> struct(c.src as src, c.q - xs[i] as q))")
        node = node.select(F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), left.alias("counts")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("counts")))).alias("half")).select("half.shard", "half.counts")
        if level % 4 == 3:
            node = store.put(node, f"tree{level}")
    node = store.put(node, "tree")
    return node.select("shard", F.explode("counts").alias("c")).select("shard", F.col("c.src").alias("src"), F.col("c.q").alias("quota"))


def _running(rows: DataFrame, key: str, h: str, size: Column, order: list[str], n: int, store: Store, name: str) -> DataFrame:
    """rows with `start`: the sum of `size` over the rows of the same key that come before in the order of (h, *order).

    h is a hex hash. Sums by key and prefix of h come first; within a prefix a window has a few thousand rows.
    """
    digits = 2
    while 16**digits * 4096 < n:
        digits += 1
    held = rows.withColumn("bucket", F.substring(h, 1, digits)).withColumn("amount", size)
    sums = held.groupBy(key, "bucket").agg(F.sum("amount").alias("words"))
    offset = F.sum("words").over(W.partitionBy(key).orderBy("bucket")) - F.col("words")
    sums = store.put(sums.select(F.col(key).alias("sum_key"), F.col("bucket").alias("sum_bucket"), offset.alias("before")), name)
    inner = F.sum("amount").over(W.partitionBy(key, "bucket").orderBy(h, *order).rowsBetween(W.unboundedPreceding, 0)) - F.col("amount")
    placed = held.withColumn("inner", inner).join(sums, F.col(key).eqNullSafe(F.col("sum_key")) & (F.col("bucket") == F.col("sum_bucket")))
    return placed.select(*rows.columns, (F.col("inner") + F.col("before")).alias("start"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = 4096, shard_words: int = 1 << 21, seed: int = 20240601, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(members, pieces).

    members, one row per row of docs: doc_id, source, size, source_size, target, taken (words that the mix takes of it),
    content (a hash of its text). pieces, one row per document and pass that gives any word: doc_id, source, content,
    pass, n_words (the document's first words; all of them but in the last document of a source's last block), size,
    shard, position (from 0 in its shard).

    A null or blank text has size 0, target share and taken 0; a null source is a source of its own, after all others;
    rows that repeat an id are documents of their own, ordered by size and a hash of their text. Rows with a null id go
    by their text's hash. An empty table gives two empty results. Texts are measured whole, however long. The same rows
    give the same mix, whatever their partitions: all choices hash the id, the text and the seed.
    """
    store = Store(docs.sparkSession, "mix")
    text = F.col(text_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), name).cast("binary"))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), h.alias("h"), F.xxhash64(text).alias("content"))
    narrow = store.put(narrow, "sizes")
    sources = store.put(source_targets(narrow, store, weights, share, most), "targets")
    rows, words = sources.agg(F.sum("n_rows"), F.sum("target")).first()
    placed = _running(narrow, "source", "h", F.col("size"), ["doc_id", "size", "content"], rows or 0, store, "offsets")
    plan = sources.select(F.col("source").alias("s2"), "source_size", "src", "target")
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("s2"))).withColumn("block", F.floor(F.col("start") / block_words).cast("long"))
    placed = store.put(placed.select("doc_id", "source", "content", "h", "size", "source_size", "src", "target", "start", "block"), "placed")

    # The draws: every block in each whole pass, and of the last pass those that come first until the goal is met.
    goal = F.round("target").cast("long")
    passes = sources.where("source_size > 0").select(F.col("src").alias("k"), F.floor(goal / F.col("source_size")).cast("long").alias("whole"), (goal % F.col("source_size")).cast("long").alias("part"))
    blocks = placed.where("size > 0").groupBy("src", "block").agg(F.sum("size").alias("words"), F.min("start").alias("first"))
    blocks = store.put(blocks.join(passes, F.col("src") == F.col("k")).drop("k"), "blocks")
    drawn = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), "whole")))
    drawn = drawn.withColumn("turn", F.md5(F.concat_ws(":", F.lit(str(seed)), "src", "pass", "block").cast("binary")))
    n_blocks = blocks.count()
    ordered = _running(drawn.where("pass = whole"), "src", "turn", F.col("words"), ["block"], n_blocks, store, "part-offsets")
    last = ordered.withColumn("limit", F.least("words", F.col("part") - F.col("start")).cast("long")).where("limit > 0").drop("start")
    drawn = store.put(drawn.where("pass < whole").withColumn("limit", F.col("words").cast("long")).unionByName(last), "drawn")
    ranked = _running(drawn, "src", "turn", F.lit(1).cast("long"), ["pass", "block"], most * n_blocks, store, "ranks").withColumnRenamed("start", "rank")

    depth = 0
    while shard_words << depth < (words or 0):
        depth += 1
    quotas = splitting_tree(drawn.groupBy("src").agg(F.count(F.lit(1)).alias("draws")), depth, seed, store)
    before = F.sum("quota").over(W.partitionBy("src").orderBy("shard")) - F.col("quota")
    deal = quotas.withColumn("before", before).where("quota > 0").select("src", "shard", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("quota") - 1)).alias("rank"))
    # Neither side is a broadcast: the draws grow with the words.
    dealt = store.put(ranked.join(deal.hint("merge"), ["src", "rank"]).select("src", "block", "pass", "first", "limit", "shard"), "dealt")
    pieces = placed.where("size > 0").join(dealt.hint("merge"), ["src", "block"])
    given = F.least(F.col("size"), F.greatest(F.lit(0), F.col("limit") - (F.col("start") - F.col("first")))).cast("long")
    pieces = pieces.withColumn("n_words", given).where("n_words > 0")
    local = W.partitionBy("shard").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "h", "pass", "src").cast("binary")), "h", "pass", "start")
    pieces = store.put(pieces.select("doc_id", "source", "content", "pass", "n_words", "size", "shard", (F.row_number().over(local) - 1).cast("long").alias("position"), "src", "start"), "pieces")
    # Of the documents with words each has a start of its own in its source.
    taken = pieces.groupBy(F.col("src").alias("src2"), F.col("start").alias("start2")).agg(F.sum("n_words").alias("taken"))
    members = placed.join(taken.hint("merge"), (F.col("src") == F.col("src2")) & (F.col("start") == F.col("start2")) & (F.col("size") > 0), "left")
    members = members.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "content")
    store.keep("placed", "pieces")
    return members, pieces.drop("src", "start")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs' own columns: one row per document and pass, its text cut to the words that the mix takes.

    Documents that give no word (blank texts, or those of blocks that no pass draws) don't appear. Rows that repeat id,
    source and text deal the cuts of all of them out in turn, in the order of a hash of their other columns.
    """
    _, pieces = mix_sources(docs, **options)
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    own = docs.select(F.struct(*docs.columns).alias("row"))
    key = F.struct(F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{source_col}`").alias("source"), F.xxhash64(f"row.`{text_col}`").alias("content"))
    taken = pieces.groupBy(F.struct(F.col("doc_id").alias("id"), "source", "content").alias("key")).agg(F.array_sort(F.collect_list("n_words")).alias("cuts"))
    copies = W.partitionBy("key")
    rows = own.withColumn("key", key).join(taken.hint("merge"), "key")
    rows = rows.withColumn("copy", F.row_number().over(copies.orderBy(F.xxhash64("row"))) - 1).withColumn("copies", F.count(F.lit(1)).over(copies))
    rows = rows.select("row", F.explode(F.expr("filter(cuts, (x, i) -> i % copies = copy)")).alias("cut"))
    text = F.col(f"row.`{text_col}`")
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")
    short = F.when(F.col("cut") >= F.size(words), text).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), " "))
    return rows.select(*[short.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
