"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct five-word shingles (64-bit hashes, chained over eight bytes of a word, then words). The sketch has COORDINATES bins. In round i every
shingle is hashed to a bin and a value there, and an empty bin takes the least value; rounds go on until every bin is
full, and after COORDINATES rounds round j fills bin j - COORDINATES from all shingles, so all bins fill at the latest
after twice as many. Two sets agree in a bin with probability equal to their similarity, with the concentration of
independent hashes, and a set of many shingles costs about one hash per shingle.

1. One pass over the texts makes each document's digest of the set, band keys and two bits per bin.
2. Equal sets collapse to a node, with map-side combine; copies never meet in a band.
3. Nodes that share a band key are candidates. In each band bucket all nodes are first compared with a pivot (its least
   node); components follow; buckets whose nodes are not all in one component then try a second pivot (the greatest),
   with those that are not in its component yet, and then each node outside the first pivot's component meets every node of another component. So a bucket of near copies
   costs about one comparison per node, and no candidate pair goes undecided. A phase with no open bucket is left out.
   Components of up to MOST_EDGES links are found in one task, beyond that by rounds of joins.
4. A pair first needs the agreement of its sketch bits (almost six deviations below the threshold), then the exact similarity
   of both full sets, which are read again from the texts of candidates only. A pair that shares several bands is made
   in the first of them.

With 51 bands of the first 255 bins, five in each, a pair of similarity 0.75 shares no band with probability 1e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.components import MOST_EDGES, connected_components
from waymark.plans.store import Store
from waymark.llm.textarrays import NOT_SPACE, Words, batches, fold, mix, shingles

COORDINATES = 1024
BANDS, ROWS = 51, 5
SHARED, ALL = 75, 100
WORDS = COORDINATES // 64
#: Two bits of each bin go with a node. Of COORDINATES bins those of sets of similarity 0.75 differ there in 192 on average,
#: with a deviation of 10.1 (measured over 128,000 pairs; the most was 238), so that this limit is 5.9 deviations away.
MOST_DIFFERING = 252

_BIN = np.uint64(54)
_VALUE = np.uint64((1 << 54) - 1)
_NONE = np.uint64((1 << 64) - 1)


def _hashed(values: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Hashes of all values in each of the rounds."""
    return mix(values[None, :] ^ mix(rounds.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(1))[:, None]).ravel()


def sketch(values: np.ndarray) -> np.ndarray:
    """COORDINATES numbers for a set of 64-bit hashes (sorted, distinct, not empty): round and least value of each bin."""
    out, full = np.zeros(COORDINATES, np.uint64), np.zeros(COORDINATES, bool)
    # Round 0 takes the hashes themselves: the first of each bin is its least.
    bins = (values >> _BIN).astype(np.int64)
    head = np.flatnonzero(np.diff(bins, prepend=-1))
    full[bins[head]] = True
    out[bins[head]] = mix(values[head] & _VALUE)
    i, n = 1, len(values)
    while i < COORDINATES and not full.all():
        # A few rounds at a time: the round in the high bits, so that a bin's earliest round counts, and in it the least value.
        rounds = np.arange(i, min(COORDINATES, i + max(1, 4096 // n)))
        got = _hashed(values, rounds)
        best = np.full(COORDINATES, _NONE)
        np.minimum.at(best, (got >> _BIN).astype(np.int64), np.repeat(rounds.astype(np.uint64) << _BIN, n) | (got & _VALUE))
        new = ~full & (best != _NONE)
        out[new] = mix(best[new])
        full |= new
        i += len(rounds)
    empty = np.flatnonzero(~full)
    for at in range(0, len(empty), step := max(1, 65536 // n)):
        some = empty[at : at + step]
        out[some] = mix(_hashed(values, COORDINATES + some).reshape(len(some), n).min(1) ^ np.uint64(0xE7037ED1A0B428DB))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    parts = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, k])
    return key.view(np.int64)


def sketch_bits(coordinates: np.ndarray) -> np.ndarray:
    """The last bits of all bins as WORDS longs, then the bits before them."""
    return np.packbits(np.concatenate([coordinates & np.uint64(1), coordinates >> np.uint64(1) & np.uint64(1)]).astype(bool)).view(np.int64)


def _texts_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    for i, j in batches(texts):
        words = Words([fold(t) for t in texts[i:j]], NOT_SPACE)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            yield shingles(words.hash[a:b])


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sketched(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        size, digest, keys, bits = [], [], [], []
        for values in _texts_sets(batch.column("text").to_pylist()):
            size.append(len(values))
            digest.append(_digest(values) if len(values) else None)
            if len(values):
                coordinates = sketch(values)
                keys.append(band_keys(coordinates).tolist())
                bits.append(sketch_bits(coordinates).tolist())
            else:
                keys.append(None)
                bits.append(None)
        carried = batch.schema.names[3:]
        arrays = [batch.column("id"), batch.column("content"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), *[batch.column(c) for c in carried]]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "content", "n", "digest", "keys", "bits", *carried])


def _full_sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of candidates; a row whose text has another set (its 64-bit content hash met another's) gives none."""
    for batch in rows:
        node, values = [], []
        for n, digest, own in zip(batch.column("node").to_pylist(), batch.column("digest").to_pylist(), _texts_sets(batch.column("text").to_pylist()), strict=True):
            if len(own) and _digest(own) == digest:
                node.append(n)
                values.append(pa.array(own.view(np.int64)))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.concat_arrays(values) if values else pa.array([], pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), lists], ["node", "values"])


def _common(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        keep = []
        for a, b in zip(batch.column("a_values"), batch.column("b_values"), strict=True):
            x, y = a.values.to_numpy(), b.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(ALL * both >= SHARED * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"])


def _alike(a: str, b: str) -> Column:
    """What two nodes must meet before their sets are read: sizes and sketch bits that allow the similarity."""
    apart = [F.col(f"{a}_b{k}").bitwiseXOR(F.col(f"{b}_b{k}")) for k in range(2 * WORDS)]
    differ = sum(F.bit_count(apart[k].bitwiseOR(apart[k + WORDS])) for k in range(WORDS))
    low, high = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return (low * ALL >= high * SHARED) & (differ <= MOST_DIFFERING)


def _side(df: DataFrame, name: str, *more: str) -> DataFrame:
    """A node's columns for one side of a pair; further ones are named by the side too, but for the key."""
    rest = [F.col(c).alias(c if c == "key" else f"{name}_{c}") for c in more]
    return df.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), *[F.col(f"b{k}").alias(f"{name}_b{k}") for k in range(2 * WORDS)], *rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept, cluster, and the columns named in `carry`.

    Words are runs of non-space after lower-casing A-Z. A text of fewer than five words has its whole sequence as its
    one shingle; a null text, or one without words, has no shingle and is linked with nothing: its component is its own
    id and its cluster null. component_id is the least id reachable over links of similarity 0.75 or more; kept where it
    is the row's own; cluster is a number of the component, whatever its ids. Null ids are never a component's id unless
    all are null; rows that repeat an id and text share a component and are all kept or all not. An empty table gives an
    empty result. Texts are read whole, one batch of about a megabyte at a time, a longer text by itself.
    """
    store = Store(docs.sparkSession, "near")
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("content"), *[F.col(c).alias(f"carried{i}") for i, c in enumerate(carry or [])])
    carried = [f.name for f in own.schema][3:]
    kinds = ", ".join(["id " + own.schema["id"].dataType.simpleString(), "content long, n long, digest binary, keys array<long>, bits array<long>", *[f"{c} {own.schema[c].dataType.simpleString()}" for c in carried]])
    sketched = store.put(own.mapInArrow(_sketched, kinds), "sketches")
    # One row of each set stands for it: its id (null last) and the hash of its text find it again.
    who = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("content").alias("content"))
    groups = sketched.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.min(who).alias("who"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    nodes = store.put(groups.select("*", F.monotonically_increasing_id().alias("node")), "nodes")

    buckets = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = store.put(shared, "shared")
    held = store.put(buckets.join(shared.hint("merge"), "key").select("key", "band", "node", "low", "high"), "buckets")
    store.drop("shared")
    # What is written of a bucket is narrow; the sketch bits join it where pairs are made.
    facts = nodes.select("node", "n", *[F.col("bits")[k].alias(f"b{k}") for k in range(2 * WORDS)])
    # The sets of all candidates, once.
    wanted = held.select("node").distinct().join(nodes.select("node", "digest", "who").hint("merge"), "node")
    wanted = wanted.select("node", "digest", F.col("who.id").alias("wanted_id"), F.col("who.content").alias("wanted"))
    texts = own.select("id", "text", "content").join(wanted.hint("merge"), (F.col("content") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("wanted_id")))
    found = texts.select("node", "digest", "text").mapInArrow(_full_sets, "node long, values array<long>")
    sets = store.put(found.groupBy("node").agg(F.first("values").alias("values")), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a, b = sets.select(F.col("node").alias("u"), F.col("values").alias("a_values")), sets.select(F.col("node").alias("v"), F.col("values").alias("b_values"))
        full = pairs.select("u", "v").join(a.hint("merge"), "u").join(b.hint("merge"), "v")
        return store.put(full.mapInArrow(_common, "u long, v long"), name)

    def against(pivot: str, rows: DataFrame) -> DataFrame:
        """Each node with the pivots of its buckets, once for each. The pivots' side is joined first: they are the hot keys, and
        adaptive execution splits that join; by the other nodes, dealt evenly, the sets then follow without an exchange.
        """
        pairs = rows.where(F.col("node") != F.col(pivot)).select(F.col("node").alias("u"), F.col(pivot).alias("v")).distinct()
        return pairs.join(_side(facts, "v").hint("merge"), "v").join(_side(facts, "u").hint("merge"), "u").where(_alike("u", "v"))

    def joined(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Components of those before, each a star round its root, and of further links."""
        stars = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        return store.put(connected_components(stars.unionByName(links), store, name, MOST_EDGES), f"roots-{name}")

    def open_buckets(rows: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        """Of the rows those of buckets whose nodes are not yet all in one component, with the roots of the node and of the greatest."""
        rows = rows.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max_by("root", "node").alias("high_root")).where("r0 < r1").select("key", "high_root")
        return store.put(rows.join(several.hint("merge"), "key"), name)

    roots = store.put(connected_components(verified(against("low", held), "links-low"), store, "low", MOST_EDGES), "roots-low")
    left = open_buckets(held, roots, "open-high")
    store.drop("buckets")
    if not left.isEmpty():
        # What is in the pivot's component already needs no link to it.
        links = verified(against("high", left.where("root <> high_root AND node <> low")), "links-high")
        roots = joined(roots, links, "high")
        left = open_buckets(left.drop("root", "high_root"), roots, "open-rest")
        store.drop("open-high")
    if not left.isEmpty():
        main = left.where("node = low").select("key", F.col("root").alias("main"))
        left = store.put(left.join(main.hint("merge"), "key").withColumn("out", F.col("root") != F.col("main")), "rest")
        store.drop("open-rest")
        wide = nodes.select("node", "keys").join(facts.hint("merge"), "node")
        outside, every = left.where("out").join(wide.hint("merge"), "node"), left.join(wide.hint("merge"), "node")
        rest = _side(outside, "u", "key", "root", "low", "high", "keys", "band").join(_side(every, "v", "key", "root", "keys", "out"), "key")
        fresh = (F.col("u_root") != F.col("v_root")) & ~F.col("v").isin(F.col("u_low"), F.col("u_high")) & (~F.col("v_out") | (F.col("u") < F.col("v")))
        first = F.expr("array_position(zip_with(u_keys, v_keys, (x, y) -> x = y), true) = u_band + 1")
        roots = joined(roots, verified(rest.where(fresh & _alike("u", "v") & first), "links-rest"), "rest")
    store.drop("sets")

    placed = nodes.select("node", "digest", "least").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = store.put(placed, "placed")
    tops = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    member = store.put(placed.join(tops.hint("merge"), "root").select("digest", "component_id", F.col("root").alias("cluster")), "members")
    store.keep("sketches", "members")
    out = sketched.select("id", "n", "digest", *carried).join(member.hint("merge"), "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    mine = [F.col(c).alias(name) for c, name in zip(carried, carry or [], strict=True)]
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "cluster", *mine)
