"""What the methods promise: no label leaks, brute-force scores, recall at the threshold, hashes, long texts, clashes."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm import SCHEMA, _labelled, frame, greedy, linked, shingle_set, words
from waymark.llm import exact_dedup, licenses, media, minhash, mixing, packing, quality, textarrays, token_counts, toxicity, url_filters
from waymark.llm.queries import tokenizer_path


def test_held_out_labels_change_nothing(spark):
    docs, labels = _labelled(spark, 300, lambda rng, t: t, lambda rng, t: " ".join(w + "#" for w in t.split()))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.select("doc_id", *[F.when(out, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        a, b = [{r.doc_id: r.score for r in score(docs, fit(docs, x)).collect()} for x in (labels, flipped)]
        assert a == b


def test_convolution_equals_loops():
    rng = np.random.default_rng(4)
    size = 2 << toxicity.BUCKET_BITS
    emb = rng.normal(size=(size, 3)).astype(np.float32)
    kernels = [rng.normal(size=(k, 3, 4)).astype(np.float32) for k in toxicity.WIDTHS]
    bias = [rng.normal(size=4).astype(np.float32) for _ in toxicity.WIDTHS]
    model = toxicity.ConvModel(emb, kernels, bias, rng.normal(size=12).astype(np.float32), 0.3)
    texts = ["", None, "one", "one two", "A quite longer text, with several words", "x " * 50]
    ids, first = toxicity.word_ids(texts)
    got = model.score(ids, first)
    for i, text in enumerate(texts):
        own = ids[first[i] : first[i + 1]]
        assert len(own) == len(re.findall(r"[A-Za-z0-9]+", text or ""))
        pooled = []
        for kernel, b in zip(kernels, bias, strict=True):
            k = len(kernel)
            runs = [sum((emb[a] + emb[s]) @ kernel[j] for j, (a, s) in enumerate(own[at : at + k])) + b for at in range(len(own) - k + 1)]
            pooled.append(np.max([np.zeros(4), *runs], 0))
        z = float(np.concatenate(pooled) @ model.weight + model.intercept)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-4


def test_additive_score_equals_lookups():
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(400, 5)), rng.integers(0, 2, 400).astype(float)
    model = quality.train(x, label, np.ones(400), rounds=5, pair_rounds=3)
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        z = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        z += sum(t[bins[i] * quality.COARSE // quality.BINS][bins[j] * quality.COARSE // quality.BINS] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_features_by_hand():
    texts = ["One two two.\nshort line\nshort line", "", None, "ÄÖ 123 !!", " ".join(["w" * 30] * 4)]
    got = quality.features(texts)
    for text, row in zip(texts, got, strict=True):
        raw, f = (text or "").encode(), dict(zip(quality.FEATURES, row, strict=True))
        ws = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        lines = [x for x in re.split(rb"[\r\n]", raw) if x]
        if not ws:
            assert not row.any()
            continue
        want = {"words": np.log1p(len(ws)), "bytes": np.log1p(len(raw)), "word_length": np.mean([len(w) for w in ws]), "digit": sum(48 <= b < 58 for b in raw) / len(raw), "upper": sum(65 <= b < 91 for b in raw) / len(raw),
                "high": sum(b > 127 for b in raw) / len(raw), "distinct": len(set(ws)) / len(ws), "next_repeats": sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / len(ws),
                "long_words": sum(len(w) > 20 for w in ws) / len(ws), "line_repeats": 1 - len(set(lines)) / len(lines), "top_word": max(ws.count(w) for w in ws) / len(ws)}
        assert all(abs(f[k] - v) < 1e-9 for k, v in want.items())


def _thue_morse(n):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("AB"[x] for x in t[:n]), "".join("BA"[x] for x in t[:n])


def test_word_hashes_tell_words_apart(spark):
    """Two words that any polynomial modulo 2^64 takes for one, words of all lengths, and those that end in zero bytes."""
    a, b = _thue_morse(1024)
    short = [f"{p}{'x' * k}{q}" for p in "ab" for k in range(0, 300, 7) for q in "cd"]
    found = textarrays.Words([" ".join([a, b, a[:200], b[:200], *short]).encode()], textarrays.NOT_SPACE)
    assert len(set(found.hash.tolist())) == 4 + len(short)
    rows = [(1, f"{a} two three four five", "s"), (2, f"{b} two three four five", "s"), (3, a, "s"), (4, b, "s"), (5, a.lower(), "s")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def _pair(rng, n, common):
    pool = rng.choice(1 << 62, 2 * n - common, replace=False).astype(np.uint64)
    pool = textarrays.mix(pool)
    return np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n:]]))


def test_recall_at_the_threshold():
    """Pairs of similarity 0.75 exactly, or just above: all share a band and pass the bits. """
    rng = np.random.default_rng(11)
    off = []
    for n, common, tries in ((7, 6, 400), (14, 12, 400), (70, 60, 400), (350, 300, 300), (1400, 1200, 60)):
        assert 100 * common >= 75 * (2 * n - common)
        for _ in range(tries):
            x, y = (minhash.sketch(s) for s in _pair(rng, n, common))
            assert (minhash.band_keys(x) == minhash.band_keys(y)).any()
            apart = (minhash.sketch_bits(x) ^ minhash.sketch_bits(y)).view(np.uint64)
            off.append(int(np.bitwise_count(apart[: minhash.WORDS] | apart[minhash.WORDS :]).sum()))
    assert max(off) <= minhash.MOST_DIFFERING and 188 < np.mean(off) < 196
    # The limit is this many deviations away; the tail of a normal there is under 2e-8.
    assert (minhash.MOST_DIFFERING - np.mean(off)) / np.std(off) > 5.5


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(2)
    base = words(rng, 60)
    rows = [(None, base, "a"), (None, base + " x", "a"), (None, words(rng, 30), "a"), (7, base + " y", "b"), (7, words(rng, 30), "b"), (7, None, "b"), (9, words(rng, 30), "b"), (9, words(rng, 30), "b")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    sets = [shingle_set(t) for _, t, _ in rows]
    mine = {i: c for c in linked(dict(enumerate(sets))) for i in c}
    want = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in mine[i] if rows[j][0] is not None]
        c = min(ids, default=None) if sets[i] else d
        want.append((d, len(sets[i]), c, d == c))
    assert got == sorted(want, key=str)
    carried = minhash.near_duplicates(frame(spark, rows), carry=["source", "text"]).collect()
    assert {(r.n_shingles, r.source) for r in carried} == {(len(s), x[2]) for s, x in zip(sets, rows, strict=True)}


def test_url_paths_keep_their_case(spark):
    entries = spark.sql("select * from values ('l','block','A.org/Path/','add',date'2024-01-01'), ('m','block','b.org//x','add',date'2024-01-01') as t(list_name, action, pattern, op, listed_at)")
    urls = [("http://a.org/Path/x", "block"), ("http://a.org/path/x", "none"), ("http://A.ORG/Path", "block"), ("http://b.org/x/y", "block"), ("http://b.org/X", "none"), ("http://a.org/" + "p/" * 300, "none")]
    caps = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("date"))
    got = [r.decision for r in url_filters.url_filters(caps, entries).orderBy("page_id").collect()]
    assert got == [w for _, w in urls]
    assert url_filters.url_filters(caps.limit(0), entries).count() == 0


def _standing(found):
    out = []
    for d in sorted(found, key=lambda d: (-d[4], d[0] - d[1], d[0], d[3])):
        if not any(s[0] <= d[0] and d[1] <= s[1] for s in out):
            out.append(d)
    return sorted(out)


@pytest.mark.parametrize("seed", range(20))
def test_suppression_equals_all_pairs(seed):
    rng = random.Random(seed)
    for _ in range(60):
        found = [(a := rng.randrange(12), a + rng.randrange(1, 6), "l", f"r{rng.randrange(9)}-{i}", rng.randrange(4)) for i in range(rng.randrange(14))]
        assert licenses.standing(found) == _standing(found)


def test_detections_equal_ungated_rules():
    """Every rule over every text, places counted by splitting, notices tried at each word before a name."""
    parts = ["licensed under the", "released under the terms of the", "see the", "SPDX-License-Identifier:", "Apache License, Version 2.0", "MIT License", "GNU GPL v3 or later", "BSD-3-Clause license", "CC BY-SA 4.0", "all rights reserved",
             "permission is hereby granted, free of charge, to any person obtaining a copy", "Mozilla Public License 2.0", "some other words", "Copyright (c) 2019", "Ünïcode wörds"]
    rng = random.Random(8)
    for _ in range(60):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        ws = re.findall(rb"[0-9a-z\x80-\xff]+", textarrays.fold(text))
        joined, found = b" " + b" ".join(ws) + b" ", []
        for rule in licenses.RULES:
            for m in rule.pattern.finditer(joined):
                a, b, priority = joined[: m.start()].count(b" ") - 1, joined[: m.end()].count(b" "), rule.priority
                if rule.notice:
                    tried = [(at, p) for at in range(max(0, a - 14), a) for words_, p in licenses.NOTICES if re.fullmatch(words_, b" ".join(ws[at:a]) + b" ")]
                    a, priority = min(tried, key=lambda x: (x[0], -x[1]), default=(a, 0))
                found.append((a, b, rule.label, rule.name, priority))
        assert licenses.scan(textarrays.fold(text))[2] == _standing(found)


def test_long_texts_take_time_in_proportion():
    began = time.perf_counter()
    starts, _, found = licenses.scan(b"mit license x " * 70000)
    assert len(starts) == len(found) == 70000
    auto = token_counts.build_automaton(token_counts.vocabulary(tokenizer_path()))
    long = textarrays.Words([b"abcde" * 200000], textarrays.NOT_SPACE)
    assert auto.count(long.data, long.start, long.end - long.start, 0x20).sum() > 0
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("few", [0, 3, 64, 10**6])
def test_automaton_by_steps_and_by_bytes(monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW", few)
    rng = random.Random(few)
    pieces = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 7))) for _ in range(25)}
    ws = [bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 5, 300]))) for _ in range(70)]
    w = textarrays.Words(ws, textarrays.NOT_SPACE)
    assert token_counts.build_automaton(list(pieces)).count(w.data, w.start, w.end - w.start, None).tolist() == [greedy(x, pieces) for x in ws]


def test_equal_words_are_equal_in_bytes():
    """Even where all hashes are the same."""
    ws = ["a", "b", "a", "ab", "x" * 300, "x" * 299 + "y", "x" * 300]
    found = textarrays.Words([" ".join(ws).encode()], textarrays.NOT_SPACE)
    found.hash[:] = 5
    some, where = token_counts.distinct(found)
    assert [ws[some[k]] for k in where] == ws


def test_packing_goes_on_over_chunks():
    rng = random.Random(3)
    fit, room = packing.BestFit(100, first=7), {}
    for _ in range(5):
        lengths = [rng.randrange(1, 101) for _ in range(50)]
        where, offset = fit.place(lengths)
        for i in sorted(range(50), key=lambda i: -lengths[i]):
            fits = [r for r in room.values() if r >= lengths[i]]
            assert 100 - offset[i] == (min(fits) if fits else 100) and (fits or where[i] not in room)
            room[where[i]] = room.get(where[i], 100) - lengths[i]
    assert sorted(room) == list(range(7, fit.next)) and min(room.values()) >= 0


def test_packing_uses_the_files_own_library_where_it_must(tmp_path):
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        model = json.load(f)
    model["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(model), encoding="utf-8")
    assert packing.byte_bpe_encoder(str(tmp_path / "t.json"))("ABC Def") == packing.byte_bpe_encoder(tokenizer_path())("abc def")


def _mix(rows, block_words=64, seed=20240601):
    """What the mix takes of each row (id, text, source), by definition."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight, target, left, free = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(total.values()), set(names)
    while True:
        level = left / max(1, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * level >= 2 * total[s]}
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        left, free = left - sum(2 * total[s] for s in over), free - over
    target |= {s: weight[s] * level for s in free}
    taken = [0] * len(rows)
    for src, s in enumerate(names):
        order = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (md5(f"{seed}:{rows[i][0] if rows[i][0] is not None else md5(rows[i][1] or '')}"), size[i]))
        blocks, at = {}, 0
        for i in order:
            if size[i]:
                blocks.setdefault(at // block_words, []).append(i)
            at += size[i]
        if not at:
            continue
        whole, part = divmod(int(np.floor(target[s] + 0.5)), at)
        for i in order:
            taken[i] = whole * size[i]
        for b in sorted(blocks, key=lambda b: md5(f"{seed}:{src}:{whole}:{b}")):
            for i in blocks[b]:
                n = min(size[i], part)
                taken[i], part = taken[i] + n, part - n
    return taken


def test_mixing_equals_its_definition(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.choice([1, 5, 40, 300])), rng.choice(["s0", "s0", "s1", "s2", None])) for i in range(120)] + [(500, None, "s0"), (501, " ", "s9"), (None, "a b c", "s1"), (None, words(rng, 20), "s1")]
    members, pieces = mixing.mix_sources(frame(spark, rows), block_words=64, shard_words=500)
    got = sorted(((r.doc_id, r.source, r["size"], r.taken) for r in members.collect()), key=str)
    assert got == sorted(((d, s, len((t or "").split()), n) for (d, t, s), n in zip(rows, _mix(rows), strict=True)), key=str)
    dealt = pieces.collect()
    assert sum(r.n_words for r in dealt) == sum(r[3] for r in got) and len({(r.shard, r.position) for r in dealt}) == len(dealt)
    # A block's pieces of one pass are in one shard: as many draws in a shard as the tree's quota, capacities equal within one.
    shards = {r.shard for r in dealt}
    assert max(shards) > 2


def test_mixed_documents_with_repeats_and_clashing_names(spark):
    rng = random.Random(7)
    base = words(rng, 30)
    rows = [(1, base, "s0")] * 3 + [(1, words(rng, 30), "s0"), (2, words(rng, 30), "s1"), (None, base, "s1"), (None, base, "s1")]
    docs = frame(spark, rows).withColumnsRenamed({"gid": "cut", "node": "copies", "size": "key", "text_sha256": "content"}).withColumn("pass", F.lit(1)).withColumn("row", F.lit(2))
    out = mixing.mixed_documents(docs, block_words=8)
    assert out.columns == docs.columns
    members, _ = mixing.mix_sources(docs, block_words=8)
    count = lambda df, c: {tuple(r) for r in df.groupBy("doc_id", "source").agg(F.sum(c)).collect()}
    assert count(out.withColumn("n", mixing.n_words(F.col("text"))), "n") == count(members.where("taken > 0"), "taken")
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed_documents(docs.repartition(5), block_words=8).collect()))


def test_pipeline_decides_by_row(spark, tmp_path, monkeypatch):
    """Rows that share an id go by their own texts: one may be toxic, a copy, or near another."""
    rng = random.Random(12)
    base = words(rng, 60)
    insult = lambda t: " ".join([*t.split()[:3], "idiot", *t.split()[3:]])
    docs, labels = _labelled(spark, 400, lambda rng, t: t, lambda rng, t: insult(t))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd = [(9001, insult(words(rng, 40)), "s"), (9001, base, "s"), (9002, base.upper(), "s"), (9003, base + " tail", "s"), (9003, words(rng, 50), "s"), (None, base, "s"), (None, None, "s"), (9004, "", "s"), (9005, base, "s"), (9005, base, "s")]
    docs = docs.unionByName(frame(spark, odd))
    clean = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in clean.collect()]
    assert (9001, odd[0][1]) not in kept and (9001, base) in kept
    once = corpus_pipeline.drop_copies(spark, clean, str(tmp_path))
    groups = {}
    for d, t in kept:
        groups.setdefault(textarrays.fold(t), []).append(d)
    want = [(max((d for d in ids if d is not None), default=None), t) for t, ids in groups.items()]
    assert sorted(((r.doc_id, textarrays.fold(r.text)) for r in once.collect()), key=str) == sorted(want, key=str)
    near = corpus_pipeline.drop_near_copies(spark, once, str(tmp_path))
    rows = [(r.doc_id, r.text) for r in once.collect()]
    sets = dict(enumerate(shingle_set(t) for _, t in rows))
    least = sorted((min((rows[i][0] is None, rows[i][0] or 0) for i in c) for c in linked(sets)), key=str)
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in near.collect()), key=str) == least
    assert near.columns == docs.columns


def test_empty_tables(spark):
    none = frame(spark, [])
    model = quality.fit_quality(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    path = tokenizer_path()
    for out in (quality.score_quality(none, model), licenses.scan_licenses(none), token_counts.token_counts(none, path), media.media_column(none), exact_dedup.exact_dedup(none), minhash.near_duplicates(none), mixing.mixed_documents(none), packing.pack_documents(none, path)):
        assert out.count() == 0


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "one two", "en", "s"), ("b", "one  two three", "en", "s"), (None, "ONE TWO", "en", None)], "doc_id string, text string, lang string, source string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs).collect()} == {("a", "a"), (None, "a"), ("b", "b")}
    assert {r.doc_id for r in packing.pack_documents(docs, tokenizer_path()).collect()} == {"a", "b", None}
    assert {r.doc_id for r in mixing.mix_sources(docs)[0].collect()} == {"a", "b", None}
    assert set(SCHEMA.split(", ")[0].split()) == {"doc_id", "long"}
