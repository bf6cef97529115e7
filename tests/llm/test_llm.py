"""Each training-data operator against a brute-force version, on small tables with nulls, empty texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import exact_dedup, licenses, media, minhash, mixing, packing, quality, textarrays, token_counts, toxicity, url_filters
from waymark.llm.queries import tokenizer_path

#: Extra columns carry names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gid long, node long, text_sha256 string, size long"


def frame(spark, rows, parts=3):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(d, t, "en", s, None, 1, 2, "x", 3) for d, t, s in rows], SCHEMA).repartition(parts)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "Ünder", "x1"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, words(rng, rng.randrange(1, 60)), f"s{i % 3}") for i in range(40)]
    base = words(rng, 80)
    out += [(100 + i, base, "s0") for i in range(12)] + [(200, base.upper(), None), (201, base + " tail", "s1"), (202, "head " + base, None)]
    out += [(300, None, "s1"), (301, "", "s2"), (302, " \n\t", None), (303, None, None), (None, "orphan text here", "s1"), (5, out[5][1], out[5][2]), (304, words(rng, 9000), "s2"), (305, "a b c", "s0"), (306, "A b C", "s0")]
    return out


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup(spark, rows):
    got = sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, rows), first_digit=4).collect()), key=str)
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(fold(t), []).append(d)
    want = []
    for d, t, _ in rows:
        ids = [x for x in groups[fold(t)] if x is not None]
        keep = max(ids) if ids else None
        want.append((d, keep, len(groups[fold(t)]), d == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_long_copies_take_few_rounds(spark, monkeypatch):
    """Each round is a handful of jobs, whose plans and threads weigh on the driver: texts of 100 KB are over in four."""
    put, names = exact_dedup.Store.put, []
    monkeypatch.setattr(exact_dedup.Store, "put", lambda self, df, name: (names.append(name), put(self, df, name))[1])
    text = words(random.Random(8), 14000)
    assert 90_000 < len(text) < 130_000
    rows = [(i, text + tail, "s0") for i, tail in enumerate(["", "", " x", " y"])]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (3, 1)}
    assert sum(n.startswith("level") for n in names) == 4


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(sets):
    """Components, as sets of keys, of links of similarity 0.75 or more; a key without shingles is alone."""
    out = []
    for k, own in sets.items():
        touched = [c for c in out if any(own and 100 * len(own & sets[j]) >= 75 * len(own | sets[j]) for j in c)]
        out = [c for c in out if c not in touched] + [{k}.union(*touched)]
    return out


def test_near_duplicates(spark, rows):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    sets = [shingle_set(t) for _, t, _ in rows]
    mine = {i: c for c in linked(dict(enumerate(sets))) for i in c}
    want = set()
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in mine[i] if rows[j][0] is not None]
        c = min(ids, default=None) if sets[i] else d
        want.add((d, len(sets[i]), c, d == c))
    assert got == want
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_drifting_copies(spark):
    """Copies with ever more edits: links are between neighbours, not with one pivot."""
    rng = random.Random(9)
    base = words(rng, 120).split()
    rows = []
    for i in range(60):
        t = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 9)):
            t[k] = f"e{i}x{k}"
        rows.append((i, " ".join(t), "s"))
    test_near_duplicates(spark, rows)


def test_near_duplicates_write_few_tables(spark, monkeypatch):
    """On tables with large groups the time went into rounds of components, each of many short stages."""
    from waymark.plans.store import Store

    put, names = Store.put, []
    monkeypatch.setattr(Store, "put", lambda self, df, name: names.append(name) or put(self, df, name))
    test_near_duplicates_of_drifting_copies(spark)
    assert "links-low" in names and len(names) <= 2 * 16


def test_near_duplicates_second_pivot_meets_other_components_only(spark, monkeypatch):
    from waymark.plans.store import Store

    put, roots, links = Store.put, {}, []

    def seen(self, df, name):
        out = put(self, df, name)
        if name == "roots-low":
            roots.update({r.node: r.root for r in out.collect()})
        if name == "links-high":
            links.extend((roots.get(r.u, r.u), roots.get(r.v, r.v)) for r in out.collect())
        return out

    monkeypatch.setattr(Store, "put", seen)
    rng, rows = random.Random(9), []
    base = words(rng, 120).split()
    for i in range(60):
        t = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 9)):
            t[k] = f"e{i}x{k}"
        rows.append((i, " ".join(t), "s"))
    minhash.near_duplicates(frame(spark, rows)).collect()
    assert roots and all(a != b for a, b in links)


def test_near_duplicates_beyond_the_bound_of_one_task(spark, rows, monkeypatch):
    monkeypatch.setattr(minhash, "MOST_EDGES", 2)
    test_near_duplicates(spark, rows)
    test_near_duplicates_of_drifting_copies(spark)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    off = []
    for n in (1, 4, 60, 900):
        pool = np.unique(rng.integers(0, 2**64, 3 * n, dtype=np.uint64))
        a, b = np.sort(pool[: 2 * n]), np.sort(pool[n : 3 * n])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        off.append(abs((minhash.sketch(a) == minhash.sketch(b)).mean() - j))
        assert (minhash.sketch(a) == minhash.sketch(a.copy())).all()
    assert max(off) < 0.06


def test_mixing(spark, rows):
    members, pieces = mixing.mix_sources(frame(spark, rows), block_words=64, shard_words=2000)
    got, dealt = members.collect(), pieces.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(map(str, [(r.doc_id, r.source, r["size"]) for r in got])) == sorted(map(str, [(d, s, size(t)) for d, t, s in rows]))
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    names = sorted([s for s in totals if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(totals.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * totals[s]}
        if not over:
            break
        target |= {s: 2.0 * totals[s] for s in over}
        left -= sum(2 * totals[s] for s in over)
        free -= over
    target |= {s: weight[s] * level for s in free}
    for s in names:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == totals[s] and 0 <= r.taken <= 2 * r["size"] for r in own)
        assert sum(r.taken for r in own) == round(target[s]) == sum(p.n_words for p in dealt if p.source == s)
    shards = {}
    for p in dealt:
        shards.setdefault(p.shard, []).append(p.position)
    assert len(shards) > 4 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    again, _ = mixing.mix_sources(frame(spark, rows, parts=7), block_words=64, shard_words=2000)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    mixed = mixing.mixed_documents(frame(spark, rows))
    assert mixed.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert mixing.mix_sources(frame(spark, []))[1].count() == 0


def test_splitting_tree_has_exact_quotas(spark):
    from waymark.plans.store import Store

    draws = {0: 700, 1: 3, 2: 1000, 3: 1}
    tree = mixing.splitting_tree(spark.createDataFrame(list(draws.items()), "src long, draws long"), 4, 11, Store(spark, "t")).collect()
    assert {s: sum(r.quota for r in tree if r.src == s) for s in draws} == draws
    shard = [sum(r.quota for r in tree if r.shard == k) for k in range(16)]
    assert max(shard) - min(shard) <= 1 and min(r.quota for r in tree) >= 0


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    rows = [r for r in rows if r[0] != 5] + [(900, "a <|endoftext|> b", "s")]
    got = packing.pack_documents(frame(spark, rows), path, chunk=20).collect()
    tok = Tokenizer.from_file(path)
    for d, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        own, at = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 101) for _ in range(300)]
    fit = packing.BestFit(100)
    where, offset = fit.place(lengths)
    n = fit.next
    room, at = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(r, w) for w, r in enumerate(room) if r >= lengths[i]]
        if fits:
            r = min(fits)[0]
            assert 100 - offset[i] == r  # the tightest room
            room[where[i]] -= lengths[i]
        else:
            assert offset[i] == 0
            room.append(100 - lengths[i])
        at[i] = where[i]
    assert n == len(room) and min(room) >= 0


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        k = next(k for k in range(len(word) - i, 0, -1) if word[i : i + k] in pieces or k == 1)
        i, n = i + k, n + 1
    return n


def test_token_counts(spark, rows):
    pieces = set(token_counts.vocabulary(tokenizer_path()))
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in token_counts.token_counts(frame(spark, rows), tokenizer_path()).collect())
    want = []
    for d, t, _ in rows:
        ws = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        want.append((str(d), len(ws), sum(greedy(b" " + w, pieces) for w in ws)))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_greedy(seed):
    rng = random.Random(seed)
    pieces = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 7))) for _ in range(25)}
    auto = token_counts.build_automaton(list(pieces))
    ws = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    w = textarrays.Words(ws, textarrays.NOT_SPACE)
    assert auto.count(w.data, w.start, w.end - w.start, None).tolist() == [greedy(x, pieces) for x in ws]


BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_licenses(spark, rows):
    texts = ["Licensed under the Apache License, Version 2.0.", "GNU General Public License v3 or later; MIT License! mit license", "cc-by cc by-nc-sa 4.0", "gnu\ngeneral  public-license", "accby apache licenses", "Ünder the MIT license"]
    rows = rows + [(1000 + i, t, "s") for i, t in enumerate(texts)]
    got = {(str(r.doc_id), r.n_words, tuple(r.base_starts), tuple(r.base_labels)) for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    want = set()
    for d, t, _ in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
        hits = [(i, label) for p, label in BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        want.add((str(d), len(ws), tuple(sorted(i for i, _ in hits)), tuple(sorted({x for _, x in hits}))))
    assert got == want
    labels = lambda t: [d[2] for d in licenses.scan(t.lower().encode())[2]]
    assert labels(texts[0]) == ["apache-2.0"] and labels(texts[1]) == ["gpl-3.0-or-later", "mit", "mit"]
    assert len(licenses.RULES) > 200


def test_media_round_trip(spark, rows):
    got = media.media_column(frame(spark, rows)).collect()
    for r in got:
        texts = [t for d, t, _ in rows if d == r.doc_id]
        raw = (texts[0] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert media.read_payload(media.decode(bytes(r.media))) == payload and len(r.tensor) == r.height * r.width * 3


def test_slow_decoder_agrees(monkeypatch):
    payload = bytes(range(256)) * 3
    stored = media.encode(payload)
    fast = media.decode(stored)
    monkeypatch.setattr(media, "_fast_scan", lambda *a: False)
    slow = media.decode(stored)
    assert all((fast.components[k].coefficients == slow.components[k].coefficients).all() for k in fast.components)
    assert media.rgb(fast).shape == (fast.height, fast.width, 3)


def test_inverse_transform_of_a_constant():
    block = np.zeros((1, 64), np.float32)
    block[0, 0] = 80
    assert np.allclose(block @ media.INVERSE, 10)


def test_url_filters(spark):
    entries = spark.sql("select * from values ('l','block','a.org','add',date'2024-01-02'), ('l','block','a.org','remove',date'2024-01-05'), ('l','block','a.org','add',date'2024-01-05'), ('k','allow','a.org/x','add',date'2024-01-03'), ('k','allow',null,'add',date'2024-01-03') as t(list_name, action, pattern, op, listed_at)")
    urls = [("http://A.org:80/", 1, "none"), ("http://u@b.a.org/y", 2, "block"), ("http://a.org./x/z?q", 3, "allow"), ("http://a.org/xy", 4, "block"), ("http://a.org", 5, "none"), ("http://ba.org/", 3, "none"), (None, 3, "none"), ("nonsense", 3, "none"), ("http://a.org/x", None, "none")]
    rows = [(i, u, d and f"2024-01-0{d}") for i, (u, d, _) in enumerate(urls)] + [(1, urls[1][0], "2024-01-02")]
    caps = spark.createDataFrame(rows, "page_id long, url string, at string").select("page_id", "url", F.col("at").cast("date").alias("fetched_at"), F.lit(1).alias("n"), F.lit(2).alias("key"))
    got = [(r.page_id, r.decision) for r in url_filters.url_filters(caps, entries).orderBy("page_id").collect()]
    assert got == sorted([(i, w) for i, (_, _, w) in enumerate(urls)] + [(1, "block")])
    assert url_filters.url_filters(caps, entries.limit(0)).where("decision <> 'none'").count() == 0


def _labelled(spark, n, good, bad):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        t = words(rng, rng.randrange(5, 80))
        mark = i % 4 == 0
        if mark:
            t = bad(rng, t)
        docs.append((i, good(rng, t) if not mark else t, "s"))
        labels.append((i, 0 if mark else 1, 1 if mark else 0))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    insult = lambda rng, t: " ".join([*t.split()[:3], rng.choice(["idiot", "moron"]), *t.split()[3:]])
    docs, labels = _labelled(spark, 700, lambda rng, t: t, insult)
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert scored.where((F.col("score") >= 0.5).cast("int") == F.col("toxic")).count() >= 0.93 * scored.count()
    odd = toxicity.score_toxicity(frame(spark, [(1, None, None), (1, "", None), (None, "x " * 30000, "s")]), model).collect()
    assert len(odd) == 3 and odd[0].score == odd[1].score or len({r.score for r in odd}) <= 2
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, none).where("rejected").count() == 0


def test_quality_held_out(spark):
    junk = lambda rng, t: " ".join(w + "###" for w in t.split())
    docs, labels = _labelled(spark, 600, lambda rng, t: t, junk)
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert scored.where((F.col("score") >= 0.3).cast("int") == F.col("quality")).count() >= 0.95 * scored.count()
    odd = quality.score_quality(frame(spark, [(1, None, None), (2, " ", None), (2, "x " * 30000, "s")]), model).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0))).first().score == 0.5


def test_pipeline_equals_its_stages(spark, tmp_path):
    """Every stage's result against brute force over what the stage before it kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = docs.collect(), out.collect()
        ids = [r.doc_id for r in after]
        if name == "toxicity":
            marked = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
            assert len(set(ids) & marked) >= 0.9 * len(marked & {r.doc_id for r in before})
        if name == "exact_dedup":
            assert sorted(ids) == sorted({fold(r.text): r.doc_id for r in sorted(before, key=lambda r: r.doc_id)}.values())
        if name == "near_duplicates":
            sets = {r.doc_id: shingle_set(r.text) for r in before}
            assert sorted(ids) == sorted({min(c) for c in linked(sets)})
        if name == "mixing":
            members, _ = mixing.mix_sources(docs)
            assert out.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == members.select(F.sum("taken")).first()[0]
        if name != "packing":
            assert out.columns == docs.columns
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
        docs = out
