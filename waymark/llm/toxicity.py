"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (letters and digits, A-Z lower-cased) hash to two rows of an embedding table, one for the whole word and one for
its first bytes, whose sum is the word's vector; so inflected forms share what they have learned. Filters of several widths slide over the
word sequence, each filter keeps its maximum over the whole text, and a logistic layer weighs the maxima. For scoring,
embedding and filters fold into one table per width and tap, so a text costs a few gathers per word, however long it is.

Training takes a sample of labelled rows of at most `max_rows` per class (lowest hash first), gathered as hashed word
ids; everything else runs over all rows. A threshold per language is calibrated on a part of the sample that the fit
doesn't see; the language chooses only the threshold, never the score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.textarrays import ALNUM, Words, batches, fold

BUCKET_BITS = 15
STEM_BYTES = 5
WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 12


@dataclass
class ConvModel:
    """emb: rows of words, then of stems; kernels[width]: taps x dim x filters; weight over the maxima of all filters."""

    emb: np.ndarray
    kernels: list[np.ndarray]
    bias: list[np.ndarray]
    weight: np.ndarray
    intercept: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    @cached_property
    def tables(self) -> list[list[np.ndarray]]:
        """tables[width][tap]: what a word adds to each filter there."""
        return [[np.ascontiguousarray(self.emb @ tap) for tap in kernel] for kernel in self.kernels]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def maxima(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per text the maximum of each filter, at least 0; texts are ids[first[i]:first[i + 1]]."""
        n = len(first) - 1
        out = []
        for taps, bias in zip(self.tables, self.bias, strict=True):
            k = len(taps)
            best = np.zeros((n, len(bias)), np.float32)
            if len(ids) >= k:
                total = None
                for j in range(k):
                    for part in (0, 1):
                        got = taps[j].take(ids[j : len(ids) - k + 1 + j, part], axis=0)
                        total = got if total is None else np.add(total, got, out=total)
                # Texts with at least k words; the runs that cross into the next text are left out.
                has = np.flatnonzero(np.diff(first) >= k)
                if len(has):
                    bounds = np.stack([first[has], first[has + 1] - k + 1], 1).ravel()
                    if bounds[-1] == len(total):
                        bounds = bounds[:-1]
                    best[has] = np.maximum(np.maximum.reduceat(total, bounds, axis=0)[::2] + bias, 0)
            out.append(best)
        return np.concatenate(out, 1)

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.maxima(ids, first).astype(np.float64) @ self.weight.astype(np.float64) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n x 2 table rows, first): a row of ids per word; text i's words are first[i]:first[i + 1]."""
    words = Words([fold(t) for t in texts], ALNUM)
    ids = np.empty((len(words.hash), 2), np.int64)
    ids[:, 0] = words.hash >> np.uint64(64 - BUCKET_BITS)
    ids[:, 1] = (words.stems(STEM_BYTES) >> np.uint64(64 - BUCKET_BITS)) + np.uint64(1 << BUCKET_BITS)
    return ids, words.first


def train(ids: list[np.ndarray], label: np.ndarray, epochs: int | None = None, batch: int = 64, rate: float = 0.01, word_rate: float = 1.0, drop: float = 0.2, seed: int = 7) -> ConvModel:
    """Adam on the logistic loss. Gradients reach only the words at each filter's maximum. Small samples take more epochs."""
    epochs = epochs or int(np.clip(24000 // max(1, len(ids)), 8, 20))
    rng = np.random.default_rng(seed)
    size = 2 << BUCKET_BITS
    emb = rng.normal(0, 0.02, (size, DIM)).astype(np.float32)
    kern = [rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = np.concatenate([rng.choice([-0.5, 0.5], FILTERS * len(WIDTHS)).astype(np.float32), [0.0]]).astype(np.float32)
    dense = [*kern, *bias, out]
    m, v = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    step = 0
    share = label.mean() if len(label) else 0.0
    balance = np.where(label > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))

    def adam(p, g, mm, vv):
        mm[...] = 0.9 * mm + 0.1 * g
        vv[...] = 0.99 * vv + 0.01 * g * g
        p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-6)

    for _ in range(epochs):
        for at in np.array_split(order := rng.permutation(len(ids)), max(1, len(order) // batch)):
            step += 1
            grads, ge = [np.zeros_like(p) for p in dense], {}
            rows = [ids[i][rng.random(len(ids[i])) >= drop] for i in at]
            flat = np.concatenate(rows).astype(np.int64)
            first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            used, where = np.unique(flat, return_inverse=True)
            where = where.reshape(flat.shape)
            vectors = emb[used]
            pooled, hits = [], []
            for k, kernel, b in zip(WIDTHS, kern, bias, strict=True):
                runs = max(0, len(where) - k + 1)
                total = np.zeros((runs, FILTERS), np.float32) + b
                for j in range(k):
                    tap = vectors @ kernel[j]
                    for part in (0, 1):
                        total += tap.take(where[j : j + runs, part], axis=0)
                best = np.zeros((len(rows), FILTERS), np.float32)
                arg = np.full((len(rows), FILTERS), -1)
                for r in range(len(rows)):
                    lo, hi = first[r], first[r + 1] - k + 1
                    if hi > lo:
                        a = total[lo:hi].argmax(0) + lo
                        best[r] = total[a, np.arange(FILTERS)]
                        arg[r] = np.where(best[r] > 0, a, -1)
                pooled.append(np.maximum(best, 0))
                hits.append(arg)
            feats = np.concatenate(pooled, 1)
            z = feats @ out[:-1] + out[-1]
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[at]) * balance[at] / len(at)).astype(np.float32)
            grads[-1][:-1], grads[-1][-1] = feats.T @ d + 1e-4 * out[:-1], d.sum()
            de = np.zeros_like(vectors)
            for w, (k, kernel) in enumerate(zip(WIDTHS, kern, strict=True)):
                back = d[:, None] * out[w * FILTERS : (w + 1) * FILTERS]
                r, f = np.nonzero(hits[w] >= 0)
                pos, g = hits[w][r, f], back[r, f]
                np.add.at(grads[len(WIDTHS) + w], f, g)
                for j in range(k):
                    for part in (0, 1):
                        row = where[pos + j, part]
                        np.add.at(de, row, g[:, None] * kernel[j][:, f].T)
                        np.add.at(grads[w][j].T, f, g[:, None] * vectors[row])
            for i, p in enumerate(dense):
                adam(p, grads[i], m[i], v[i])
            # Plain gradient steps: a word moves as often as it decides, so a rare one stays near nothing.
            emb[used] -= word_rate * de
        rate *= 0.85 ** (8 / epochs)
    return ConvModel(emb, kern, bias, out[:-1], float(out[-1]))


def best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The middle of the widest gap among the best cuts, 0.5 at least; 0.5 where one class is absent.

    A clean text that is rejected counts twice as much as a toxic one that is kept.
    """
    if len(score) == 0 or label.min() == label.max():
        return 0.5
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order]
    below = np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()
    above = 1 - np.concatenate([[0], np.cumsum(y)]) / y.sum()
    edges = np.concatenate([[0.0], s, [1.0]])
    gaps = np.diff(edges)
    quality = np.where(gaps > 0, np.round(2 * below + above, 9), -1)
    top = np.flatnonzero(quality == quality.max())
    cut = top[np.argmax(gaps[top])]
    return float(np.clip((edges[cut] + edges[cut + 1]) / 2, 0.5, 0.95))


def learnable(labels: DataFrame, mark: str, id_col: str) -> DataFrame:
    """Label rows (_id, _label, _h) that a fit may see: marked 0 or 1, with an id, not held out (crc32 mod 5 = 0)."""
    seen = labels.where(F.col(mark).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    return seen.select(F.col(id_col).alias("_id"), F.col(mark).cast("int").alias("_label"), F.xxhash64(F.col(id_col)).alias("_h"))


def labelled_sample(docs: DataFrame, labels: DataFrame, mark: str, max_rows: int, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """At most max_rows labelled rows of each class, lowest hash of the id first; rows held out (crc32 mod 5 = 0) never."""
    seen = learnable(labels, mark, id_col)
    halves = [seen.where(F.col("_label") == k).orderBy("_h", "_id").limit(max_rows) for k in (0, 1)]
    picked = halves[0].unionByName(halves[1])
    own = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_{c}") for c in columns])
    return own.join(F.broadcast(picked), F.col("_doc") == F.col("_id"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", mark: str = "toxic") -> ConvModel:
    """Train on at most max_rows labelled documents of each class; four fifths fit, the rest calibrates the thresholds.

    Without labelled rows the model scores every text 0.5 below its threshold. Languages with fewer than 20 held rows or
    5 toxic ones, unknown and null languages use the common threshold.
    """
    sample = labelled_sample(docs, labels, mark, max_rows, id_col, text_col, [lang_col] if lang_col else [])
    lang = F.col(f"_{lang_col}") if lang_col else F.lit(None).cast("string")

    def hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids, first = word_ids(b.column("_text").to_pylist())
            raw = [ids[i:j].astype("<u4").tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_h"), b.column("_label"), b.column("lang"), pa.array(raw, pa.binary())], ["h", "label", "lang", "ids"])

    def learned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _learn([r for b in rows for r in b.to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # The sample is bounded, so one task trains; only the model comes to the driver.
    ids = sample.select("_h", "_label", lang.alias("lang"), "_text").mapInArrow(hashed, "h long, label int, lang string, ids binary")
    row = ids.repartition(1).mapInArrow(learned, "model binary").first()
    return pickle.loads(row["model"]) if row else _learn([])


def _learn(rows: list[dict]) -> ConvModel:
    """rows: h, label, lang, ids (table rows of words and stems, little-endian)."""
    rows = sorted(rows, key=lambda r: (r["h"], r["label"]))
    label = np.array([r["label"] for r in rows], np.float32)
    if not rows or label.min() == label.max():
        return ConvModel(np.zeros((2 << BUCKET_BITS, 1), np.float32), [np.zeros((k, 1, FILTERS), np.float32) for k in WIDTHS], [np.zeros(FILTERS, np.float32)] * len(WIDTHS), np.zeros(FILTERS * len(WIDTHS), np.float32), -1e-3)
    ids, langs = [np.frombuffer(r["ids"], "<u4").reshape(-1, 2) for r in rows], [r["lang"] for r in rows]
    held = np.arange(len(ids)) % 5 == 4
    model = train([x for x, h in zip(ids, held, strict=True) if not h], label[~held])
    at = np.flatnonzero(held)
    first = np.concatenate([[0], np.cumsum([len(ids[i]) for i in at])]).astype(np.int64)
    score = model.score(np.concatenate([ids[i] for i in at]).astype(np.int64), first)
    model.threshold = best_threshold(score, label[at])
    for name in sorted({x for x in langs if x is not None}):
        own = np.array([langs[i] == name for i in at])
        if own.sum() >= 20 and 5 <= label[at][own].sum() < own.sum():
            model.thresholds[name] = best_threshold(score[own], label[at][own])
    return model


def score_toxicity(docs: DataFrame, model: ConvModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per row of docs: id_col, score, threshold (of its language), rejected (score >= threshold).

    A null text is empty; an empty text has the score of no words; a very long one is scored whole, in a batch of its
    own. Repeated rows get equal scores. The model (a few MB, its size fixed by the table) is broadcast.
    """
    verdict = _verdicts(docs, model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            score, cut = verdict(b.column("text"), b.column("lang"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(score), pa.array(cut), pa.array(score >= cut)], ["id", "score", "threshold", "rejected"])

    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, threshold double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: ConvModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that score below their threshold, with all their columns: each row goes by its own text."""
    verdict = _verdicts(docs, model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            score, cut = verdict(b.column(text_col), b.column(lang_col))
            yield b.filter(pa.array(score < cut))

    return docs.mapInArrow(run, docs.schema)


def _verdicts(docs: DataFrame, model: ConvModel):
    """(texts, languages) -> scores and thresholds, in a task."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def verdict(column: pa.Array, langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own, texts = shared.value, column.to_pylist()
        score = np.zeros(len(texts))
        for i, j in batches(texts):
            score[i:j] = own.score(*word_ids(texts[i:j]))
        return score, np.array([own.thresholds.get(x, own.threshold) for x in langs.to_pylist()], float)

    return verdict
