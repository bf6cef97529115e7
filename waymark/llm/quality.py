"""Quality: a generalised additive model with pairwise interactions over text statistics.

Each feature is cut into bins at quantiles of the sample. Cyclic boosting goes round the features: a shallow tree over
the feature's bins fits the current gradient and is added, shrunk, to the feature's lookup table. Then the pairs of
features whose coarse grid explains most of what is left get tables of their own in the same way. A score is the logistic
of a sum of table entries, so scoring is a few vectorised lookups per document.

Features are counts over the whole text, made with numpy for a batch of texts at once. The fit takes at most `max_rows`
labelled rows per class (lowest hash first); scoring runs over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.textarrays import NOT_SPACE, Words, batches
from waymark.llm.toxicity import labelled_sample, learnable

BINS, COARSE, PAIRS = 32, 8, 8

NOT_BREAK = np.ones(256, np.uint8)
NOT_BREAK[[0x0A, 0x0D]] = 0


def _class(*chars: int | range) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for c in chars:
        out[list(c) if isinstance(c, range) else c] = 1
    return out


UPPER, DIGIT, HIGH = _class(range(65, 91)), _class(range(48, 58)), _class(range(128, 256))
LETTER = _class(range(65, 91), range(97, 123)) | HIGH
STOP, PUNCT = _class(*b".!?"), _class(*b",;:'\"-()")
SYMBOL = (1 - LETTER - DIGIT - STOP - PUNCT) * NOT_SPACE

FEATURES = ("words", "bytes", "word_length", "word_spread", "upper", "digit", "high", "stop", "punct", "symbol", "odd_ends", "symbol_words", "long_words", "distinct", "next_repeats", "line_length", "line_repeats", "short_lines", "top_word")


def features(texts: list[str | None]) -> np.ndarray:
    """One row per text; a text without words has zeros."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n = len(raw)
    words, lines = Words(raw, NOT_SPACE), Words(raw, NOT_BREAK)
    data, edges = words.data, np.concatenate([[0], words.ends])
    size = np.diff(edges) - 1.0

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return np.diff(sums[edges]) / np.maximum(size, 1)

    def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return np.diff(sums[first])

    count = np.diff(words.first).astype(float)
    some = np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    mean = summed(length, words.first) / some
    spread = np.sqrt(np.maximum(summed(length**2, words.first) / some - mean**2, 0))
    last, head = data[words.end - 1] if len(length) else data[:0], data[words.start] if len(length) else data[:0]
    owner, line_owner = np.repeat(np.arange(n), np.diff(words.first)), np.repeat(np.arange(n), np.diff(lines.first))

    def repeats(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values per text, and the count of its most frequent one."""
        order = np.lexsort((hashes, owner))
        o, h = owner[order], hashes[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(o) != 0) | (np.diff(h) != 0)])) if len(o) else np.zeros(0, int)
        runs = np.diff(np.append(new, len(o)))
        most = np.zeros(n)
        np.maximum.at(most, o[new], runs)
        return np.bincount(o[new], minlength=n).astype(float), most

    distinct, top = repeats(owner, words.hash)
    line_distinct, _ = repeats(line_owner, lines.hash)
    same = np.concatenate([[0.0], (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])]) if len(owner) else np.zeros(0)
    n_lines = np.maximum(np.diff(lines.first), 1).astype(float)
    line_size = (lines.end - lines.start).astype(float)
    columns = (
        np.log1p(count), np.log1p(size), mean, spread, share(UPPER), share(DIGIT), share(HIGH), share(STOP), share(PUNCT), share(SYMBOL),
        summed(SYMBOL[last], words.first) / some, summed(SYMBOL[head] * (length <= 2), words.first) / some, summed(length > 20, words.first) / some,
        distinct / some, summed(same, words.first) / some, np.log1p(summed(line_size, lines.first) / n_lines), 1 - line_distinct / n_lines, summed(line_size < 30, lines.first) / n_lines, top / some,
    )
    return np.where(count[:, None] > 0, np.stack(columns, 1), 0.0)


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        z = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            z += table[bins[f]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[bins[i] * COARSE // BINS, bins[j] * COARSE // BINS]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


RIDGE = 4.0


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values over bins from sums of gradient and curvature: each node splits where the gain is most."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > 1e-6:
            return np.concatenate([_shallow_tree(g[:cut], h[:cut], depth - 1), _shallow_tree(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), -g.sum() / (h.sum() + RIDGE))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One cut of the rows, and in each half a tree of one cut over the columns; or the transpose, if it gains more."""

    def one_way(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        best, value = -1.0, np.zeros_like(g)
        for cut in range(1, len(g)):
            halves = [(g[:cut].sum(0), h[:cut].sum(0)), (g[cut:].sum(0), h[cut:].sum(0))]
            leaves = [_shallow_tree(a, b, 1) for a, b in halves]
            gain = sum(float((-2 * a * v - b * v * v).sum()) for (a, b), v in zip(halves, leaves, strict=True))
            if gain > best:
                best, value = gain, np.concatenate([np.tile(leaves[0], (cut, 1)), np.tile(leaves[1], (len(g) - cut, 1))])
        return best, value

    (a, rows), (b, columns) = one_way(g, h), one_way(g.T, h.T)
    return rows if a >= b else columns.T


def train(x: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15) -> AdditiveModel:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(BINS) for _ in edges]
    share = float(np.clip((weight * label).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3))
    intercept = float(np.log(share / (1 - share)))
    z = np.full(len(x), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return weight * (p - label), weight * np.maximum(p * (1 - p), 1e-4)

    for _ in range(rounds):
        for f, b in enumerate(bins):
            g, h = slopes()
            step = rate * _shallow_tree(np.bincount(b, g, BINS), np.bincount(b, h, BINS), 2)
            tables[f] += step
            z += step[b]
    coarse = [b * COARSE // BINS for b in bins]
    g, h = slopes()
    gains = []
    for i in range(len(bins)):
        for j in range(i + 1, len(bins)):
            cell = coarse[i] * COARSE + coarse[j]
            gg, hh = np.bincount(cell, g, COARSE**2), np.bincount(cell, h, COARSE**2)
            gains.append((-float(_gain(gg, hh).sum()), i, j))
    pairs = [(i, j) for _, i, j in sorted(gains)[:PAIRS]]
    pair_tables = [np.zeros((COARSE, COARSE)) for _ in pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(pairs):
            g, h = slopes()
            cell = coarse[i] * COARSE + coarse[j]
            step = rate * _pair_tree(np.bincount(cell, g, COARSE**2).reshape(COARSE, COARSE), np.bincount(cell, h, COARSE**2).reshape(COARSE, COARSE))
            pair_tables[k] += step
            z += step[coarse[i], coarse[j]]
    return AdditiveModel(edges, tables, pairs, pair_tables, intercept)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", mark: str = "quality") -> AdditiveModel:
    """Fit on at most max_rows labelled documents of each class, weighted back to the classes' shares of the labels.

    Held-out labels (crc32 of the id mod 5 = 0) are read neither for the sample nor for the shares.
    Without labelled rows of both classes every text scores the share of label 1 (0.5 if there is no label).
    """
    sample = labelled_sample(docs, labels, mark, max_rows, id_col, text_col, [])

    def measured(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            texts = b.column("_text").to_pylist()
            x = np.concatenate([features(texts[i:j]) for i, j in batches(texts)]) if texts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("_h"), b.column("_label"), pa.array(list(x), pa.list_(pa.float64()))], ["h", "label", "x"])

    got = sample.select("_h", "_label", "_text").mapInArrow(measured, "h long, label int, x array<double>").toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
    label = got["label"].to_numpy().astype(float)
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    if not len(label) or label.min() == label.max():
        none = [np.zeros(BINS) for _ in FEATURES]
        return AdditiveModel([np.zeros(0)] * len(FEATURES), none, [], [], 0.0 if not len(label) else (4.0 if label[0] else -4.0))
    counts = {r[0]: r[1] for r in learnable(labels, mark, id_col).groupBy("_label").count().collect()}
    weight = np.where(label == 1, counts[1] / label.sum(), counts[0] / (1 - label).sum())
    return train(x, label, weight / weight.mean())


def score_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, score (higher: label 1 likelier).

    A null text is empty; a text without words has the score of zero features. Repeated rows get equal scores; ids,
    nulls among them, pass through; an empty table gives an empty result. A very long text is measured whole, in a batch
    of its own. The model is a few hundred numbers.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            texts = b.column("text").to_pylist()
            score = np.zeros(len(texts))
            for i, j in batches(texts):
                score[i:j] = model.score(features(texts[i:j]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(score)], ["id", "score"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
