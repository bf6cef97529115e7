"""Token counts by a linear longest-match automaton over a vocabulary trie.

Greedy longest-match word pieces of a word could back up many bytes at each piece. Here each trie node has a failure
link and the number of pieces that are popped on the way: where a node has no child for the next byte, its text is cut
into its longest-match pieces (only their number is kept) and the link leads to the node of what is left. So a word's
count takes one pass over its bytes, and no piece is ever built.

The automaton's arrays come from a vocabulary file (their size is fixed by it) and are broadcast. A batch of texts runs
each of its distinct words once, all words in step, with numpy; where only a few long words are left, each goes on by
itself, byte by byte. Words count as equal where their hashes and all their bytes are. A document's count is a sum over
its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.textarrays import LONG, NOT_SPACE, Words, batches


#: Fewer words than this go on by themselves: a step of numpy costs about as much as so many single ones.
FEW = 64


@dataclass
class Automaton:
    """edge: sorted parent * 256 + byte, child: their targets; link and popped per node; node 0 is the root."""

    edge: np.ndarray
    child: np.ndarray
    link: np.ndarray
    popped: np.ndarray

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children, -1 where there is none."""
        key = node.astype(np.int64) * 256 + byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.child[at], -1)

    @cached_property
    def steps(self) -> tuple[dict[int, int], list[int], list[int]]:
        """edge -> child, links and popped counts for steps of one word."""
        return dict(zip(self.edge.tolist(), self.child.tolist(), strict=True)), self.link.tolist(), self.popped.tolist()

    def run(self, node: int, data: bytes) -> tuple[int, int]:
        """(node, pieces popped) after the bytes of one word."""
        child, link, popped = self.steps
        count = 0
        for byte in data:
            nxt = child.get(node * 256 + byte)
            while nxt is None:
                count += popped[node]
                node = link[node]
                nxt = child.get(node * 256 + byte)
            node = nxt
        return node, count

    def count(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, lead: int | None) -> np.ndarray:
        """Pieces of each word data[start:start + length], after a first byte `lead` where given."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        node, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        if lead is not None and len(start):
            node[:] = self.step(np.zeros(1, np.int64), np.array([lead]))[0]
        for k in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -k, side="left"))  # words longer than k come first
            if live < FEW:
                for i in range(live):
                    node[i], pops = self.run(int(node[i]), data[start[i] + k : start[i] + length[i]].tobytes())
                    count[i] += pops
                break
            byte = data[start[:live] + k].astype(np.int64)
            now = node[:live]
            todo = np.arange(live)
            while len(todo):
                got = self.step(now[todo], byte[todo])
                hit = got >= 0
                now[todo[hit]] = got[hit]
                todo = todo[~hit]
                count[todo] += self.popped[now[todo]]
                now[todo] = self.link[now[todo]]
        todo = np.flatnonzero(node)
        while len(todo):
            count[todo] += self.popped[node[todo]]
            node[todo] = self.link[node[todo]]
            todo = todo[node[todo] > 0]
        out = np.empty_like(count)
        out[order] = count
        return out


def build_automaton(pieces: list[bytes]) -> Automaton:
    """Trie, failure links and popped counts of pieces; every single byte is a piece, so a match never fails."""
    children: list[dict[int, int]] = [{}]
    whole = [False]
    for piece in {*pieces, *(bytes([b]) for b in range(256))} - {b""}:
        node = 0
        for b in piece:
            nxt = children[node].get(b)
            if nxt is None:
                nxt = children[node][b] = len(children)
                children.append({})
                whole.append(False)
            node = nxt
        whole[node] = True
    link, popped = [0] * len(children), [0] * len(children)
    level = [0]
    while level:
        below = []
        for u in level:
            for b, v in children[u].items():
                below.append(v)
                if whole[v]:
                    link[v], popped[v] = 0, 1
                else:
                    # What u pops, then on from where u's link lands, until the byte has a child there.
                    z, pops = link[u], popped[u]
                    while b not in children[z]:
                        pops += popped[z]
                        z = link[z]
                    link[v], popped[v] = children[z][b], pops
        level = below
    edges = sorted((u * 256 + b, v) for u, c in enumerate(children) for b, v in c.items())
    return Automaton(np.array([e for e, _ in edges], np.int64), np.array([v for _, v in edges], np.int64), np.array(link, np.int64), np.array(popped, np.int64))


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, as bytes, without its added tokens."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    added = {t["content"] for t in model.get("added_tokens", [])}
    return [bytes(letters[c] for c in piece) for piece in model["model"]["vocab"] if piece not in added]


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(some, where): word i equals word some[where[i]], byte for byte."""
    _, some, where = np.unique(words.hash, return_index=True, return_inverse=True)
    length, other = words.end - words.start, some[where]
    same = length == length[other]
    step = 1 << 16  # words compared at once
    for at in range(0, len(length), step):
        own = np.flatnonzero(same[at : at + step] & (length[at : at + step] <= LONG)) + at
        n = length[own]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = words.data[np.repeat(words.start[own], n) + within] != words.data[np.repeat(words.start[other[own]], n) + within]
        same[np.repeat(own, n)[differ]] = False
    for i in np.flatnonzero(same & (length > LONG) & (other != np.arange(len(other)))):
        a, b = words.start[i], words.start[other[i]]
        same[i] = np.array_equal(words.data[a : a + length[i]], words.data[b : b + length[i]])
    odd = np.flatnonzero(~same)
    where[odd] = len(some) + np.arange(len(odd))
    return np.concatenate([some, odd]), where


def token_counts(docs: DataFrame, tokenizer_path: str, lead: int | None = 0x20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_tokens, longest (most tokens of a word).

    Words are runs of non-space; each is matched with the byte `lead` before it, the vocabulary's mark of a word's start.
    A null text, and one without words, has zeros. Repeated rows count alike; ids, nulls among them, pass through; an
    empty table gives an empty result. Very long texts and words take time in proportion to their bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_automaton(vocabulary(tokenizer_path)))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words([(t or "").encode("utf-8", "replace") for t in texts], NOT_SPACE)
        some, where = distinct(words)
        each = shared.value.count(words.data, words.start[some], (words.end - words.start)[some], lead)[where]
        sums = np.concatenate([[0], np.cumsum(each)])
        most = np.zeros(len(texts), np.int64)
        has = np.flatnonzero(np.diff(words.first))
        if len(has):
            most[has] = np.maximum.reduceat(each, words.first[has])
        return np.diff(words.first), np.diff(sums[words.first]), most

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            texts = b.column("text").to_pylist()
            parts = [counted(texts[i:j]) for i, j in batches(texts)] or [(np.zeros(0, np.int64),) * 3]
            columns = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", "n_words", "n_tokens", "longest"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, n_words long, n_tokens long, longest long").withColumnRenamed("id", id_col)
