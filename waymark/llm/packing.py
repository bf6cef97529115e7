"""Packing by best-fit decreasing.

Documents become token ids with a closing id 0. A document longer than a window is first cut into full windows, each a
sequence of its own; the tails, longest first, go to the open window with the least room that still takes them. The
open windows are counted in a segment tree indexed by remaining capacity, so a placement takes O(log window).

Each scan partition packs its own documents in one pass, without a shuffle; a hot source or a group of copies is spread
as its rows are. A task holds the numbers of at most `chunk` tails (never ids or texts), places them in decreasing
order, and goes on to the next with the same tree: windows stay open until the partition ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 1024
EOD = 0
NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class CapacityTree:
    """How many open windows have each remaining capacity 0..size; `tightest(n)` is the least capacity >= n in use."""

    def __init__(self, size: int) -> None:
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        i = self.base + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, capacity: int) -> int:
        i = self.base + capacity
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.windows[capacity].pop()

    def tightest(self, n: int) -> int:
        """-1 if no open window has room for n."""
        count, i = self.count, self.base + n
        if count[i]:
            return n
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1


class BestFit:
    """Windows numbered from `first`; `place` puts a batch of lengths (1..window) into them, longest first."""

    def __init__(self, window: int = WINDOW, first: int = 0) -> None:
        self.window, self.next, self.tree = window, first, CapacityTree(window)

    def fresh(self) -> int:
        """The number of a window that is full at once."""
        self.next += 1
        return self.next - 1

    def place(self, lengths: list[int]) -> tuple[list[int], list[int]]:
        """For each length its window and its offset there. Ties: first come."""
        where, offset = [0] * len(lengths), [0] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            n = lengths[i]
            room = self.tree.tightest(n)
            if room < 0:
                room, w = self.window, self.fresh()
            else:
                w = self.tree.take(room)
            where[i], offset[i] = w, self.window - room
            if room > n:
                self.tree.add(room - n, w)
        return where, offset


def byte_bpe_encoder(path: str):
    """texts -> lists of ids, as the tokenizer file gives them without special tokens being added.

    The ranked merges are read from the file into the faster of two libraries that give the same ids. Texts with one of
    the file's added tokens go through the file's own library, where these strings are ids of their own; so do all texts
    where the file normalises, splits words or merges in another way than plain byte-level BPE.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # The byte alphabet of byte-level BPE: printable bytes are themselves, the others follow from code point 256.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    added = [t["content"] for t in model.get("added_tokens", [])]
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in added}
    slow = Tokenizer.from_file(path)

    def whole(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    split, how = model.get("pre_tokenizer") or {}, model["model"]
    plain_split = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    plain_merges = how.get("type") == "BPE" and not any(how.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("normalizer") or not plain_split or not plain_merges:
        return whole
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return whole(text) if any(a in text for a in added) else fast.encode_ordinary(text)

    return encode


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, eod: int = EOD, chunk: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the one id `eod`; a very long one is cut into full windows as soon as it is read. Each id of
    a document lies in exactly one piece; the pieces of a sequence have gapless offsets from 0 and sum to at most
    `window`. Rows that repeat an id are documents of their own; ids of any type pass through, nulls among them; other
    columns are ignored. An empty table gives no pieces. sequence_id: the partition in the high bits, then a running
    number. Where the pieces lie depends on how the rows are dealt over partitions; ids and crcs don't.
    """
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe_encoder(tokenizer_path)
        fit = BestFit(window, TaskContext.get().partitionId() << 32)
        tails: list[tuple] = []

        def pieces(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], NAMES)

        def placed(kind: pa.DataType) -> pa.RecordBatch:
            where, offset = fit.place([t[2] for t in tails])
            return pieces([(*t, w, o) for t, w, o in zip(tails, where, offset, strict=True)], kind)

        kind = pa.int64()
        for batch in rows:
            out, kind = [], batch.schema.field("doc_id").type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(eod)
                raw, n = np.array(ids, "<u4").tobytes(), len(ids)
                full = n - n % window
                for start in range(0, full, window):
                    out.append((doc, start, window, zlib.crc32(raw[4 * start : 4 * (start + window)]), n, fit.fresh(), 0))
                if full < n:
                    tails.append((doc, full, n - full, zlib.crc32(raw[4 * full :]), n))
            if out:
                yield pieces(out, kind)
            if len(tails) >= chunk:
                yield placed(kind)
                tails.clear()
        if tails:
            yield placed(kind)

    key = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
