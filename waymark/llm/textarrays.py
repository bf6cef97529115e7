"""Words of a batch of texts as numpy arrays: offsets and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Byte classes: 1 where the byte is part of a word.
NOT_SPACE = np.ones(256, np.uint8)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
ALNUM = np.zeros(256, np.uint8)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes than this are hashed one by one, so that a very long word costs no rounds over all others.
LONG = 256


def fold(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty; a lone surrogate becomes '?'."""
    return (text or "").encode("utf-8", "replace").lower()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of texts: start and end in `data`, hash, and first[i]:first[i + 1] for text i."""

    def __init__(self, texts: list[bytes], kind: np.ndarray = NOT_SPACE, hashes: bool = True) -> None:
        # Texts are apart by a line break, which is no part of a word and none of a line.
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.ends = np.cumsum(lengths)
        inside = kind[self.data]
        turns = np.flatnonzero(np.diff(inside, prepend=np.uint8(0), append=np.uint8(0)))
        self.start, self.end = turns[0::2], turns[1::2]
        self.first = np.concatenate([[0], np.searchsorted(self.start, self.ends)]) if texts else np.zeros(1, np.int64)
        self.hash = self._hashes() if hashes else None

    def _hashes(self, most: int | None = None) -> np.ndarray:
        """A chain over eight bytes at a time: each step is a bijection of what came before and of the bytes it adds, so
        words of equal length that differ in one step never meet, and others do with the chance of random numbers."""
        length = self.end - self.start
        if most is not None:
            length = np.minimum(length, most)
        blocks = np.ndarray(max(0, len(self.data)), "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        out = mix(length.astype(np.uint64) + _STEP)
        live = np.flatnonzero(length <= LONG)
        for at in range(0, int(length[live].max(initial=0)), 8):
            live = live[length[live] > at]
            got = blocks[self.start[live] + at]
            short = np.minimum(length[live] - at, 8).astype(np.uint64)
            got &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - short * np.uint64(8))
            out[live] = mix(out[live] * _STEP + mix(got))
        for i in np.flatnonzero(length > LONG):
            out[i] = np.uint64(xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.start[i] + length[i]].tobytes()))
        return out

    def stems(self, most: int) -> np.ndarray:
        """Hash of each word's first `most` bytes."""
        return self._hashes(most)


def shingles(word_hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of each run of `width` words; of the whole sequence where it is shorter; none of none."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    if n < width:
        width = n
    total = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + word_hashes[k : n - width + 1 + k])
    return np.unique(total)


def batches(texts: list[str | None], most_bytes: int = 1 << 20):
    """Slices of texts of about most_bytes characters each; a longer text is a slice of its own."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > most_bytes:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)
