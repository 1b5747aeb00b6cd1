"""Vectorised hashes of words and shingles over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd base of the polynomial that hashes a word's bytes, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text hashed at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: Bytes whose sums are held at a time while a block's words are hashed; a longer word is hashed alone.
SUMMED_BYTES = 1 << 17


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of keys and seed."""
    x = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse, grown as needed and kept by a worker."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, SUMMED_BYTES)
            steps = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = map(np.multiply.accumulate, steps)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of texts of about ``size`` bytes; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def byte_table(data: bytes) -> np.ndarray:
    """A table of 256, true for the given bytes."""
    found = np.zeros(256, bool)
    found[list(data)] = True
    return found


#: What ends a word unless other bytes are given: space and 9 to 13.
WHITE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")


def cut_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased, and where each word begins and ends; a text's end ends a word."""
    low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    inside = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return low, begins, ends


def hashes_of(low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word; it doesn't depend on the word's place, so sums of some words at a time do."""
    found, start = np.empty(len(begins), np.uint64), 0
    while start < len(begins):
        first = int(begins[start])
        stop = max(start + 1, int(np.searchsorted(ends, first + SUMMED_BYTES, "right")))
        own = low[first : int(ends[stop - 1])]
        up, down = POWERS.upto(len(own))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up)))
        begin, end = begins[start:stop] - first, ends[start:stop] - first
        found[start:stop] = mixed((total[end] - total[begin]) * down[begin], 7)
        start = stop
    return found


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, A-Z lower-cased, and the number of words of each text.

    Words are runs of other bytes than space and 9 to 13; a text's end ends a word.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    low, begins, ends = cut_words(data, offsets)
    return hashes_of(low, begins, ends), np.diff(np.searchsorted(begins, offsets))


def chained(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The hash of ``width`` consecutive words from each start."""
    h = np.full(len(starts), width, np.uint64)
    for k in range(width):
        h = h * np.uint64(BASE) + words[starts + k]
    return mixed(h, 11)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[list[np.ndarray]]:
    """For each block of texts the sorted distinct shingle hashes of each text.

    A text of fewer than ``width`` words is one shingle of all of them; a text
    without words has none.
    """
    for data, offsets in blocks(texts):
        words, counts = word_hashes(data, offsets)
        first = np.concatenate(([0], np.cumsum(counts)))
        every = chained(words, np.arange(max(0, len(words) - width + 1)), width)
        sets = []
        for a, n in zip(first[:-1].tolist(), counts.tolist()):
            if n >= width:
                sets.append(np.unique(every[a : a + n - width + 1]))
            else:
                sets.append(chained(words, np.array([a]), n) if n else np.zeros(0, np.uint64))
        yield sets
