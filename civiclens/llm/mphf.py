"""Minimal perfect hashing of 64-bit keys, in numpy.

Keys are spread over a bit array twice their number; a bit with one key is
that key's, and the keys that met others go on to the next, smaller array.  A
key's number is the count of set bits before its own, so n keys get the numbers
0 to n-1.  A key that was not among them finds no bit or another key's number:
callers keep the keys by number and compare.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits for each key of a level.
SPACE = 2


def mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A level's hash of the keys (the usual 64-bit finaliser)."""
    x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels in 64-bit words, and the words, of distinct keys."""
    sizes, words, left = [], [], keys.astype(np.uint64)
    while len(left):
        size = -(-SPACE * len(left) // 64)
        slot = (mix(left, len(sizes)) % np.uint64(size * 64)).astype(np.int64)
        alone = np.bincount(slot, minlength=size * 64) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone[slot]]
    return np.array(sizes, "<u4"), np.concatenate(words) if words else np.zeros(0, "<u8")


@dataclass
class Numbers:
    """The functions of several buckets of keys; a bucket's numbers start at
    ``first`` of it."""

    sizes: np.ndarray  # bucket x level, in words
    starts: np.ndarray  # bucket x level, in words
    words: np.ndarray
    before: np.ndarray  # set bits before each word
    first: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Numbers:
        levels = max((len(s) for s, _ in parts), default=0)
        sizes = np.zeros((len(parts), levels), np.int64)
        for i, (s, _) in enumerate(parts):
            sizes[i, :len(s)] = s
        flat = sizes.ravel()
        starts = (np.cumsum(flat) - flat).reshape(sizes.shape)
        words = np.concatenate([np.zeros(0, "<u8"), *[w for _, w in parts]])
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return cls(sizes, starts, words, before, before[starts[:, 0]] if levels else np.zeros(len(parts), np.int64))

    def find(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Numbers over all buckets; -1 where no bit is set."""
        out = np.full(len(keys), -1, np.int64)
        keys, left = keys.astype(np.uint64), np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[bucket, level]
            there = size > 0
            if not there.all():
                left, keys, bucket, size = left[there], keys[there], bucket[there], size[there]
            if not len(left):
                break
            slot = (mix(keys, level) % (size.astype(np.uint64) * np.uint64(64))).astype(np.int64)
            word = self.starts[bucket, level] + (slot >> 6)
            bits, bit = self.words[word], (slot & 63).astype(np.uint64)
            hit = (bits >> bit) & np.uint64(1) == 1
            lower = bits[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(lower)
            left, keys, bucket = left[~hit], keys[~hit], bucket[~hit]
        return out
