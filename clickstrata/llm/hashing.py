"""Vectorised 64-bit hashes of words and shingles.

A batch of texts is one byte string. Words are read eight bytes at a time, all words at once, each eight bytes mixed into
the word's hash by a bijection, so no Python object per word is made, and words that differ in one place only always
differ. Words of more than ``LONG`` bytes are hashed one by one (xxh3). No word is a polynomial of its letters: such
hashes have words that collide whatever their base.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
LONG = 64  # bytes
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a run of texts, lower-cased in A-Z and split at ASCII white space.

    ``hashes``: one per word; ``first``: index of each text's first word, with the end as last entry;
    ``start``/``end``: byte offsets in ``data``; ``text_at``: byte offset of each text.
    """

    def __init__(self, texts: list[str], lower: bool = True):
        parts = [t.encode("utf-8", "replace") for t in texts]
        joined = b"\n".join(parts)
        self.data = joined.lower() if lower else joined
        raw = np.frombuffer(self.data, np.uint8)
        space = _SPACES[raw]
        edge = np.empty(len(raw) + 1, bool)
        if len(raw):
            edge[0] = not space[0]
            edge[-1] = not space[-1]
            np.not_equal(space[1:], space[:-1], out=edge[1:-1])
        else:
            edge[:] = False
        cuts = np.flatnonzero(edge)
        self.raw, self.space, self.start, self.end = raw, space, cuts[0::2], cuts[1::2]
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.text_at = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, self.text_at)

    @property
    def hashes(self) -> np.ndarray:
        sizes = self.end - self.start
        out = mix(sizes.astype(np.uint64) + np.uint64(BASE))
        if not len(sizes):
            return out
        padded = self.data + b"\0" * 8
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        rest = np.flatnonzero(sizes <= LONG)
        at, left = self.start[rest], sizes[rest]
        while len(rest):
            held = np.minimum(left, 8).astype(np.uint64)
            part = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * held))
            out[rest] = mix((out[rest] ^ part) + np.uint64(BASE))
            more = left > 8
            rest, at, left = rest[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]])
        return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, by the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + hashes[k : n + k]
    return mix(out)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words has its whole sequence as one."""
    words = Words(texts)
    hashes, first, out = words.hashes, words.first, []
    every = windows(hashes, size)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(windows(hashes[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
