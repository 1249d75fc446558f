"""Byte-level BPE encoding and decoding as a tree reduction over a monoid of encoded spans.

An encoded span is the list of its pattern matches (where each ends) with their token ids; the merges run inside a
match. Halves are encoded recursively down to leaves of ``leaf`` code points. Two neighbours are joined by encoding
again a window around their border, from the last match of the left one that cannot change, over a stretch of the
right one that doubles until a match of the window ends where one of the right half's does. From there on both read
the same text from the same place, so what lies outside the window is proven to stay. Joining is associative; a leaf
is small, so texts of ordinary length take many joins.

The proof asks of the pattern what the public ones give: no look-behind, and no match looks further than REACH code
points past its end, or than that past the white space it begins with or is followed by.

Decoding concatenates the tokens' bytes up the same tree. Null and empty texts give no ids; equal rows give equal
rows; an empty table gives an empty result; a text of any length takes time in proportion, and a match of n bytes
n * log(n). Extra columns stay; where one has the result's name, the result's gets an underscore behind it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from bisect import bisect_left
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fresh, small_batches, tidy

LEAF = 512
WINDOW = 16
REACH = 3
KEPT_MATCHES = 1 << 17  # matches whose ids a worker keeps; as many older ones are at hand


class Merges(dict):
    """The ranks of a vocabulary, and the ids of single matches by match, worked out when they are missing; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        size = len(self.bytes_of)
        self.pairs: dict[int, int] = {}  # id of a pair's merge, by the ids of its parts
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a * size + b] = i
        self.of_byte = [self.ranks.get(bytes([b])) for b in range(256)]
        found = regex.compile(pattern)
        self.find, self.every = found.finditer, found.findall
        self.plain = not found.groups  # else findall() gives groups
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, match: str) -> tuple[int, ...]:
        found = self.older.get(match)
        if found is None:
            data = match.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            found = (whole,) if whole is not None else self.merged(data) if len(data) <= 64 else self.merged_long(data)
        if len(match) <= 64:
            if len(self) >= KEPT_MATCHES:
                self.older = dict(self)
                self.clear()
            self[match] = found
        return found

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Neighbours are merged lowest rank first, the leftmost of equal ones."""
        pair, size = self.pairs.get, len(self.bytes_of)
        ids = [self.of_byte[b] for b in data]
        ranks = [pair(a * size + b, size) for a, b in zip(ids, ids[1:])]  # of each id with the next one; size: no merge
        while ranks:
            least = min(ranks)
            if least == size:
                break
            i = ranks.index(least)
            ids[i] = least
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pair(least * size + ids[i + 1], size)
            if i:
                ranks[i - 1] = pair(ids[i - 1] * size + least, size)
        return tuple(ids)

    def merged_long(self, data: bytes) -> tuple[int, ...]:
        """The same by a heap over a linked list, for long matches."""
        rank, n = self.ranks.get, len(data)
        ends = list(range(1, n + 1))  # of the part that begins here; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:  # one of the parts has changed
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := rank(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (left := before[i]) >= 0 and (r := rank(data[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[data[at : ends[at]]])
            at = ends[at]
        return tuple(out)


@functools.lru_cache(maxsize=4)
def merges(path: str, pattern: str) -> Merges:
    return Merges(path, pattern)


Span = tuple[list[int], list[tuple[int, ...]]]  # where the matches end, and their ids


class Tree:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        self.merges = merges(path, pattern)
        self.bytes_of = self.merges.bytes_of
        self.leaf, self.window = max(1, leaf), max(1, window)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._span(text, 0, len(text))[1]))

    def _span(self, text: str, a: int, b: int) -> Span:
        if b - a <= self.leaf:
            return self._matches(text, a, b)
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self._span(text, a, mid), self._span(text, mid, b))

    def _matches(self, text: str, a: int, b: int) -> Span:
        of = self.merges
        if of.plain:
            found = of.every(text, a, b)
            ends = list(accumulate(map(len, found), initial=a))
            if ends[-1] == b:  # no gap between matches
                return ends[1:], list(map(of.__getitem__, found))
        every = list(of.find(text, a, b))
        return [m.end() for m in every], [of[m[0]] for m in every]

    @staticmethod
    def _settled(text: str, end: int, edge: int) -> bool:
        """Whether a match that ends at ``end`` is the same whatever follows ``edge``."""
        return edge - end >= REACH and not text[end : edge - 1].isspace()

    def _join(self, text: str, a: int, mid: int, b: int, left: Span, right: Span) -> Span:
        """The matches of text[a:b] from those of its halves."""
        keep = len(left[0])
        while keep and not self._settled(text, left[0][keep - 1], mid):
            keep -= 1
        start, size = left[0][keep - 1] if keep else a, self.window
        while True:
            edge = min(b, mid + size)
            ends, ids = [], []
            for m in self.merges.find(text, start, edge):
                end = m.end()
                if edge < b and not self._settled(text, end, edge):
                    break
                ends.append(end)
                ids.append(self.merges[m[0]])
                if end > mid and (at := bisect_left(right[0], end)) < len(right[0]) and right[0][at] == end:
                    return left[0][:keep] + ends + right[0][at + 1 :], left[1][:keep] + ids + right[1][at + 1 :]
            if edge == b:
                return left[0][:keep] + ends, left[1][:keep] + ids
            size *= 2

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


def encode_udf(path: str, pattern: str):
    """Text to ids (array of int)."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        tree = Tree(path, pattern)
        return pd.Series([np.asarray(tree.encode(t or ""), np.int32) for t in texts])

    return run


def decode_udf(path: str, pattern: str):
    """Ids to bytes."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        tree = Tree(path, pattern)
        return pd.Series([tree.decode(list(map(int, x))) if x is not None else b"" for x in ids])

    return run


def checked_udf(path: str, pattern: str):
    """A text's ids, and whether they decode to its bytes."""

    @F.pandas_udf("ids array<int>, round_trip boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        tree = Tree(path, pattern)
        ids = [np.asarray(tree.encode(t or ""), np.int32) for t in texts]
        fine = [tree.decode(x.tolist()) == (t or "").encode() for x, t in zip(ids, texts)]
        tidy()
        return pd.DataFrame({"ids": ids, "round_trip": fine})

    return run


def digest_udf(path: str, pattern: str):
    """n_tokens, ids_sha256 and decoded_sha256 of a text, without moving the ids back to the JVM."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        tree, rows = Tree(path, pattern), []
        for text in texts:
            ids = tree.encode(text or "")
            rows.append(
                (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tree.decode(ids)).hexdigest())
            )
        tidy()
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    return small_batches(docs).withColumn(fresh(docs, to)[0], encode_udf(path, pattern)(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "bytes") -> DataFrame:
    return small_batches(docs).withColumn(fresh(docs, to)[0], decode_udf(path, pattern)(F.col(ids)))


def checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (the ids decode to the text's bytes)."""
    encoded = small_batches(docs).select("doc_id", checked_udf(path, pattern)(F.col("text")).alias("b"))
    return encoded.select("doc_id", F.size("b.ids").cast("long").alias("n_tokens"), "b.ids", "b.round_trip")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return small_batches(docs).select("doc_id", digest_udf(path, pattern)(F.col("text")).alias("d")).select("doc_id", "d.*")
