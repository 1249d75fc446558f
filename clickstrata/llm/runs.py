"""Maximal periodic runs in the word sequences of texts, by a suffix tree of each text.

The tree is that of the suffix array: its inner nodes are the intervals of suffixes with a common prefix. A batch of
texts has one suffix array, made by prefix doubling, in which suffixes of different texts share nothing. A tandem
repeat of period q at word i, after which the period breaks, has the node of depth q as the lowest common ancestor of
the suffixes i and i + q. So each node looks at the leaves outside its largest child only (the smaller halves: n log n
leaves in all) and asks whether the suffix a depth further, or before, is a leaf of the node too. What is found is
rotated to the left as far as the period holds; the tandem repeats of one run thereby merge into it.

Words are runs of characters other than ASCII white space. Null texts have no words; a null id plants no period; rows
that repeat an id each have a result; one text is handled by one task, in memory that grows with its words; an empty
table gives an empty result; other columns are not read. Of runs of equal length the first by start, then period, is
reported as the longest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import sliced, tidy
from .suffixes import suffix_array

LEAST = 12  # words of a run
BATCH = 1 << 20  # characters that share a suffix array
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of which those from a place on repeat a prefix of themselves in one of ten documents."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def inner_nodes(common: np.ndarray) -> np.ndarray:
    """Rows (depth, first, last, first of the largest child, its last) of the tree's inner nodes below the root; all but the depth are places in the suffix array."""
    out: list[tuple[int, int, int, int, int]] = []
    stack = [[0, 0, 0, 0]]  # depth, first, largest child's first and last
    for k, depth in enumerate(common[1:].tolist()):
        first = last = k
        top = stack[-1]
        while top[0] > depth:
            stack.pop()
            if last - first > top[3] - top[2]:
                top[2], top[3] = first, last
            out.append((top[0], top[1], k, top[2], top[3]))
            first, last, top = top[1], k, stack[-1]
        if top[0] < depth:
            stack.append([depth, first, first, last])
        elif depth and last - first > top[3] - top[2]:
            top[2], top[3] = first, last
    return np.array(out, np.int64).reshape(-1, 5)


def _ranges(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, and of which range each is."""
    sizes = stop - first
    owner = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner], owner


def branching_repeats(symbols: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Distinct rows (start, period) of tandem repeats whose period breaks right behind them."""
    array, inverse, common = suffix_array(symbols, stop)
    nodes = inner_nodes(common)
    depth, first, last, largest, largest_last = nodes.T
    found = []
    for a, b in ((first, largest), (largest_last + 1, last + 1)):  # leaves outside the largest child
        slots, owner = _ranges(a, b)
        at, q, low, high = array[slots], depth[owner], first[owner], last[owner]
        for other, begin in ((at + q, at), (at - q, at - q)):
            ok = (other < stop[at]) & (other >= start[at])
            rank = inverse[np.where(ok, other, 0)]
            ok &= (rank >= low) & (rank <= high)
            begin, period, end = begin[ok], q[ok], stop[at[ok]]
            after = begin + 2 * period
            inside = after < end
            breaks = ~inside | (symbols[begin + period] != symbols[np.where(inside, after, 0)])
            found.append(np.stack([begin[breaks], period[breaks]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _rotated(symbols: np.ndarray, begin: int, period: int, low: int) -> int:
    """The first place from which the period holds up to ``begin``, not before ``low``."""
    chunk = 32
    while begin > low:
        a = max(low, begin - chunk)
        differ = np.flatnonzero(symbols[a:begin] != symbols[a + period : begin + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        begin, chunk = a, chunk * 4
    return begin


def maximal_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    ids: list[int] = []
    known = 0
    for words in texts:
        own: dict[bytes, int] = {}
        ids.extend([own.setdefault(w, known + len(own)) for w in words])
        known += len(own)
    symbols = np.array(ids, np.int64)
    ends = np.cumsum(sizes)
    start, stop = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    repeats = branching_repeats(symbols, start, stop)
    for back in range(1, least - 1):  # short repeats must have been going on for some words
        begin, period = repeats.T
        at = np.maximum(begin - back, 0)
        holds = (begin - back >= start[begin]) & (symbols[at] == symbols[at + period])
        repeats = repeats[holds | (2 * period + back - 1 >= least)]
    until: dict[int, list[tuple[int, int]]] = {}  # runs by their end: their periods and starts
    for begin, period in repeats[np.argsort(repeats[:, 1], kind="stable")].tolist():
        end = begin + 2 * period
        held = until.setdefault(end, [])
        if any(period % q == 0 and at <= begin for q, at in held):
            continue  # the repeated part is itself a repetition
        text = int(np.searchsorted(ends, begin, side="right"))
        low = int(ends[text] - sizes[text])
        at = _rotated(symbols, begin, period, low)
        held.append((period, at))
        if end - at >= least:
            out[text].append((at - low, end - at, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without what a run repeats: its first period stays."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    covered = np.cumsum(gone)[:-1]
    return [w for w, c in zip(words, covered) if not c]


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _row(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    kept = kept_words(words, runs)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    exponent = 1000 * longest[1] // longest[2] if runs else None
    listed = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
    return (doc_id, len(runs), *longest, exponent, _digest(listed.encode()), _digest(b" ".join(kept)), len(words), len(words) - len(kept))


def detect(docs: DataFrame, prepare=planted) -> DataFrame:
    """One row a document: how many runs, the longest one, digests of all runs and of the text without repetitions.

    ``prepare`` takes a text's words and its id and returns the words to look at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        types = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
        for batch in batches:
            ids, rows, done = batch.column("doc_id").to_pylist(), [], 0
            for texts in sliced((x.as_py() for x in batch.column("text")), BATCH):
                listed = [prepare(t.encode("utf-8", "replace").split(), i) for t, i in zip(texts, ids[done:])]
                rows += [_row(i, w, r) for i, w, r in zip(ids[done:], listed, maximal_runs(listed))]
                done += len(texts)
            tidy()
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
