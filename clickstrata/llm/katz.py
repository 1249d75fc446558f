"""Language-model scoring: a Katz back-off model with Good-Turing discounts.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end a text. Counts cover every training
document and every word; nothing that grows with the vocabulary is shipped or collected.

1. Texts are tokenised once, in batches, into tables bucketed by batch: the text as numbers of the batch's own
   words, and those words with their counts, cut into parts by word.
2. Words are counted, sorted by count and numbered. A number thus tells the word's count: the driver and the
   workers hold one entry for each count that occurs (at most sqrt(2 * tokens) of them), not one a word. Batches
   get the numbers of their words back. What only held-out texts have is the one unknown word.
3. Each batch's distinct training n-grams go, sorted and packed, to the part of their middle word, so a part can count and
   normalise both bigrams and trigrams of its words alone. A word with more tokens than ``cap`` has parts of its own,
   dealt by the word before it, and a pair with more than ``cap`` has parts dealt by the word after it. The few sums
   that such parts share are joined by key. Counts of counts give the discounts.
4. The model is stored: a table of words with counts, and tables in buckets of their part with the contexts (their
   alpha) and n-grams (count, P) of both orders. ``train`` makes it, ``Model.save`` and ``load`` keep it for later
   calls, ``Model.score`` scores other texts by it without a recount.
5. Each batch's distinct n-grams are sent to their part with the places of the texts, and looked up recursively: a
   trigram that is stored has its P; else alpha of its context, if stored, times that of the bigram, which is looked up
   likewise, down to the unigram. Bigrams of a word with parts of its own are a table dealt by the last word: what no
   trigram answers is sent on to it. An n-gram that a batch has often is sent once, without places, and its log P is
   sent back: a text copied any number of times costs one row of each n-gram a batch.

P(w | h) = d_r * r / c(h) if the n-gram was seen r times, else alpha(h) * P(w | shorter h), and the plain
shorter one where the context itself was never seen; from trigrams down to unigrams, whose leftover mass is the
unknown word's. d_r is the Good-Turing discount for r <= 5 (n_r are counts over the whole table of that order),
else 1; alpha(h) makes the sum over w one.

Null and empty texts are one end token; a null doc_id is training data; repeated rows are rows of their own;
with no training tokens every probability is that of an empty model; an empty table gives an empty result; a text
of any length is held by one worker as a whole. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import bucketed, forget, tidy, written
from .hashing import mix

END = b""  # no word is empty
BEGIN, UNKNOWN, FIRST = 0, 1, 2  # numbers of what stands before a text, of the unknown word, and of the most frequent word
ORDER = 3
GOOD_TURING = 5
CHUNK = 8192
CHUNK_CHARS = 5 << 20
CAP = 3 << 18
#: An n-gram that stands more often in a batch is sent without places, and its log P comes back.
OFTEN = 8


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list[str | None]]]:
    """(doc_ids, held_out, texts) of runs of rows."""
    ids, held, texts, size = [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, out, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                ids.append(doc)
                held.append(out)
                texts.append(text)
                size += len(text or "")
                if len(texts) == CHUNK or size > CHUNK_CHARS:
                    yield ids, np.array(held, bool), texts
                    ids, held, texts, size = [], [], [], 0
    if texts:
        yield ids, np.array(held, bool), texts


# --- packed arrays -----------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers or doubles, by byte planes, compressed; doubles that repeat as places among the different ones."""
    out = []
    for a in arrays:
        values, at = np.unique(a, return_inverse=True) if a.dtype.kind == "f" else (a, a)
        out += [a] if a.dtype.kind != "f" or len(values) * 2 >= len(a) else [None, values, at]
    return bytes([len(out)]) + b"".join(b"\0" if a is None else _packed(a) for a in out)


def _packed(a: np.ndarray) -> bytes:
    if a.dtype.kind != "f":
        top = int(a.max()) if len(a) else 0
        a = a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
    raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""
    packed = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
    return a.dtype.str.encode() + len(a).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def unpack(data: bytes) -> list[np.ndarray]:
    found, at = [], 1
    for _ in range(data[0]):
        if not data[at]:
            found.append(None)
            at += 1
            continue
        kind = np.dtype(data[at : at + 3].decode())
        n, size = int.from_bytes(data[at + 3 : at + 7], "little"), int.from_bytes(data[at + 7 : at + 11], "little")
        at += 11
        if n:
            raw = np.frombuffer(pa.decompress(data[at : at + size], n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
            a = np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind)[:, 0]
        else:
            a = np.zeros(0, kind)
        found.append(a if kind.kind == "f" else a.astype(np.int64))
        at += size
    out, rest = [], iter(found)
    for a in rest:
        out.append(a if a is not None else next(rest)[next(rest)])
    return out


def pack_sorted(v: np.ndarray, u: np.ndarray, *more: np.ndarray) -> bytes:
    """As ``pack``, of rows sorted by ``v``, then ``u``: of both only the steps from row to row."""
    before = np.append(0, v)[:-1]
    return pack(v - before, np.where(v == before, u - np.append(0, u)[:-1], u), *more)


def unpack_sorted(data: bytes) -> list[np.ndarray]:
    dv, du, *more = unpack(data)
    u = np.cumsum(du)
    heads = np.flatnonzero(np.append(True, dv[1:] > 0)) if len(dv) else np.zeros(0, np.int64)
    return [np.cumsum(dv), u - np.repeat((u - du)[heads], np.diff(np.append(heads, len(dv)))), *more]


# --- discounts and back-off weights ------------------------------------------------------------------


def discounts(counts: dict[int, int], k: int = GOOD_TURING) -> np.ndarray:
    """d_0..d_k (d_0 unused). Where the counts of counts give no value in (0, 1), an absolute discount of a half."""
    d = np.array([1.0] + [(r - 0.5) / r for r in range(1, k + 1)])
    n = [counts.get(r, 0) for r in range(k + 2)]
    if n[1] and n[k + 1] * (k + 1) < n[1]:
        common = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r]:
                got = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < got < 1:
                    d[r] = got
    return d


def reduced(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.where(n < len(d), d[np.minimum(n, len(d) - 1)], 1.0) * n


def weights(c: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By context, from its count, its discounted count and the shorter contexts' probability of what it saw: what a discounted count is worth, and alpha.

    Where every word was seen the discount is undone, and where no count was low enough for one, c / (c + 1)
    leaves the mass of one more token to unseen words. A context never seen gives (0, 1).
    """
    some = np.maximum(c, 1)
    free, share = 1 - seen, kept / some
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.where(free <= 1e-9, 1 / share, np.where(1 - share <= 1e-12, c / (c + 1.0), 1.0))
        alpha = np.where(free > 1e-9, (1 - factor * share) / free, 1.0)
    return np.where(c > 0, factor / some, 0.0), np.where(c > 0, alpha, 1.0)


class Unigrams:
    """Counts and probabilities by word number: numbers follow the counts, so one entry a count is enough."""

    def __init__(self, sizes: dict[int, int]):
        """``sizes``: how many words have a count."""
        self.counts = np.array(sorted((c for c in sizes if c > 0), reverse=True), np.int64)
        many = np.array([sizes[c] for c in self.counts.tolist()], np.int64)
        self.starts = FIRST + np.cumsum(many) - many
        self.total, self.distinct = int((self.counts * many).sum()), int(many.sum())
        r = reduced(self.counts, discounts(sizes))
        kept, n = float((r * many).sum()), max(self.total, 1)
        factor = self.total / (self.total + 1) if self.total and 1 - kept / n <= 1e-12 else 1.0
        self.p, self.unknown = r * (factor / n), 1 - factor * kept / n

    def _class(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, ids, "right") - 1

    def count(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= FIRST, np.append(self.counts, 0)[self._class(ids)], 0)

    def chance(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= FIRST, np.append(self.p, 0.0)[self._class(ids)], self.unknown)


class Routes:
    """Which part an n-gram belongs to: ``cold`` parts by middle word, then those of each hot word, then those of each hot pair."""

    def __init__(self, unigrams: Unigrams, texts: int, pairs: list[tuple[int, int, int]], cap: int, order: int):
        self.order, self.cold = order, max(1, -(-(unigrams.total + texts) // cap))
        often = unigrams.counts[unigrams.counts > cap]
        many = np.diff(np.append(unigrams.starts, FIRST + unigrams.distinct))[: len(often)]
        split = np.concatenate([[-(-texts // cap) if texts > cap else 0, 0], np.repeat(-(-often // cap), many)]).astype(np.int64)
        self.split, self.first = split, self.cold + np.cumsum(split) - split
        self.pair_from = self.cold + int(split.sum())
        kept = sorted(((u << 32) + v, -(-n // cap)) for u, v, n in pairs if n > cap and v < len(split) and split[v]) if order == 3 else []
        self.pairs, self.pair_split = np.array([k for k, _ in kept], np.int64), np.array([n for _, n in kept], np.int64)
        self.pair_first = self.pair_from + np.cumsum(self.pair_split) - self.pair_split
        self.end = self.pair_from + int(self.pair_split.sum())

    def part(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = (mix(v) % np.uint64(self.cold)).astype(np.int64)
        hot = np.flatnonzero(v < len(self.split))
        hot = hot[self.split[v[hot]] > 0]
        if len(hot):
            side = (u if self.order == 3 else w)[hot]
            out[hot] = self.first[v[hot]] + (mix(side + 7) % self.split[v[hot]].astype(np.uint64)).astype(np.int64)
        if len(self.pairs) and len(hot):
            code = (u[hot] << 32) + v[hot]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            own = (self.pairs[at] == code) & (u[hot] < len(self.split))  # both words of a hot pair are hot
            at, hot = at[own], hot[own]
            out[hot] = self.pair_first[at] + (mix(w[hot] + 13) % self.pair_split[at].astype(np.uint64)).astype(np.int64)
        return out

    def pair(self, part: int) -> int:
        """The hot pair whose part it is."""
        return int(self.pairs[int(np.searchsorted(self.pair_first, part, "right")) - 1])

    def share(self, w: np.ndarray, word: int) -> np.ndarray:
        """Which share of the words after a hot word each is in."""
        return (mix(w + 29) % np.uint64(self.split[word])).astype(np.int64)


# --- tokenising ----------------------------------------------------------------------------------------


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


_CODED = "uid long, docs array<long>, held array<boolean>, code binary, wpart int, words binary, counts binary, word binary, next binary, times long"


def _coded(width: int):
    """A batch's row (docs, held, code), a row for each of its parts of words, and its most frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        schema = pa.schema(
            [
                ("uid", pa.int64()),
                ("docs", pa.list_(pa.int64())),
                ("held", pa.list_(pa.bool_())),
                ("code", pa.binary()),
                ("wpart", pa.int32()),
                ("words", pa.binary()),
                ("counts", pa.binary()),
                ("word", pa.binary()),
                ("next", pa.binary()),
                ("times", pa.int64()),
            ]
        )
        for k, (ids, held, texts) in enumerate(chunks(batches)):
            numbers = _Numbers()
            parts = []
            for text in texts:  # one text's tokens are held at a time
                words = tokens(text)
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            lengths = np.array([len(p) for p in parts], np.int64)
            code = np.concatenate(parts)
            del parts
            words = list(numbers)
            wpart = np.array([zlib.crc32(w) % width for w in words], np.int64)
            by = np.argsort(wpart, kind="stable")
            place = np.empty(len(by), np.int32)
            place[by] = np.arange(len(by), dtype=np.int32)
            code, wpart = place[code], wpart[by]
            words = [words[i] for i in by.tolist()]
            n = np.bincount(code, np.repeat(~held, lengths), len(words)).astype(np.int64)
            uid = (task << 24) + k
            rows = [{"uid": uid, "docs": ids, "held": held.tolist(), "code": pack(code, lengths)}]
            cuts = np.append(np.flatnonzero(np.append(True, wpart[1:] != wpart[:-1])), len(wpart)).tolist()
            rows += [{"uid": uid, "wpart": int(wpart[a]), "words": pa.compress(b"\n".join(words[a:b]) + b"\n", codec="zstd", asbytes=True), "counts": pack(n[a:b], np.array([sum(map(len, words[a:b])) + b - a]))} for a, b in zip(cuts, cuts[1:])]
            rows += [{"uid": uid, "word": a, "next": b, "times": times} for a, b, times in _frequent_pairs(code, lengths, words)]
            yield pa.RecordBatch.from_pylist(rows, schema)
            tidy()

    return run


def _frequent_pairs(code: np.ndarray, lengths: np.ndarray, words: list[bytes], share: int = 1024) -> list[tuple]:
    """Neighbours that make up over 1 / share of the batch: at most ``share`` of them; null stands for the text's begin."""
    least = max(1, len(code) // share)
    starts = np.cumsum(lengths) - lengths
    often = np.bincount(code, minlength=len(words)) >= least
    begin = len(words)
    before = np.empty_like(code)
    before[1:] = code[:-1]
    before[starts] = begin
    mask = np.append(often, len(starts) >= least)
    keep = mask[before] & mask[code]
    pairs, times = np.unique(before[keep].astype(np.int64) * (begin + 1) + code[keep], return_counts=True)
    found = [(p // (begin + 1), p % (begin + 1), t) for p, t in zip(pairs[times >= least].tolist(), times[times >= least].tolist())]
    out = [(None if a == begin else words[a], words[b], t) for a, b, t in found]
    return out + [(None, None, len(starts))] * (len(starts) >= least)


def _words(table: pa.Table) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(uid, words, counts) of each batch's row."""
    for row in table.select(["uid", "words", "counts"]).to_pylist():
        n, size = unpack(row["counts"])
        yield row["uid"], pa.decompress(row["words"], int(size[0]), codec="zstd", asbytes=True).split(b"\n")[:-1], n


def _counted(table: pa.Table) -> pa.Table:
    total: Counter = Counter()
    for _, words, n in _words(table):
        for word, times in zip(words, n.tolist()):
            total[word] += times
    wpart = table.column("wpart")[0].as_py()
    return pa.table(
        {
            "wpart": pa.array([wpart] * len(total), pa.int32()),
            "word": pa.array(list(total), pa.binary()),
            "n": pa.array(list(total.values()), pa.int64()),
        }
    )


def _answered(table: pa.Table, numbered: pa.Table) -> pa.Table:
    """Each batch's words' numbers, in the order of its row."""
    ids = dict(zip(numbered.column("word").to_pylist(), numbered.column("id").to_pylist()))
    rows = [(uid, pack(np.fromiter((ids.get(w, UNKNOWN) for w in words), np.int64, len(words)))) for uid, words, _ in _words(table)]
    wpart = table.column("wpart")[0].as_py() if table.num_rows else 0
    return pa.table(
        {
            "uid": pa.array([u for u, _ in rows], pa.int64()),
            "wpart": pa.array([wpart] * len(rows), pa.int32()),
            "ids": pa.array([x for _, x in rows], pa.binary()),
        }
    )


# --- n-grams -------------------------------------------------------------------------------------------


def _batch_grams(row: dict, routes: Routes, unigrams: Unigrams, places: bool, base: float) -> Iterator[tuple]:
    """(part, data) of the batch's distinct training n-grams; with ``places`` of all, with their texts, and at last (None, sums) of what needs no part."""
    ids = np.concatenate([unpack(x["ids"])[0] for x in sorted(row["ids"], key=lambda x: x["wpart"])])
    code, lengths = unpack(row["code"])
    held = np.array(row["held"], bool)
    starts, size = np.cumsum(lengths) - lengths, len(ids) + 1
    begin = size - 1
    before = np.full(len(code), begin, np.int64)
    before[1:] = code[:-1]
    before[starts] = begin
    pair = before.copy()
    if routes.order == 3:
        further = np.full(len(code), begin, np.int64)
        further[1:] = before[:-1]
        further[starts] = begin
        pair = pair * size + further
        del further
    else:
        pair = pair * size + begin
    text = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    if places:
        c, p = unigrams.count(ids), unigrams.chance(ids)
        own = np.append(ids == UNKNOWN, False)[before]  # neither context was seen
        sums = np.add.reduceat(np.log10((c + 1) / base)[code], starts), np.add.reduceat((c > 0)[code].astype(np.int64), starts), np.bincount(
            text[own],
            np.log10(p[code[own]]),
            len(lengths),
        ).astype(float)
        own_sums = (lengths, sums[1], sums[0], sums[2])
        keep = np.flatnonzero(~own)
    else:
        keep = np.flatnonzero(~np.append(ids == UNKNOWN, False)[before] & ~held[text])
    if size**3 >= 1 << 62:
        known, pair = np.unique(pair, return_inverse=True)
    else:
        known = None
    full = pair[keep] * size + code[keep]
    del pair, before
    by = np.argsort(full)
    full = full[by]
    cuts = np.flatnonzero(np.append(True, full[1:] != full[:-1])) if len(full) else np.zeros(0, np.int64)
    kinds = full[cuts]
    del full
    occurs = np.diff(np.append(cuts, len(by)))
    marks = text[keep][by]
    last, head = kinds % size, kinds // size
    head = head if known is None else known[head]
    numbers = np.append(ids, BEGIN)
    u, v, w = numbers[head % size], numbers[head // size], numbers[last]
    part = routes.part(u, v, w)
    at = np.argsort((v << 32) + u)
    at = at[np.argsort(part[at], kind="stable")]
    part, u, v, w, occurs, cuts = part[at], u[at], v[at], w[at], occurs[at], cuts[at]
    home = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(cuts):
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)).tolist()
        if places:  # occurrences in the parts' order
            ends = np.cumsum(occurs)
            marks = marks[np.repeat(cuts - (ends - occurs), occurs) + np.arange(len(marks))]
            often = occurs > OFTEN
            stays = np.repeat(often, occurs)
            home, marks = (occurs[often], marks[stays]), marks[~stays]
            occurs = np.where(often, 0, occurs)
            ends, replies = np.append(0, np.cumsum(occurs)), np.append(0, np.cumsum(often))
        for a, b in zip(edges, edges[1:]):
            if places:
                answers = np.arange(replies[a], replies[b])
                data = pack_sorted(v[a:b], u[a:b], w[a:b], occurs[a:b], marks[ends[a] : ends[b]], answers)
            else:
                data = pack_sorted(v[a:b], u[a:b], w[a:b], occurs[a:b])
            yield int(part[a]), data
    if places:
        yield None, pack(*own_sums, *home)


def _sent(routes: Routes, unigrams: Unigrams, places: bool, base: float):
    """part, uid, data, docs, held: the batch's n-grams by part; with ``places`` a row of the batch's own sums and documents as well."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for row in table.to_pylist():
            for part, data in _batch_grams(row, routes, unigrams, places, base):
                rows.append(
                    (
                        row["uid"] % routes.cold if part is None else part,
                        row["uid"],
                        data,
                        *((row["docs"], row["held"]) if part is None else (None, None)),
                    )
                )
        tidy()
        return pa.table(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.binary()),
                pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                pa.array([r[4] for r in rows], pa.list_(pa.bool_())),
            ],
            names=["part", "uid", "data", "docs", "held"],
        )

    return run


class _Grams:
    """The distinct n-grams of a part: sorted by middle word, the word before, the word after; ``row`` gives each input row's."""

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray):
        self.v_of, vi = np.unique(v, return_inverse=True)
        top = int(max(u.max(), w.max())) + 1
        self.u_of = self.w_of = None
        if len(self.v_of) * top * top >= 1 << 62:
            self.u_of, u = np.unique(u, return_inverse=True)
            self.w_of, w = np.unique(w, return_inverse=True)
            top = max(len(self.u_of), len(self.w_of))
        code = (vi * top + u) * top + w
        by = np.argsort(code)
        code = code[by]
        new = np.append(True, code[1:] != code[:-1])
        cuts = np.flatnonzero(new)
        self.row = np.empty(len(by), np.int64)
        self.row[by] = np.cumsum(new) - 1
        code = code[cuts]
        self.n = np.add.reduceat(n[by], cuts)
        last, self.context = code % top, code // top  # context: (v, u)
        self.v_at, u_at = self.context // top, self.context % top
        self.u = u_at if self.u_of is None else self.u_of[u_at]
        self.w = last if self.w_of is None else self.w_of[last]
        pair = self.v_at * top + last
        by = np.argsort(pair)
        pair = pair[by]
        new = np.append(True, pair[1:] != pair[:-1])
        cuts = np.flatnonzero(new)
        self.pair = np.empty(len(by), np.int64)  # each n-gram's bigram of the last two words
        self.pair[by] = np.cumsum(new) - 1
        self.pair_n = np.add.reduceat(self.n[by], cuts)
        self.pair_v, self.pair_w = self.v_at[by[cuts]], self.w[by[cuts]]


def _few(n: np.ndarray) -> list[tuple[int, int]]:
    times = np.bincount(n[n <= GOOD_TURING + 1], minlength=GOOD_TURING + 2)
    return [(r, int(times[r])) for r in range(1, GOOD_TURING + 2) if times[r]]


KEPT = -1
_TALLY = "level int, r long, times long, part long, u long, v long, share long, data binary"


def _rows_of(schema: str, columns: dict) -> pa.Table:
    """A table of the named columns; the schema's others are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.table(
        [pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in fields],
        names=[name for name, _ in fields],
    )


def _tallied(routes: Routes):
    """The part's n-grams with counts, and counts of counts; for parts of a hot word or pair also the counts of what follows it, packed, in as many shares as the word has parts."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        v, u, w, n = (np.concatenate(x) for x in zip(*(unpack_sorted(d) for d in table.column("data").to_pylist())))
        if not len(v):
            return _rows_of(_TALLY, {"level": []})
        found = _Grams(v, u, w, n)
        few = [(3, *x) for x in _few(found.n)]
        if part < routes.cold:
            few += [(2, *x) for x in _few(found.pair_n)]
        out = [_rows_of(_TALLY, {"level": [x[0] for x in few], "r": [x[1] for x in few], "times": [x[2] for x in few]})]
        counted = pack_sorted(found.v_of[found.v_at], found.u, found.w, found.n)
        out.append(_rows_of(_TALLY, {"level": [KEPT], "part": [part], "data": [counted]}))
        if part >= routes.cold:  # one middle word; one word before it, if it is a pair
            word = int(found.v_of[0])
            shares = routes.share(found.pair_w, word)
            by = np.argsort(shares, kind="stable")
            cuts = np.append(_starts(shares[by]), len(by))
            rows = [by[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
            u = None if part < routes.pair_from else int(found.u[0])
            out.append(
                _rows_of(
                    _TALLY,
                    {
                        "level": [0] * len(rows),
                        "part": [part] * len(rows),
                        "u": [u] * len(rows),
                        "v": [word] * len(rows),
                        "share": [int(shares[x[0]]) for x in rows],
                        "data": [pack(found.pair_w[x], found.pair_n[x]) for x in rows],
                    },
                )
            )
        tidy()
        return pa.concat_tables(out)

    return run


def _share(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The words after a hot word that are of one share, how often they follow it, and each part's places among them with its own counts."""
    parts = [unpack(x) for x in table.column("data").to_pylist()]
    words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    n = np.bincount(at, np.concatenate([n for _, n in parts]), len(words)).astype(np.int64)
    cuts = np.cumsum([len(w) for w, _ in parts])[:-1]
    return words, n, list(zip(np.split(at, cuts), (n for _, n in parts)))


_SHARES = "v long, r long, times long, c long, large long, seen double"


def _share_sums(unigrams: Unigrams):
    """Of a share: how many words follow so often, for few times; and one row of all times, those of many times, and the words' P."""

    def run(table: pa.Table) -> pa.Table:
        word = table.column("v")[0].as_py()
        words, n, _ = _share(table)
        few = _few(n)
        sums = (int(n.sum()), int(n[n > GOOD_TURING].sum()), float(unigrams.chance(words[n > 0]).sum()))
        return pa.concat_tables([
            _rows_of(_SHARES, {"v": [word] * len(few), "r": [r for r, _ in few], "times": [t for _, t in few]}),
            _rows_of(_SHARES, {"v": [word], "c": [sums[0]], "large": [sums[1]], "seen": [sums[2]]}),
        ])

    return run


_ANSWERS = "part long, data binary, u long, v long, share long, c long, kept double, seen double"


def _share_answers(unigrams: Unigrams, worth: dict[int, tuple[float, float]], d: list[np.ndarray]):
    """P of the bigrams that each part asked for, packed; for a hot pair's parts also their share of its context's sums; and the share itself, with counts and P."""

    def run(table: pa.Table) -> pa.Table:
        word = table.column("v")[0].as_py()
        words, n, parts = _share(table)
        unit, alpha = worth[word]
        p = np.where(n > 0, reduced(n, d[2]) * unit, alpha * unigrams.chance(words))
        us = table.column("u").to_pylist()
        sums = [(0, 0.0, 0.0) if u is None else (int(own.sum()), float(reduced(own, d[3]).sum()), float(p[at][own > 0].sum())) for u, (at, own) in zip(us, parts)]
        whole = _rows_of(_ANSWERS, {"data": [pack(words, n, p)], "v": [word], "share": [table.column("share")[0].as_py()]})
        asked = _rows_of(
            _ANSWERS,
            {
                "part": table.column("part").to_pylist(),
                "data": [pack(words[at], p[at]) for at, _ in parts],
                "u": us,
                "v": [word] * len(us),
                "c": [x[0] for x in sums],
                "kept": [x[1] for x in sums],
                "seen": [x[2] for x in sums],
            },
        )
        return pa.concat_tables([asked, whole])

    return run


def _by_context(context: np.ndarray, n: np.ndarray, less: np.ndarray, q: np.ndarray):
    """From sorted contexts: each row's context's place, and (count, discounted count, q of what was seen) a context."""
    new = np.append(True, context[1:] != context[:-1])
    cuts, at = np.flatnonzero(new), np.cumsum(new) - 1
    return at, (np.add.reduceat(n, cuts), np.add.reduceat(less, cuts), np.add.reduceat(np.where(n > 0, q, 0.0), cuts))


def _starts(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, a[1:] != a[:-1]))


_MODEL = "part long, level int, contexts binary, grams binary"


def _built(routes: Routes, unigrams: Unigrams, d: list[np.ndarray], pairs: dict[int, tuple]):
    """A part's tables: contexts (middle word, word before, alpha, n-grams of it) and n-grams (last word, count, P), by order.

    ``shared`` has P of the bigrams with a hot word, by last word; ``pairs`` the sums of the hot pairs' contexts.
    """

    def run(table: pa.Table, shared: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return _rows_of(_MODEL, {"part": []})
        part = table.column("part")[0].as_py()
        found = _Grams(*unpack_sorted(table.column("data")[0].as_py()))
        rows = []
        if part < routes.cold:
            p1, less = unigrams.chance(found.pair_w), reduced(found.pair_n, d[2])
            at, sums = _by_context(found.pair_v, found.pair_n, less, p1)
            unit, alpha = weights(*sums)
            p2 = less * unit[at]
            sizes = np.bincount(at)
            rows.append((2, pack_sorted(found.v_of, np.zeros(len(sizes), np.int64), alpha, sizes), pack(found.pair_w, found.pair_n, p2)))
        else:
            words, chance = (np.concatenate(x) for x in zip(*(unpack(y) for y in shared.column("data").to_pylist())))
            by = np.argsort(words)
            p2 = chance[by][np.searchsorted(words[by], found.pair_w)]
        if routes.order == 3:
            less = reduced(found.n, d[3])
            at, sums = _by_context(found.context, found.n, less, p2[found.pair])
            if part >= routes.pair_from:
                sums = tuple(np.array([x]) for x in pairs[routes.pair(part)])
            unit, alpha = weights(*sums)
            first = _starts(found.context)
            contexts = pack_sorted(found.v_of[found.v_at[first]], found.u[first], alpha, np.diff(np.append(first, len(at))))
            rows.append((3, contexts, pack(found.w, found.n, less * unit[at])))
        tidy()
        return _rows_of(_MODEL, {"part": [part] * len(rows), "level": [r[0] for r in rows], "contexts": [r[1] for r in rows], "grams": [r[2] for r in rows]})

    return run


def _position(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values stand in a sorted array, and whether they do."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


class _Level:
    """Contexts and n-grams of one order in a part, for look-ups."""

    def __init__(self, contexts: bytes | None, grams: bytes | None):
        none = np.zeros(0, np.int64)
        v, u, self.alpha, sizes = unpack_sorted(contexts) if contexts else (none, none, none, none)
        w, _, self.p = unpack(grams) if grams else (none, none, none)
        self.v_of, at = np.unique(v, return_inverse=True)
        self.top_u, self.top_w = int(u.max(initial=0)) + 1, int(w.max(initial=0)) + 1
        self.context = at * self.top_u + u
        self.gram = np.repeat(np.arange(len(sizes)), sizes) * self.top_w + w

    def find(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P, whether stored, alpha): alpha is 1 where the context is not stored."""
        at, known = _position(self.v_of, v)
        at, hit = _position(self.context, at * self.top_u + u)
        known &= hit & (u < self.top_u)
        alpha = np.where(known, self.alpha[at], 1.0) if len(self.alpha) else np.ones(len(v))
        at, hit = _position(self.gram, at * self.top_w + w)
        hit &= known & (w < self.top_w)
        return self.p[at] if len(self.p) else np.ones(len(v)), hit, alpha


def _summed(p: np.ndarray, occurs: np.ndarray, marks: np.ndarray, answers: np.ndarray) -> bytes:
    """log P by text, and of the n-grams that are answered by number."""
    sums = np.bincount(marks, np.repeat(p, occurs), CHUNK).astype(float)
    place = np.flatnonzero(sums)
    return pack(place, sums[place], answers, p[occurs == 0])


_SUMS = "uid long, data binary, docs array<long>, held array<boolean>, v long, share long"


def _sums_table(uid: list, data: list, v: list | None = None, share: list | None = None) -> pa.Table:
    n = len(uid)
    whole = [pa.array(uid, pa.int64()), pa.array(data, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.bool_()))]
    return pa.table(
        [*whole, pa.array(v or [None] * n, pa.int64()), pa.array(share or [None] * n, pa.int64())],
        names=["uid", "data", "docs", "held", "v", "share"],
    )


def _looked_up(routes: Routes, unigrams: Unigrams, pairs: dict[int, tuple]):
    """A row a batch with the sums of log10 P by text; bigrams with a hot word that are open are sent on; rows of the batches' own sums are passed on."""

    def run(table: pa.Table, model: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        own = table.filter(pc.is_valid(table.column("docs"))).select(["uid", "data", "docs", "held"])
        out = [_sums_table([], [])]
        if own.num_rows:
            blank = _sums_table(own.column("uid").to_pylist(), own.column("data").to_pylist())
            out.append(pa.table({c: own.column(c) if c in ("docs", "held") else blank.column(c) for c in blank.column_names}).cast(blank.schema))
        table = table.filter(pc.is_null(table.column("docs")))
        if table.num_rows:
            part = table.column("part")[0].as_py()
            stored = {r["level"]: _Level(r["contexts"], r["grams"]) for r in model.to_pylist()}
            two, three = (stored.get(k) or _Level(None, None) for k in (2, 3))
            whole = None
            if part >= routes.pair_from:
                whole = float(weights(*(np.array([x]) for x in pairs[routes.pair(part)]))[1][0])
            for uid, data in zip(table.column("uid").to_pylist(), table.column("data").to_pylist()):
                v, u, w, occurs, marks, answers = unpack_sorted(data)
                p, open_ = np.ones(len(v)), np.ones(len(v), bool)
                if routes.order == 3:
                    chance, hit, alpha = three.find(v, u, w)
                    p, open_ = np.where(hit, chance, alpha if whole is None else whole), ~hit
                if part < routes.cold:
                    chance, hit, alpha = two.find(v, np.zeros(len(v), np.int64), w)
                    p = np.where(open_, p * np.where(hit, chance, alpha * unigrams.chance(w)), p)
                out.append(_sums_table([uid], [_summed(np.log10(p), occurs, marks, answers)]))
                if part >= routes.cold and open_.any():  # one middle word
                    word = int(v[0])
                    shares = np.where(open_, routes.share(w, word), -1)
                    texts, number = np.repeat(shares, occurs), np.full(len(v), -1)
                    number[occurs == 0] = answers
                    some = [int(x) for x in np.unique(shares) if x >= 0]
                    sent = [pack(w[at], occurs[at], marks[texts == x], number[at & (occurs == 0)]) for x, at in ((x, shares == x) for x in some)]
                    out.append(_sums_table([uid] * len(some), sent, [word] * len(some), some))
        tidy()
        return pa.concat_tables(out)

    return run


def _followed(unigrams: Unigrams, worth: dict[int, float]):
    """A row a batch with the sums of log10 P of bigrams with a hot word, of one share; ``worth`` has the words' alpha."""

    def run(table: pa.Table, model: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sums_table([], [])
        words, n, chance = unpack(model.column("data")[0].as_py()) if model.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        alpha, out = worth.get(table.column("v")[0].as_py(), 1.0), []
        for data in table.column("data").to_pylist():
            w, occurs, marks, answers = unpack(data)
            at, hit = _position(words, w)
            p = np.where(hit, chance[at], alpha * unigrams.chance(w)) if len(words) else alpha * unigrams.chance(w)
            out.append(_summed(np.log10(p), occurs, marks, answers))
        tidy()
        return _sums_table(table.column("uid").to_pylist(), out)

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """A batch's documents from its sums."""
    docs = next(r for r in table.to_pylist() if r["docs"] is not None)
    lengths, known, base, score, occurs, marks = unpack(docs["data"])
    score, often = score.copy(), np.zeros(len(occurs))
    for row in table.select(["data", "docs"]).to_pylist():
        if row["docs"] is None:
            place, sums, answers, p = unpack(row["data"])
            score[place] += sums
            often[answers] += p
    score += np.bincount(marks, np.repeat(often, occurs), len(score))
    return pa.table(
        {
            "doc_id": pa.array(docs["docs"], pa.int64()),
            "held_out": pa.array(docs["held"], pa.bool_()),
            "n_tokens": lengths,
            "n_known": known,
            "base_score": base,
            "score": score,
        }
    )


def numbered(words: DataFrame) -> DataFrame:
    """wpart, word, n, id, as a stored table: numbers from FIRST by falling count, then word."""
    keys = [F.desc("n"), F.col("word")]
    sorted_ = written(
        words.where("n > 0").repartitionByRange(*keys).sortWithinPartitions(*keys).select(
            "wpart",
            "word",
            "n",
            F.monotonically_increasing_id().alias("at"),
        )
    )
    part = F.shiftright("at", 33)
    before, offsets = FIRST, []
    for p, n in sorted(sorted_.groupBy(part.alias("p")).agg(F.count("*")).collect()):  # a row a partition
        offsets.append((p, before))
        before += n
    offset = sorted_.sparkSession.createDataFrame(offsets, "p long, before long")
    found = written(
        sorted_.withColumn("p", part)
        .join(F.broadcast(offset), "p")
        .select("wpart", "word", "n", (F.col("before") + F.col("at") - F.shiftleft("p", 33)).alias("id"))
    )
    forget(sorted_)
    return found


def _hot_pairs(coded: DataFrame, ids: DataFrame, cap: int) -> list[tuple[int, int, int]]:
    """(number, number, times) of neighbours that some batches count over ``cap`` times: at most tokens / cap of them."""
    summed = coded.where("times is not null").groupBy("word", "next").agg(F.sum("times").alias("times")).where(F.col("times") > cap)
    one, two = ids.select(F.col("word").alias("a"), F.col("id").alias("u")), ids.select(F.col("word").alias("b"), F.col("id").alias("v"))
    found = summed.join(one, F.col("word") == F.col("a"), "left").join(two, F.col("next") == F.col("b"), "left")
    named = lambda word, number: F.when(F.col(word).isNull(), BEGIN).otherwise(F.coalesce(F.col(number), F.lit(UNKNOWN))).cast("long")
    return [tuple(r) for r in found.select(named("word", "u"), named("next", "v"), "times").collect()]


_SENT = "part long, uid long, data binary, docs array<long>, held array<boolean>"
_DOCS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _tokenised(docs: DataFrame, held_out, width: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return bucketed(rows.mapInArrow(_coded(width), _CODED), "uid", width)


def _by_part(coded: DataFrame):
    return coded.where("words is not null").select("uid", "wpart", "words", "counts").groupBy("wpart")


def _ready(coded: DataFrame, words: DataFrame, width: int):
    """Batches with the numbers of their words."""
    numbers = words.select("wpart", "word", "id").groupBy("wpart")
    answers = _by_part(coded).cogroup(numbers).applyInArrow(_answered, "uid long, wpart int, ids binary")
    answers = bucketed(answers.groupBy("uid").agg(F.collect_list(F.struct("wpart", "ids")).alias("ids")), "uid", width)
    return coded.where("code is not null").select("uid", "docs", "held", "code").join(answers, "uid").groupBy("uid")


@dataclass
class Model:
    """Stored tables. words: wpart, word, n, id; grams: part, level (order), contexts (word, word before, alpha, n-grams) and grams (last word, count, P), packed; follows: v, share, data (last word, count, P), the bigrams of hot words; hot: v, alpha of hot words; pairs: u, v, times, c, kept, seen of hot pairs; facts: width, texts, cap, order."""

    words: DataFrame
    grams: DataFrame
    follows: DataFrame
    hot: DataFrame
    pairs: DataFrame
    facts: DataFrame

    def save(self, path: str) -> None:
        for name in self.__dataclass_fields__:
            getattr(self, name).write.option("compression", "zstd").parquet(f"{path}/{name}")

    @cached_property
    def _known(self):
        """What every task needs: one entry a count that occurs, a hot word and a hot pair."""
        width, texts, cap, order = self.facts.first()
        unigrams = Unigrams(dict(self.words.groupBy("n").agg(F.count("*")).collect()))
        pairs = self.pairs.collect()
        routes = Routes(unigrams, texts, [tuple(r)[:3] for r in pairs], cap, order)
        return width, unigrams, routes, {(r.u << 32) + r.v: (r.c, r.kept, r.seen) for r in pairs}, dict(map(tuple, self.hot.collect()))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, n_known, train_tokens, base_score, score of other texts: nothing is counted anew."""
        width = self._known[0]
        coded = _tokenised(docs, F.lit(True), width)
        return self._scores(_ready(coded, self.words, width)).drop("held_out")

    def _scores(self, ready) -> DataFrame:
        width, unigrams, routes, pairs, worth = self._known
        base = float(unigrams.total + unigrams.distinct + 1)  # one more a word, and for the unknown one
        sent = ready.applyInArrow(_sent(routes, unigrams, True, base), _SENT).groupBy("part")
        look = _looked_up(routes, unigrams, pairs)
        summed = sent.cogroup(self.grams.groupBy("part")).applyInArrow(lambda t, m: look(t, m), _SUMS)
        if routes.end > routes.cold:
            summed = written(summed)
            follow = _followed(unigrams, worth)
            onward = summed.where("v is not null").groupBy("v", "share").cogroup(self.follows.groupBy("v", "share"))
            summed = summed.where("v is null").unionByName(onward.applyInArrow(lambda t, m: follow(t, m), _SUMS))
        out = summed.drop("v", "share").groupBy("uid").applyInArrow(_gathered, _DOCS)
        total = F.lit(unigrams.total).cast("long").alias("train_tokens")
        return out.select("doc_id", "held_out", "n_tokens", "n_known", total, "base_score", "score")


def load(spark: SparkSession, path: str) -> Model:
    return Model(*(spark.read.parquet(f"{path}/{name}") for name in Model.__dataclass_fields__))


def _trained(coded: DataFrame, width: int, order: int, cap: int):
    """The model of the batches' training texts, and the batches with the numbers of its words."""
    spark = coded.sparkSession
    counts = written(_by_part(coded).applyInArrow(_counted, "wpart int, word binary, n long"))
    words = numbered(counts)
    forget(counts)
    unigrams = Unigrams(dict(words.groupBy("n").agg(F.count("*")).collect()))  # a row a count
    n_texts = coded.where("code is not null").agg(F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()[0]
    hot_pairs = _hot_pairs(coded, words, cap)
    routes = Routes(unigrams, n_texts, hot_pairs, cap, order)
    ready = _ready(coded, words, width)
    counted = ready.applyInArrow(_sent(routes, unigrams, False, 1.0), _SENT).groupBy("part").applyInArrow(_tallied(routes), _TALLY)
    tally = bucketed(counted, "part", width)
    few = {k: Counter() for k in (2, 3)}
    for k, r, times in tally.where("level > 0").groupBy("level", "r").agg(F.sum("times")).collect():
        few[k][r] += times
    shares = tally.where("level = 0").groupBy("v", "share")
    has_hot = routes.end > routes.cold
    summed = []
    if has_hot:
        # some rows a hot word
        summed = (
            written(shares.applyInArrow(_share_sums(unigrams), _SHARES))
            .groupBy("v", "r")
            .agg(F.sum("times"), F.sum("c"), F.sum("large"), F.sum("seen"))
            .collect()
        )
        for _, r, times, *_ in (x for x in summed if x[1] is not None):
            few[2][r] += times
    d = [np.zeros(1), np.zeros(1), discounts(few[2]), discounts(few[3])]
    less, worth, pairs = Counter(), {}, {}
    for v, r, times, *_ in (x for x in summed if x[1] is not None and x[1] <= GOOD_TURING):
        less[v] += times * r * float(d[2][r])
    for v, _, _, c, large, seen in (x for x in summed if x[1] is None):
        unit, alpha = weights(np.array([c]), np.array([less[v] + large]), np.array([seen]))
        worth[v] = float(unit[0]), float(alpha[0])
    answers = spark.createDataFrame([], _ANSWERS)
    if has_hot:
        answers = written(shares.applyInArrow(_share_answers(unigrams, worth, d), _ANSWERS))
        sums = answers.where("u is not null").groupBy("u", "v").agg(F.sum("c"), F.sum("kept"), F.sum("seen"))  # a row a hot pair
        pairs = {(u << 32) + v: (c, kept, seen) for u, v, c, kept, seen in sums.collect()}
    pairs = {int(k): pairs.get(int(k), (0, 0.0, 0.0)) for k in routes.pairs}
    build = _built(routes, unigrams, d, pairs)
    kept = tally.where(f"level = {KEPT}").select("part", "data")
    grams = kept.where(F.col("part") < routes.cold).groupBy("part").applyInArrow(lambda t: build(t), _MODEL)
    if has_hot:
        asked = answers.where("part is not null").select("part", "data").groupBy("part")
        hot = kept.where(F.col("part") >= routes.cold).groupBy("part").cogroup(asked)
        grams = grams.unionByName(hot.applyInArrow(lambda t, s: build(t, s), _MODEL))
    rows = [(u, v, times, *pairs[(u << 32) + v]) for u, v, times in hot_pairs if (u << 32) + v in pairs]
    stored = bucketed(grams, "part", width)
    forget(tally)  # the model has all of it
    model = Model(
        words,
        stored,
        answers.where("part is null").select("v", "share", "data"),
        spark.createDataFrame([(v, alpha) for v, (_, alpha) in worth.items()], "v long, alpha double"),
        spark.createDataFrame(rows, "u long, v long, times long, c long, kept double, seen double"),
        spark.createDataFrame([(width, n_texts, cap, order)], "width long, texts long, cap long, `order` long"),
    )
    return model, ready


def train(docs: DataFrame, order: int = ORDER, cap: int = CAP) -> Model:
    """The model of all texts; ``order`` 2 or 3, ``cap`` about the tokens of a part. Its tables last as long as the application, or from ``save`` on."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _trained(_tokenised(docs, F.lit(False), width), width, order, cap)[0]


def score(docs: DataFrame, held_out, order: int = ORDER, cap: int = CAP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, by the model of the rows where ``held_out``, a boolean column, is not true."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model, ready = _trained(_tokenised(docs, held_out, width), width, order, cap)
    return model._scores(ready)
