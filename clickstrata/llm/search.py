"""Ranked lexical search over a clustered index: documents are reordered by recursive graph bisection, then cut to shards.

Order. Recursive bisection splits documents in two halves such that terms gather in one of them: documents move
between the halves while the sum of their logarithmic gaps falls. Up to ``BLOCK`` postings one task does it, over all
terms, down to ``LEAF`` documents. Above that a tree of at most ``FAN`` leaves is fitted to a bounded sample of a node's
documents (``SAMPLE``, expected) and ``DIMS`` hashed terms, and every document of the node is sent down the tree; nodes
that are still too large are split again, and those that no split tells apart (copies) are cut by hash. The order only
decides how soon a search stops, never what it finds.

Index. A shard is up to ``SHARD`` documents next to each other. Its rows are its documents (ids and lengths; term null)
and, for each term, the places and frequencies of the term's documents and the largest impact among them. Every document
with a term is in it. ``build`` stores it as a table; ``search`` takes queries by the million or by one.

Search. A shard's bound for a query is the sum of its terms' weights times their largest impacts. Queries visit shards
in falling order of bounds, in three rounds (``VISITS``, then all that are left), each without the shards whose bound is
below the query's tenth score so far. A bound that equals it is visited, as a lesser doc_id may win the tie; so what is
skipped cannot be among the first ten. All is in 64-bit integers but the logarithm of a weight.

Null and empty texts hold no term and are not found; a null doc_id comes behind the others of equal score; repeated
documents are found each; each row of the queries is a query of its own, whatever its item_id; queries without terms, or
with terms that no document holds, find nothing; a text of any length is indexed whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .decontaminate import words_of
from .frames import tidy, written

BLOCK = 1 << 20  # postings that one task puts in order
SHARD = 1024
LEAF = 64
SAMPLE = 4096
DIMS = 1024
FAN = 64
ROUTE = 1 << 14  # documents that one task sends down a tree
PASSES = 8
VISITS = (4, 32)  # shards a query visits in the first rounds
SLICE = 256  # queries that one task scores against a shard


def _postings(indptr: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the documents' postings stand, and whose each is (a place in ``docs``)."""
    sizes = indptr[docs + 1] - indptr[docs]
    owner = np.repeat(np.arange(len(docs)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + indptr[docs][owner], owner


def _gap(held: np.ndarray, size: int) -> np.ndarray:
    return held * np.log2(size / (held + 1.0))


def halves(terms: np.ndarray, owner: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """Which of ``n`` documents go to the left half: swaps between halves while terms' gaps become smaller."""
    left = np.arange(n) < n // 2
    often = np.bincount(terms, minlength=n_terms)
    useful = np.flatnonzero(often > 1)
    if not len(useful):
        return left
    number = np.full(n_terms, -1, np.int64)
    number[useful] = np.arange(len(useful))
    terms = number[terms]
    owner, terms = owner[terms >= 0], terms[terms >= 0]
    often, sizes = often[useful].astype(float), (n // 2, n - n // 2)
    # begin with documents by the least hash of their terms: like ones start on the same side
    few = often[terms] <= n / 2
    least = np.full(n, 1 << 32, np.int64)
    np.minimum.at(least, owner[few], (terms[few] + 1) * 2654435761 % (1 << 32))
    left[:] = False
    left[np.argsort(least, kind="stable")[: n // 2]] = True
    for _ in range(PASSES):
        here = left[owner]
        held = np.bincount(terms[here], minlength=len(often)).astype(float)
        rest = often - held
        now = _gap(held, sizes[0]) + _gap(rest, sizes[1])
        to_right = now - _gap(np.maximum(held - 1, 0), sizes[0]) - _gap(rest + 1, sizes[1])
        to_left = now - _gap(held + 1, sizes[0]) - _gap(np.maximum(rest - 1, 0), sizes[1])
        gain = np.bincount(owner, np.where(here, to_right[terms], to_left[terms]), minlength=n)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        k = int(np.count_nonzero(gain[a] + gain[b[: len(a)]] > 1e-9))
        if not k:
            break
        left[a[:k]], left[b[:k]] = False, True
    return left


def bisected(indptr: np.ndarray, terms: np.ndarray, n_terms: int, leaf: int = LEAF) -> np.ndarray:
    """The order of documents by recursive graph bisection."""
    out, todo = [], [np.arange(len(indptr) - 1)]
    while todo:
        docs = todo.pop()
        if len(docs) <= leaf:
            out.append(docs)
            continue
        at, owner = _postings(indptr, docs)
        left = halves(terms[at], owner, len(docs), n_terms)
        todo += [docs[~left], docs[left]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def fitted(indptr: np.ndarray, terms: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a bisection tree (inner nodes from 1, as in a heap) over hashed terms."""
    weights, limits = np.zeros((leaves, DIMS), np.float32), np.zeros(leaves)
    todo = [(1, np.arange(len(indptr) - 1))]
    while todo:
        node, docs = todo.pop()
        if node >= leaves or len(docs) < 2:
            continue
        at, owner = _postings(indptr, docs)
        own = terms[at]
        left = halves(own, owner, len(docs), DIMS)
        held = np.bincount(own[left[owner]], minlength=DIMS)
        rest = np.bincount(own, minlength=DIMS) - held
        weights[node] = np.log2((rest + 1) / max(1, np.count_nonzero(~left))) - np.log2((held + 1) / max(1, np.count_nonzero(left)))
        score = np.bincount(owner, weights[node][own], minlength=len(docs))
        limits[node] = np.median(score)
        todo += [(2 * node, docs[score <= limits[node]]), (2 * node + 1, docs[score > limits[node]])]
    return weights, limits


def routed(weights: np.ndarray, limits: np.ndarray, indptr: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Each document's leaf."""
    n, leaves = len(indptr) - 1, len(limits)
    owner = np.repeat(np.arange(n), np.diff(indptr))
    node = np.ones(n, np.int64)
    for _ in range(leaves.bit_length() - 1):
        score = np.bincount(owner, weights[node[owner], terms], minlength=n)
        node = 2 * node + (score > limits[node])
    return node - leaves


def _packed(found: Counter) -> tuple[int, bytes]:
    """A document's frequencies and terms as one compressed value, and its size before: postings are moved in this form."""
    raw = np.fromiter(found.values(), np.int32, len(found)).tobytes() + b" ".join(found)
    return len(raw), pa.compress(raw, "zstd", asbytes=True)


def _unpacked(count: int, size: int, packed: bytes) -> tuple[list[bytes], np.ndarray]:
    raw = pa.decompress(packed, size, "zstd", asbytes=True)
    return raw[4 * count :].split(b" "), np.frombuffer(raw, np.int32, count)


def _dims(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of the documents' hashed terms."""
    parts = column.to_pylist()
    return np.cumsum([0, *(len(x) // 2 for x in parts)]), np.frombuffer(b"".join(parts), np.uint16).astype(np.int64)


_TOKENS = {"rid": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "weight": pa.int64(), "size": pa.int64(), "packed": pa.binary(), "dims": pa.binary()}


def _tokenised(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n (terms), weight (different ones), size and packed (postings), dims of documents with a term."""

    def run(batches):
        for batch in batches:
            rows = []
            for rid, doc_id, text in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                if words:
                    found = Counter(words)
                    dims = np.array(list({xxhash.xxh3_64_intdigest(t) % DIMS for t in found}), np.uint16)
                    rows.append((rid, doc_id, len(words), len(found), *_packed(found), dims.tobytes()))
            columns = zip(*rows) if rows else [[]] * len(_TOKENS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TOKENS.values())], list(_TOKENS))
            tidy()

    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "rid long, doc_id long, n long, weight long, size long, packed binary, dims binary")


def _split(placed: DataFrame, sizes: DataFrame, block: int, sample: int) -> DataFrame:
    """``placed`` (rid, dims, weight, node) with the documents of too large nodes in the leaves of their nodes' trees."""

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        leaves = int(table.column("leaves")[0].as_py())
        weights, limits = fitted(*_dims(table.column("dims")), leaves)
        return pa.table({"node": [key[0].as_py()], "weights": [weights.tobytes()], "limits": [limits.tobytes()]})

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        node = left.column("node")[0].as_py() if left.num_rows else 0
        leaf = np.zeros(left.num_rows, np.int64)
        if left.num_rows and right.num_rows:
            weights = np.frombuffer(right.column("weights")[0].as_py(), np.float32).reshape(-1, DIMS)
            leaf = routed(weights, np.frombuffer(right.column("limits")[0].as_py()), *_dims(left.column("dims")))
        return left.select(["rid", "dims", "weight"]).append_column("node", pa.array(node * FAN + leaf, pa.int64()))

    large = sizes.where(F.col("postings") > block)
    wanted = F.ceil(F.col("postings") / block)
    large = large.select(
        "node",
        "docs",
        F.least(F.lit(FAN), F.pow(F.lit(2.0), F.ceil(F.log2(wanted.cast("double"))))).cast("int").alias("leaves"),
        F.greatest(F.lit(1), F.ceil(F.col("docs") / ROUTE)).cast("long").alias("salts"),
    )
    joined = placed.join(large, "node", "left")
    fits = joined.where(F.col("leaves").isNotNull() & (F.pmod(F.xxhash64("rid", "node"), F.col("docs")) < sample)).select("node", "leaves", "dims")
    trees = fits.groupBy("node").applyInArrow(fit, "node long, weights binary, limits binary")
    salted = trees.join(large.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")), "node")
    moved = joined.select("rid", "dims", "weight", "node", F.pmod(F.xxhash64("rid"), F.coalesce("salts", F.lit(1).cast("long"))).alias("salt"))
    return moved.groupBy("node", "salt").cogroup(salted.groupBy("node", "salt")).applyInArrow(route, "rid long, dims binary, weight long, node long")


def _blocks(tokens: DataFrame, postings: int, block: int, sample: int) -> DataFrame:
    """rid, node, piece: documents in blocks of about ``block`` postings, like ones together."""
    placed, reach = tokens.select("rid", "dims", "weight", F.lit(0).cast("long").alias("node")), block
    sizes = lambda: placed.groupBy("node").agg(F.sum("weight").alias("postings"), F.count("*").alias("docs"))
    while reach < postings:
        placed, reach = written(_split(placed, sizes(), block, sample)), reach * FAN
    pieces = sizes().select("node", F.greatest(F.lit(1), F.ceil(F.col("postings") / (2 * block))).cast("long").alias("pieces"))
    return placed.select("rid", "node").join(pieces, "node").select("rid", "node", F.pmod(F.xxhash64("rid"), F.col("pieces")).alias("piece"))


_LISTS = "shard string, term string, a array<long>, b array<int>, top long"
_TYPES = {"shard": pa.string(), "term": pa.string(), "a": pa.list_(pa.int64()), "b": pa.list_(pa.int32()), "top": pa.int64()}


def lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The length factor of documents with ``n`` terms."""
    return 25 + 75 * n * docs // max(terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class Index:
    """``lists``: the shards' rows; ``docs``: documents with a term; ``terms``: all their terms with repeats."""

    lists: DataFrame
    docs: int
    terms: int


def build(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, leaf: int = LEAF, sample: int = SAMPLE) -> Index:
    tokens = written(_tokenised(docs))
    held = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    n_docs, n_terms, postings = (int(x) for x in held)

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        known: dict[bytes, int] = {}
        codes, tfs, indptr = [], [], np.cumsum([0, *table.column("weight").to_pylist()])
        for row in zip(*(table.column(c).to_pylist() for c in ("weight", "size", "packed"))):
            words, own = _unpacked(*row)
            codes.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
            tfs.append(own)
        codes, tfs = np.concatenate(codes), np.concatenate(tfs).astype(np.int64)
        order = bisected(indptr, codes, len(known), leaf)
        ids, n = table.column("doc_id").take(pa.array(order)).combine_chunks(), table.column("n").to_numpy()[order]
        at, place = _postings(indptr, order)
        code, tf = codes[at], tfs[at]
        number, inside = place // shard, place % shard
        ranked = np.lexsort((inside, code, number))
        number, code, inside, tf, place = number[ranked], code[ranked], inside[ranked], tf[ranked], place[ranked]
        heads = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (code[1:] != code[:-1])]))
        starts = np.arange(0, len(order), shard)
        name = pa.array([f"{key[0].as_py()}.{key[1].as_py()}.{k}" for k in range(len(starts))])
        offsets = lambda x, total: pa.array(np.append(x, total).astype(np.int32))
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        listed = [
            [name, pa.nulls(len(starts), pa.string()), pa.ListArray.from_arrays(offsets(starts, len(order)), ids), pa.ListArray.from_arrays(offsets(starts, len(order)), pa.array(n, pa.int32())), pa.nulls(len(starts), pa.int64())],
            [
                name.take(pa.array(number[heads])),
                pa.array([w.decode() for w in known], pa.string()).take(pa.array(code[heads])),
                pa.ListArray.from_arrays(offsets(heads, len(code)), pa.array(inside, pa.int64())),
                pa.ListArray.from_arrays(offsets(heads, len(code)), pa.array(tf, pa.int32())),
                pa.array(np.maximum.reduceat(impact(tf, lengths(n, n_docs, n_terms)[place]), heads), pa.int64()),
            ],
        ]
        tidy()
        return pa.concat_tables([pa.table(dict(zip(_TYPES, columns)), schema=pa.schema(_TYPES)) for columns in listed])

    blocks = _blocks(tokens, postings, block, sample)
    joined = tokens.join(blocks, "rid").select("node", "piece", "rid", "doc_id", "n", "weight", "size", "packed")
    return Index(written(joined.groupBy("node", "piece").applyInArrow(cut, _LISTS)), n_docs, n_terms)


def _asked(queries: DataFrame) -> DataFrame:
    """q, item_id, term, times: the distinct terms of each query."""

    def run(batches):
        for batch in batches:
            rows = []
            for q, text in zip(batch.column("q").to_pylist(), batch.column("text")):
                rows += [(q, t.decode(), times) for t, times in Counter(words_of(text.as_py())).items()]
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()))], ["q", "term", "times"])

    return queries.mapInArrow(run, "q long, term string, times long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each query, by score, then doc_id."""
    items = written(queries.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"))
    asked = written(_asked(items.select("q", "text")))
    own = written(
        index.lists.join(asked.select("term").distinct(), "term", "left_semi").select(*_TYPES).unionByName(index.lists.where("term IS NULL"))
    )
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1)))
    weights = own.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("a").cast("long")).alias("df")).select("term", weight.alias("weight"))
    need = written(asked.join(weights, "term").select("q", "term", (F.col("times") * F.col("weight")).alias("weight")).where("weight > 0"))
    tops = own.where("term IS NOT NULL").select("shard", "term", "top")
    bounds = written(tops.join(need, "term").groupBy("q", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")))
    spark, n_docs, n_terms = queries.sparkSession, index.docs, index.terms

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            lists = {t: i for i, t in enumerate(left.column("term").to_pylist())}
            a, b = left.column("a"), left.column("b")
            ids = np.array(a[lists[None]].as_py(), object)
            m = lengths(b[lists[None]].values.to_numpy().astype(np.int64), n_docs, n_terms)
            asked: dict[int, int] = {}
            for q, floor in zip(right.column("q").to_pylist(), right.column("floor").to_pylist()):
                asked[q] = floor
            line = {q: i for i, q in enumerate(asked)}
            sums = np.zeros((len(asked), len(ids)), np.int64)
            held: dict[str, tuple] = {}
            for q, term, w in zip(right.column("q").to_pylist(), right.column("term").to_pylist(), right.column("weight").to_pylist()):
                if term not in lists:
                    continue
                if term not in held:
                    at = a[lists[term]].values.to_numpy()
                    held[term] = at, impact(b[lists[term]].values.to_numpy().astype(np.int64), m[at])
                at, gain = held[term]
                sums[line[q], at] += w * gain
            for q, floor in asked.items():
                row = sums[line[q]]
                if len(row) > k:
                    floor = max(floor, int(np.partition(row, len(row) - k)[len(row) - k]))
                good = np.flatnonzero(row >= max(floor, 1)).tolist()
                good.sort(key=lambda i: (-row[i], ids[i] is None, ids[i] or 0))
                out += [(q, ids[i], int(row[i])) for i in good[:k]]
        tidy()
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("q", "doc_id", "score"), columns)})

    best, seen = spark.createDataFrame([], "q long, doc_id long, score long"), None
    for most in (*VISITS, None):
        floors = best.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("q", "least")
        open_ = bounds if seen is None else bounds.join(seen, ["q", "shard"], "left_anti")
        open_ = open_.join(floors, "q", "left").withColumn("floor", F.coalesce("least", F.lit(1).cast("long"))).where("bound >= floor")
        if most:
            turn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "shard"))
            open_ = open_.withColumn("turn", turn).where(F.col("turn") <= most)
        visits = written(open_.select("q", "shard", "floor", F.floor(F.col("q") / SLICE).alias("slice")))
        work = visits.join(need, "q").select(*[F.col(c).alias(c) for c in ("shard", "slice", "q", "floor", "term", "weight")])  # own columns
        sides = own.join(visits.select("shard", "slice").distinct(), "shard")
        keys = ["shard", "slice"]
        found = sides.groupBy(*keys).cogroup(work.groupBy(*keys)).applyInArrow(score, "q long, doc_id long, score long")
        best = written(_best(best.unionByName(found), k).select("q", "doc_id", "score"))
        visited = visits.select("q", "shard")
        seen = visited if seen is None else seen.unionByName(visited)
    return _best(best, k).join(items.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
