"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

1. Every text becomes its set of distinct ``size``-word shingles (64-bit hashes); a text with fewer words has
   its whole sequence as one. Texts with equal sets are one class, told apart by two 64-bit hashes of the set.
2. Sets are cut to a prefix in hash order. Partners x and y share at least ceil(t*n) shingles of either. With
   prefixes longer by l - 1 than the shortest that work, they share at least l prefix shingles, where l is the
   lesser of theirs; l is 1 + ``extra`` * n here. A class stays only if that many of its prefix shingles occur in
   other classes.
3. Each shingle that two classes still share names a hub: its class with the most shared prefix shingles.
   A hub's group is the product of its classes' prefixes, cut into pairs of blocks by their number and by the
   shingles that they hold; the pairs of a large group are dealt to tasks one by one. If x has c of its d shared
   prefix shingles under a hub, a partner has at least l*c/d of them under one hub at least; pairs below that,
   or below the bound of their sizes, are discarded. A block pair returns a spanning forest of what is left.
   Documents that merely share passages end here, without their sets being moved.
4. The forests' components are candidate clusters. Each goes, with whole sets, through the same product in
   blocks, which accumulates full overlap counts and returns a spanning forest of the links and link counts,
   never all pairs. A pair meets once.
5. Components of these forests are the result.

Two layers of texts (documents as they are, and as they were) go through the same steps at once. A class knows the
layers it is in; shingles are shared, and pairs made, within a layer only, and so are links, forests and components.

Null and empty texts, and texts without words, have the empty set and link with nothing. Rows with equal
texts link. Repeated ids are rows of their own; null ids join their class but name no component unless alone.
An empty table gives an empty result; very long texts are whole sets, and a block holds at least one set; columns
other than doc_id and text are not read. Collisions of the shingles' hash matter only within one pair of sets, those
of a class's first hash only add candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import forget, fresh, sliced, small_batches, tidy, written
from .hashing import mix, shingle_sets

SIZE = 5
PERCENT = 80
EXTRA = 0.08
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20  # about so many shingles in a block
PART = 1 << 18  # edges that one task of the components solves
SHIP_ROWS = 500_000  # class keys broadcast at most: 8 MB


def need(n: np.ndarray | int, percent: int):
    """The least overlap a set of n shares with any partner."""
    return -(-n * percent // 100)


def bits(n: np.ndarray | int):
    """Bits in the parity bitmap of a set of n: the least power of two from n on, 128 at least."""
    return np.maximum(128, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def parity(found: np.ndarray) -> np.ndarray:
    """The set's parity bitmap as 64-bit words."""
    size = int(bits(len(found)))
    odd = np.bincount((mix(found + np.uint64(0x2545F491)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def differing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """At least how many elements the set of bitmap ``one`` and those of ``others`` (a row each) differ in; the wider is folded."""
    while len(one) > others.shape[1]:
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    while len(one) < others.shape[1]:
        half = others.shape[1] // 2
        others = others[:, :half] ^ others[:, half:]
    return np.bitwise_count(one ^ others).sum(axis=1, dtype=np.int64)


def set_key(found: np.ndarray) -> tuple[int, int]:
    """Two hashes of a sorted set, as signed 64-bit values."""
    out = []
    for salt in (0x51ED270B, 0x1B56C4E9):
        with np.errstate(over="ignore"):
            total = mix(found + np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(found))
        out.append(int(mix(np.array([total], np.uint64)).view(np.int64)[0]))
    return out[0], out[1]


def profiles(docs: DataFrame, size: int, percent: int, extra: float) -> DataFrame:
    """doc_id, n, key, second (the class's hashes), prefix (little-endian 64-bit shingles in hash order) and parity bitmap (both null where the batch has the class already)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, seconds, counts, prefixes, parities, seen = batch.column(0), [], [], [], [], [], set()
            for texts in sliced(batch.column(1).to_pylist()):
                for found in shingle_sets(texts, size):
                    n, (key, second) = len(found), set_key(found)
                    keys.append(key)
                    seconds.append(second)
                    counts.append(n)
                    if n and (key, second) not in seen:
                        seen.add((key, second))
                        prefixes.append(found[: min(n, n - need(n, percent) + 1 + int(extra * n))].astype("<u8").tobytes())
                        parities.append(parity(found).tobytes())
                    else:
                        prefixes.append(None)
                        parities.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(seconds, pa.int64()),
                    pa.array(prefixes, pa.binary()),
                    pa.array(parities, pa.binary()),
                ],
                ["doc_id", "n", "key", "second", "prefix", "parity"],
            )
        tidy()

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(run, "doc_id long, n long, key long, second long, prefix binary, parity binary")
    )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The incidence matrix's entries (shingle, key, n, layers) from prefixes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            arrays = [np.frombuffer(x, "<i8") for x in part.column("prefix").to_pylist()]
            lengths = [len(x) for x in arrays]
            if not arrays:
                continue
            of = [pa.array(np.repeat(part.column(c).to_numpy(), lengths)) for c in ("key", "n", "layers")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(arrays)), *of], _ENTRY)


_ENTRY = ["shingle", "key", "n", "layers"]
_ENTRIES = "shingle long, key long, n long, layers int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries sorted by shingle and key: those whose shingle two classes of a layer hold, each class once. Streams; holds one batch."""
    before, last = None, [None, None]  # the entry before this batch; of each layer its last entry, and whether that has been put out
    for batch in batches:
        entry = [batch.column(c).to_numpy() for c in _ENTRY]
        s, k = entry[:2]
        if not len(s):
            continue
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
        if before == (s[0], k[0]):
            keep[0] = False
        before = (s[-1], k[-1])
        entry = [x[keep] for x in entry]
        s, layers = entry[0], entry[3]
        out, first = np.zeros(len(s), bool), {}
        at = [np.flatnonzero(layers >> i & 1) for i in range(2)]
        for mine, held in zip(at, last):
            if not len(mine):
                continue
            same = s[mine[1:]] == s[mine[:-1]]
            out[mine[1:]] |= same
            out[mine[:-1]] |= same
            if held and held[0] == s[mine[0]]:
                out[mine[0]] = True
                if not held[4]:
                    first[held[:2]] = held[:4]
        for i, (mine, held) in enumerate(zip(at, last)):
            if len(mine):
                last[i] = (*(x[mine[-1]] for x in entry), bool(out[mine[-1]]))
            elif held and held[:2] in first:
                last[i] = (*held[:4], True)
        columns = [np.concatenate([np.array(list(x), y.dtype), y[out]]) for x, y in zip(zip(*first.values()) if first else [()] * 4, entry)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], _ENTRY)
    tidy()


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _sides(rows: pd.DataFrame) -> list[pd.DataFrame]:
    """The one or two blocks of a block pair; empty if one of two has no rows."""
    one, two = rows["one"].iloc[0], rows["two"].iloc[0]
    sides = [rows[rows.block == one]] if one == two else [rows[rows.block == one], rows[rows.block == two]]
    return [] if any(s.empty for s in sides) else sides


def _edges(pairs: list[tuple], counted: list[tuple] = ()) -> pd.DataFrame:
    out = [(a, b, 0) for a, b in pairs] + [(k, None, n) for k, n in counted]
    return pd.DataFrame(
        {
            "a": pd.Series([x[0] for x in out], dtype="int64"),
            "b": pd.Series([x[1] for x in out], dtype="Int64"),
            "links": pd.Series([x[2] for x in out], dtype="int64"),
        }
    )


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each left row, its overlap with every right row (``right`` None: with later left rows), accumulated over the columns of the row's shingles."""
    own = left if right is None else right
    columns = np.concatenate(own)
    rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
    order = np.argsort(columns, kind="stable")
    columns, rows = columns[order], rows[order]
    for i, found in enumerate(left):
        a, b = np.searchsorted(columns, found, "left"), np.searchsorted(columns, found, "right")
        size = b - a
        total = int(size.sum())
        if not total:
            continue
        at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
        overlap = np.bincount(rows[at], minlength=len(own))
        if right is None:
            overlap[: i + 1] = 0
        yield i, overlap


def _candidates(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the pairs of one hub's block pair that can still be linked."""
    sides = _sides(rows)
    if not sides:
        return _edges([])
    keys, n, floor, layers = ([s[c].to_numpy() for s in sides] for c in ("key", "n", "floor", "layers"))
    sets = [[np.asarray(x) for x in s.shingles] for s in sides]
    maps = [np.frombuffer(x, "<u8") for x in sides[0].parity]
    widths = np.array([len(x) for x in sides[-1].parity]) // 8
    # the other side's bitmaps by width, and where each stands among them
    wide = {int(w): np.frombuffer(b"".join(sides[-1].parity[widths == w]), "<u8").reshape(-1, w) for w in np.unique(widths)}
    at = np.zeros(len(widths), np.int64)
    for w in wide:
        at[widths == w] = np.arange(len(wide[w]))
    base = 0 if len(sides) == 1 else len(keys[0])
    forest, edges = Forest(base + len(keys[-1])), []
    for i, overlap in overlaps(sets[0], sets[1] if len(sides) == 2 else None):
        m, other = n[0][i], n[-1]
        mine = (m < other) | ((m == other) & (keys[0][i] < keys[-1]))  # whose bound holds: the smaller class's
        fits = (overlap > 0) & ((layers[0][i] & layers[-1]) > 0) & (overlap >= np.where(mine, floor[0][i], floor[-1])) & (
            np.minimum(m, other) * 100 >= np.maximum(m, other) * percent
        )
        left = np.flatnonzero(fits)
        for w in np.unique(widths[left]).tolist():
            found = left[widths[left] == w]
            found = found[differing(maps[i], wide[w][at[found]]) * (100 + percent) <= (m + other[found]) * (100 - percent)]
            edges += [(keys[0][i], keys[-1][j]) for j in found.tolist() if forest.join(i, base + j)]
    tidy()
    return _edges(edges)


def _linked(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Spanning edges (a, b, 0) of the links of one block pair, and link counts (a, null, links), by layer.

    ``copies`` has a class's documents in each layer; a node is key * layers + layer.
    """
    sides = _sides(rows)
    if not sides:
        return _edges([])
    copies = [np.stack(s.copies.to_list()) for s in sides]
    layers = copies[0].shape[1]
    nodes = [s.key.to_numpy()[:, None] * layers + np.arange(layers) for s in sides]
    sets = [[np.frombuffer(x, "<u8") for x in s.shingles] for s in sides]
    sizes = np.array([len(x) for x in sets[-1]])
    base = 0 if len(sides) == 1 else len(nodes[0])
    forests, edges = [Forest(base + len(nodes[-1])) for _ in range(layers)], []
    links = [np.zeros(n.shape, np.int64) for n in nodes]
    for i, overlap in overlaps(sets[0], sets[1] if len(sides) == 2 else None):
        partners = np.flatnonzero((overlap > 0) & (overlap * 100 >= (len(sets[0][i]) + sizes - overlap) * percent))
        for layer in np.flatnonzero(copies[0][i]).tolist():
            found = partners[copies[-1][partners, layer] > 0]
            links[0][i, layer] += copies[-1][found, layer].sum()
            links[-1][found, layer] += copies[0][i, layer]
            edges += [(nodes[0][i, layer], nodes[-1][j, layer]) for j in found.tolist() if forests[layer].join(i, base + j)]
    tidy()
    return _edges(edges, [(k, n) for ks, ns in zip(nodes, links) for k, n in zip(ks.ravel(), ns.ravel()) if n])


def grouped_pairs(rows: DataFrame, group: str, key: str, held, block: int, run, schema: str) -> DataFrame:
    """``run`` over each block pair (block, one, two) of each group of ``rows`` (one a group and key); ``held`` is a row's shingles.

    Groups of one block are dealt by group. The rows of larger ones are joined with their number of blocks, repeated
    for each pair and dealt by pair, so that no task has a group as a whole.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"), F.sum(held).alias("weight")).where("size > 1")
    blocks = F.greatest(
        F.expr(f"(size + {block - 1}) div {block}"),
        F.expr(f"least(size, (weight + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES})"),
    )
    sizes = written(sizes.select(group, blocks.alias("blocks")))
    large = sizes.where("blocks > 1")
    # dealt to so many tasks, whatever their bytes: they are small for the work they bring
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = rows.join(large, group, "left_anti").join(sizes.where("blocks <= 1"), group, "left_semi")
    whole = (
        single.withColumns({c: F.lit(0).cast("long") for c in ("block", "one", "two")})
        .repartition(parts, group)
        .groupBy(group)
        .applyInPandas(run, schema)
    )
    placed = rows.join(large, group).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))
    every = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    every = every.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other", "blocks")
    dealt = every.repartition(parts, group, "one", "two").groupBy(group, "one", "two").applyInPandas(run, schema)
    return whole.unionByName(dealt)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label (least node reachable) by the task's edges (a, b)."""
    held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches if x.num_rows]
    if held:
        nodes, at = np.unique(np.concatenate([x for pair in zip(*held) for x in pair]), return_inverse=True)
        forest, half = Forest(len(nodes)), len(at) // 2
        for one, two in zip(at[:half].tolist(), at[half:].tolist()):
            forest.join(one, two)
        roots = nodes[[forest.root(i) for i in range(len(nodes))]]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "label"])
    tidy()


def components(edges: DataFrame, part: int = PART) -> DataFrame:
    """node, label (least node reachable) of every node of undirected ``edges`` (a, b).

    A task solves about ``part`` edges. Of more edges, each part is solved by itself, nodes take the least label that a
    part gave them, and the edges between labels are dealt again; each such round leaves fewer nodes. Rounds are
    written tables; few are best, as each costs the driver memory for its plans and tasks.
    """
    left = written(edges.select("a", "b").where("a <> b"))  # a second computation may give another forest
    names = None
    while True:
        parts = max(1, -(-left.count() // part))
        stars = step = written(left.repartition(parts).mapInArrow(_stars, "node long, label long"))
        if parts > 1:
            step = _to_roots(written(stars.groupBy("node").agg(F.min("label").alias("label"))))
        on = lambda c: step.select(F.col("node").alias(c), F.col("label").alias(f"{c}_now"))
        if names is None:
            names = step
        else:
            names = written(names.join(on("label"), "label", "left").select("node", F.coalesce("label_now", "label").alias("label")))
        if parts == 1:
            return names
        both = stars.where("node <> label").join(on("node"), "node").join(on("label"), "label")
        left = written(both.select(F.col("node_now").alias("a"), F.col("label_now").alias("b")).where("a <> b").distinct())


def _to_roots(step: DataFrame) -> DataFrame:
    """``step`` (node, label) with the label at the end of each node's chain of labels, by pointer jumping."""
    while True:
        further = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = written(step.join(further, "label").select("node", F.col("further").alias("label"), F.col("label").alias("old")))
        step = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return step


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, extra: float = EXTRA, block: int = BLOCK, also: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row a document (n_links: other documents linked with it).

    With ``also``, a table of other texts (doc_id, text), those of ids in ``docs`` are joined with one another too: the
    result has a row for each, and a column ``layer``, 0 for ``docs`` and 1 for them.
    """
    sketches, texts = written(profiles(small_batches(docs), size, percent, extra)), [docs]
    rows, wide = ["doc_id", "n", "key", "second"], [sketches]
    profile = written(sketches.select(*rows)).withColumn("layer", F.lit(0))  # stays when prefixes and bitmaps go
    if also is not None:
        more, texts = written(profiles(small_batches(also), size, percent, extra)), [docs, also]
        wide.append(more)
        ids = profile.select(F.col("doc_id").alias("kept")).distinct()
        here = written(more.select(*rows).join(ids, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi"))
        profile, sketches = profile.unionByName(here.withColumn("layer", F.lit(1))), sketches.unionByName(more)
    one = ["key", "second", "layer"]
    members = profile.where("n > 0").groupBy(*one).agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    held_in = F.array(*[F.count_if(F.col("layer") == i) for i in range(len(texts))])
    classes = profile.where("n > 0").groupBy("key", "second", "n").agg(held_in.alias("copies"))
    prefixed = sketches.where("prefix is not null").select("key", "second", "n", "prefix", F.lit(1).alias("layers"))
    if also is not None:  # a class of both layers brings its prefix once
        within = profile.where("n > 0").groupBy("key", "second").agg(F.bit_or(F.col("layer") + 1).alias("layers"))
        prefixed = prefixed.drop("layers").dropDuplicates(["key", "second"]).join(within, ["key", "second"])
    entries = prefixed.select("key", "n", "layers", "prefix").mapInArrow(_entries, _ENTRIES)
    shared = written(entries.repartition("shingle").sortWithinPartitions("shingle", "key").mapInArrow(_shared, _ENTRIES))
    n = F.col("n")
    lesser = lambda m: 1 + F.floor(m * F.lit(extra)).cast("long")
    strong = (
        shared.groupBy("key", "n")
        .agg(F.count("*").alias("held"))
        .where(F.col("held") >= lesser(F.expr(f"(n * {percent} + 99) div 100")))
    )
    rows = shared.join(strong.select("key", "held"), "key")
    hub = (
        rows.groupBy("shingle")
        .agg(F.max(F.struct("held", "key")).alias("hub"), F.count("*").alias("classes"))
        .where("classes > 1")
        .select("shingle", F.col("hub.key").alias("hub"))
    )
    grouped = written(rows.join(hub, "shingle").groupBy("hub", "key", "n", "layers").agg(F.collect_list("shingle").alias("shingles")))
    held = grouped.groupBy("key").agg(F.sum(F.size("shingles")).alias("held"))
    held = (
        sketches.where("parity is not null")
        .select("key", "parity")
        .join(held, "key")
        .groupBy("key")
        .agg(F.first("held").alias("held"), F.first("parity").alias("parity"))
    )
    # l * c / d, rounded up
    prefixes = (
        grouped.join(held, "key")
        .withColumn("floor", F.ceil(lesser(n) * F.size("shingles") / F.col("held") - 1e-9).cast("long"))
        .drop("held")
    )
    weight = F.size("shingles") + F.octet_length("parity") / 8
    edges = "a long, b long, links long"
    prefixes = written(prefixes)
    for gone in (*wide, shared, grouped):
        forget(gone)
    candidates = grouped_pairs(prefixes, "hub", "key", weight.cast("long"), block, lambda g: _candidates(g, percent), edges)
    clusters = components(candidates)
    forget(prefixes)
    clustered = clusters.withColumnRenamed("node", "key").join(classes, "key")
    keys = written(clustered.withColumn("id", F.monotonically_increasing_id()))  # classes that share a first hash part here
    # the sets of these classes only, from the texts
    few = keys.count() <= SHIP_ROWS
    small = F.broadcast if few else (lambda x: x)
    place = F.struct("layer", F.col("doc_id").isNull().alias("none"), "doc_id")
    sample = profile.where("n > 0").groupBy("key", "second").agg(F.min(place).alias("at"))
    wanted = written(sample.join(small(keys.select("key", "second")), ["key", "second"]).select("key", "second", "at.layer", "at.doc_id"))
    sets = written(
        keys.join(_sets(texts, wanted, size, few), ["key", "second"]).select("label", F.col("id").alias("key"), "n", "copies", "shingles")
    )
    out = written(grouped_pairs(sets, "label", "key", n, block, lambda g: _linked(g, percent), edges))
    forget(sets)
    label = components(out.where("b is not null"))
    links = out.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    nodes = keys.select("key", "second", "id", F.explode(F.sequence(F.lit(0), F.lit(len(texts) - 1))).alias("layer"))
    linked = (
        nodes.select(*one, (F.col("id") * len(texts) + F.col("layer")).alias("node"))
        .join(label.select("node", F.col("label").alias("component")), "node")
        .join(links, "node")
        .drop("node")
    )
    named = members.join(linked, one, "left")
    smallest = named.where("component is not null").groupBy("component").agg(F.min("least").alias("lowest"))
    final = (
        named.join(smallest, "component", "left")
        .select(
            *one,
            F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("lowest"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        )
    )
    full = (
        profile.where("n > 0")
        .select("doc_id", "n", *one)
        .join(final, one)
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("lowest", "doc_id").alias("component_id"),
            F.col("links").alias("n_links"),
            "layer",
        )
    )
    full = full.unionByName(
        profile.where("n = 0").select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.col("doc_id").alias("component_id"),
            F.lit(0).cast("long").alias("n_links"),
            "layer",
        )
    )
    return full if also is not None else full.drop("layer")


def _sets(layers: list[DataFrame], wanted: DataFrame, size: int, few: bool) -> DataFrame:
    """key, second, shingles (sorted little-endian 64-bit) of the wanted classes, from the texts of their layer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in sliced(batch.column(0).to_pylist()):
                found = shingle_sets(texts, size)
                hashes = [set_key(x) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in hashes], pa.int64()),
                        pa.array([k for _, k in hashes], pa.int64()),
                        pa.array([x.astype("<u8").tobytes() for x in found], pa.binary()),
                    ],
                    ["key", "second", "shingles"],
                )

    def chosen(layer: int) -> DataFrame:
        ids = wanted.where(F.col("layer") == layer).select(F.col("doc_id").alias("wanted")).distinct()
        texts = layers[layer].select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return texts.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")

    got = reduce(DataFrame.union, [chosen(i) for i in range(len(layers))]).mapInArrow(run, "key long, second long, shingles binary")
    only = wanted.select("key", "second").distinct()
    return got.join(F.broadcast(only) if few else only, ["key", "second"], "left_semi").dropDuplicates(["key", "second"])


def clean(docs: DataFrame, also: DataFrame | None = None, **params) -> DataFrame:
    """One document of each component stays, that with the least doc_id; all columns stay.

    With ``also``, a table of other texts of documents (doc_id, text), a document goes too if those texts of the
    documents here put it into a component with a lesser doc_id. Rows that repeat an id stand or fall together.
    """
    (own,) = fresh(docs, "__own")
    joined = join(docs, also=also, **params)
    by = [c for c in ("doc_id", "layer") if c in joined.columns]
    judged = joined.groupBy(*by).agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = judged.where("not stays").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_anti")
