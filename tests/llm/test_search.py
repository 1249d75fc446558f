import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from clickstrata.llm import search

SCHEMA = "text string, doc_id long, score string, rank int, q string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def tables(spark, seed, n=150):
    random.seed(seed)
    topics = [[f"t{t}w{i}" for i in range(15)] for t in range(6)]
    texts = [" ".join(random.choice(random.choice([topics[i % 6], ["the", "of", "É", "x1"]])) for _ in range(random.randint(1, 40))) for i in range(n)]
    docs = [(t, i, "own", None, None) for i, t in enumerate(texts)]
    docs += [(texts[3], 900 + i, None, None, None) for i in range(30)]  # copies: ties, and nothing to split by
    docs += [(texts[5], 5, None, None, None), (texts[5], None, None, None, None), (None, 1000, None, None, None), ("", 1001, None, None, None), ("-- !", 1002, None, None, None)]
    docs += [("The THE the " * 20_000 + "t1w1", 1003, None, None, None)]
    items = [(i, " ".join(random.choice(topics[i % 6] + ["the", "The"]) for _ in range(random.randint(1, 12)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nobody says this"), (None, "t2w3 t2w3 the"), (3, texts[3]), (3, texts[3])]
    return docs, items, spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed, sizes", [(0, {}), (1, {"block": 300, "shard": 4, "leaf": 2, "sample": 60}), (2, {"block": 20, "shard": 3, "leaf": 2, "sample": 20})])
def test_ranks_against_brute_force(spark, monkeypatch, seed, sizes):
    docs, items, table, queries = tables(spark, seed)
    if sizes:
        monkeypatch.setattr(search, "FAN", 8)
        monkeypatch.setattr(search, "ROUTE", 40)
        monkeypatch.setattr(search, "SLICE", 5)
        monkeypatch.setattr(search, "VISITS", (1, 2))
    index = search.build(table, **sizes)
    got = sorted((tuple(r) for r in search.search(index, queries).collect()), key=repr)
    assert got == brute([(d[1], d[0]) for d in docs], items)
    held = index.lists.where("term IS NULL").selectExpr("explode(a) AS id").collect()
    assert len(held) == len([d for d in docs if TERM.search(d[0] or "")])  # every row once


def test_empty_tables(spark):
    none, asked = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(search.build(none), asked).collect() == []
    some = spark.createDataFrame([("a b", 1, None, None, None)], SCHEMA)
    assert [tuple(r)[:3] for r in search.search(search.build(some), asked).collect()] == [(1, 1, 1)]
    assert search.search(search.build(some), asked.limit(0)).collect() == []


def test_bisection_brings_like_documents_together():
    random.seed(3)
    topic = [i % 4 for i in range(256)]
    sets = [sorted({random.randrange(20) + 100 * t for _ in range(12)} | {900 + random.randrange(5)}) for t in topic]
    indptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    order = search.bisected(indptr, np.array([t for s in sets for t in s]), 1000, 64)
    assert sorted(order.tolist()) == list(range(256))
    assert all(len({topic[d] for d in order[k : k + 64]}) == 1 for k in range(0, 256, 64))


def test_a_search_stops_before_shards_that_cannot_matter(spark, monkeypatch):
    """Queries on one topic do not visit the shards of the others, though their terms occur there."""
    visited, topics = [], 8
    rows = [(f"shared t{i % topics}a t{i % topics}b t{i % topics}c " + f"t{i % topics}d " * (i % 5), i, None, None, None) for i in range(320)]
    index = search.build(spark.createDataFrame(rows, SCHEMA), shard=40, leaf=20)
    monkeypatch.setattr(search, "VISITS", (1, 1))
    monkeypatch.setattr(search, "written", lambda df, f=search.written: visited.append(f(df)) or visited[-1])
    asked = [(t, f"shared t{t}a t{t}d") for t in range(topics)]
    got = sorted((tuple(r) for r in search.search(index, spark.createDataFrame(asked, "item_id long, text string")).collect()), key=repr)
    assert got == brute([(r[1], r[0]) for r in rows], asked)
    visits = sum(df.count() for df in visited if "floor" in df.columns and "slice" in df.columns)
    assert visits < topics * topics / 2
