import numpy as np

from clickstrata.llm import jaccard


def words(seed, n=60):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 100_000, n)]


def near(text, k):
    return " ".join([*text[:-1], f"other{k}"])


def test_two_layers_are_judged_in_one_pass_and_apart(spark, monkeypatch):
    a, b = words(1), words(2)
    # as they are: 1 and 3 are near; as they were: 2 and 3 are, so 2 stays, which one graph of both would lose
    now = [(1, near(a, 1)), (2, " ".join(words(3))), (3, near(a, 3)), (4, ""), (None, "x y"), (None, "x y"), (5, " ".join(words(5))), (6, " ".join(words(6)))]
    was = [(1, near(a, 1)), (2, near(b, 2)), (3, near(b, 3)), (4, ""), (None, "x y"), (5, near(words(7), 5)), (6, near(words(7), 6)), (0, near(a, 0)), (9, near(b, 9))]
    docs, also = (spark.createDataFrame(x, "doc_id long, text string") for x in (now, was))
    tables = []
    monkeypatch.setattr(jaccard, "written", lambda df, f=jaccard.written: tables.append(1) or f(df))
    found = jaccard.join(docs, block=2, also=also).collect()
    of = {(r.layer, r.doc_id): (r.component_id, r.n_links) for r in found}
    assert of[0, 1] == of[0, 3] == (1, 1) and of[0, 2] == (2, 0) and of[1, 1] == (1, 0)
    assert of[1, 2] == of[1, 3] == (2, 1) and of[1, 5] == of[1, 6] == (5, 1) and of[0, None] == (None, 1)
    assert not {(1, 0), (1, 9)} & set(of) and len(found) == 15
    both = len(tables)
    tables.clear()
    jaccard.join(docs, block=2).collect()
    assert both <= len(tables) + 2  # two tables more, those of the second layer's profiles
    tables.clear()
    assert sorted(r.doc_id or 0 for r in jaccard.clean(docs, also).collect()) == [0, 0, 1, 2, 4, 5]
    assert len(tables) == both


def test_entries_are_shared_within_a_layer_whatever_the_batches():
    import pyarrow as pa

    random = np.random.default_rng(4)
    for size in (1, 2, 3, 50):
        of = {(int(s), int(k)): (int(k) % 3 + 1) for s, k in random.integers(0, 12, (60, 2))}  # a class's layers: bits
        rows = [(s, k, 9, m) for (s, k), m in sorted(of.items()) for _ in range(1 + (s + k) % 2)]
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + size])], jaccard._ENTRY) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in jaccard._shared(iter(batches)) for r in b.to_pylist()]
        want = [(s, k, 9, m) for (s, k), m in of.items() if any(s == t and k != l and m & o for (t, l), o in of.items())]
        assert sorted(got) == sorted(want)
