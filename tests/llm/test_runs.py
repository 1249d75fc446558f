import hashlib
import random
import zlib

import pytest

from clickstrata.llm import runs

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30000))
SCHEMA = "text string, doc_id long, n_runs string, period int"


def brute_runs(words, least=12):
    """Every period by comparing the words with themselves moved by it."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, size, q) for (s, size), q in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc_id,
        len(found),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_brute_force(seed):
    random.seed(seed)
    for _ in range(60):
        texts = []
        for _ in range(random.randint(1, 5)):
            words = [b"%d" % random.randrange(random.choice([1, 2, 3, 5])) for _ in range(random.randint(0, 50))]
            part = words[: random.randint(1, 8)]
            texts.append(words + part * random.randint(0, 6) + words[:3])
        least = random.choice([2, 4, 12])
        assert runs.maximal_runs(texts, least) == [brute_runs(t, least) for t in texts]


def test_texts_that_are_one_run_or_have_many():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    assert runs.maximal_runs([b]) == [brute_runs(b)]
    assert runs.maximal_runs([[b"x"] * 50_000, [b"x", b"y"] * 20_000]) == [[(0, 50_000, 1)], [(0, 40_000, 2)]]


def test_all_odd_rows_against_brute_force(spark):
    same = "a b c d e f g h i j k l"
    texts = [None, "", " \t\n", "one", same, same, f"{same} {same} x", f"{same} {same} {same}", LONG, "a " * 40, "é  è\x0bé è é è é è é è é è é è", "A a " * 11]
    rows = [(t, i, "own", 1) for i, t in enumerate(texts)] + [(same * 3, None, None, None), ("z " * 30, 4, "twice", None)]
    rows += [(" ".join(f"u{k % 7}v{k}" for k in range(i)), i, None, None) for i in range(100, 180)]  # some have a planted period
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r)[:8] for r in runs.detect(table).collect()]
    key = lambda r: repr(r)
    assert sorted((r for r in got if r[0] != 8), key=key) == sorted((brute_row(i, t) for t, i, _, _ in rows if t != LONG), key=key)
    (long,) = [r for r in got if r[0] == 8]
    assert long[1:5] == (1, 0, 30000, 997 * 13)
    assert runs.detect(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_that_repeat_go_and_the_first_period_stays():
    words = b"p a b a b a b a b a b a b q".split()
    (found,) = runs.maximal_runs([words])
    assert found == [(1, 12, 2)] and runs.kept_words(words, found) == b"p a b q".split()
