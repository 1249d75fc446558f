import numpy as np

from clickstrata.llm import katz


def test_sorted_pairs_come_back():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (1, 5), (500, 1), (500, 3), (500, 1 << 31)):
        v, u, w = rng.integers(0, top, (3, n))
        by = np.lexsort((u, v))
        got = katz.unpack_sorted(katz.pack_sorted(v[by], u[by], w))
        assert [x.tolist() for x in got] == [v[by].tolist(), u[by].tolist(), w.tolist()]


def test_ngrams_of_a_batch_are_sent_sorted():
    """A frequent word's n-grams cost less than its neighbours' numbers as they come."""
    rng = np.random.default_rng(2)
    n = 4000
    unigrams = katz.Unigrams({n: 1, 1: n})
    routes = katz.Routes(unigrams, 1, [], 1 << 20, 3)
    code = np.zeros(2 * n, np.int64)
    code[1::2] = 1 + rng.permutation(n)  # the frequent word stands between any two others
    ids = np.append(2, 3 + rng.permutation(n))
    row = {"ids": [{"wpart": 0, "ids": katz.pack(ids)}], "code": katz.pack(code, np.array([2 * n])), "held": [False]}
    for places in (False, True):
        (data,) = (x for part, x in katz._batch_grams(row, routes, unigrams, places, 1.0) if part is not None)
        v, u, *more = katz.unpack_sorted(data)
        assert (np.diff((v << 32) + u) >= 0).all() and set(zip(v.tolist(), u.tolist())) >= {(2, int(x)) for x in ids[code[1:-1:2]]}
        assert len(data) < 0.9 * len(katz.pack(v, rng.permutation(u), *more))
