"""Words that a polynomial hash takes for one."""

import random

import pytest

from clickstrata.llm import jaccard, quality
from clickstrata.llm.hashing import Words


def thue_morse(n, letters="ab"):
    """Two different words of ``n`` letters."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_that_polynomials_take_for_one(spark, n):
    one, two = thue_morse(n)
    rows = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join(rows).collect()} == {1: (1, 1), 2: (2, 0), 3: (1, 1)}
    assert quality.measure([f"{one} x y {two} x y", f"{one} x y {one} x y"]).n_repeat_words.tolist() == [0, 6]
    docs = spark.createDataFrame([(i, f"{w} " + " ".join(f"w{k}" for k in range(3)), "en", "s", 1) for i, w in ((1, one), (2, two))], "doc_id long, text string, lang string, source string, n_chars long")
    assert jaccard.clean(docs, docs).count() == 2  # the pipeline's stage keeps both


def test_equal_hashes_are_equal_words():
    random.seed(4)
    words = list({"".join(random.choice("abé") for _ in range(random.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(4000)})
    text = [" ".join(words[:2000]), "\t".join(words[2000:]), "", " ".join(words[:50])]
    hashes = Words(text).hashes
    assert len(set(hashes.tolist())) == len(words) and (hashes[-50:] == hashes[:50]).all()
    assert len(Words([""]).hashes) == 0
