import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickstrata.llm import bpe, chat, decontaminate, jaccard, katz, licenses, lines, quality, secrets, sharding
from clickstrata.llm.hashing import shingle_sets

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(20000))
TEXTS = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h", "A b c d e f g H", LONG, LONG + " tail", "token = 'abcdef123456'\nx: 1"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __own string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 2 else "en", "s", len(t or ""), "extra") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s", 15, "extra"), (None, "no id here at all", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def public():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_every_operator_takes_odd_rows_and_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, None)], "item_id long, text string")
    for table, n in ((docs, 12), (empty, 0)):
        assert secrets.find(table).count() == n
        assert katz.score(table, F.col("doc_id") == 3).count() == n
        assert jaccard.join(table).count() == n
        assert quality.judge(table).count() == n
        assert lines.dedup(table, counts=("a", "b")).count() == n
        assert bpe.digests(table, *public()).count() == n
        assert sharding.shard(table).count() == n
        assert licenses.scan(table).count() == n
        assert decontaminate.decontaminate(table, bench).count() == n
        for stage in (quality.clean(table), lines.dedup(table), jaccard.clean(table), decontaminate.clean(table, bench)):
            assert stage.columns == table.columns and stage.count() <= n


def test_secrets_follow_constants():
    text = 'base = "Zx9k2LmQ8rT1vB7n"\nuser = "bob"\napi_secret = base\nclientKey: "q8W2e7R1t6Y3u5I9"'
    base, more = secrets.scan(text)
    assert text.index("Zx9k") in [a for a, _, _ in more] and text.index("q8W2") in [a for a, _, _ in more]
    assert all(text[a:b] != "bob" for a, b, _ in more)


def brute_components(texts, percent=80):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in ([x for x in (t or "").encode().lower().split()] for t in texts)]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 400, rng.integers(20, 120))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(8):
            copy = list(b)
            for at in rng.integers(0, len(copy), rng.integers(0, 4)):
                copy[at] = f"n{rng.integers(0, 9999)}"
            texts.append(" ".join(copy))
    found = jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=7).toPandas().set_index("doc_id").component_id
    assert [found[i] for i in range(len(texts))] == brute_components(texts)


@pytest.mark.parametrize("part", [7, 40, 1000])
def test_components_of_any_number_of_parts(spark, part):
    random = np.random.default_rng(part)
    ids = random.permutation(400).tolist()
    edges = [*zip(ids[:150], ids[1:150]), *[(ids[200], i) for i in ids[201:260]], *[(ids[300 + i], ids[300 + j]) for i, j in random.integers(0, 90, (60, 2)).tolist()]]
    up = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = jaccard.components(spark.createDataFrame([(a, b) for a, b in edges], "a long, b long"), part).collect()
    assert sorted(map(tuple, got)) == sorted((i, up[i]) for i in {i for e in edges for i in e if e[0] != e[1]})
    assert jaccard.components(spark.createDataFrame([(1, 1)], "a long, b long"), part).count() == 0


def test_components_of_a_long_chain_take_few_tables(spark, monkeypatch):
    tables, ids = [], np.random.default_rng(1).permutation(500).tolist()
    monkeypatch.setattr(jaccard, "written", lambda df, f=jaccard.written: tables.append(1) or f(df))
    assert {r.label for r in jaccard.components(spark.createDataFrame([*zip(ids, ids[1:])], "a long, b long")).collect()} == {0}
    assert len(tables) <= 3


def test_jaccard_of_odd_rows_and_blocks_by_weight(spark, monkeypatch):
    """Nulls, repeats, short and long texts, clashing names; blocks of few shingles."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 60)
    rng = np.random.default_rng(9)
    base = " ".join(f"w{x}" for x in rng.integers(0, 90, 40))
    texts = [*TEXTS, *(f"{base} e{k % 5}" for k in range(12)), *(f"s{k} {base}" for k in range(6)), "a  B c d E f g h", LONG.upper()]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string, key string, n long")).collect()}
    assert [got[i].component_id for i in range(len(texts))] == brute_components(texts)
    assert got[0].n_shingles == 0 and got[3].n_shingles == 1 and got[4].n_links == 3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_edit_distance_and_segments_lose_nothing(spark, most):
    rng = np.random.default_rng(most)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice(list("abcé"), rng.integers(8, 30)))
        b = list(a)
        for _ in range(rng.integers(0, most + 3)):
            at, kind = rng.integers(0, len(b)), rng.integers(0, 3)
            b[at : at + (kind > 0)] = [] if kind == 2 else [str(rng.choice(list("abcé")))]
            b = b or ["a"]
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"m": F.length("a"), "n": F.length("b")})
    one, two = lines.keys("a", "m", most), lines.keys("b", "n", most)
    meet = F.arrays_overlap(one[0], two[1]) | F.arrays_overlap(two[0], one[1])
    if most == 1:
        x, y = lines.around_keys("a", "m"), lines.around_keys("b", "n")
        index, probe = (lambda k: F.slice(k, 1, lines.CUTS)), (lambda k: F.slice(k, lines.CUTS + 1, lines.CUTS))
        meet = meet & (F.arrays_overlap(index(x), index(y)) | F.arrays_overlap(index(x), probe(y)) | F.arrays_overlap(probe(x), index(y)))
    rows = df.select("a", "b", lines.within("a", "b", most).alias("near"), meet.alias("meet")).collect()
    for r in rows:
        near = edits(r.a, r.b) <= most
        assert r.near == near, (r.a, r.b)
        assert not near or r.meet


def test_line_dedup_keeps_first_places(spark):
    text = "This is the very first line of the corpus here"
    docs = spark.createDataFrame([(1, f"{text}\nshort"), (2, f"{text.upper()}\nanother line that stays where it is"), (3, f"{text}!"), (4, text)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup(docs).collect()} == {1: f"{text}\nshort", 2: "another line that stays where it is"}


def brute_lines(texts, edits=1, least=32):
    """What stays of each text: later copies and lines near an earlier first one go."""
    norm = lambda x: x.strip(" ").lower()
    firsts, places = {}, []
    for i, text in enumerate(texts):
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                places.append((i, k, norm(line)))
                firsts.setdefault(norm(line), (i, k))
    order = sorted(firsts, key=firsts.get)
    near = {b for j, b in enumerate(order) for a in order[:j] if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and edits_of(a, b) <= edits}
    gone = {(i, k) for i, k, line in places if line in near or firsts[line] != (i, k)}
    out = {}
    for i, text in enumerate(texts):
        left = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        if not any(i == a for a, _ in gone) or left.strip():
            out[i] = left
    return out


def edits_of(a, b):
    return edits(a, b) if sum(x != y for x, y in zip(a, b)) else abs(len(a) - len(b))


@pytest.mark.parametrize("group", [32, 2])
def test_line_dedup_against_brute_force(spark, monkeypatch, group):
    """Small groups are cut further down to single letters."""
    monkeypatch.setattr(lines, "GROUP", group)
    rng = np.random.default_rng(12)
    stem = "a line of some length that many of the others share in part"
    pool = [stem, "short", "x", "", " \t", "another line that is quite unlike the first of them"]
    for _ in range(60):  # one or two edits, many at one place
        line = list(stem)
        for _ in range(rng.integers(1, 3)):
            at = int(rng.choice([7, 7, 7, 8, 30, len(stem) - 1, 0]))
            kind = rng.integers(0, 3)
            line[at : at + (kind > 0)] = [] if kind == 2 else [str(rng.choice(list("abcdefgh0123")))]
        pool.append("".join(line))
    texts = ["\n".join(rng.choice(pool, rng.integers(1, 6))) for _ in range(40)] + [None, "", "  " + stem.upper() + " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup(docs).collect()} == brute_lines(texts)


def test_common_and_rare_lines_meet_one_rule(spark, monkeypatch):
    texts = [f"one line that every document of this table holds\nline {i % 40} of its own {'abcdefgh'[i % 8] * 12}\n{i}" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    for share in (0.0, 0.02, 1.0):  # all lines, the shared line and no line are common
        monkeypatch.setattr(lines, "COMMON", share)
        got.append({r.doc_id: r.text for r in lines.dedup(docs).collect()})
    assert got[0] == got[1] == got[2] and sum("every document" in t for t in got[0].values()) == 1


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {k + i for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for i in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_repeat_words": len(repeated)}


def brute_limits(groups):
    """Limits by (lang, source) from the ratios of documents that pass the base rule, by sorted lists."""
    def learnt(values):
        bucket = lambda x: -math.inf if x <= 0 else math.ceil(math.log(x) / math.log(quality.GAMMA))
        got = sorted(map(bucket, values))[max(math.floor(len(values) * quality.QUANTILE), 1) - 1]
        return 0.0 if got == -math.inf else quality.GAMMA**got * 2 / (1 + quality.GAMMA)

    out = {}
    for lang, source in {(g[0], g[1]) for g in groups}:
        for metric, floor in quality.FLOORS.items():
            own = [r[metric] for a, b, r in groups if (a, b) == (lang, source)]
            of_lang = [r[metric] for a, _, r in groups if a == lang]
            wider = learnt(of_lang) if len(of_lang) >= quality.MIN_ROWS else learnt([r[metric] for _, _, r in groups])
            value = min(learnt(own), max(wider, floor) * quality.SPREAD) if len(own) >= quality.MIN_ROWS else wider
            out[lang, source, metric] = max(value * quality.FACTORS[metric], floor)
    return out


def test_quality_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "MIN_ROWS", 40)
    rng = np.random.default_rng(6)
    pool = [f"w{i}é" for i in range(300)] + ["##", "$|", "a*b"]
    rows = []
    for i in range(330):
        n, weight = int(rng.integers(30, 120)), np.r_[np.ones(300), np.full(3, rng.choice([0, 0, 40]))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in rng.choice(pool, n, p=weight / weight.sum()))
        text += text[: rng.integers(0, len(text))] * int(rng.integers(0, 2))
        rows.append((i, text, ["en", "de", None][i % 3 if i % 7 else 0], ["a", "b", "c", None][int(rng.choice(4, p=[0.6, 0.3, 0.05, 0.05]))]))
    rows += [(900, None, "en", "a"), (901, "", "xx", None), (5, rows[5][1], rows[5][2], rows[5][3])]
    got = quality.judge(spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, source string, n_words string"), min_rows=40).collect()
    wanted, groups = {}, []
    for i, text, lang, source in rows:
        m = brute_quality(text)
        over = lambda a, b: a / b if b else 0.0
        r = {"symbol_ratio": over(m["n_symbols"], m["word_chars"]), "dup_line_ratio": over(m["n_dup_lines"], m["n_lines"]), "repeat_ratio": over(m["n_repeat_words"], m["n_words"]), "word_length": over(m["word_chars"], m["n_words"])}
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        wanted[i] = (m, failed, lang, source, r)
        groups += [] if failed else [(lang, source, r)]
    bounds = brute_limits(groups)
    verdicts = set()
    for row in got:
        m, failed, lang, source, r = wanted[row.doc_id]
        kept = not failed and all(r[metric] <= bounds[lang, source, metric] for metric in r)
        assert row.quality.asDict() == m | {"base_failed": failed, "kept": kept}, row.doc_id
        verdicts.add((failed, kept))
    assert len(got) == len(rows) and len(verdicts) == 3


def test_quality_counts():
    got = quality.measure(["a b c a b c x", "", "l 1\nl 1\n\n\n#$é"]).to_dict("records")
    assert [g["n_words"] for g in got] == [7, 0, 5] and [g["n_repeat_words"] for g in got] == [6, 0, 0]
    assert got[2]["n_dup_lines"] == 1 and got[2]["n_symbols"] == 2 and got[2]["word_chars"] == 7


def library():
    import base64

    import tiktoken

    path, pattern = public()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf,window", [(1, 1), (3, 2), (16, 2), (256, 16)])
def test_bpe_tree_equals_the_library(leaf, window):
    tree, whole = bpe.Tree(*public(), leaf=leaf, window=window), library()
    rng = np.random.default_rng(leaf)
    pool = list("ab'lvre sdmt1234é  \n\n\t12!?　𝄞\r\x0b\x1c\x85\u200b字ſ") + ["'ll", "'ve", "    ", "the ", "<|endoftext|>"]
    for n in [*rng.integers(0, 200, 150), 3000]:
        text = "".join(rng.choice(pool, n))
        ids = tree.encode(text)
        assert ids == whole.encode_ordinary(text) and tree.decode(ids, 8) == text.encode(), text


def test_bpe_of_long_runs():
    tree, whole = bpe.Tree(*public()), library()
    for data in (b"abcabc the there", "naïve é".encode(), b"x" * 40):
        assert tree.merges.merged(data) == tree.merges.merged_long(data)
    for text in (" " * 5000, "a" * 3001, "ab" * 2000 + " " * 700 + "x", "\n" * 999 + "7" * 1001, "!" * 777 + "é" * 800):
        assert tree.encode(text) == whole.encode_ordinary(text)


def test_bpe_query_against_the_library(spark):
    texts = [*TEXTS, "naïve  text's\n\nend 12345"]
    got = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *public()).collect()}
    for i, text in enumerate(texts):
        ids = library().encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_permutation_is_one():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(sharding.permute(np.arange(n), n)) == list(range(n))
    assert sharding.place(7, 100) == (int(sharding.permute(np.array([7]), 100)[0]) % 40, int(sharding.permute(np.array([7]), 100)[0]) // 40)


def test_shards_against_the_permutation(spark, monkeypatch):
    """Gapless slots, counts at most one apart, equal rows by ranges."""
    import zlib

    monkeypatch.setattr(sharding, "RANGE", 3)
    texts = ["same"] * 25 + [None, None, "", "ü𝄞"] + [f"text {i}" for i in range(60)]
    rows = [(7 if t == "same" else i, t, "own") for i, t in enumerate(texts)] + [(None, "no id", "own")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, number string")).collect()
    expected = collections.Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    places = sorted((r.shard, r.slot) for r in got)
    assert places == sorted(sharding.place(k, len(rows)) for k in range(len(rows)))
    sizes = collections.Counter(s for s, _ in places)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and places == [(s, k) for s in sorted(sizes) for k in range(sizes[s])]


def test_base_licenses_against_brute_force(spark):
    rng = np.random.default_rng(2)
    bits = ["under the mit license", "Under THE\nMIT  license", "apache license, version 2", "apache license version 20", "cc-by-nc", "CC BY", "nc", "word", "é1", "_", "license", ""]
    texts = [" ".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(300)] + [None, ""]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, words string")).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        at = {label: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p, label in licenses.BASE.items()}
        every = sorted(x for xs in at.values() for x in xs)
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(words), len(every), every[0] if every else None, every[-1] if every else None), text
        assert got[i].base_labels == ",".join(sorted(k for k, x in at.items() if x)) and 0 <= got[i].score <= 1
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))


def test_license_labels(spark):
    texts = {1: "x Released under the MIT License.", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "Licensed under CC BY-NC 4.0.", 4: "the license", 5: None}
    rows = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in rows} == {1: "mit", 2: "gpl-3", 3: "cc-by-nc", 4: "", 5: ""}
    assert {r.doc_id: r.first_word for r in rows}[1] == 2


def test_chat_events_fold_and_read_back(spark):
    events = [(1, 0, 7, "delta", None, "Hi <s>"), (1, 1, 8, "delta", "assistant", "old"), (1, 2, 8, "regenerate", None, None), (1, 3, 8, "delta", None, "new [x] \\"), (1, 4, None, "delta", "user", "aside")]
    events += [(1, 5, 7, "edit", "user", "Hello"), (1, 6, 9, "delta", "assistant", "last"), (1, 7, 8, "delta", None, "!"), (2, 0, None, None, None, None)]
    df = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string").repartition(3)
    rows = chat.format_log(df).orderBy("conv_id", "turn").collect()
    assert [chat.parse(r.formatted)[0] for r in rows] == [("user", "Hello"), ("assistant", "new [x] \\!"), ("user", "aside"), ("assistant", "last"), ("", "")]
    digest = {r.conv_id: r for r in chat.digests(chat.format_log(df)).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256(b"new [x] \\!last").hexdigest() and digest[2].n_turns == 1
    assert chat.digests(chat.format_log(df.limit(0))).count() == 0


def test_chat_of_a_table_against_brute_force(spark):
    """Ties, repeated rows, nulls, long texts; every way a turn is logged gives the same."""
    rows = [(1, t, role, f"text {t} [{role}] </s>") for t in range(7) for role in ("user", "assistant")]
    rows += [(1, 3, "user", "text 3 [user] </s>"), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", LONG), (3, 2, "assistant", "\\b<>[]"), (None, 0, "user", "lost"), (None, 1, "assistant", "found")]
    table = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    got = {r.conv_id: r for r in chat.digests(chat.format_log(chat.table_events(table))).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(chat.render(r, t)[0]) for _, r, t in turns)


def brute_hits(text, items, size=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, named = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in body or ""))
        for k in range(max(1, len(own) - size + 1) if own else 0):
            window = own[k : k + size]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    named.add("" if item is None else str(item))
    return len(words), len(hit), ",".join(sorted(named))


@pytest.mark.parametrize("max_bytes", [4 << 20, 1 << 10, 1])
def test_decontamination_against_brute_force(spark, max_bytes):
    """By one automaton, and by several; items without an id; a window that stands in every text and in many items."""
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(rng.choice(["ab", "Cd", "é", "x9", "ß"], n))
    items = [(1, word(14)), (2, word(3)), (2, word(12)), (3, None), (4, " .,! "), (5, word(10)), (5, "Ab"), (None, "no id"), (None, "ab x9"), (6, "common"), (7, "Common!")]
    texts = [f"{word(5)} {items[k][1] or ''} - common {word(20)}" for k in range(8)] * 2 + [None, "", "a,b", items[0][1].upper() + "!" + items[1][1].replace(" ", "\n.")]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.h for r in decontaminate.decontaminate(docs, bench, to="h", max_bytes=max_bytes).collect()}
    for i, text in enumerate(texts):
        n, hit, named = brute_hits(text, items)
        assert (got[i].n_words, got[i].n_hit, got[i].items_sha256) == (n, hit, hashlib.sha256(named.encode()).hexdigest()), text
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("hits.n_hit > 0").count() == 0


def test_clashing_names_stay(spark):
    """A column that has the result's name stays as it is; the result's gets an underscore behind it."""
    names = ["secrets", "Quality", "hits", "ids", "n_lines", "n_removed"]
    docs = spark.createDataFrame([(1, "some text here", "en", "s", *names)], f"doc_id long, text string, lang string, source string, {', '.join(f'{n} string' for n in names)}")
    bench = spark.createDataFrame([(1, "text here")], "item_id long, text string")
    results = [secrets.find(docs), quality.judge(docs), decontaminate.decontaminate(docs, bench), decontaminate.decontaminate(docs, bench, max_bytes=1), bpe.encode(docs, *public()), lines.dedup(docs, counts=("n_lines", "n_removed"))]
    for out, new in zip(results, (["secrets_"], ["quality_"], ["hits_"], ["hits_"], ["ids_"], ["n_lines_", "n_removed_"])):
        row = out.first()
        assert [row[n] for n in names] == names and out.columns == [*docs.columns, *new]


def test_windows_and_spans():
    items = [(1, "a b c d e f g h i j k"), (2, "Xy z")]
    auto = decontaminate.automaton(decontaminate.pattern_table((w.decode(), i) for i, t in items for w in decontaminate.item_windows(t)))
    text = "q. A, b c d e f g h i j! k xY  Z q"
    words, hits, items = decontaminate.scan(text, auto)
    assert items == {1, 2} and sum(b - a for a, b in hits) == 13
    assert [text[a:b] for a, b in decontaminate.original_spans(text, hits)] == ["A, b c d e f g h i j! k xY  Z"]


def test_shingles():
    assert [len(s) for s in shingle_sets(["", "a", "a b c d e", "a b c d e f", "A B C D E"], 5)] == [0, 1, 1, 2, 1]


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    clean = ["\n".join(" ".join(word() for _ in range(12)) for _ in range(8)) for _ in range(6)]
    leak = " ".join(word() for _ in range(15))
    texts = [*clean, clean[0], clean[1] + f"\n{leak}", "too short", clean[2].replace(" ", "$$ ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [0, 1, 2, 3, 4, 5] and all(r.round_trip for r in out)
    assert re.fullmatch("[a-z -]+", "-".join(n.lower() for n, _ in corpus_pipeline.STAGES).replace("n-gram", "n gram").replace("byte-level", "byte level")) and collections.Counter(len(s) for s in corpus_pipeline.STAGES) == {2: 5}


def test_pipeline_against_brute_force(spark, tmp_path):
    """The five stages on a small table with nulls, repeats, near copies that share lines, leaks and odd columns."""
    import corpus_pipeline

    rng = np.random.default_rng(17)
    line = lambda n=12: " ".join("".join(rng.choice(list("abcdefghijklmno"), 5)) for _ in range(n))
    clean = ["\n".join(line() for _ in range(8)) for _ in range(8)]
    near = ["\n".join(x if k else x + " end" for k, x in enumerate(clean[i].split("\n"))) for i in (1, 2)]
    one = [clean[3].replace("\n", " "), clean[3].replace("\n", " ") + " more words"]
    leak = line(14)
    texts = [*clean, *near, *one, clean[4] + "\n" + leak, clean[0], "too short", clean[5].replace(" ", " $$$ "), (line(3) + "\n") * 30, None, "", "\n".join([line(), "x", line(), "x", *[line() for _ in range(6)]])]
    rows = [(i, t, ["en", None][i % 2], "s", len(t or ""), "own") for i, t in enumerate(texts)]
    rows += [(40, None, "en", "s", None, "own"), (41, line(60), None, None, 7, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    ratios, failed = {}, {}
    over = lambda a, b: a / b if b else 0.0
    for i, text, *_ in rows:
        m = brute_quality(text)
        ratios[i] = {"symbol_ratio": over(m["n_symbols"], m["word_chars"]), "dup_line_ratio": over(m["n_dup_lines"], m["n_lines"]), "repeat_ratio": over(m["n_repeat_words"], m["n_words"]), "word_length": over(m["word_chars"], m["n_words"])}
        failed[i] = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    bounds = brute_limits([(r[2], r[3], ratios[r[0]]) for r in rows if not failed[r[0]]])
    left = [(r[0], r[1]) for r in rows if not failed[r[0]] and all(ratios[r[0]][m] <= bounds[r[2], r[3], m] for m in ratios[r[0]])]
    by_line = brute_lines([t for _, t in left])
    left = [(left[k][0], text) for k, text in sorted(by_line.items())]
    original = dict((r[0], r[1]) for r in rows)
    as_now, as_was = brute_components([t for _, t in left]), brute_components([original[i] for i, _ in left])
    left = [x for k, x in enumerate(left) if as_now[k] == k == as_was[k]]
    left = [(i, t) for i, t in left if not brute_hits(t, [(1, leak)])[1]]
    assert {i for i, _ in left} == set(got) and 8 not in got and 9 not in got and 11 not in got
    for i, text in left:
        assert list(got[i].ids) == library().encode_ordinary(text) and got[i].n_tokens == len(got[i].ids) and got[i].round_trip


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_parity_bound_never_exceeds_the_difference():
    from clickstrata.llm import jaccard

    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 2**63, int(rng.integers(2, 900)), dtype=np.uint64))
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, len(pool) + 1)))) for _ in "ab")
        apart = len(np.setxor1d(a, b))
        assert jaccard.differing(jaccard.parity(a), jaccard.parity(b)[None, :])[0] <= apart
    assert jaccard.differing(jaccard.parity(a), jaccard.parity(a)[None, :])[0] == 0


def brute_secrets(text):
    """The three plain patterns, each by its own words."""
    word, sep = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "+/_.=-"
    out, at = [], 0
    names = ["password", "passwd", "secret", "token", "apikey", "api_key"]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    while at < len(text):
        for name in names:
            if lower.startswith(name, at):
                k = at + len(name)
                k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in (":", "=") and text[k : k + 1]:
                    k += 1
                    while text[k : k + 1] == " ":
                        k += 1
                    k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
                    end = k
                    while text[end : end + 1] and text[end] in word + sep:
                        end += 1
                    if end > k:
                        if end - k >= 6:
                            out.append((at, end, "assign"))
                        at = end - 1
                        break
        at += 1
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        out += [(*m.span(), "access")] * (len(m[0]) >= 20)
    for m in re.finditer("[0-9a-f]+", text):
        out += [(*m.span(), "hex")] * (len(m[0]) >= 24)
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def test_plain_secrets_against_brute_force(spark):
    rng = np.random.default_rng(8)
    bits = ["password", "PassWd", "secret", "Token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "abc", "x1/Y+", "AKIA", "ABCDEFGH12345678", "0123456789abcdef0123", "ſ", "K", "é", "\n", "𝄞"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(600)] + [None, ""]
    got = {r.doc_id: r.s for r in secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "s").collect()}
    for i, text in enumerate(texts):
        base = brute_secrets(text or "")
        n = collections.Counter(k for _, _, k in base)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == (n["assign"], n["access"], n["hex"], digest), text
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(got[i].spans.split(",")) | {""}


KEY = "Zx9k2LmQ8rT1vB7n"


@pytest.mark.parametrize("text", [
    f'cfg["password"] = "{KEY}"', f'password: str = "{KEY}"', f'"password": ["{KEY}", "x"]', f'user.setPassword("{KEY}")', f"<password>{KEY}</password>",
    f'password = """{KEY}"""', f"apiKey: Optional[str] = '{KEY}'", f'secret = rb"{KEY}"', f'token =\\\n   "{KEY}"', f'password:\n  "{KEY}"', f'props.put("db.password", "{KEY}")',
    f'x = "{KEY}"\ny = x\npassword = y', f"secret_key := `{KEY}`", f'p = "{KEY}"\np += "more"\napi_token = p', f'connect(user="u", password="{KEY}")',
])
def test_assignments_of_all_kinds(text):
    assert (text.index(KEY), text.index(KEY) + len(KEY), "named") in secrets.named_spans(text)


@pytest.mark.parametrize("text", [
    "password = get_password(user)", "token = tokenizer.encode(text)", 'secret_key = os.environ["SECRET_KEY"]', "key: configuration_value", 'password = ""',
    f'x = "{KEY}"\nx = f()\npassword = x', f'get_password("{KEY}")', 'password = "a sentence of words"', "don't say: 'it's a token'", f'setColor("{KEY}")',
])
def test_names_and_calls_are_no_literals(text):
    assert secrets.named_spans(text) == []


def test_long_chains_of_constants_lose_no_part():
    text = f'password = "{KEY}"\n' + "".join(f'password = password + "part{i}"\n' for i in range(3000))
    assert len(secrets.named_spans(text)) == 3001
    assert len(secrets.named_spans(f'a = "{KEY}"\n' + "a = a + a\n" * 300 + "password = a")) == 1


class BruteKatz:
    def __init__(self, texts, order):
        self.c = [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            for gram in self.grams(t, order):
                for k in range(order + 1):
                    self.c[k][gram[order - k :]] += 1
        self.d = [katz.discounts(collections.Counter(c.values())) for c in self.c]

    @staticmethod
    def grams(text, order):
        words = [None] * (order - 1) + katz.tokens(text)
        return [tuple(words[i : i + order]) for i in range(len(words) - order + 1)]

    def p(self, gram):
        if not gram:
            return 0.0
        k, rows = len(gram), {g: r for g, r in self.c[len(gram)].items() if g[:-1] == gram[:-1]}
        c, d = sum(rows.values()), self.d[k]
        if not c:
            return self.p(gram[1:])
        held = {g: (d[r] if r < len(d) else 1.0) * r / c for g, r in rows.items()}
        factor = c / (c + 1) if 1 - sum(held.values()) <= 1e-12 else 1.0
        if gram in rows:
            return factor * held[gram]
        left = 1 - factor * sum(held.values())
        return left if k == 1 else left / (1 - sum(self.p(g[1:]) for g in rows)) * self.p(gram[1:])


@pytest.mark.parametrize("order,cap", [(2, 1 << 20), (2, 20), (3, 1 << 20), (3, 60), (3, 12)])
def test_katz_backs_off_to_discounted_unigrams(spark, order, cap):
    """The small caps give hot words and hot pairs parts of their own."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.6, 12) if x < 40) for _ in range(25)] + ["w1 w2 never seen w1 w3", "only held out words", "", None]
    texts += ["w1 w1 w2 " * 6, "W1 w1 w3"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in katz.score(table, F.col("doc_id") % 5 == 0, order=order, cap=cap).collect()}
    train = [t for i, t in enumerate(texts) if i % 5]
    brute = BruteKatz(train, order)
    counts = collections.Counter(w for t in train for w in katz.tokens(t))
    for i, text in enumerate(texts):
        words = katz.tokens(text)
        assert abs(got[i].score - sum(np.log10(brute.p(g)) for g in brute.grams(text, order))) < 1e-8, i
        assert abs(got[i].base_score - sum(np.log10((counts[w] + 1) / (counts.total() + 1 * (len(counts) + 1))) for w in words)) < 1e-8
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(w in counts for w in words), counts.total())
    if order == 2:
        return
    words = [(w[0],) for w in brute.c[1]] + [(b"unseen",)]
    for context in [(None, None), (None, b"w1"), (b"w1", b"w1"), (b"w2", b"w1")]:
        assert abs(sum(brute.p((*context, *w)) for w in words) - 1) < 1e-9


@pytest.mark.parametrize("order,cap", [(2, 20), (3, 1 << 20), (3, 12)])
def test_katz_model_is_stored_and_scores_other_texts(spark, tmp_path, order, cap):
    """Saved by one call and read by another; texts with unknown words, copies beyond what a batch sends with places, odd rows."""
    rng = np.random.default_rng(6)
    train = [" ".join(f"w{x}" for x in rng.zipf(1.6, 12) if x < 40) for _ in range(20)] + [None, "w1 w1 w2 " * 6]
    copied = "w1 w2 w1 w1 w3 w2 unheard w1 w30"
    other = [copied] * 40 + ["", None, "W1 w2", "nothing known here", "w2 w1 " * 30]
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    katz.train(frame(train), order=order, cap=cap).save(str(tmp_path / "model"))
    model = katz.load(spark, str(tmp_path / "model"))
    got = {r.doc_id: r for r in model.score(frame(other).coalesce(1)).collect()}
    brute = BruteKatz(train, order)
    counts = collections.Counter(w for t in train for w in katz.tokens(t))
    assert len(got) == len(other)
    for i, text in enumerate(other):
        words = katz.tokens(text)
        assert abs(got[i].score - sum(np.log10(brute.p(g)) for g in brute.grams(text, order))) < 1e-8, i
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(w in counts for w in words), counts.total())
    stored = {r.word: r.n for r in model.words.collect()}
    assert stored == dict(counts)
    kept = sum(katz.unpack(r.grams)[1].sum() for r in model.grams.where(f"level = {order}").collect())
    assert order == 2 or kept == counts.total()  # every training trigram's count is in the tables
    empty = model.score(frame(other).limit(0))
    assert empty.count() == 0 and "held_out" not in empty.columns


def test_katz_copies_cost_one_row_a_gram():
    """What a batch sends does not grow with the copies of a text, in counting and in scoring."""
    unigrams = katz.Unigrams({5: 3, 2: 4})
    routes = katz.Routes(unigrams, 100, [], 1 << 20, 3)
    sizes = []
    for copies in (10, 8000):
        code = np.tile(np.arange(7), copies)
        row = {"ids": [{"wpart": 0, "ids": katz.pack(np.arange(2, 9))}], "code": katz.pack(code, np.full(copies, 7)), "held": [False] * copies}
        sent = [x for x in katz._batch_grams(row, routes, unigrams, True, 1.0) if x[0] is not None]
        assert all(not len(katz.unpack(data)[4]) for _, data in sent)
        sizes.append([len(katz.unpack(data)[0]) for _, data in sent])
        counted = [katz.unpack(data)[3] for _, data in katz._batch_grams(row, routes, unigrams, False, 1.0)]
        assert sum(n.sum() for n in counted) == 7 * copies and sum(map(len, counted)) == 7
    assert sizes[0] == sizes[1]


def test_a_file_of_many_notices_loses_no_label(spark):
    every = [(i, f"{text} . of file {i}") for i, (_, text, _) in enumerate(licenses.TEMPLATES * 3)]
    docs = every + [(1000, "\n\n".join(text for _, text, _ in licenses.TEMPLATES)), (1001, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1000].labels == ",".join(sorted({label for label, _, _ in licenses.TEMPLATES})) and got[1001].labels == ""


def test_customary_license_headers(spark):
    gnu = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version."
    wanted = {
        gnu.format("", "3"): "gpl-3", gnu.format("", "2"): "gpl-2", gnu.format("Lesser ", "2.1"): "lgpl-2.1", gnu.format("Lesser ", "3"): "lgpl-3", gnu.format("Affero ", "3"): "agpl-3",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "isc",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software": "unlicense",
        "Creative Commons Legal Code\n\nCC0 1.0 Universal": "cc0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "a permission to use the software that is provided by creative commons": "",
    }
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(wanted)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(wanted))] == list(wanted.values())


def test_every_template_holds_its_phrase_and_licence_words():
    for label, text, phrase in licenses.TEMPLATES:
        assert f" {phrase} " in f" {text} " and set(text.split()) - licenses.FUNCTION_WORDS, label


def brute_licenses(texts):
    """Score and labels of whole texts, word by word."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    lower = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    df = collections.Counter(w for ws in {t: set(ws) for t, ws in zip(lower, words)}.values() for w in ws)
    out = []
    for ws in words:
        scores, labels = [0.0], {label for p, label in licenses.BASE.items() if f" {p} " in f" {' '.join(ws)} "}
        for label, body, phrase in licenses.TEMPLATES:
            parts = body.split()
            own = set(parts) - licenses.FUNCTION_WORDS
            rare = sorted((df[w], w) for w in own & set(ws))[:6]
            votes = collections.Counter(k for _, w in rare for k in {i - j for i, x in enumerate(ws) if x == w for j, y in enumerate(parts) if y == w})
            scores.append(max(votes.values(), default=0) / min(6, len(own)))
            if scores[-1] >= 0.6 and f" {phrase} " in f" {' '.join(ws)} ":
                labels.add(label)
        out.append((",".join(sorted(labels)), max(scores)))
    return out


def test_license_scores_against_brute_force(spark):
    """Whole texts without any anchor, cut and shuffled templates, repeated texts, odd rows."""
    rng = np.random.default_rng(8)
    texts = [None, "", "the of and", "warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"]
    for _, body, _ in licenses.TEMPLATES * 2:
        words = body.split()
        a, b = sorted(rng.integers(0, len(words) + 1, 2).tolist())
        texts += [" ".join(words[a:b]), f"x {body} y", " ".join(rng.permutation(words)), "word " * 50 + body.upper()]
    texts += [texts[5], texts[5].upper(), " . ".join(body for _, body, _ in licenses.TEMPLATES), "software " * 5000]
    rows = [(i, t, "own", 0.5) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, words string, score double")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_licenses(texts)
    assert got[3][1] > 0.6


def test_quality_limits_are_learnt(spark):
    """A source of clean texts drops one with a third of its lines repeated; one where a twelfth of symbols is usual keeps it."""
    def text(k, repeats=0, symbols=0):
        lines = [f"k{k} a{i}x{k} b{i} c{k}y{i} d{i} e{k}z{i}" for i in range(12)]
        return "\n".join(lines + lines[:1] * repeats + ["#" * symbols] * (symbols > 0))
    rows = [(k, text(k), "en", "clean") for k in range(700)] + [(k, text(k, symbols=30), "en", "code") for k in range(700, 950)]
    rows += [(5000, text(5000, repeats=6), "en", "clean"), (5001, text(5001, symbols=30), "en", "clean"), (5002, text(5002, symbols=30), "en", "code"), (5003, text(5003, symbols=400), "en", "code")]
    got = {r.doc_id: r.quality for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0].kept and got[5002].kept and not any(got[i].base_failed for i in (5000, 5001, 5003))
    assert [got[i].kept for i in (5000, 5001, 5003)] == [False, False, False]
