import random

import numpy as np
import pytest

from clickstrata.llm import pages

SCHEMA = "html string, page_id long, url string, text string, n_chars string"


def text_of(source):
    page = pages.Page(source)
    return page.text(pages.repeated([page.tokens], [0])[0])


def brute_repeated(streams, owners, least):
    """Every gram of every stream looked for in every stream of another page."""
    out = []
    for stream, page in zip(streams, owners):
        hit = [False] * len(stream)
        for i in range(len(stream) - least + 1):
            gram = stream[i : i + least]
            if any(other[k : k + least] == gram for other, o in zip(streams, owners) if o != page for k in range(len(other) - least + 1)):
                hit[i : i + least] = [True] * least
        out.append(hit)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_repeats_against_brute_force(seed):
    random.seed(seed)
    for least in (2, 4, 8):
        streams = [[random.choice("ab") for _ in range(random.randint(0, 30))] for _ in range(random.randint(1, 6))]
        streams += [s[:] for s in streams[:2]]
        owners = [random.randrange(len(streams)) for _ in streams]
        assert [x.tolist() for x in pages.repeated(streams, owners, least=least)] == brute_repeated(streams, owners, least)
        for stream, owner, hit in zip(streams, owners, brute_repeated(streams, owners, least)):  # each stream in a part of its own
            others = {k for s, o in zip(streams, owners) if o != owner for k in pages._gram_keys(s, least)}
            assert pages.repeated([stream], [owner], others, least)[0].tolist() == hit


@pytest.mark.parametrize(
    "source, text",
    [
        ("", ""),
        (None, ""),
        ("just text", "just text"),
        ("<nav>menu</nav><article><h1>A &amp; B</h1><p>one\n  two<br>three</p></article><footer>x</footer>", "A & B one two three"),
        ("<main><p>a<b>b</b>c <i>d</i></p><aside>side</aside><form><label>your name</label></form><p>e</main>", "abc d e"),
        ("<body class='has-sidebar'><div class='page with-menu'><article>kept</article></div><div id=sidebar>s</div>", "kept"),
        ("<article>a<script>var t='</article>'; x<y</script><style>p{}</style>b<!-- c --><noscript>n</noscript></article>", "ab"),
        ("<article>a <div class='ad-box'>buy<div>now</div></div> b</article><div class=comments><article>says who</article></div>", "a b"),
        ("<article><header><h1>Title</h1></header><p>body<footer>by me</footer></article><header>site</header>", "Title body"),
        ("<article><p>1 < 2 &lt;b&gt; &#233;&eacute;&nbsp;x &amp", "1 < 2 <b> éé x &"),
        ("<article><p title='a>b'>q</p><p title='never closed>r</p><p>s", "q r s"),
        ("<article><p>done</p><p class=", "done"),
        ("<article><p>a</x></y></article>tail<footer>f", "a"),
        ("<html><head><title>t</title><body><div>open text</div><div class='cookie-notice'>accept</div>", "open text"),
        ("<div><p class='notice'>n<p>text</div>", "text"),
        ("<div role=main>m</div><div role='navigation'>n</div>", "m"),
        ("<p>x<span class='ad'>buy</span>y</p>", "x y"),
    ],
)
def test_texts(source, text):
    assert text_of(source) == text


def test_odd_markup_takes_linear_time():
    for piece in ("<a '", "<div>", "</x>", "<p><b>", '<a "', "<!--", "<", "&amp"):
        text_of("<article>" + piece * 100_000)


NOTICE = "<div>Please read our terms of use before you go on to read this page</div>"


def site(spark):
    story = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(f"<body>{NOTICE}<div>{story(i)}</div>", i, f"https://one.example/{i}", "own", None) for i in range(12)]
    rows += [(f"<body>{NOTICE}<div>alone on its host</div>", 50, "http://two.example", None, None)]
    rows += [(f"<body><div>{story(77)}</div>", 51, "http://two.example/x?http://one.example", None, None)] * 2  # one page, twice
    rows += [(f"<body><article>{story(0)}</article>", i, "https://one.example/copy", None, None) for i in (60, 61)]
    rows += [(None, 70, None, None, None), ("", None, "", None, None), ("no host", None, None, None, None), ("<p>" + "long " * 200_000, 71, "//three.example", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("part", [1 << 23, 900, 1])
def test_hosts_in_parts_give_the_same_texts(spark, part):
    story = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    terms = "Please read our terms of use before you go on to read this page"
    got = sorted(((r.page_id, r.text, r.n_chars) for r in pages.extract(site(spark), part=part).collect()), key=repr)
    want = [(i, story(i)) for i in range(12)] + [(50, f"{terms} alone on its host"), (51, story(77)), (51, story(77)), (60, story(0)), (61, story(0))]
    want += [(70, ""), (None, ""), (None, "no host"), (71, ("long " * 200_000).strip())]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=repr)


def test_an_empty_table(spark):
    assert pages.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_method_judges_articles_and_the_check_corrects_it():
    page = pages.Page("<body><div>menu of the site</div><article><p>cited words</p><p>own words</p></article><div class=notice>only here</div>")
    assert [t for t in page.tokens if t[0] != "<"] == "menu of the site cited words own words only here".split()
    covered = np.array([t in ("menu", "of", "the", "site", "cited", "words") and i < 11 for i, t in enumerate(page.tokens)])
    assert page.unique(covered) == [False, False, True, True]
    assert page.text(covered) == "cited words own words"


def test_articles_are_no_evidence_of_repeats():
    copies = [pages.Page(f"<article>{' '.join('abcdefghij')}</article>") for _ in range(2)] + [pages.Page(f"<div>{' '.join('abcdefghij')}</div>")]
    inside = [np.array(p.inside, bool) for p in copies]
    assert not any(c.any() for c in pages.repeated([p.tokens for p in copies], [0, 1, 2], inside=inside))
    twice = copies + copies[2:]
    found = pages.repeated([p.tokens for p in twice], [0, 1, 2, 3], inside=inside + inside[2:])
    assert [[p.unique(c)[0] for p, c in zip(twice, found)], twice[0].text(found[0]), twice[2].text(found[2])] == [[False] * 4, " ".join("abcdefghij"), ""]


@pytest.mark.parametrize("part", [1 << 23, 900, 1])
def test_repeats_of_a_host_with_articles_only_are_found_in_all_its_parts(spark, part):
    rows = [(f"<body>{NOTICE}<article>story {i}</article>", i, "http://one.example", None, None) for i in range(12)]
    got = pages.extract(spark.createDataFrame(rows, SCHEMA), part=part).select("text", "n_outside", "n_repeated").collect()
    assert sorted(got) == sorted((f"story {i}", 17, 17) for i in range(12))
