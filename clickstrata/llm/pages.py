"""Main text of web pages: a host's suffix array tells boilerplate from unique runs, an exact check by markup follows.

A page is lexed into blocks of text, each in one of three regions: inside an article (``article``, ``main``), inside
what markup names as something else (menus, headers, footers, sidebars, notices, adverts, forms, comments), or open.
The whole token streams (words and tags) of a host's pages, articles and all, are concatenated, and a suffix array
ordered by the first ``LEAST`` tokens finds every substring of so many tokens or more that stands on two distinct
pages outside articles. What such substrings cover is boilerplate, on every page; a block that they cover by less than
half is a unique run.

Repeats alone cannot tell: a notice that stands once on its host is no repeat, and an article may cite one. So the
check corrects the method where markup speaks: unique runs that it names as something else, or that stand beside an
article, go; blocks of an article that are covered come back. A copied article is no repeat outside articles.

A host of more than ``PART`` characters is dealt to parts by page, and the parts' grams of ``LEAST`` tokens outside
articles are exchanged as 64-bit hashes, a gram once a part and task, packed, so that a substring counts as repeated
wherever on the host its copies stand. No task holds more than a part, or the grams of about ``SHARE`` parts.

Null or empty html has no text; a null url belongs to the host without a name; rows equal in page_id, url and html are
one page to the search for repeats, and each of them has its row in the result; a page of any length is lexed whole, in
linear time; an unfinished tag at the end of a page is no text; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import tidy, written
from .hashing import mix
from .katz import pack, unpack
from .suffixes import suffix_array

LEAST = 8  # tokens of a repeated substring; a power of two
PART = 2 << 20  # characters of html that one task holds of a host
SHARE = 4  # parts whose grams one task compares, on average
HELD = 1 << 20  # grams that a task packs at once
FEW = 50_000  # hosts of more than a part whose names are sent to every task; with more of them the pages are joined
COVERED = 0.5  # share of a block's words from which it is boilerplate

MAIN, OPEN, NAMED, CLOSED = range(4)  # in an article; not said; not the article by its name; never, whatever stands in it

# Elements of HTML and customary names.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSED = frozenset("head nav footer aside form noscript template svg math canvas object select button dialog menu audio video".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion sidebar menu navbar nav navigation breadcrumb "
    "breadcrumbs footer cookie cookies consent notice notices popup modal newsletter subscribe share sharing social related recommended widget masthead "
    "toolbar pagination pager login signup complementary contentinfo alert search".split()
)
_HEADS = frozenset(("header", "masthead", "banner"))
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")


def _region(tag: str, attributes: str, outer: int) -> int:
    """The region inside an element."""
    if outer == CLOSED or tag in _CLOSED:
        return CLOSED
    names = {n for _, value in _ATTRIBUTE.findall(attributes) for n in _NAME.findall(value.lower())} if "=" in attributes else set()
    if names & _COMMENTS:
        return CLOSED
    if tag in ("article", "main") or (tag not in ("html", "body") and "role" in attributes and "main" in names):
        return MAIN
    if tag in ("html", "body"):
        return outer
    if outer != MAIN and (tag == "header" or names & _HEADS):
        return NAMED
    return NAMED if names & _NAMES - (_HEADS if outer == MAIN else frozenset()) else outer


class Page:
    """A page's blocks, (region, text) in page order, and its tokens, with their blocks (-1: a tag) and whether they stand in an article."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[int, str]] = []
        self.tokens: list[str] = []
        self.owner: list[int] = []
        self.inside: list[bool] = []
        self._open: list[tuple[str, int]] = []
        self._names: Counter = Counter()
        self._text: list[str] = []
        self._lex(source or "")
        self._break()

    def _here(self) -> int:
        return self._open[-1][1] if self._open else OPEN

    def _break(self) -> None:
        """Ends the block that is being read."""
        words = "".join(self._text).split()
        self._text.clear()
        if words:
            region = self._here()
            self.tokens += words
            self.owner += [len(self.blocks)] * len(words)
            self.inside += [region == MAIN] * len(words)
            self.blocks.append((region, " ".join(words)))

    def _tag(self, token: str) -> None:
        self.tokens.append(token)
        self.owner.append(-1)
        self.inside.append(self._here() == MAIN)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "body":
            self._open.clear()
            self._names.clear()
        elif tag not in _INLINE:
            while self._open and (self._open[-1][0] == "p" or (self._open[-1][0] in _INLINE and self._names["p"])):  # a block ends a paragraph
                self._names[self._open.pop()[0]] -= 1
            if self._open and self._open[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._names[self._open.pop()[0]] -= 1
        if tag not in _VOID and not attributes.endswith("/"):
            self._open.append((tag, _region(tag, attributes, self._here())))
            self._names[tag] += 1
        self._tag(f"<{tag}")

    def _end(self, tag: str) -> None:
        self._tag(f"</{tag}")
        if self._names[tag] > 0:
            while True:
                name = self._open.pop()[0]
                self._names[name] -= 1
                if name == tag:
                    return

    def _lex(self, source: str) -> None:
        at, size, pattern = 0, len(source), _TAG
        while at < size:
            mark = source.find("<", at)
            if mark < 0:
                mark = size
            if mark > at:
                chunk = source[at:mark]
                self._text.append(html.unescape(chunk) if "&" in chunk else chunk)
            if mark == size:
                return
            after = source[mark + 1 : mark + 2]
            if after in "!?" and after:
                comment = source.startswith("<!--", mark)
                end = source.find("-->" if comment else ">", mark + (4 if comment else 2))
                at = size if end < 0 else end + (3 if comment else 1)
                continue
            found = pattern.match(source, mark) if after == "/" or after.isalpha() else None
            if not found and (after == "/" or after.isalpha()):
                pattern = _PLAIN_TAG  # from here on quotes do not pair
                found = pattern.match(source, mark)
                if not found and source.find(">", mark) < 0:
                    return
            if not found:
                self._text.append("<")
                at = mark + 1
                continue
            at = found.end()
            tag = found[2].lower()
            if tag not in _INLINE and tag not in ("script", "style"):
                self._break()
            elif self._open and _ATTRIBUTE.search(found[3]) and _region(tag, found[3], self._here()) != self._here():
                self._break()
            if found[1]:
                if tag in _INLINE and self._open and self._open[-1][0] == tag and len(self._open) > 1 and self._open[-2][1] != self._open[-1][1]:
                    self._break()
                self._end(tag)
            elif tag in _RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
                if not close:
                    return
                end = source.find(">", close.end())
                at = size if end < 0 else end + 1
            else:
                self._start(tag, found[3])

    def has_article(self) -> bool:
        return any(region == MAIN for region, _ in self.blocks)

    def unique(self, covered: np.ndarray) -> list[bool]:
        """Whether each block is a unique run: repeats cover less than half of its words."""
        owner = np.array(self.owner, np.int64)
        words = np.bincount(owner[owner >= 0], minlength=len(self.blocks))
        held = np.bincount(owner[(owner >= 0) & covered], minlength=len(self.blocks))
        return (held < COVERED * words).tolist()

    def text(self, covered: np.ndarray) -> str:
        """The unique runs, corrected where markup speaks: by the article that it names, or by what it names as something else."""
        article = self.has_article()
        main = [region == MAIN or (unique and region == OPEN and not article) for (region, _), unique in zip(self.blocks, self.unique(covered))]
        return " ".join(text for (_, text), stays in zip(self.blocks, main) if stays)


def _hashed(tokens, host: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(host.encode("utf-8", "replace"))
    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace"), seed) for t in tokens], np.uint64)


def _rolled(keys: np.ndarray, least: int) -> np.ndarray:
    """Keys of all grams from those of a stream's tokens; ``least``, a power of two, is their length."""
    step = 1
    while step < least:
        keys = mix(keys[:-step] * np.uint64(0x9E3779B97F4A7C15) + keys[step:]) if len(keys) > step else keys[:0]
        step *= 2
    return keys


def _gram_keys(tokens: list[str], least: int, host: str = "") -> np.ndarray:
    """64-bit keys of all grams of a stream of a host."""
    return _rolled(_hashed(tokens, host), least)


def _outside(inside: np.ndarray, least: int) -> np.ndarray:
    """Of each gram of a stream whether none of its tokens stands in an article."""
    before = np.append(0, np.cumsum(inside))
    return before[least:] == before[:-least] if len(inside) >= least else np.zeros(0, bool)


def repeated(
    streams: list[list[str]], pages: list[int], elsewhere=(), least: int = LEAST, host: str = "", inside: list[np.ndarray] | None = None
) -> list[np.ndarray]:
    """For each stream which of its tokens stand in a substring of ``least`` tokens or more that is on two distinct pages.

    ``pages``: the streams' pages, by number. ``elsewhere``: keys of grams that stand on other pages too. ``inside``: which
    tokens stand in articles; substrings that hold one are no evidence, but are covered by others like them.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    ends = np.cumsum(sizes)
    covered = np.zeros(int(sizes.sum()) + 1, np.int64)
    if sizes.sum():
        known: dict[str, int] = {}
        symbols = np.array([known.setdefault(t, len(known)) for s in streams for t in s], np.int64)
        stop, page = np.repeat(ends, sizes), np.repeat(np.array(pages, np.int64), sizes)
        array, _, common = suffix_array(symbols, stop, least)
        heads = np.flatnonzero(common[:-1] < least)  # each begins a row of suffixes that share their first tokens
        first = last = page
        if inside:
            counts = np.ones(len(symbols), bool)
            for begin, x in zip((ends - sizes).tolist(), inside):
                told = _outside(x, least)
                counts[begin : begin + len(told)] = told
            first, last = np.where(counts, page, len(streams)), np.where(counts, page, -1)
        low, high = np.minimum.reduceat(first[array], heads), np.maximum.reduceat(last[array], heads)
        at = array[np.repeat(low < high, np.diff(np.append(heads, len(array))))]
        at = at[at + least <= stop[at]]
        if len(elsewhere):
            others = elsewhere if isinstance(elsewhere, np.ndarray) else np.array(list(elsewhere), np.uint64)
            found = np.flatnonzero(np.isin(_rolled(_hashed(known, host)[symbols], least), others))
            at = np.append(at, found[found + least <= stop[found]])
        covered += np.bincount(at, minlength=len(covered)) - np.bincount(at + least, minlength=len(covered))
    return np.split(np.cumsum(covered)[:-1] > 0, ends[:-1])


_FOUND = "page_id long, url string, text string, n_chars long, n_outside long, n_repeated long"


def dealt(pages: DataFrame, part: int = PART) -> DataFrame:
    """``__host``, ``__part``, ``__parts`` and page_id, url, html: hosts with more characters than ``part`` in parts."""
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
        F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), "^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1).alias("__host"),
    )
    large = own.groupBy("__host").agg(F.sum(F.length("html").cast("long")).alias("n")).where(F.col("n") > part)
    parts = written(large.select("__host", F.ceil(F.col("n") / part).cast("long").alias("__parts")))
    joined = own.join(F.broadcast(parts) if parts.count() <= FEW else parts, "__host", "left")
    joined = joined.withColumn("__parts", F.coalesce("__parts", F.lit(1).cast("long")))
    return joined.withColumn("__part", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("__parts")))


def _sent(least: int):
    """Keys of pages' grams outside articles with their parts, packed by host and share of its keys."""

    def run(batches):
        held, size = {}, 0

        def rows():
            hosts, shares, keys, parts = [], [], [], []
            for (host, many), found in held.items():
                key, part = (np.concatenate(x) for x in zip(*found))
                by = np.lexsort((part, key))
                key, part = key[by], part[by]
                new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
                key, part = key[new], part[new]
                share = ((key >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)).astype(np.int64)  # rises with the key
                cuts = np.append(np.flatnonzero(np.append(True, share[1:] != share[:-1])), len(share)).tolist()
                for a, b in zip(cuts, cuts[1:]):
                    hosts.append(host)
                    shares.append(int(share[a]))
                    keys.append(_keys_packed(key[a:b]))
                    parts.append(pack(part[a:b]))
            types = (pa.string(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((hosts, shares, keys, parts), types)], ["__host", "share", "grams", "parts"])

        for batch in batches:
            for host, part, many, source in zip(*(batch.column(c) for c in ("__host", "__part", "__parts", "html"))):
                page, host = Page(source.as_py()), host.as_py()
                inside = np.array(page.inside, bool)
                runs = np.split(np.arange(len(inside)), np.flatnonzero(np.diff(inside)) + 1)
                keys = [_gram_keys(page.tokens[r[0] : r[-1] + 1], least, host) for r in runs if len(r) >= least and not inside[r[0]]]
                keys = np.concatenate(keys) if keys else []
                if len(keys):
                    keys = np.unique(keys)
                    held.setdefault((host, max(1, many.as_py() // SHARE)), []).append((keys, np.full(len(keys), part.as_py(), np.int64)))
                    size += len(keys)
                if size > HELD:
                    yield rows()
                    held, size = {}, 0
        if held:
            yield rows()
        tidy()

    return run


def _keys_packed(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return pack(np.append(keys[:1], np.diff(keys)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data)[0]).view(np.uint64)  # whole sums go around 2^64


def _shared(table: pa.Table) -> pa.Table:
    """Of a share of a host's keys those that two parts have, packed, by part."""
    key = np.concatenate([_keys(x) for x in table.column("grams").to_pylist()])
    part = np.concatenate([unpack(x)[0] for x in table.column("parts").to_pylist()])
    by = np.lexsort((part, key))
    key, part = key[by], part[by]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    several = part[heads] != part[np.append(heads[1:], len(key)) - 1]
    kept = np.repeat(several, np.diff(np.append(heads, len(key))))
    kept[1:] &= (key[1:] != key[:-1]) | (part[1:] != part[:-1])
    key, part = key[kept], part[kept]
    by = np.argsort(part, kind="stable")
    key, part = key[by], part[by]
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)).tolist() if len(part) else [0]
    host = table.column("__host")[0].as_py()
    rows = [(host, int(part[a]), _keys_packed(key[a:b])) for a, b in zip(cuts, cuts[1:])]
    tidy()
    types = (pa.string(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["__host", "__part", "grams"])


def _exchanged(own: DataFrame, least: int) -> DataFrame:
    """``__host``, ``__part``, ``grams``: keys, packed, of grams of a large host's part that stand in another of its parts too."""
    large = own.where("__parts > 1").select("__host", "__part", "__parts", "html")
    sent = large.mapInArrow(_sent(least), "__host string, share long, grams binary, parts binary")
    return sent.groupBy("__host", "share").applyInArrow(_shared, "__host string, __part long, grams binary")


def _packed(own: DataFrame) -> DataFrame:
    """``own`` with html compressed page by page, as it is moved to its part."""

    def pack(batches):
        for batch in batches:
            raw = [x.as_py().encode("utf-8", "replace") for x in batch.column("html")]
            packed = [pa.compress(x, "zstd", asbytes=True) if x else b"" for x in raw]
            columns = [*(batch.column(c) for c in ("__host", "__part", "page_id", "url")), pa.array([len(x) for x in raw], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["__host", "__part", "page_id", "url", "size", "packed"])

    schema = "__host string, __part long, page_id long, url string, size long, packed binary"
    return own.select("__host", "__part", "page_id", "url", "html").mapInArrow(pack, schema)


def extract(pages: DataFrame, least: int = LEAST, part: int = PART) -> DataFrame:
    """page_id, url, text, n_chars of each page; and how many tokens stand outside its articles, and how many of them in repeats.

    These numbers are the same whatever the parts.
    """
    own = dealt(pages, part)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sizes, packed = left.column("size").to_pylist(), left.column("packed").to_pylist()
        sources = [pa.decompress(x, n, "zstd", asbytes=True).decode() if n else "" for n, x in zip(sizes, packed)]
        ids, urls = left.column("page_id").to_pylist(), left.column("url").to_pylist()
        lexed = [Page(s) for s in sources]
        numbers: dict = {}
        pages = [numbers.setdefault(row, len(numbers)) for row in zip(ids, urls, sources)]
        host = left.column("__host")[0].as_py() if lexed else ""
        answers = [_keys(x) for x in right.column("grams").to_pylist()]
        elsewhere, inside = np.concatenate(answers) if answers else np.zeros(0, np.uint64), [np.array(p.inside, bool) for p in lexed]
        covered = repeated([p.tokens for p in lexed], pages, elsewhere, least, host, inside) if lexed else []
        texts = [p.text(c) for p, c in zip(lexed, covered)]
        tidy()
        columns = [ids, urls, texts, [len(t) for t in texts], [int((~x).sum()) for x in inside], [int(c[~x].sum()) for c, x in zip(covered, inside)]]
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({c.split(" ")[0]: pa.array(v, t) for c, v, t in zip(_FOUND.split(", "), columns, types)})

    keys = ["__host", "__part"]
    return _packed(own).groupBy(*keys).cogroup(_exchanged(own, least).groupBy(*keys)).applyInArrow(run, _FOUND)
