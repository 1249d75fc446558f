"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Lines are compared trimmed and lower-cased. Of equal lines (by two 64-bit hashes) the first (by doc_id, text hash,
line number) stays. A line is also dropped if another line within its threshold has an earlier first place. The
threshold is ``edits`` edits (one) from ``fuzzy_chars`` code points on and none below, where one edit would be more
than a thirtieth of the line.

Two lines within t edits share one of t + 1 segments of the shorter one, at a place bounded by the segment's number
and the difference in length; each line indexes its segments by (length, number, hash) and probes the places that
can match in lines of equal or lesser length. For one edit the partition is finer: of three segments of the shorter
line all but one must agree, those before the edit in place and those behind it moved by the difference in length, so
a key is the hash of all but one segment. Lines under one key become pairs while there are at most ``GROUP`` of them.
Larger groups are not paired: their open segment is cut in three again, round by round, until it is one character;
then the lines that differ in it alone link to the first of them, and longer lines to the one that a deletion gives.
So a group of n lines makes about n links. Candidates are verified by banded bit-parallel edit distance, with a word
of 2t + 1 bits sliding along the diagonal. Line texts are moved for lines with a candidate only. With ``edits`` of
two or more, groups are paired whatever their size.

Null texts stay null; lines without a word are never dropped; a document that loses all lines with words is dropped;
rows equal in id and text stand together; null ids come first; an empty table gives an empty result; very long lines
are cut and hashed whole, and held as arrays of characters while they are verified. Extra columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import forget, fresh, written

EDITS = 1
FUZZY_CHARS = 32
#: Lines under one key that are paired; larger groups are cut further.
GROUP = 32
CUTS = 3
#: Lines with over this share of all lines are common; there are at most 1 / COMMON of them.
COMMON = 2e-4


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def _segments(n: str, edits: int) -> list[tuple[str, str]]:
    """(start, length) of the edits + 1 segments of a line of length ``n``, as SQL; the last ones take the rest."""
    k = edits + 1
    short = f"({n} div {k})"
    longer = f"({n} % {k})"  # so many last segments are longer by one
    return [(f"({i} * {short} + greatest(0, {longer} - {k - i}))", f"({short} + if({i} >= {k} - {longer}, 1, 0))") for i in range(k)]


def keys(line: str, n: str, edits: int) -> tuple[Column, Column]:
    """Arrays of hashes: the line's index keys; its probe keys for lines of lesser length (those for equal length are the index keys and their shifts)."""
    key = lambda m, i, at, size: f"xxhash64({m}, {i}, substring({line}, {at} + 1, {size}))"
    index = [key(n, i, at, size) for i, (at, size) in enumerate(_segments(n, edits))]
    probes = []
    for less in range(edits + 1):
        m = f"({n} - {less})"
        for i, (at, size) in enumerate(_segments(m, edits)):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            probes += [key(m, i, f"({at} + {shift})", size) for shift in range(low, high + 1)]
    return F.expr(f"array({', '.join(index)})"), F.expr(f"array({', '.join(probes)})")


def around(line: str, m: str, more: str, low: str, high: str) -> str:
    """SQL for the hash of a line of length m + more but for its part from ``low`` to ``high`` + more."""
    return f"xxhash64({m}, {low}, {high}, substring({line}, 1, {low}), substring({line}, {high} + {more} + 1))"


def around_keys(line: str, n: str) -> Column:
    """Keys of all but one of CUTS segments: first those of the line itself, then those it has as a line one longer than another."""
    every = [
        around(
            line,
            f"({n} - {more})",
            str(more),
            f"({i} * ({n} - {more}) div {CUTS})",
            f"({i + 1} * ({n} - {more}) div {CUTS})",
        ) for more in (0, 1) for i in range(CUTS)
    ]
    return F.expr(f"array({', '.join(every)})")


def within(a: str, b: str, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits: bit-parallel, over a band of 2 * edits + 1 diagonals.

    Bit k of a word at column j stands for row j - edits + k. ``vp``/``vn`` hold where the column's values
    rise or fall by one from the row above; ``d`` is the value on the band's lowest diagonal, and from where
    that leaves the table, on the last row.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    pattern, text = f"split({a}, '')", f"split({b}, '')"
    m, n = f"length({a})", f"length({b})"
    match = " + ".join(f"if(coalesce(get(p, j - 1 - {edits} + {k}) = get(t, j - 1), false), {1 << k}L, 0L)" for k in range(width))
    d0 = f"((((((x & s.vp) + s.vp) & {mask}L) ^ s.vp) | x | s.vn))"
    hp, hn = f"((s.vn | ~(d0 | s.vp)) & {mask}L)", "(d0 & s.vp)"
    low = f"if(d0 & {1 << (width - 1)}L = 0, 1, 0)"
    row = f"shiftleft(1L, cast(m - j + {edits} as int))"
    last = f"(if({hp} & {row} <> 0, 1, 0) - if({hn} & {row} <> 0, 1, 0))"
    step = (
        f"if(s.d > {edits} + {edits} + abs(n - m), s, element_at(transform(transform(array({match}), x -> {d0}), d0 -> "
        f"named_struct('vp', ({hn} | ~(shiftright(d0, 1) | {hp})) & {mask}L, 'vn', shiftright(d0, 1) & {hp}, "
        f"'d', s.d + if(j + {edits} <= m, {low}, {last}))), 1))"
    )
    start = ((1 << (edits + 1)) - 1) << edits
    body = f"aggregate(sequence(1, n), named_struct('vp', {start}L, 'vn', 0L, 'd', {edits}), (s, j) -> {step}, s -> s.d)"
    # names for what is used often
    named = f"element_at(transform(array(named_struct('p', {pattern}, 't', {text}, 'm', {m}, 'n', {n})), v -> {_bound(body)}), 1)"
    return F.expr(
        f"CASE WHEN abs({m} - {n}) > {edits} THEN false WHEN {m} <= {edits} OR {n} <= {edits} THEN levenshtein({a}, {b}) <= {edits} ELSE {named} <= {edits} END"
    )


def _bound(body: str) -> str:
    import re

    return re.sub(r"\b([ptmn])\b(?!\()", r"v.\1", body)


def _pairs(keyed: DataFrame) -> DataFrame:
    """Candidates (a, b) under common keys: lines that index the key, and lines that probe it."""
    index, every = keyed.where("more = 0").select("k", F.col("h").alias("x")), keyed.select("k", F.col("h").alias("y"), "more")
    met = index.join(every, "k").where((F.col("x") < F.col("y")) | ((F.col("more") > 0) & (F.col("x") != F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows (k, ...) whose key others have too, with its ``size``."""
    sizes = rows.groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, "k")


def _cut_further(hot: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (a, b) of large groups (h, m, more, low, high): lines that agree but for ``low`` to ``high``."""
    found, held = [], []
    while True:
        cut = (
            hot.withColumn("part", F.explode(F.sequence(F.lit(0), F.least(F.lit(CUTS), F.col("high") - F.col("low")).cast("int") - 1)))
            .withColumn("of", F.least(F.lit(CUTS), F.col("high") - F.col("low")))
        )
        cut = cut.withColumns({"to": F.expr("low + (part + 1) * (high - low) div of"), "low": F.expr("low + part * (high - low) div of")})
        cut = cut.select("h", "m", "more", "low", F.col("to").alias("high"))
        keyed = written(
            _grouped(
                cut.join(texts.select("h", "line"), "h").withColumn("k", F.expr(around("line", "m", "more", "low", "high"))).drop("line")
            )
        )
        held.append(keyed)
        found.append(_pairs(keyed.where(F.col("size") <= GROUP)))
        hot = keyed.where(F.col("size") > GROUP)
        ends = hot.where("high - low <= 1").join(texts.select("h", "line", "first"), "h")
        star = ends.where("more = 0").groupBy("k").agg(F.min(F.struct("first", "h")).alias("least"))
        found.append(ends.where("more = 0").join(star, "k").select(F.col("h").alias("a"), F.col("least.h").alias("b")).where("a <> b"))
        letters = (
            F.when(F.col("more") == 0, F.array(F.expr("substring(line, low + 1, 1)")))
            .otherwise(F.array_distinct(F.array(F.expr("substring(line, low + 1, 1)"), F.expr("substring(line, low + 2, 1)"))))
        )
        last = ends.select("k", "h", "more", F.explode(letters).alias("letter")).select(F.xxhash64("k", "letter").alias("k"), "h", "more")
        # under k and the letter, the index side is one line
        found.append(_pairs(last.where("more = 1").unionByName(last.where("more = 0").dropDuplicates(["k"]))))
        hot = hot.where("high - low > 1").select("h", "m", "more", "low", "high")
        if hot.isEmpty():
            out = written(reduce(DataFrame.unionByName, found).distinct())
            for table in held:
                forget(table)
            return out


def decisions(docs: DataFrame, edits: int = EDITS, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """doc_id, hash (of the text), gone: positions of the lines to drop, for documents that lose any. A written table, the only one that stays."""
    rows = docs.select("doc_id", "text").where("text is not null")
    second = lambda line: F.xxhash64(F.lit(1), line)
    cut = (
        rows.select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
        .withColumn("line", normal(F.col("line")))
        .withColumn("n", F.length("line"))
    )
    fuzzy = F.col("n") >= fuzzy_chars
    of = around_keys("line", "n") if edits == 1 else F.concat(*keys("line", "n", edits))
    own = CUTS if edits == 1 else edits + 1  # so many keys are the line's index
    lines = written(
        cut.select(
            "doc_id",
            "hash",
            "pos",
            F.xxhash64("line").alias("h"),
            second(F.col("line")).alias("g"),
            F.when(fuzzy, F.col("n")).alias("n"),
            F.when(fuzzy, of).alias("keys"),
        )
    )
    firsts = written(
        lines.groupBy("h", "g").agg(
            F.min(F.struct("doc_id", "hash", "pos")).alias("first"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("keys").alias("keys"),
        )
    )
    exploded = (
        firsts.where("keys is not null")
        .select("h", "n", F.posexplode("keys").alias("at", "k"))
        .select(
            "h",
            "k",
            (
                F.col("n").cast("long") * 16 + F.least("at", F.lit(15))
            ).alias("of") if edits == 1 else F.when(F.col("at") < own, 0).otherwise(1).cast("long").alias("of"),
        )
    )
    keyed = written(_grouped(exploded).withColumn("more", F.when(F.col("of") % 16 < own, 0).otherwise(1)))
    needed = written(keyed.select("h").distinct())
    again = (
        rows.select(F.explode(F.split("text", "\n")).alias("line"))
        .select(normal(F.col("line")).alias("line"))
        .where(F.length("line") >= fuzzy_chars)
        .select(F.xxhash64("line").alias("h"), "line")
    )
    texts = again.join(needed, "h", "left_semi").groupBy("h", second(F.col("line")).alias("g")).agg(F.min("line").alias("line"))
    texts = written(texts.join(firsts.select("h", "g", "first"), ["h", "g"]))
    if edits == 1:
        small, large = keyed.where(F.col("size") <= GROUP), keyed.where(F.col("size") > GROUP)
        pairs, further = _pairs(small), None
        if not large.isEmpty():
            m, part = F.expr("of div 16 - more"), F.expr(f"of % 16 % {CUTS}")
            hot = (
                large.select("h", m.alias("m"), "more", part.alias("part"))
                .select("h", "m", "more", F.expr(f"part * m div {CUTS}").alias("low"), F.expr(f"(part + 1) * m div {CUTS}").alias("high"))
            )
            further = _cut_further(hot, texts)
            pairs = pairs.unionByName(further)
    else:
        pairs, further = _pairs(keyed), None
    side = lambda mine, other: texts.select(
        F.col("h").alias(mine),
        F.col("g").alias(f"g{mine}"),
        F.col("line").alias(other),
        F.col("first").alias(f"f{mine}"),
    )
    pairs = written(pairs.distinct())
    for table in (keyed, needed, further):
        if table is not None:
            forget(table)
    both = pairs.join(side("a", "one"), "a").join(side("b", "two"), "b")
    close = both.where(within("one", "two", edits))
    line = lambda x: F.struct(F.col(x).alias("h"), F.col(f"g{x}").alias("g"))
    later = (
        close.select(F.when(F.col("fa") < F.col("fb"), line("b")).otherwise(line("a")).alias("l"))
        .select("l.h", "l.g")
        .distinct()
        .withColumn("near", F.lit(True))
    )
    judged = (
        firsts.join(later, ["h", "g"], "left")
        .where("copies > 1 or near")
        .select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    own_place = F.struct("doc_id", "hash", "pos")
    # the rows of a common line stay where they are; its verdict is broadcast
    often = firsts.where(F.col("copies") > F.greatest(F.lit(1), F.lit(lines.count() * COMMON))).select("h", "g")
    common = F.broadcast(judged.join(F.broadcast(often), ["h", "g"], "left_semi"))
    places = lines.select("doc_id", "hash", "pos", "h", "g")
    found = places.join(common, ["h", "g"]).unionByName(places.join(F.broadcast(often), ["h", "g"], "left_anti").join(judged, ["h", "g"]))
    gone = found.where(F.col("near") | ~own_place.eqNullSafe(F.col("first")))
    out = written(gone.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set("pos")).alias("gone")))
    for table in (lines, firsts, texts, pairs):
        forget(table)
    return out


def dedup(docs: DataFrame, edits: int = EDITS, fuzzy_chars: int = FUZZY_CHARS, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` without the dropped lines; with names in ``counts`` all documents stay and get their number of lines and of dropped lines."""
    own, hashed, mark = fresh(docs, "__own", "__hash", "__marks")
    marks = decisions(docs, edits, fuzzy_chars).select(F.col("doc_id").alias(own), F.col("hash").alias(hashed), F.col("gone").alias(mark))
    joined = docs.join(marks, F.col("doc_id").eqNullSafe(F.col(own)) & F.xxhash64("text").eqNullSafe(F.col(hashed)), "left")
    text = (
        F.when(F.col(mark).isNull(), F.col("text"))
        .otherwise(F.expr(f"array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains({mark}, i)), '\\n')"))
    )
    if counts:
        every, dropped = fresh(docs, *counts)
        out = joined.withColumns(
            {
                every: F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"),
                dropped: F.coalesce(F.size(mark), F.lit(0)).cast("long"),
            }
        )
        return out.withColumn("text", text).drop(own, hashed, mark)
    out = joined.withColumn("text", text).where(F.col(mark).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(mark).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
