"""License scan: a positional rare-token index over license templates, in DataFrame functions only.

Every whole text is lexed, and all its licence words (words of a template that are no function words) are looked up. Of
each template, a file's ``RARE`` licence words with the highest inverse document frequency, over all distinct texts, are
those that count: each place of such a word votes for (template, place in the file - place in the template). A template's
score is the number of words that its best offset has, as a share of ``RARE`` or of the template's licence words, where
it has fewer; it is a label if the score reaches ``min_score`` and its mandatory phrase stands in the file. Three base
phrases are always labels. A file's score is the best of all templates'. The index is a constant of some hundred rows:
one-line notices, and the customary headers and passages of the common licenses.

Null and empty texts have no words and score 0; equal texts get equal rows, and are looked up once; ties in frequency
go by word; repeated and null ids are rows of their own; an empty table gives an empty result; a very long text is one
array of words in its task; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, template, mandatory phrase.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this program is free software under the gnu general public license version 2", "gnu general public license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    # customary headers and passages; a phrase holds in that wording and in no other license's
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind express or implied"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", "apache license version 2 0 january 2004"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license", "gnu general public license as published by the free software foundation version 2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", "gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", "gnu general public license version 3 29 june 2007"),
    ("gpl-2", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", "gnu general public license version 2 june 1991"),
    ("lgpl-3", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation inc", "gnu lesser general public license version 2 1 february 1999"),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc", "gnu affero general public license version 3 19 november 2007"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "this software is provided by the copyright holders and contributors as is"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software released into the public domain"),
    ("cc0", "creative commons legal code cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "has waived all copyright and related or neighboring rights"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file"),
)
RARE = 6
MIN_SCORE = 0.6
#: Function words, which tell no license from other texts.
FUNCTION_WORDS = frozenset(
    "a an and any are as at be been but by can do for from has have if in inc is it its may must no not of on or other shall that the their this to under was were will with without you your".split()
)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _template_rows() -> list[tuple]:
    """(template, label, phrase, word, place, wanted) of the templates' licence words."""
    out = []
    for t, (label, text, phrase) in enumerate(TEMPLATES):
        words = text.split()
        own = set(words) - FUNCTION_WORDS
        out += [(t, label, phrase, word, at, min(RARE, len(own))) for at, word in enumerate(words) if word in own]
    return out


def _starts(words: str, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    parts = phrase.split()
    test = " AND ".join(f"get({words}, i + {k}) = '{p}'" for k, p in enumerate(parts))
    return F.expr(f"filter(sequence(0, greatest(size({words}) - {len(parts)}, 0)), i -> {test})")


def scan(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row a document."""
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    vocabulary = ", ".join(f"'{w}'" for w in sorted({r[3] for r in _template_rows()}))
    lexed = docs.select("doc_id", lower.alias("lower")).select("doc_id", "lower", F.regexp_extract_all("lower", F.lit(f"({_WORD})"), F.lit(1)).alias("words"))
    # a phrase cannot stand where one of its words does not occur in the text
    might = lambda p: reduce(lambda a, b: a & b, [F.col("lower").contains(w) for w in p.split()])
    starts = {p: F.when(might(p), _starts("words", p)) for p in BASE}
    at = F.flatten(F.array(*[F.coalesce(starts[p], F.array().cast("array<int>")) for p in BASE]))
    base = F.array(*[F.when(F.size(F.coalesce(starts[p], F.array().cast("array<int>"))) > 0, F.lit(label)) for p, label in BASE.items()])
    hits = F.expr(f"filter(transform(words, (w, i) -> struct(i AS pos, w AS word)), x -> x.word IN ({vocabulary}))")
    found = lexed.withColumns({"at": at, "base": F.array_sort(F.array_distinct(F.array_compact(base))), "hits": hits})
    holds = F.size("hits") > 0
    kept = written(
        found.select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.size("at").cast("long").alias("n_base"),
            F.array_min("at").cast("long").alias("first_word"),
            F.array_max("at").cast("long").alias("last_word"),
            "base",
            F.when(holds, F.sha2("lower", 256)).alias("file"),
            F.when(holds, F.col("hits")).alias("hits"),
            F.when(holds, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("line"),
        )
    )
    method = labels(kept.where("file IS NOT NULL").select("file", "hits", "line"), docs.sparkSession, min_score)
    # files without a licence word are spread, not one null key
    rows = kept.drop("hits", "line").withColumn("key", F.coalesce("file", F.xxhash64("doc_id").cast("string")))
    joined = rows.join(method.withColumnRenamed("file", "key"), "key", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def labels(files: DataFrame, spark, min_score: float = MIN_SCORE) -> DataFrame:
    """file, score and more (labels, or null) of files (file, hits: places of licence words, line: the words between blanks)."""
    index = spark.createDataFrame(_template_rows(), "template int, label string, phrase string, word string, tpos int, wanted int")
    files = files.dropDuplicates(["file"])
    tokens = files.select("file", F.inline("hits"))
    frequency = tokens.select("file", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))  # one row a licence word
    posted = tokens.join(F.broadcast(index.join(F.broadcast(frequency), "word")), "word")
    keys = ["file", "template"]
    by_word = (
        posted.repartition(*keys)
        .groupBy(*keys, "label", "phrase", "wanted", "df", "word")
        .agg(F.collect_set(F.col("pos") - F.col("tpos")).alias("offsets"))
    )
    ranked = by_word.groupBy(*keys, "label", "phrase", "wanted").agg(F.array_sort(F.collect_list(F.struct("df", "word", "offsets"))).alias("words"))
    rarest = ranked.select(*keys, "label", "phrase", "wanted", F.explode(F.flatten(F.transform(F.slice("words", 1, RARE), lambda w: w["offsets"]))).alias("offset"))
    votes = rarest.groupBy(*keys, "label", "phrase", "wanted", "offset").agg(F.count("*").alias("votes"))
    best = votes.groupBy(*keys, "label", "phrase", "wanted").agg(F.max("votes").alias("votes")).withColumn("score", F.col("votes") / F.col("wanted"))
    checked = best.where(F.col("score") >= min_score).join(files.select("file", "line"), "file")
    stands = F.col("line").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    named = checked.where(stands).groupBy("file").agg(F.array_sort(F.collect_set("label")).alias("more"))
    return best.groupBy("file").agg(F.max("score").alias("score")).join(named, "file", "left")
