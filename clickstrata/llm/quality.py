"""Quality rules with thresholds learnt from the corpus by mergeable quantile sketches.

Each text gives word and line counts. For each language and source every ratio goes into a log-bucket
sketch: bucket ceil(log_gamma(ratio)), one count a bucket, zeros apart. Sketches merge by adding counts, so
map-side combining is exact, any order gives the same sketch, and a bucket's quantile is within gamma of the
true one. A group's upper limit is a factor times its ``quantile``, an upper one with zeros kept; documents that
fail the base rule are left out of the sketches, so plain junk moves no limit. Groups under ``min_rows`` rows take
their language's value, and languages under it the whole table's; a group's value counts up to ``SPREAD`` times
its language's, or the floor if that is more, so a source that is mostly junk does not learn its junk. Floors are the tolerance where a
whole language has next to none of a thing. Documents are then joined with the limits (one row a group, far fewer than documents).

Null or empty texts have no words and fail the base rule; null lang and source are groups of their own;
repeated rows are judged alike; an empty table gives an empty result; a very long text is measured whole, in memory
that grows with it. Extra columns stay; where one has the result's name, the result's gets an underscore behind it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import fresh, sliced, small_batches, tidy
from .hashing import Words, mix, windows

GAMMA = 1.02
QUANTILE = 0.9
FACTORS = {"symbol_ratio": 1.5, "dup_line_ratio": 3.0, "repeat_ratio": 8.0, "word_length": 1.4}
SPREAD = 2.0
MIN_ROWS = 200
#: No limit goes below these: documents under them are ordinary whatever their group looks like.
FLOORS = {"symbol_ratio": 0.02, "dup_line_ratio": 0.2, "repeat_ratio": 0.05, "word_length": 4.0}

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def line_counts(text: str) -> tuple[int, int]:
    """Lines with a word; those of them equal to an earlier one."""
    lines = [x for x in text.split("\n") if _HAS_WORD.search(x)]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: list[str]) -> pd.DataFrame:
    words = Words(texts, lower=False)
    hashes, first = words.hashes, words.first
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    # words in 3-word windows that occur again in the same text
    repeated = np.zeros(len(hashes), np.int64)
    triple = windows(hashes, 3)
    inside = np.flatnonzero(owner[: len(triple)] == owner[2:]) if len(triple) else np.zeros(0, np.int64)
    if len(inside):
        _, back, times = np.unique(triple[inside] ^ mix(owner[inside] + np.uint64(1)), return_inverse=True, return_counts=True)
        again = inside[times[back] > 1]
        for k in range(3):
            repeated[again + k] = 1
    sums = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[first])
    at = np.minimum(words.text_at, len(words.raw))
    by_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    lines = [line_counts(t) for t in texts]
    return pd.DataFrame({
        "n_words": counts,
        "word_chars": by_text(((words.raw & 0xC0) != 0x80) & ~words.space),
        "n_symbols": by_text(_SYMBOLS[words.raw]),
        "n_dup_lines": [d for _, d in lines],
        "n_lines": [n for n, _ in lines],
        "n_repeat_words": sums(repeated),
    }).astype("int64")


def metrics_udf():
    """A Pandas UDF of a text. Called nondeterministic, or Spark runs it once more in each filter on its result, in a Python worker of its own."""

    @F.pandas_udf(METRICS)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.concat([measure(part) for part in sliced(texts)] or [measure([])], ignore_index=True)
        tidy()
        return out

    return run.asNondeterministic()


def ratios(m: str) -> dict[str, Column]:
    c = lambda name: F.col(f"{m}.{name}").cast("double")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": over(c("n_symbols"), c("word_chars")),
        "dup_line_ratio": over(c("n_dup_lines"), c("n_lines")),
        "repeat_ratio": over(c("n_repeat_words"), c("n_words")),
        "word_length": over(c("word_chars"), c("n_words")),
    }


def sketch(df: DataFrame, keys: list[str], values: dict[str, Column], gamma: float = GAMMA) -> DataFrame:
    """keys, metric, bucket (null: zero or less), n: one mergeable log-bucket sketch a group and metric."""
    pairs = F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]))
    rows = df.select(*keys, pairs.alias("metric", "value"))
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / F.lit(math.log(gamma))).cast("long"))
    return rows.groupBy(*keys, "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], q: float, gamma: float = GAMMA) -> DataFrame:
    """keys, metric, value, total: each sketch's lower q-quantile (a bucket's mid value), so that in a small group the largest value alone sets no limit."""
    by = Window.partitionBy(*keys, "metric")
    run = by.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketches.withColumn("below", F.sum("n").over(run)).withColumn("total", F.sum("n").over(by))
    mid = F.coalesce(F.pow(F.lit(gamma), F.col("bucket")) * (2 / (1 + gamma)), F.lit(0.0))
    return (
        ranked.where(F.col("below") >= F.greatest(F.floor(F.col("total") * q), F.lit(1)))
        .groupBy(*keys, "metric")
        .agg(F.min(mid).alias("value"), F.first("total").alias("total"))
    )


def limits(measured: DataFrame, m: str, quantile: float = QUANTILE, factors: dict | None = None, floors: dict | None = None, min_rows: int = MIN_ROWS) -> DataFrame:
    """lang, source, and one map of metric to upper limit, per group that occurs."""
    factors, floors = factors or FACTORS, floors or FLOORS
    base = sketch(measured.where(~base_failed(m)), ["lang", "source"], ratios(m))
    own = quantiles(base, ["lang", "source"], quantile)
    of_lang = (
        quantiles(merge(base, ["lang"]), ["lang"], quantile)
        .select(
            F.col("lang").alias("lang2"),
            F.col("metric").alias("metric2"),
            F.col("value").alias("value2"),
            F.col("total").alias("total2"),
        )
    )
    of_all = quantiles(merge(base, []), [], quantile).select(F.col("metric").alias("metric3"), F.col("value").alias("value3"))
    joined = (
        own.join(of_lang, F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("metric") == F.col("metric2")), "left")
        .join(of_all, F.col("metric") == F.col("metric3"), "left")
    )
    wider = F.when(F.col("total2") >= min_rows, F.col("value2")).otherwise(F.col("value3"))
    of = lambda values: F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("metric"))
    typical = F.when(F.col("total") >= min_rows, F.least("value", F.greatest(wider, of(floors)) * SPREAD)).otherwise(wider)
    limit = F.greatest(typical * of(factors), of(floors))
    return (
        joined.groupBy("lang", "source")
        .agg(F.map_from_entries(F.collect_list(F.struct("metric", limit.alias("limit")))).alias("limits"))
    )


def base_failed(m: str) -> Column:
    n = F.col(f"{m}.n_words")
    return (n < 50) | (F.col(f"{m}.n_repeat_words") * 100 > n * 50)


def measured_docs(docs: DataFrame, to: str) -> DataFrame:
    return small_batches(docs).withColumn(fresh(docs, to)[0], metrics_udf()(F.col("text")))


def judge(docs: DataFrame, to: str = "quality", **params) -> DataFrame:
    """``docs`` with a struct column: the metrics, base_failed, kept.

    The texts are scanned twice, once for the sketches and once for the verdict: cheaper than to move them.
    A caller that needs no texts can write the metrics once and call limits() and verdict() on that table.
    """
    (to,) = fresh(docs, to)
    measured = measured_docs(docs, to)
    groups = limits(measured.select("lang", "source", to), to, **params)
    return verdict(measured, groups, to)


def verdict(measured: DataFrame, groups: DataFrame, to: str) -> DataFrame:
    lang, source, limit = fresh(measured, "__lang", "__source", "__limits")
    groups = groups.select(F.col("lang").alias(lang), F.col("source").alias(source), F.col("limits").alias(limit))
    joined = measured.join(groups, F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)), "left")
    within = F.lit(True)
    for name, value in ratios(to).items():
        within = within & (value <= F.coalesce(F.element_at(limit, F.lit(name)), F.lit(float("inf"))))
    full = F.struct(f"{to}.*", base_failed(to).alias("base_failed"), (~base_failed(to) & within).alias("kept"))
    return joined.withColumn(to, full).drop(lang, source, limit)


def clean(docs: DataFrame, **params) -> DataFrame:
    """The documents kept; all their columns stay."""
    (to,) = fresh(docs, "__quality")
    return judge(docs, to, **params).where(f"{to}.kept").drop(to)
