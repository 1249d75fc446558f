"""Reproducible shuffle into shards: a keyed Feistel permutation with cycle walking over row numbers.

Rows get global numbers in a total order (doc_id, size, checksum, second hash). Equal rows are counted
first, so a key that holds a third of the table is one row in the range shuffle. Number n goes to
p = perm(n) in [0, total): shard p mod shards, slot p div shards. Counts differ by at most one and slots have
no gaps. place() computes shard and slot of one number without Spark. Equal rows get their numbers by ranges of
``RANGE``, which are dealt to tasks before they become rows, so no row or task holds all copies.

Null texts have size 16 and the checksum of no bytes; null ids come first; rows equal in all four values are
interchangeable; an empty table gives an empty result; of very long texts only size and checksums are moved; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import written
from .hashing import mix

SHARDS = 40
SEED = 20240229
ROUNDS = 4
RANGE = 10_000  # numbers of equal rows that one row stands for


def permute(numbers: np.ndarray, total: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """perm(numbers) in [0, total). The Feistel domain is the least even power of two that holds total, so a walk takes under four steps on average."""
    half = np.uint64(max(1, ((max(total, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed))

    def once(x):
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (mix(right + key) & mask)
        return (left << half) | right

    out = once(numbers.astype(np.uint64))
    outside = np.flatnonzero(out >= total)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= total]
    return out.astype(np.int64)


def place(number: int, total: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    p = int(permute(np.array([number]), total, seed)[0])
    return p % shards, p // shards


def numbered(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Distinct ``keys`` rows with ``n`` (how often) and ``number`` (of the first), and the total."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    ranged = (
        counted.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
        .sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    )
    kept = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    parts = kept.groupBy("part").agg(F.sum("n").alias("rows"))
    before = parts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # a row a partition
    within = F.sum("n").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    total = parts.agg(F.sum("rows")).first()[0] or 0
    return kept.withColumn("within", within).join(F.broadcast(before), "part").withColumn(
        "number",
        F.col("before") + F.col("within"),
    ).drop("part", "at", "within", "before"), total


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row a document."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    rows, total = numbered(keyed, ["doc_id", "size", "text_crc32", "text_hash"])

    @F.pandas_udf("long")
    def perm(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, seed))

    ranges = rows.withColumn("k", F.explode(F.expr(f"sequence(0L, (n - 1) div {RANGE})")))
    ranges = ranges.withColumns({"number": F.expr(f"number + k * {RANGE}"), "n": F.expr(f"least(n - k * {RANGE}, {RANGE})")})
    if rows.where(F.col("n") > RANGE).limit(1).count():
        ranges = ranges.repartition("number")
    each = ranges.withColumn("number", F.explode(F.expr("sequence(number, number + n - 1)")))
    p = each.withColumn("p", perm("number"))
    return p.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("p") % shards).cast("int").alias("shard"),
        F.expr(f"p div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
