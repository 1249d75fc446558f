"""From raw documents to token ids: five stages, each over all rows its predecessor kept.

Null and empty texts fail the quality rules' base rule and go there; rows that repeat an id stand or fall together in
the near-duplicate stage and apart in the others; null ids are kept as they are; an empty table gives an empty
result; extra columns, whatever their names, stay up to the last stage. A text of any length is handled whole.
Every stage's result is a table in the shared folder, so a lost executor costs the tasks that ran on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickstrata.llm import bpe, decontaminate, jaccard, lines, quality
from clickstrata.llm.frames import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's limits."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier in the corpus; documents that lose all lines go."""
    return lines.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by their texts as they are now and as they were read.

    Line dedup leaves of a near copy only what differs, which is like no other text any more: its text as read tells.
    """
    return jaccard.clean(docs, table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text's bytes."""
    import public_tokenizers

    return bpe.checked(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]
#: Near-duplicate components, quantile sketches and BPE have no plain SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
