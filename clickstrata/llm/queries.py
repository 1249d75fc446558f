"""The registered queries of this subpackage: each applies its operator to the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard, katz, licenses, lines, pages, quality, runs, search, secrets, sharding, sql
from .frames import table, written


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find(docs, "__s").select("doc_id", "__s.*")


def op2_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score(docs, F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = written(quality.measured_docs(docs, "m").drop("text"))
    judged = quality.verdict(measured, quality.limits(measured, "m"), "m")
    return judged.select(
        "doc_id",
        "m.n_words",
        "m.word_chars",
        "m.n_symbols",
        "m.n_dup_lines",
        "m.n_repeat_words",
        "m.base_failed",
        "m.kept",
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_lines, n_removed and the digest of the text that is left; every document has a row."""
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_log(chat.table_events(rows.unionByName(extra))))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), to="h")
    return hits.select(
        "doc_id",
        "h.n_words",
        "h.n_hit",
        "h.n_items",
        "h.items_sha256",
        (F.col("h.n_hit") > 0).alias("contaminated"),
        F.col("h.spans").alias("spans"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build(table(spark, sf_dir, "documents"))
    return search.search(index, table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.detect(table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def queries() -> dict:
    return {
        f.__name__: f for f in (
            op1_secret_scan,
            op2_katz_score,
            op3_ngram_jaccard,
            op4_quality_rules,
            op5_line_dedup,
            op6_byte_bpe,
            op7_feistel_shards,
            op8_license_scan,
            op9_chat_format,
            op10_decontamination,
            op11_ranked_search,
            op12_periodic_runs,
            op13_html_text,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_jaccard": sql.NGRAM_JACCARD,
        "op4_quality_rules": sql.QUALITY_RULES,
        "op5_line_dedup": sql.LINE_DEDUP,
        "op7_feistel_shards": sql.FEISTEL_SHARDS,
        "op8_license_scan": sql.LICENSE_SCAN,
        "op9_chat_format": sql.CHAT_FORMAT,
        "op10_decontamination": sql.DECONTAMINATION,
        "op11_ranked_search": sql.RANKED_SEARCH,
        "op12_periodic_runs": sql.PERIODIC_RUNS,
        "op13_html_text": sql.HTML_TEXT,
    }
