"""The queries of this subpackage's operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import jaccard, leaks, lm, packing, pii, quality, secrets, shards, tokens, urls
from lamina.llm.common import table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return tokens.count_documents(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_equal")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a real run comes from outside; this one is for the tables here."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), b"a key for the synthetic tables")
    n = lambda k: F.size(F.filter("entities", lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(n, pii.KINDS), F.transform("entities", lambda e: e["surrogate"]).alias("surrogates"), "text")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_token_counts,
        op2_secret_scan,
        op3_url_filter,
        op4_lm_scoring,
        op5_ngram_jaccard,
        op6_quality_rules,
        op7_pii_surrogates,
        op8_sharding,
        op9_best_fit_packing,
        op10_benchmark_decontamination,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from lamina.llm.sql import ORACLE

    return dict(ORACLE)
