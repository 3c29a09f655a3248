"""The training-data pipeline: stages that each take documents and hand documents on; the last packs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import jaccard, leaks, packing, quality, secrets
from lamina.llm.common import Scratch, table
from lamina.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first quality rules keep, without their failing lines. A null or empty text has no words
    and goes; repeated rows are judged alike; a very long text is judged whole."""
    return quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id. Five-word shingles, similarity 0.8.
    Documents without words are no copies of each other and stay, as do rows without an id; of rows that repeat id and
    text one stays; rows that repeat an id with different texts stay or go together, and stay if one of them does."""
    given, docs = docs.columns, docs.toDF(*[c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)])
    linked = jaccard.link(docs.select("doc_id", "text"), width=5, percent=80)
    first = linked.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = docs.join(first, "doc_id")
    repeated = kept.filter("rows > 1").dropDuplicates(["doc_id", "text"])
    out = kept.filter("rows = 1").unionByName(repeated).select(*docs.columns)
    return out.unionByName(docs.filter("doc_id is null")).toDF(*given)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked, as it is or with other slot values. Null and empty texts are clean;
    repeated rows are judged alike."""
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every reported credential replaced by a mark. A null text stays null; repeated rows each change."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in training sequences. A null or empty text is one piece, its closing id;
    repeated rows are packed each on its own."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Template matching and packing are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
