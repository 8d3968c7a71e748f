"""From raw documents to packed training sequences: toxicity, language, near duplicates, benchmark passages, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, langid, neardup, packing, toxicity
from tracewright.llm.common import table, text_column
from tracewright.llm.tokens import tokenizer_path
from tracewright.session import prepare, shared_folder

# SQL can't express the trained stages; tests hold the near-duplicate and benchmark stages and what they leave against brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or toxicity stays below 0.5. Null and empty texts have none and stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = text_column(toxicity.scorer(model, report=2.0), lambda b: b.column(1).to_pylist(), "double", 0.0)
    return docs.filter(score(F.col("text")) < 0.5)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: those without letters (also null texts), or with no likely language, go."""
    named = text_column(langid.predictor(langid.fit(docs)), lambda b: [t != langid.UNDETERMINED and s >= 0.5 for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], "boolean", False)
    return docs.filter(named(F.col("text")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8 or more): of the smallest id, rows without id last.

    Rows are judged by id and text: an id with several texts loses only those that have a kept copy, and of a group's texts
    under one id the one with the smallest hash stays. Rows that repeat id and text leave one. Documents without shingles
    are in no group and stay.
    """
    kept = neardup.one_of_each(docs).withColumnsRenamed({"key": "_key", "th": "_th"})
    same = F.col("doc_id").eqNullSafe(F.col("_key")) & (F.xxhash64("text") == F.col("_th"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered to a half by tiles of three tokens or more."""
    kept = docs
    for block in decontaminate.blocks(table(spark, sf_dir, "benchmark"), "item_id", "text"):
        found = text_column(decontaminate.tiler(block, 3, 0.5), lambda b: [True] * b.num_rows, "boolean", False)
        kept = kept.filter(~found(F.col("text")))
    return kept


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents with their place in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("language_id", in_a_language), ("minhash_near_dedup", one_of_each_group), ("benchmark_decontamination", without_benchmarks), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again by the next."""
    prepare(spark)
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
