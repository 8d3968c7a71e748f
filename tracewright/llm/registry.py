"""Queries over the given tables, one per operator, and check SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import filteraudit, manifest
from tracewright.llm.common import table
from tracewright.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepare(spark), folder)

        QUERIES[name] = run
        if check:
            CHECKS[name] = check
        return build

    return register


@query("op5_packing")
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tracewright.llm.packing import pack
    from tracewright.llm.tokens import tokenizer_path

    return pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op6_minhash_near_dedup")
def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tracewright.llm.neardup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), size=4)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tracewright.llm.toxicity import scored_fold

    return scored_fold(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from tracewright.llm.langid import predicted_fold

    return predicted_fold(table(spark, folder, "documents"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from tracewright.llm.quality import scored_fold

    return scored_fold(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_benchmark_decontamination")
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from tracewright.llm.decontaminate import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op2_license_scans")
def op2_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    from tracewright.llm.licenses import scan

    return scan(table(spark, folder, "documents"))


@query("op1_sharding")
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from tracewright.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, folder, "documents"))


@query("op4_document_fingerprints")
def op4_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from tracewright.llm.merkle import edited_fingerprints

    return edited_fingerprints(table(spark, folder, "documents"))


@query("op10_warc")
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    from tracewright.llm.warc import round_trip

    return round_trip(table(spark, folder, "pages"))


@query("op13_filter_interaction_audit", filteraudit.CHECK_SQL)
def op13_filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filteraudit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_merkle_dataset_manifest", manifest.CHECK_SQL)
def op11_merkle_dataset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.tamper_audit(table(spark, folder, "documents"))


@query("op12_pii")
def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    from tracewright.llm.pii import span_report

    return span_report(table(spark, folder, "documents"))
