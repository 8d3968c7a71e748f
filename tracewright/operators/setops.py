"""Unions, differences and deduplication of evidence and lead tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_timeline(*tables: DataFrame) -> DataFrame:
    """Rows of different artifact tables in one timeline; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def dedup_leads(leads: DataFrame, keys, order) -> DataFrame:
    """One lead per key: the first along `order`, chosen by an aggregate so a hot key stays small."""
    others = [c for c in leads.columns if c not in keys]
    first = leads.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__r"), F.count(F.lit(1)).alias("occurrences"))
    return first.select(*keys, "__r.*", "occurrences")


def view_counts(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Rows per key in each of two views, by one grouped union instead of a join."""
    both = a.select(*keys, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*keys, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    return both.groupBy(*keys).agg(F.sum("__a").alias("in_a"), F.sum("__b").alias("in_b"))


def view_minus(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Keys of a that b does not have."""
    return view_counts(a, b, keys).where("in_a > 0 AND in_b = 0").select(*keys)


def bait_set(violations: DataFrame, denylisted: DataFrame, keys=("case_id",)) -> DataFrame:
    """Distinct findings that assert planted bait, per case."""
    cols = [*keys, "finding_id", "description"]
    both = violations.select(*cols).unionByName(denylisted.select(*cols)).distinct()
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("planted"))


def unrecovered(calls: DataFrame, keys=("case_id",)) -> DataFrame:
    """Tools that failed and never succeeded; rejected and skipped calls do not count as failures."""
    bad = F.col("error").isNotNull() & ~F.coalesce("rejected", F.lit(False)) & ~F.coalesce("skipped", F.lit(False))
    per = calls.groupBy(*keys, "tool").agg(F.bool_or(bad).alias("failed"), F.bool_or(F.col("error").isNull()).alias("ok"))
    return per.where("failed AND NOT ok").select(*keys, "tool")
