"""Confidence tiers, claim ids, execution claims and severity ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence ranks and weights, tier thresholds.
CONFIDENCE_RANK = {"CONFIRMED": 2, "INFERRED": 1, "HYPOTHESIS": 0}
CONFIDENCE_WEIGHT = {"CONFIRMED": 1.0, "INFERRED": 0.6, "HYPOTHESIS": 0.3}
CONFIRMED_FROM = 0.80
INFERRED_FROM = 0.50

# Technique ids and phrases that make a finding an execution claim.
EXECUTION_TECHNIQUES = ("T1059", "T1106", "T1129", "T1203", "T1543", "T1547", "T1053")
EXECUTION_PHRASES = (
    r"\bexecut(?:ed|ion|ing)\b", r"\bran\b", r"\brun count\b", r"\bprocess creation\b",
    r"\binvok(?:ed|ation|ing)\b", r"\blaunch(?:ed|ing)\b", r"\bspawn(?:ed|ing)\b", r"\bstarted\b",
)

# Artifact families by word.
DISK_WORDS = ("disk", "filesystem", "registry", "mft", "prefetch", "amcache", "shimcache", "usnjrnl")
LOG_WORDS = ("log", "evtx", "sysmon", "iis", "powershell")
MEMORY_WORDS = ("memory", "volatility", "vad")

# Alert levels, lowest first.
ALERT_LEVELS = ("informational", "low", "medium", "high", "critical")


def _case(value: Column, table: dict, default) -> Column:
    chain = reduce(lambda c, kv: c.when(value == kv[0], F.lit(kv[1])), table.items(), F)
    return chain.otherwise(F.lit(default))


def confidence_rank(confidence: Column) -> Column:
    """2, 1, 0; an unknown label ranks 1."""
    return _case(confidence, CONFIDENCE_RANK, 1)


def confidence_weight(confidence: Column) -> Column:
    return _case(confidence, CONFIDENCE_WEIGHT, 0.0)


def tier_for(score: Column) -> Column:
    return F.when(score >= CONFIRMED_FROM, "CONFIRMED").when(score >= INFERRED_FROM, "INFERRED").otherwise("HYPOTHESIS")


def downgrade(confidence: Column) -> Column:
    """One tier down; HYPOTHESIS and unknown labels stay."""
    return F.when(confidence == "CONFIRMED", "INFERRED").when(confidence == "INFERRED", "HYPOTHESIS").otherwise(confidence)


def claim_id(finding_id: Column) -> Column:
    """Finding id without its pool tag."""
    return F.regexp_replace(finding_id, "^f-[ABab]-", "")


def text_claims_execution(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(EXECUTION_PHRASES)), F.lit(False))


def is_execution_claim(text: Column, technique: Column) -> Column:
    by_id = F.coalesce(technique.rlike("^(" + "|".join(EXECUTION_TECHNIQUES) + ")"), F.lit(False))
    return text_claims_execution(text) | by_id


def artifact_family(text: Column) -> Column:
    """disk, log or memory by the words in the text, else null."""
    low = F.lower(text)
    return (
        F.when(low.rlike("|".join(DISK_WORDS)), "disk")
        .when(low.rlike("|".join(LOG_WORDS)), "log")
        .when(low.rlike("|".join(MEMORY_WORDS)), "memory")
    )


def level_rank(level: Column) -> Column:
    """Position of an alert level, null when unknown."""
    return _case(F.lower(level), {name: i for i, name in enumerate(ALERT_LEVELS)}, None)
