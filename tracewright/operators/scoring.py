"""Answer keys against runs: matching, recall and precision, negative controls, bounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.joins import eligible
from tracewright.operators.setops import unrecovered
from tracewright.session import cut_lineage

# Outcome words by polarity.
EVIL = ("CONFIRMED_EVIL", "SUSPICIOUS", "SUSPICION", "EVIL")
BENIGN = ("NO_EVIL", "BENIGN")
NEUTRAL = ("UNKNOWN", "INDETERMINATE")


def outcome_consistent(run: Column, key: Column) -> Column:
    """A neutral run matches only a neutral key, a definite run never does; otherwise polarity must agree."""
    r, k = F.upper(F.coalesce(run, F.lit(""))), F.upper(F.coalesce(key, F.lit("")))
    return (
        F.when(r.isin(*NEUTRAL), k.isin(*NEUTRAL))
        .when(k.isin(*NEUTRAL), F.lit(False))
        .when(r.isin(*EVIL) & k.isin(*EVIL), F.lit(True))
        .when(r.isin(*BENIGN) & k.isin(*BENIGN), F.lit(True))
        .otherwise(r == k)
    )


def largest_matching(options: dict[str, list[str]]) -> dict[str, str]:
    """Item of each taken finding, as many as possible, earlier items and findings first.

    Items are placed one after another along augmenting paths. A path is kept on a stack of its own, so its length has no limit. Which
    findings are taken depends on this order, and scores count those left over: an algorithm by layers would place as many, but others.
    """
    taken: dict[str, str] = {}
    for first in options:
        tried: set[str] = set()
        # Each level: an item, its options that are left, and the finding it stands to take.
        path: list[list] = [[first, iter(options[first]), None]]
        while path:
            finding = next((f for f in path[-1][1] if f not in tried), None)
            if finding is None:
                path.pop()
                continue
            tried.add(finding)
            path[-1][2] = finding
            if finding not in taken:
                taken.update({f: item for item, _, f in path})
                break
            path.append([taken[finding], iter(options[taken[finding]]), None])
    return taken


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    """Maximum one-to-one assignment of one case's reduced edge list, earlier items and findings first."""
    options = {e: list(g.sort_values("finding_order")["finding_id"]) for e, g in pdf.sort_values("expected_order").groupby("expected_id", sort=False)}
    case = pdf["case_id"].iloc[0]
    return pd.DataFrame([(case, e, f) for f, e in largest_matching(options).items()], columns=["case_id", "expected_id", "finding_id"])


def match_expected(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """One-to-one assignment of expected items to run findings, as many as possible.

    Of each item's eligible findings only the first E are kept, E being the number of expected items of the case:
    an item with E or more options can always be placed, so the number matched is the true maximum, and a case
    hands at most E x E edges to one task, whatever the number of findings.
    """
    sizes = expected.groupBy("case_id").agg(F.count(F.lit(1)).alias("items"))
    first = Window.partitionBy("case_id", "expected_id").orderBy("finding_order", "finding_id")
    # First within 64 salts, then over what is left, so one popular item is not sorted whole in one task.
    salted = Window.partitionBy("case_id", "expected_id", "salt").orderBy("finding_order", "finding_id")
    few = edges.join(sizes, "case_id").withColumn("salt", F.abs(F.xxhash64("finding_id")) % 64)
    few = few.withColumn("nth", F.row_number().over(salted)).where("nth <= items")
    few = few.withColumn("nth", F.row_number().over(first)).where("nth <= items")
    return few.select("case_id", "expected_id", "expected_order", "finding_id", "finding_order").groupBy("case_id").applyInPandas(
        _assign, "case_id string, expected_id string, finding_id string"
    )


def score_runs(runs: DataFrame, findings: DataFrame, keys_table: DataFrame, expected: DataFrame, anti_facts: DataFrame, known_negatives: DataFrame, denylist: DataFrame, completed: DataFrame) -> DataFrame:
    """Recall, precision, F1, hallucination rate, planted bait and pass flag per case.

    Null means unmeasured: no denominator gives no number.
    """
    def spec(df: DataFrame, kind: str) -> DataFrame:
        return df.select("case_id", F.concat(F.lit(kind + ":"), "expected_id").alias("expected_id"), "description", "artifact_hint")

    # One pass over the findings for all three lists; the pairs found are few and are read several times below.
    specs = spec(expected, "ex").unionByName(spec(anti_facts, "af")).unionByName(spec(known_negatives, "kn"))
    pairs = cut_lineage(eligible(specs, findings).select("case_id", "finding_id", F.substring("expected_id", 1, 2).alias("kind"), F.substr("expected_id", F.lit(4)).alias("expected_id")))
    edges = pairs.where("kind = 'ex'").drop("kind").join(expected.select("case_id", "expected_id", "expected_order"), ["case_id", "expected_id"]).join(
        findings.select("case_id", "finding_id", "finding_order"), ["case_id", "finding_id"]
    )
    matched = cut_lineage(match_expected(edges, expected))
    # From here on a digest stands for the text, so texts are not shuffled.
    slim = findings.select("case_id", "finding_id", F.md5(F.coalesce("description", F.lit(""))).alias("text_digest"))
    extra = slim.join(matched.select("case_id", "finding_id"), ["case_id", "finding_id"], "left_anti")
    trips = pairs.where("kind <> 'ex'").groupBy("case_id", "finding_id").agg(F.bool_or(F.col("kind") == "af").alias("af"), F.bool_or(F.col("kind") == "kn").alias("kn"))
    flagged = extra.join(trips, ["case_id", "finding_id"], "left")
    flagged = flagged.withColumn("violation", F.when(F.col("af"), "anti_fact").when(F.col("kn"), "known_negative"))
    terms = denylist.select("case_id", F.lower("term").alias("term")).distinct()
    # The terms of one key are a short list by construction; they ride on the case row.
    listed = terms.groupBy("case_id").agg(F.collect_set("term").alias("terms"))
    said = findings.join(listed, "case_id").select(
        "case_id", "finding_id", F.md5("description").alias("text_digest"), F.filter("terms", lambda t: (t != "") & F.contains(F.lower(F.col("description")), t)).alias("hit_terms")
    ).where(F.size("hit_terms") > 0)
    per_extra = flagged.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("extra_n"),
        F.count_if(F.col("violation").isNotNull()).alias("violations"),
        F.count_if(F.col("violation") == "anti_fact").alias("anti_fact_violations"),
        F.count_if(F.col("violation") == "known_negative").alias("known_negative_violations"),
    )
    bait = flagged.where("violation IS NOT NULL").select("case_id", "finding_id", "text_digest").unionByName(said.select("case_id", "finding_id", "text_digest"))
    planted = bait.groupBy("case_id").agg(F.count_distinct("finding_id", "text_digest").alias("fp_planted"))
    asserted = said.select("case_id", F.explode("hit_terms").alias("t")).groupBy("case_id").agg(F.count_distinct("t").alias("denylist_terms_asserted"))

    def n(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))

    out = runs.join(keys_table, "case_id")
    for part in (
        n(expected, "expected_n"), n(matched, "recalled_n"), n(findings, "run_finding_n"), per_extra, planted, asserted,
        n(anti_facts, "anti_fact_total"), n(known_negatives, "known_negative_total"), n(denylist, "denylist_terms_total"), completed.select("case_id", "run_completed"),
    ):
        out = out.join(part, "case_id", "left")
    counts = [c for c in out.columns if c.endswith(("_n", "_total", "violations", "_asserted")) or c == "fp_planted"]
    out = out.na.fill(0, counts).withColumn("run_completed", F.coalesce("run_completed", F.lit(True)))
    out = out.withColumn("outcome_match", outcome_consistent(F.col("run_outcome"), F.col("key_outcome")))
    col = F.col
    recall = F.when(col("expected_n") > 0, F.bround(col("recalled_n") * 100 / col("expected_n"))).otherwise(F.when(col("run_completed") & col("outcome_match"), 100.0).otherwise(0.0))
    out = out.withColumn("recall_percent", recall).withColumn("false_positives", F.when(col("exhaustive"), col("extra_n")).otherwise(col("violations")))
    precision = F.try_divide(col("recalled_n"), col("recalled_n") + col("false_positives"))
    share = F.when(col("expected_n") > 0, col("recalled_n") / F.greatest(col("expected_n"), F.lit(1))).otherwise(col("recall_percent") / 100)
    f1 = F.when(precision.isNotNull(), F.coalesce(F.bround(F.try_divide(2 * precision * share, precision + share), 4), F.lit(0.0)))
    out = out.withColumns({
        "precision_percent": F.bround(precision * 100),
        "f1": f1,
        "hallucination_rate": F.bround(F.try_divide(col("false_positives"), col("run_finding_n")), 4),
    })
    ready = (col("scoring_status") != "not_ready") & col("min_recall_percent").isNotNull()
    passed = F.when(ready, (col("recall_percent") >= col("min_recall_percent")) & col("outcome_match") & (col("fp_planted") == 0))
    return negative_coverage(out.withColumn("scoreable", ready).withColumn("pass", passed))


def negative_coverage(df: DataFrame) -> DataFrame:
    """Share of negative controls a run respected, each class capped at its total; no controls is full coverage."""
    col = F.col
    total = col("anti_fact_total") + col("known_negative_total") + col("denylist_terms_total")
    bad = (
        F.least("anti_fact_violations", "anti_fact_total")
        + F.least("known_negative_violations", "known_negative_total")
        + F.least("denylist_terms_asserted", "denylist_terms_total")
    )
    percent = F.when(total == 0, F.lit(100.0)).otherwise(F.bround((total - bad) * 100 / F.greatest(total, F.lit(1))))
    return df.withColumns({"controls_total": total, "controls_respected": total - bad, "control_coverage_percent": percent})


def run_completed(calls: DataFrame, cases: DataFrame) -> DataFrame:
    """A run is complete unless its heartbeat ended early or a tool failed and never succeeded."""
    lost = unrecovered(calls).groupBy("case_id").agg(F.count(F.lit(1)).alias("unrecovered_tools"))
    out = cases.join(lost, "case_id", "left").na.fill(0, ["unrecovered_tools"])
    return out.withColumn("run_completed", ~F.coalesce("terminated_partial", F.lit(False)) & (F.col("unrecovered_tools") == 0))


# Bounds a score can be held to.
FLOORS = {"min_recall_percent": "recall_percent", "min_precision_percent": "precision_percent"}
CEILINGS = {"max_hallucination_rate": "hallucination_rate", "max_fp_planted": "fp_planted"}


def check_bounds(scores: DataFrame, bounds: dict) -> DataFrame:
    """One row per case and bound; a floor fails on null, a ceiling passes on null, an unknown bound is an error."""
    known = {**FLOORS, **CEILINGS, "require_outcome_match": "outcome_match"}
    unknown = [name for name in bounds if name not in known]
    if unknown:
        raise ValueError(f"unknown bounds: {unknown}")
    rows = []
    for name, limit in bounds.items():
        value = F.col(known[name])
        if name in FLOORS:
            ok, shown = F.coalesce(value >= limit, F.lit(False)), value.cast("double")
        elif name in CEILINGS:
            ok, shown = F.coalesce(value <= limit, F.lit(True)), value.cast("double")
        else:
            ok, shown = F.coalesce(value, F.lit(False)) | F.lit(not limit), value.cast("int").cast("double")
        rows.append(F.struct(F.lit(name).alias("bound"), shown.alias("value"), F.lit(float(limit)).alias("limit"), ok.alias("ok")))
    return scores.select("case_id", F.explode(F.array(*rows)).alias("b")).select("case_id", "b.*")
