"""Pool merging, correlation, verification decisions, report checks and grounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import labels
from tracewright.functions.values import anchor_class, is_identity, json_leaves, value_match
from tracewright.operators.aggregates import credibility
from tracewright.operators.ordered import dense_index
from tracewright.operators.windows import pair_positions

# Fixed value: bonus factor for agreement across pools.
BONUS = 1.2


def judge(findings: DataFrame, actions: DataFrame, keep_solo: bool = True, keys=("case_id",)) -> DataFrame:
    """One row per claim: the i-th finding of pool A with the i-th of pool B, scored and tiered.

    Pool credibility always carries the bonus factor, as the rule this reproduces does, so scores can pass 1.
    """
    key = list(keys)
    group = [*key, "tool_call_id", "artifact_path", "mitre_technique", "claim"]
    rows = findings.withColumns({c: F.coalesce(c, F.lit("")) for c in ("tool_call_id", "artifact_path", "mitre_technique")})
    rows = rows.withColumn("claim", labels.claim_id(F.col("finding_id"))).withColumn("family", labels.artifact_family(F.concat_ws(" ", "artifact_path", "description")))
    slim = rows.select(*group, "pool_origin", "seq", "finding_id", "confidence", "description", "family")
    pairs = pair_positions(slim, group, "pool_origin", ["seq", "finding_id"], F.floor(F.col("seq") / 100_000))
    # Three families at most, so these sets stay small.
    families = rows.groupBy(*key).agg(
        F.collect_set(F.when(F.col("pool_origin") == "A", F.col("family"))).alias("fam_a"),
        F.collect_set(F.when(F.col("pool_origin") == "B", F.col("family"))).alias("fam_b"),
    )
    cred = credibility(actions, [*key, "pool"]).groupBy(*key).agg(
        F.max(F.when(F.col("pool") == "A", F.col("credibility"))).alias("cred_a"),
        F.max(F.when(F.col("pool") == "B", F.col("credibility"))).alias("cred_b"),
    )
    joined = pairs.join(families, key, "left").join(cred, key, "left")
    prior = F.lit(0.5 * BONUS)
    joined = joined.withColumn("cred_a", F.coalesce("cred_a", prior)).withColumn("cred_b", F.coalesce("cred_b", prior))
    a, b = F.col("a"), F.col("b")
    family = F.coalesce(a["family"], b["family"])

    def other(col: str) -> Column:
        return F.size(F.filter(col, lambda f: ~f.eqNullSafe(family))) > 0

    paired = a.isNotNull() & b.isNotNull()
    corroborated = paired & (other("fam_a") | other("fam_b"))
    boost = F.when(corroborated, F.lit(BONUS)).otherwise(F.lit(1.0))
    score_a = F.when(a.isNotNull(), labels.confidence_weight(a["confidence"]) * F.col("cred_a")).otherwise(0.0) * boost
    score_b = F.when(b.isNotNull(), labels.confidence_weight(b["confidence"]) * F.col("cred_b")).otherwise(0.0) * boost
    merged = (score_a + score_b) / F.greatest(F.col("cred_a") + F.col("cred_b"), F.lit(1e-9))
    take_a = a.isNotNull() & (b.isNull() | (F.length(a["description"]) >= F.length(b["description"])))
    chosen = F.when(take_a, a).otherwise(b)
    kept = ~paired & chosen["confidence"].isin("CONFIRMED", "INFERRED") & F.lit(keep_solo)
    return joined.select(
        *group, "pair_no",
        chosen["finding_id"].alias("finding_id"),
        F.when(kept, chosen["confidence"]).otherwise(labels.tier_for(merged)).alias("confidence"),
        F.when(paired, "merged").when(a.isNotNull(), "A").otherwise("B").alias("pool_origin"),
        score_a.alias("score_a"), score_b.alias("score_b"), merged.alias("merged_confidence"), corroborated.alias("corroborated"),
    )


# Words that name the artifacts behind an execution claim.
AMCACHE = r"\bamcache\b"
PREFETCH = r"\bprefetch\b"
SHIMCACHE = r"\b(?:shimcache|appcompatcache)\b"
USERASSIST = r"\buserassist\b"
EXACT_PATH = r"\bmft\b.*\bexact executable\b.*\bsame path\b"
TELEMETRY = r"\b(?:sysmon|edr|carbon[\s-]?black|crowdstrike)\b"


def correlate(findings: DataFrame, exact_path_counts: bool = True) -> DataFrame:
    """Execution claims keep their tier only with independent artifacts named in the text."""
    low = F.lower("description")
    amcache, prefetch, shimcache = low.rlike(AMCACHE), low.rlike(PREFETCH), low.rlike(SHIMCACHE)
    userassist, telemetry = low.rlike(USERASSIST), low.rlike(TELEMETRY)
    strong = (prefetch & (amcache | shimcache | userassist)) | telemetry
    if exact_path_counts:
        strong = strong | (userassist & low.rlike(EXACT_PATH))
    claim = labels.is_execution_claim(F.col("description"), F.col("mitre_technique"))
    catalogue_only = amcache & ~prefetch & ~shimcache & ~telemetry
    reason = (
        F.when(~claim, "not_execution").when(catalogue_only, "catalogue_only").when(strong, "corroborated").otherwise("single_class")
    )
    action = F.when(reason.isin("not_execution", "corroborated"), "kept").otherwise("downgraded")
    tier = F.when(action == "kept", F.col("confidence")).otherwise(labels.downgrade(F.col("confidence")))
    return findings.withColumns({"is_execution": claim, "action": action, "reason": reason, "correlated_confidence": tier})


def _read(findings: DataFrame, outputs: DataFrame, values: Column, keys) -> DataFrame:
    """Assertions of each finding beside the leaves their paths reach.

    The distinct paths that all findings of a call ask for go to that call's output as one list, so an output is moved and parsed once,
    whatever the number of its findings; the leaves of each path then meet the assertions again. A call without output has no leaves.
    """
    call = [*keys, "tool_call_id"]
    asked = findings.select(*call, "finding_id", F.explode(values).alias("v")).withColumn("path", F.col("v.path"))
    # Findings of one call mostly ask for the same paths, so the lists are made distinct before they are joined up.
    lists = findings.select(*call, F.array_sort(F.array_compact(F.array_distinct(F.transform(values, lambda v: v["path"])))).alias("paths"))
    wanted = lists.groupBy(*call).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("paths")))).alias("paths"))
    held = wanted.join(outputs.select(*call, "output"), call)
    met = held.withColumn("__leaves", json_leaves(F.col("output"), F.col("paths"))).withColumn("__pair", F.explode(F.arrays_zip("paths", "__leaves")))
    leaves = met.select(*call, F.col("__pair.paths").alias("path"), F.col("__pair.__leaves").alias("leaves"))
    empty = F.array().cast(leaves.schema["leaves"].dataType)
    return asked.join(leaves, [*call, "path"], "left").select(*keys, "finding_id", "v", F.coalesce("leaves", empty).alias("leaves"))


def check_entailment(findings: DataFrame, outputs: DataFrame, keys=("case_id",)) -> DataFrame:
    """Per finding with asserted values: misses, hard and identity misses, and over-counts."""
    rows = _read(findings, outputs, F.col("asserted_values"), list(keys))
    v = F.col("v")
    hits = F.size(F.filter("leaves", lambda leaf: value_match(v["expected"], leaf, v["match"])))
    miss = F.col("hits") == 0
    # The class of a value counts only where it is missed.
    rows = rows.withColumn("hits", hits).withColumn("hard", F.when(miss, anchor_class(v["expected"], v["match"]) == "hard")).withColumn("identity", F.when(miss, is_identity(v["expected"], v["match"])))
    return rows.groupBy(*keys, "finding_id").agg(
        F.count(F.lit(1)).alias("asserted"),
        F.count_if(miss).alias("misses"),
        F.count_if(miss & F.col("hard")).alias("hard_misses"),
        F.count_if(miss & F.col("identity")).alias("identity_misses"),
        F.count_if(~miss & v["count"].isNotNull() & (F.col("hits") < v["count"])).alias("over_counts"),
    )


def check_expectation(findings: DataFrame, outputs: DataFrame, keys=("case_id",)) -> DataFrame:
    """A prediction is refuted only if its path exists and nothing there agrees."""
    values = F.when(F.col("expectation").isNotNull(), F.array("expectation")).otherwise(F.array().cast("array<struct<path:string,expected:string,match:string,count:int>>"))
    rows = _read(findings, outputs, values, list(keys))
    v = F.col("v")
    agree = F.exists("leaves", lambda leaf: value_match(v["expected"], leaf, v["match"]))
    return rows.select(*keys, "finding_id", ((F.size("leaves") > 0) & ~agree).alias("refuted"))


def drift(expected: Column, actual: Column, error: Column) -> Column:
    """replay_error, exact_match or material_drift; empty digests never match."""
    some = F.coalesce(error, F.lit("")) != ""
    same = (F.coalesce(expected, F.lit("")) != "") & (expected == actual)
    return F.when(some, "replay_error").when(F.coalesce(same, F.lit(False)), "exact_match").otherwise("material_drift")


def verify(findings: DataFrame, replays: DataFrame, entailment: DataFrame | None = None, expectation: DataFrame | None = None, second_pass: bool = False, keys=("case_id",)) -> DataFrame:
    """approved, downgraded or rejected per finding, from citation, record, replay and asserted values."""
    key = list(keys)
    rows = findings.join(replays.select(*key, "tool_call_id", "expected_sha256", "actual_sha256", "error", F.lit(True).alias("recorded")), [*key, "tool_call_id"], "left")
    if entailment is not None:
        rows = rows.join(entailment.select(*key, "finding_id", "misses", "identity_misses", "over_counts"), [*key, "finding_id"], "left")
    else:
        rows = rows.withColumns({c: F.lit(0) for c in ("misses", "identity_misses", "over_counts")})
    if expectation is not None:
        rows = rows.join(expectation.select(*key, "finding_id", "refuted"), [*key, "finding_id"], "left")
    else:
        rows = rows.withColumn("refuted", F.lit(False))
    state = drift(F.col("expected_sha256"), F.col("actual_sha256"), F.col("error"))
    firm = (F.col("confidence") == "CONFIRMED") & F.lit(not second_pass)
    softer = F.when(firm, "rejected").otherwise("downgraded")
    reason = (
        F.when(F.coalesce("tool_call_id", F.lit("")) == "", "missing_citation")
        .when(F.col("recorded").isNull(), "missing_audit_record")
        .when(state == "replay_error", "replay_error")
        .when(state == "material_drift", "drift")
        .when(F.coalesce("identity_misses", F.lit(0)) > 0, "identity_miss")
        .when(F.coalesce("misses", F.lit(0)) > 0, "value_miss")
        .when(F.coalesce("over_counts", F.lit(0)) > 0, "over_count")
        .when(F.coalesce("refuted", F.lit(False)), "refuted")
        .otherwise("match")
    )
    action = (
        F.when(reason.isin("missing_citation", "missing_audit_record", "replay_error", "identity_miss"), "rejected")
        .when(reason.isin("drift", "value_miss", "refuted"), softer)
        .when(reason == "over_count", "downgraded")
        .otherwise("approved")
    )
    return rows.select(*key, "finding_id", "confidence", action.alias("action"), reason.alias("reason"))


def rebinds(claimed: Column, call_paths: Column) -> Column:
    """Does the artifact a finding names equal a path its call read, whole or by file name."""
    norm = F.replace(F.trim(claimed), F.lit("\\"), F.lit("/"))

    def same(path: Column) -> Column:
        other = F.replace(path, F.lit("\\"), F.lit("/"))
        return (norm == other) | (F.substring_index(norm, "/", -1) == F.substring_index(other, "/", -1))

    return F.exists(call_paths, same)


def contradiction_rows(counts: DataFrame, keys=("case_id",)) -> DataFrame:
    """Numbered report rows: one per finding and rule that has contradicting partners."""
    rules = F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(r).alias("reason"), F.col(r).alias("partners")) for i, r in enumerate(("opposite_tier", "other_technique", "low_overlap"), 1)])
    each = counts.select(*keys, "finding_id", F.explode(rules).alias("r")).select(*keys, "finding_id", "r.*").where("partners > 0")
    numbered = dense_index(each, list(keys), ["finding_id", "rule_no"], F.substring("finding_id", 1, 6), "n", start=1)
    return numbered.withColumn("contradiction_id", F.format_string("ctr-%04d", F.col("n"))).drop("n", "rule_no")


def ablate(classed: DataFrame, classes, keys=("case_id",)) -> DataFrame:
    """Confirmed execution claims that would lose a tier if one artifact class were missing."""
    claim = F.col("is_execution") & (F.col("confidence") == "CONFIRMED")
    dropped = F.explode(F.array(*[F.lit(c) for c in classes])).alias("dropped_class")
    rows = classed.where(claim).select(*keys, "finding_id", "confidence", "classes", dropped)
    left = F.size(F.array_remove("classes", F.col("dropped_class")))
    before = F.when(F.size("classes") >= 2, F.col("confidence")).otherwise(labels.downgrade(F.col("confidence")))
    after = F.when(left >= 2, F.col("confidence")).otherwise(labels.downgrade(F.col("confidence")))
    return rows.withColumn("from_tier", before).withColumn("to_tier", after).where("from_tier <> to_tier").select(*keys, "finding_id", "dropped_class", "from_tier", "to_tier")


# Exfiltration wording, and classes for its two prongs.
EXFIL_WORDS = ("exfil", "outbound", "uploaded", "stolen", "data theft", "staging directory")
PRESENCE_CLASSES = ("mft", "registry", "usnjrnl", "prefetch", "lnk", "jumplist", "shellbags", "disk", "filesystem", "memory")
EGRESS_CLASSES = ("network", "pcap", "zeek", "sysmon_network")
EITHER_CLASSES = ("velociraptor",)


def exfil_prongs(classes: Column) -> Column:
    """(presence, egress, both): presence on the host and movement off it, from different classes."""
    presence = F.arrays_overlap(classes, F.array(*[F.lit(c) for c in PRESENCE_CLASSES]))
    egress = F.arrays_overlap(classes, F.array(*[F.lit(c) for c in EGRESS_CLASSES]))
    either = F.arrays_overlap(classes, F.array(*[F.lit(c) for c in EITHER_CLASSES]))
    out = (egress | (either & presence)), (presence | (either & egress))
    return F.struct(presence.alias("presence"), egress.alias("egress"), (out[0] & out[1]).alias("both"))


def exfil_gate(classed: DataFrame) -> DataFrame:
    """Exfiltration claims and whether both prongs stand."""
    low = F.lower("description")
    claims = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in EXFIL_WORDS])
    return classed.where(claims).withColumn("prongs", exfil_prongs(F.col("classes"))).withColumn("stands", F.col("prongs.both"))


def report_qa(classed: DataFrame, timeline: DataFrame, keys=("case_id",)) -> DataFrame:
    """Check rows per case: number of offending findings or events, and PASS or FAIL."""
    key = list(keys)
    low = F.lower("description")
    claim = labels.text_claims_execution(F.col("description"))
    exfil = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in EXFIL_WORDS])
    per = classed.groupBy(*key).agg(
        F.count_if(F.coalesce("tool_call_id", F.lit("")) == "").alias("uncited_finding"),
        F.count_if(claim & (F.col("confidence") == "CONFIRMED") & (F.size("classes") < 2)).alias("single_class_execution"),
        F.count_if(exfil & ~exfil_prongs(F.col("classes"))["both"]).alias("one_prong_exfiltration"),
        F.count_if((F.col("confidence") == "HYPOTHESIS") & ~low.startswith("hypothesis:")).alias("unmarked_hypothesis"),
    )
    stray = timeline.groupBy(*key).agg(F.count_if(F.coalesce("tool_call_id", F.lit("")) == "").alias("uncited_event"))
    both = per.join(stray, key, "full_outer").na.fill(0)
    names = ("uncited_finding", "single_class_execution", "one_prong_exfiltration", "unmarked_hypothesis", "uncited_event")
    each = both.select(*key, F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("offending")) for n in names])).alias("c"))
    return each.select(*key, "c.*").withColumn("status", F.when(F.col("offending") == 0, "PASS").otherwise("FAIL"))


# Report rules: name, what the text claims, the classes that alone don't bear it (empty: any), how many classes it needs.
REPORT_RULES = (
    ("execution_requires_two_classes", "execution", (), 2),
    ("pattern_only_execution", "execution", ("yara",), 2),
    ("memory_only_execution", "execution", ("memory",), 2),
    ("log_only_execution", "execution", ("evtx", "hayabusa", "sysmon"), 2),
    ("network_only_execution", "execution", ("network", "pcap", "zeek"), 2),
    ("network_only_exfiltration", "exfiltration", ("network", "pcap", "zeek", "sysmon_network"), 0),
    ("exfiltration_requires_two_prongs", "exfiltration", (), 0),
    ("uncited_finding", "uncited", (), 0),
    ("unmarked_hypothesis", "unmarked", (), 0),
)


def report_rules(spark) -> DataFrame:
    """The report rules as a table (check, claim, only, least)."""
    return spark.createDataFrame([(n, c, list(o), k) for n, c, o, k in REPORT_RULES], "check string, claim string, only array<string>, least int")


def report_offences(classed: DataFrame, timeline: DataFrame, rules: DataFrame | None = None, keys=("case_id",), event_id: str = "event_id") -> DataFrame:
    """(keys, check, offender, confidence, classes) of every finding or event that breaks a report rule, whatever its tier.

    What a finding claims is told from its text. A rule with `only` is broken by a claim all of whose classes are among those; one with
    `least` by a claim with fewer classes. Exfiltration without both prongs, missing citations and unmarked hypotheses are claims by themselves.
    """
    rules = report_rules(classed.sparkSession) if rules is None else rules
    low, classes = F.lower(F.coalesce("description", F.lit(""))), F.coalesce("classes", F.array().cast("array<string>"))
    exfil = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in EXFIL_WORDS])
    claims = F.array_compact(F.array(
        F.when(labels.text_claims_execution(F.col("description")), F.lit("execution")),
        F.when(exfil & ~F.coalesce(exfil_prongs(classes)["both"], F.lit(False)), F.lit("exfiltration")),
        F.when(F.coalesce("tool_call_id", F.lit("")) == "", F.lit("uncited")),
        F.when((F.col("confidence") == "HYPOTHESIS") & ~low.startswith("hypothesis:"), F.lit("unmarked")),
    ))
    said = classed.select(*keys, F.col("finding_id").alias("offender"), "confidence", classes.alias("classes"), F.explode(claims).alias("claim"))
    alone = (F.size("only") == 0) | ((F.size("classes") > 0) & (F.size(F.array_except("classes", "only")) == 0))
    few = (F.col("least") == 0) | (F.size("classes") < F.col("least")) | (F.size("only") > 0)
    broken = said.join(F.broadcast(rules), "claim").where(alone & few)
    stray = timeline.where(F.coalesce("tool_call_id", F.lit("")) == "").select(*keys, F.lit("uncited_event").alias("check"), F.col(event_id).cast("string").alias("offender"), F.lit(None).cast("string").alias("confidence"), F.array().cast("array<string>").alias("classes"))
    return broken.select(*keys, "check", "offender", "confidence", "classes").unionByName(stray)


def report_status(offences: DataFrame, cases: DataFrame, rules: DataFrame, keys=("case_id",)) -> DataFrame:
    """PASS or FAIL and the number of offences for every case and rule."""
    counts = offences.groupBy(*keys, "check").agg(F.count("*").alias("offending"))
    names = rules.select("check").unionByName(rules.sparkSession.createDataFrame([("uncited_event",)], "check string"))
    # A fixed list of rules beside each case.
    every = cases.select(*keys).distinct().withColumn("check", F.explode(F.array(*[F.lit(r[0]) for r in names.collect()])))
    out = every.join(counts, [*keys, "check"], "left").na.fill(0, ["offending"])
    return out.withColumn("status", F.when(F.col("offending") == 0, "PASS").otherwise("FAIL"))


def ground(techniques: DataFrame) -> DataFrame:
    """Status of claimed techniques after the knowledge-base join."""
    found = F.col("found")
    return techniques.where("claimed").withColumns({
        "status": F.when(found, "supported").otherwise("contradicted"),
        "possible_hallucination": ~found,
        "id_status": F.when(found & ~F.col("id_match"), "renumbered").otherwise("current"),
    })


def ioc_status(found: Column, malicious: Column) -> Column:
    return F.when(~found, "unknown").when(malicious > 0, "malicious").otherwise("clean")
