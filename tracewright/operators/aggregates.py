"""Aggregations over evidence, findings and run logs.

Distinct counts and sums combine on the map side, so a hot key costs one partial row per task. Members of a
group are never gathered into one list; callers that need them use the row-level functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.topk import first_per_key
from tracewright.functions import labels
from tracewright.functions.indicators import extract_iocs, request_indicators, script_indicators
from tracewright.functions.paths import registrable_domain
from tracewright.session import spread

# Our choice of thresholds where none is fixed.
BRUTE_FORCE_MIN = 5
MULTIPLEX_MIN_DOMAINS = 5


def value_counts(df: DataFrame, value: Column, k: int | None = None, keys=()) -> DataFrame:
    """Counts per value, most frequent first, then by value; empty and '-' are never counted."""
    counted = df.select(*keys, value.alias("value")).where("value <> '' AND value <> '-'").groupBy(*keys, "value").count()
    ranked = [F.desc("count"), "value"]
    return first_per_key(counted, keys, ranked, k) if k else counted.orderBy(*ranked)


def event_summary(df: DataFrame, keys=("channel", "eid"), us: str = "us") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def zeek_counts(df: DataFrame, keys=()) -> DataFrame:
    kind = F.col("log_kind")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_seen"),
        F.count_if(kind == "conn").alias("conn_count"),
        F.count_if(kind == "dns").alias("dns_count"),
        F.count_if(kind == "http").alias("http_count"),
        F.count_if(kind.isin("ssl", "tls")).alias("tls_count"),
    )


def zeek_top_hosts(df: DataFrame, k: int = 10, keys=()) -> DataFrame:
    """Connection ends and TLS server names, together; the k most frequent of each key."""
    kind = F.col("log_kind")
    named = F.when(kind == "conn", F.array("orig_h", "resp_h")).when(kind.isin("ssl", "tls"), F.array("server_name"))
    return value_counts(df.where(named.isNotNull()).select(*keys, F.explode(named).alias("h")), F.col("h"), k, keys)


def zeek_top_queries(df: DataFrame, k: int = 10, keys=()) -> DataFrame:
    """Names asked for; the k most frequent of each key."""
    return value_counts(df.where("log_kind = 'dns'"), F.col("query"), k, keys)


def conversations(pkts: DataFrame, keys=()) -> DataFrame:
    port = F.when(F.col("tcp_port") != "", F.col("tcp_port")).otherwise(F.col("udp_port"))
    rows = pkts.where("src <> '' OR dst <> ''").withColumn("dst_port", port)
    return rows.groupBy(*keys, "src", "dst", "dst_port", "proto").agg(F.count(F.lit(1)).alias("packets"))


def http_requests(pkts: DataFrame, keys=()) -> DataFrame:
    """Requests per (src, dst, host, method): first address seen, any cookie, count, time span."""
    stamped = F.when(F.col("ts") > 0, F.col("ts"))
    return (
        pkts.where("http_method <> ''")
        .groupBy(*keys, "src", "dst", F.col("http_host").alias("host"), F.col("http_method").alias("method"))
        .agg(
            F.min_by("http_uri", F.when(F.col("http_uri") != "", F.struct("pkt_no", "http_uri"))).alias("uri"),
            F.bool_or(F.col("cookie") != "").alias("has_cookie"),
            F.count(F.lit(1)).alias("requests"),
            F.min(stamped).alias("first_ts"),
            F.max(stamped).alias("last_ts"),
        )
    )


def web_indicator_rows(requests: DataFrame) -> DataFrame:
    """Requests that carry at least one exploit indicator."""
    return requests.withColumn("indicators", request_indicators(F.col("target"), F.col("user_agent"))).where(F.size("indicators") > 0)


def web_summary(requests: DataFrame, keys=()) -> DataFrame:
    """Hits per indicator and hits per attacking client, as kind/value/count rows, per `keys` (such as case and host)."""
    hits = web_indicator_rows(requests).select(*keys, F.col("client_ip"), "indicators")
    tagged = hits.select(*keys, F.explode(F.concat(
        F.transform("indicators", lambda i: F.struct(F.lit("indicator").alias("kind"), i.alias("value"))),
        F.array(F.struct(F.lit("client").alias("kind"), F.col("client_ip").alias("value"))),
    )).alias("e")).where("e.value <> ''")
    return tagged.groupBy(*keys, F.col("e.kind").alias("kind"), F.col("e.value").alias("value")).agg(F.count(F.lit(1)).alias("hits"))


def script_summary(lines: DataFrame, key: str = "path", keys=("case_id", "host")) -> DataFrame:
    """Per script: lines per indicator summed up, and whether it reads as a web shell.

    A script is a path on a host of a case: those of `keys` that the lines have belong to it.
    """
    rows = lines.withColumn("__i", script_indicators(F.col("line")))

    def has(name: str) -> Column:
        return F.bool_or(F.array_contains("__i", name))

    out = rows.groupBy(*[k for k in keys if k in lines.columns], key).agg(
        F.sum(F.size("__i")).alias("indicator_hits"),
        *[has(n).alias(n) for n in (
            "php_command_exec", "php_eval", "obfuscated_decode", "reverse_shell_socket", "error_suppression",
            "dotnet_process_start", "asp_eval", "file_upload_primitive", "request_driven_exec",
        )],
    )
    runs = F.col("php_eval") | F.col("php_command_exec")
    hides = F.col("obfuscated_decode") | F.col("reverse_shell_socket") | F.col("error_suppression")
    shell = F.col("request_driven_exec") | F.col("dotnet_process_start") | F.col("asp_eval") | (runs & hides)
    return out.withColumn("probable_webshell", shell)


def technique_density(findings: DataFrame) -> DataFrame:
    """Distinct hosts per technique."""
    named = findings.where("mitre_technique IS NOT NULL AND mitre_technique <> ''")
    return named.groupBy("mitre_technique").agg(F.count_distinct("host").alias("hosts"))


def outcome_distribution(df: DataFrame, column: str = "outcome") -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("?")).alias("outcome")).agg(F.count(F.lit(1)).alias("hosts"))


def cross_host_processes(ps: DataFrame, keep: Column, min_hosts: int = 2, keys=()) -> DataFrame:
    """Names seen on several hosts, counted per host first so a hot name shuffles as one row per host."""
    per_host = ps.where(keep).groupBy(*keys, "image_name", "host").agg(F.count(F.lit(1)).alias("__n"))
    return (
        per_host.groupBy(*keys, "image_name")
        .agg(F.count(F.lit(1)).alias("host_count"), F.sum("__n").alias("hits"), F.min("host").alias("first_host"))
        .where(F.col("host_count") >= min_hosts)
    )


def cross_host_hits(ps: DataFrame, keep: Column, min_hosts: int = 2, keys=()) -> DataFrame:
    """The process rows behind cross_host_processes, one row per process."""
    names = cross_host_processes(ps, keep, min_hosts, keys).select(*keys, "image_name", "host_count")
    return ps.where(keep).join(names, [*keys, "image_name"])


def distinct_roots(df: DataFrame, column: str, keys=()) -> DataFrame:
    known = df.where(F.coalesce(column, F.lit("")) != "")
    return known.groupBy(*keys).agg(F.count_distinct(column).alias("distinct_roots"), F.count(F.lit(1)).alias("total_roots"))


def modal_answers(scores: DataFrame, key: str = "criterion", answer: str = "answer") -> DataFrame:
    """Most frequent answer per criterion; ties go to the smallest answer."""
    per = scores.groupBy(key, answer).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(key).agg(
        F.sum("n").alias("host_count"),
        F.min_by(answer, F.struct((-F.col("n")).alias("a"), F.col(answer).alias("b"))).alias("modal_answer"),
        F.max("n").alias("modal_share"),
        F.count(F.lit(1)).alias("distinct_answers"),
    )


def credibility(actions: DataFrame, keys=("case_id", "pool")) -> DataFrame:
    """Share of replay-backed actions per pool, and that share with the fixed bonus factor."""
    backed = F.avg(F.when(F.col("action").isin("approved", "downgraded"), 1.0).otherwise(0.0))
    return actions.groupBy(*keys).agg(backed.alias("accuracy"), (backed * 1.2).alias("credibility"))


def case_outcome(findings: DataFrame, cases: DataFrame, keys=("case_id",)) -> DataFrame:
    """SUSPICIOUS, INDETERMINATE or NO_EVIL per case; a case without findings needs a substantive run."""
    severe = (F.col("confidence") == "INFERRED") & F.col("mitre_technique").rlike(r"^(T1014|T1055)(\.|$)")
    judged = findings.groupBy(*keys).agg(
        F.bool_or((F.col("confidence") == "CONFIRMED") | F.coalesce(severe, F.lit(False))).alias("__evil"),
        F.count(F.lit(1)).alias("findings"),
    )
    out = cases.join(judged, list(keys), "left")
    label = (
        F.when(F.col("__evil"), "SUSPICIOUS")
        .when(F.col("findings") > 0, "INDETERMINATE")
        .when(F.col("substantive"), "NO_EVIL")
        .otherwise("INDETERMINATE")
    )
    return out.select(*keys, F.coalesce("findings", F.lit(0)).alias("findings"), label.alias("outcome"))


def coverage_manifest(inventory: DataFrame, calls: DataFrame, keys=("case_id",)) -> DataFrame:
    """Per case and artifact class: supplied, attempted, parsed, failed, with record counts."""
    have = inventory.groupBy(*keys, "artifact_class").agg(F.count(F.lit(1)).alias("available"))
    did = calls.groupBy(*keys, "artifact_class").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("error").isNull()).alias("parsed"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.sum("records_seen").alias("records_seen"),
        F.sum("parse_errors").alias("parse_errors"),
    )
    both = have.join(did, [*keys, "artifact_class"], "full_outer")
    status = (
        F.when(F.coalesce("available", F.lit(0)) == 0, "not_supplied")
        .when(F.col("artifact_class") == "unknown", "unsupported")
        .when(F.col("parsed") > 0, "parsed")
        .when(F.col("failed") > 0, "failed")
        .otherwise("available")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("available", "attempted", "parsed", "failed", "records_seen", "parse_errors")]
    return both.select(*keys, "artifact_class", *zero, status.alias("status"))


def technique_coverage(targets: DataFrame, calls: DataFrame, findings: DataFrame, keys=("case_id",)) -> DataFrame:
    """finding, covered_no_finding or blind_spot per case and target technique; calls carry an artifact_class."""
    ran = calls.where("error IS NULL").select(*keys, "artifact_class").distinct()
    best = findings.groupBy(*keys, F.col("mitre_technique").alias("technique_id")).agg(
        F.max(labels.confidence_rank(F.col("confidence"))).alias("best_rank")
    )
    seen = targets.join(ran.withColumn("__ran", F.lit(True)), [*keys, "artifact_class"], "left")
    out = seen.join(best, [*keys, "technique_id"], "left")
    status = F.when(F.col("best_rank").isNotNull(), "finding").when(F.col("__ran"), "covered_no_finding").otherwise("blind_spot")
    return out.select(*keys, "technique_id", "artifact_class", "best_rank", status.alias("status"))


def entity_index(events: DataFrame, entities: str = "entities", us: str = "us", finding: str | None = None) -> DataFrame:
    """Events, first and last time, and linked findings per entity value."""
    wanted = [us, F.explode(entities).alias("kind", "value")] + ([F.col(finding).alias("__f")] if finding else [])
    rows = events.select(*wanted).where("value IS NOT NULL AND value <> ''")
    aggs = [F.count(F.lit(1)).alias("events"), F.min(us).alias("first_us"), F.max(us).alias("last_us")]
    if finding:
        aggs.append(F.count_distinct("__f").alias("linked_findings"))
    return rows.groupBy("kind", "value").agg(*aggs)


def host_groups(findings: DataFrame, us: str = "us") -> DataFrame:
    """Findings per host by tier, with time window and number of sources."""
    tier = F.col("confidence")
    return findings.groupBy("case_id", "host").agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.count_if(tier == "CONFIRMED").alias("confirmed"),
        F.count_if(tier == "INFERRED").alias("inferred"),
        F.count_if(tier == "HYPOTHESIS").alias("hypothesis"),
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
        F.count_distinct("artifact_path").alias("sources"),
    )


def image_host(path: Column, fallback: Column) -> Column:
    """Host key of an artifact path: files extracted from one image belong to that image's host."""
    image = F.regexp_extract(path, r"(?i)/extracted/[^/]+/([^/]+)/", 1)
    return F.when(image != "", image).otherwise(fallback)


def collect_techniques(findings: DataFrame, chain: DataFrame, targets: DataFrame, keys=("case_id",)) -> DataFrame:
    """Every technique a case refers to, whether it is claimed, and by how many findings."""
    cols = [*keys, "technique_id"]
    claimed = findings.where("mitre_technique <> ''").select(*keys, F.upper("mitre_technique").alias("technique_id"), "finding_id", "confidence")
    story = chain.where("mitre_technique <> ''").select(*keys, F.upper("mitre_technique").alias("technique_id"), "finding_id", "confidence")
    listed = targets.select(*keys, F.upper("technique_id").alias("technique_id"))
    rows = claimed.unionByName(story).withColumn("claimed", F.lit(True)).unionByName(listed.withColumn("claimed", F.lit(False)), allowMissingColumns=True)
    return rows.groupBy(*cols).agg(
        F.bool_or("claimed").alias("claimed"),
        F.count_distinct("finding_id").alias("claimed_by"),
        F.max(F.when(F.col("confidence").isNotNull(), labels.confidence_rank(F.col("confidence")))).alias("best_rank"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.bround(part / whole, 4))


def trust_score(findings: DataFrame, cases: DataFrame, keys=("case_id",)) -> DataFrame:
    """Citation and replay shares, tiers, actions, and approvals without a matching replay."""
    tried = F.col("replay_matched").isNotNull()
    passed = F.coalesce("replay_matched", F.lit(False))
    tier = F.upper(F.coalesce("confidence", F.lit("UNSPECIFIED")))
    action = F.lower(F.coalesce("verifier_action", F.lit("none")))
    per = findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("tool_call_id", F.lit("")) != "").alias("cited"),
        F.count_if(tried).alias("tried"),
        F.count_if(passed).alias("passed"),
        F.count_if(tier == "CONFIRMED").alias("confirmed"),
        F.count_if(tier == "INFERRED").alias("inferred"),
        F.count_if(tier == "HYPOTHESIS").alias("hypothesis"),
        F.count_if(action == "approved").alias("approved"),
        F.count_if((action == "approved") & ~passed).alias("approved_without_replay"),
    )
    out = cases.select(*keys).join(per, list(keys), "left").na.fill(0)
    return out.select(
        *keys, F.col("n").alias("findings"),
        _share(F.col("cited"), F.col("n")).alias("citation_coverage"),
        _share(F.col("passed"), F.col("tried")).alias("replay_pass_rate"),
        "confirmed", "inferred", "hypothesis", "approved", "approved_without_replay",
    )


def corroboration_report(classed: DataFrame, keys=("case_id",)) -> DataFrame:
    """Execution claims by distinct artifact classes behind them; rows carry is_execution, class_count, confidence."""
    claim = F.col("is_execution")
    sure = claim & (F.col("confidence") == "CONFIRMED")
    two = F.col("class_count") >= 2
    return classed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(claim).alias("execution_claims"),
        F.count_if(claim & two).alias("execution_two_class"),
        F.count_if(sure).alias("confirmed_execution"),
        F.count_if(sure & two).alias("confirmed_two_class"),
        F.count_if(sure & ~two).alias("confirmed_one_class"),
    )


def class_histogram(classed: DataFrame) -> DataFrame:
    return classed.where("is_execution").groupBy("class_count").agg(F.count(F.lit(1)).alias("claims"))


def self_score(audit: DataFrame, keys=("case_id",)) -> DataFrame:
    """Run signals from audit kinds; calls are folded to one row each before the case total."""
    kind = F.col("kind")
    call = F.coalesce("tool_call_id", F.lit(""))
    finding = kind == "finding_approved"
    per_call = audit.groupBy(*keys, call.alias("__call")).agg(
        F.bool_or((kind == "tool_call_start") & (call != "")).alias("started"),
        F.bool_or((kind == "tool_call_output") & (F.coalesce("output_hash", F.lit("")) != "")).alias("output"),
        F.count_if(finding).alias("f"),
        F.count_if(finding & (F.col("confidence") == "CONFIRMED")).alias("c"),
        F.count_if(finding & (F.col("confidence") == "INFERRED")).alias("i"),
        F.count_if(finding & (F.col("confidence") == "HYPOTHESIS")).alias("h"),
        F.count_if((kind == "verifier_action") & (F.col("action") == "rejected")).alias("rejected"),
        F.count_if(kind == "course_correction").alias("corrections"),
    )
    cited = F.when(F.col("__call") != "", F.col("f")).otherwise(0)
    out = per_call.groupBy(*keys).agg(
        F.sum("f").alias("findings"),
        F.count_if(F.col("started") & ~F.col("output")).alias("failures"),
        F.sum("corrections").alias("corrections"),
        F.sum("rejected").alias("rejected"),
        F.sum(cited).alias("cited"),
        F.sum(F.when(F.col("started"), cited).otherwise(0)).alias("traced"),
        F.sum("c").alias("__c"), F.sum("i").alias("__i"), F.sum("h").alias("__h"),
        F.count_if(F.col("started")).alias("__started"),
    )
    base = F.greatest(F.col("findings"), F.lit(1))

    def percent(col: str) -> Column:
        return F.floor(F.col(col) * 100 / base).cast("long")

    return out.select(
        *keys, "findings", "failures", "corrections", "rejected", "cited", "traced",
        percent("__c").alias("confirmed_percent"), percent("__i").alias("inferred_percent"), percent("__h").alias("hypothesis_percent"),
        ((F.col("__started") > 0) & (F.col("failures") == 0)).alias("reproducible"),
    )


def miss_rate(ledger: DataFrame, now_us: Column, days: int = 30) -> DataFrame:
    """Expert edits in the last days by type, with the total per distinct case."""
    recent = ledger.where((F.col("kind") == "expert_miss") & (F.col("us") >= now_us - F.lit(days * 86_400_000_000)))
    per = recent.groupBy(F.coalesce("edit_type", F.lit("unknown")).alias("edit_type")).agg(F.count(F.lit(1)).alias("misses"))
    cases = recent.where("case_id IS NOT NULL AND case_id <> ''").agg(F.count_distinct("case_id").alias("n")).scalar()
    return per.withColumn("cases", cases).withColumn("rate_per_case", F.col("misses") / F.greatest(F.col("cases"), F.lit(1)))


def internal_domains(mail: DataFrame, keys=("case_id",)) -> DataFrame:
    """The most frequent sender or recipient domain(s) of each store."""
    ends = mail.select(*keys, F.explode(F.array_append(F.col("to"), F.col("from_address"))).alias("a"))
    named = ends.select(*keys, registrable_domain(F.substring_index("a", "@", -1)).alias("domain"), F.instr("a", "@").alias("at"))
    per = named.where("at > 0").groupBy(*keys, "domain").agg(F.count(F.lit(1)).alias("addresses"))
    top = Window.partitionBy(*keys).orderBy(F.desc("addresses"))
    return per.withColumn("__r", F.rank().over(top)).where("__r = 1").drop("__r")


def multiplexed(requests: DataFrame, least: int = MULTIPLEX_MIN_DOMAINS, keys=()) -> DataFrame:
    """Destinations answering to several unrelated registrable domains."""
    rows = requests.where("host <> ''").withColumn("__d", registrable_domain(F.col("host")))
    return rows.groupBy(*keys, "dst").agg(F.count_distinct("__d").alias("domains"), F.count(F.lit(1)).alias("requests")).where(F.col("domains") >= least)


def brute_force(events: DataFrame, least: int = BRUTE_FORCE_MIN, keys=("host",)) -> DataFrame:
    """Failed logons per source, from `least` on."""
    failed = events.where("eid = 4625 AND source_ip <> ''")
    return failed.groupBy(*keys, "source_ip").agg(
        F.count(F.lit(1)).alias("failures"), F.count_distinct("account").alias("accounts"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    ).where(F.col("failures") >= least)


def grounding_summary(claims: DataFrame) -> DataFrame:
    return claims.agg(
        F.count(F.lit(1)).alias("claims_judged"),
        F.count_if(F.col("status") == "supported").alias("supported"),
        F.count_if(F.col("status") == "contradicted").alias("contradicted"),
        F.count_if("possible_hallucination").alias("possible_hallucinations"),
    )


def region_iocs(regions: DataFrame, keys=("host", "pid", "vad_start")) -> DataFrame:
    """Observables in the readable strings of memory samples, always as hypotheses; a sample is costly to read, so few splits are dealt out."""
    plain = F.decode(F.try_to_binary("sample_hex", F.lit("hex")), "ISO-8859-1")
    strings = F.array_join(F.regexp_extract_all(plain, F.lit("([\\x20-\\x7e]{6,})"), F.lit(1)), "\n")
    found = extract_iocs(strings)
    each = spread(regions).select(*keys, F.explode(found).alias("kind", "vals")).select(*keys, "kind", F.explode("vals").alias("value"))
    return each.withColumn("confidence", F.lit("HYPOTHESIS"))
