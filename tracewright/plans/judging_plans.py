"""Queries over findings and runs: merging, correlation, verification, coverage, grounding, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import labels
from tracewright.operators import aggregates, filters, joins, judging, recall, scoring, setops
from tracewright.plans.catalog import query
from tracewright.session import spread
from tracewright.plans.text_plans import _tokens_sql, _words_sql

_RANK = "CASE {0} WHEN 'CONFIRMED' THEN 2 WHEN 'INFERRED' THEN 1 WHEN 'HYPOTHESIS' THEN 0 ELSE 1 END"
_BLOB = "lower(concat(artifact_path, ' ', description))"
_FAMILY = f"CASE WHEN regexp_matches({_BLOB}, 'disk|filesystem|registry|mft|prefetch|amcache|shimcache|usnjrnl') THEN 'disk' WHEN regexp_matches({_BLOB}, 'log|evtx|sysmon|iis|powershell') THEN 'log' WHEN regexp_matches({_BLOB}, 'memory|volatility|vad') THEN 'memory' END"


def _actions(findings):
    return findings.select("case_id", F.col("pool_origin").alias("pool"), F.col("verifier_action").alias("action"))


@query(
    "pool_credibility",
    "SELECT case_id, pool_origin AS pool, round(avg(CASE WHEN verifier_action IN ('approved', 'downgraded') THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(1.2 * avg(CASE WHEN verifier_action IN ('approved', 'downgraded') THEN 1.0 ELSE 0.0 END), 6) AS credibility FROM findings GROUP BY 1, 2",
    uses=("findings",),
)
def _(src):
    out = aggregates.credibility(_actions(src.findings))
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("credibility", F.round("credibility", 6))


_JUDGE = f""", r AS (SELECT *, regexp_replace(finding_id, '^f-[ABab]-', '') AS claim, {_FAMILY} AS family FROM findings),
  p AS (SELECT *, row_number() OVER (PARTITION BY case_id, tool_call_id, artifact_path, mitre_technique, claim, pool_origin ORDER BY seq, finding_id) AS pair_no, CASE confidence WHEN 'CONFIRMED' THEN 1.0 WHEN 'INFERRED' THEN 0.6 WHEN 'HYPOTHESIS' THEN 0.3 ELSE 0 END AS w FROM r),
  fam AS (SELECT case_id, coalesce(list(DISTINCT family) FILTER (WHERE pool_origin = 'A' AND family IS NOT NULL), []) AS fa, coalesce(list(DISTINCT family) FILTER (WHERE pool_origin = 'B' AND family IS NOT NULL), []) AS fb,
        coalesce(1.2 * avg(CASE WHEN verifier_action IN ('approved', 'downgraded') THEN 1.0 ELSE 0.0 END) FILTER (WHERE pool_origin = 'A'), 0.6) AS ca, coalesce(1.2 * avg(CASE WHEN verifier_action IN ('approved', 'downgraded') THEN 1.0 ELSE 0.0 END) FILTER (WHERE pool_origin = 'B'), 0.6) AS cb FROM r GROUP BY 1),
  j AS (SELECT case_id, tool_call_id, artifact_path, mitre_technique, claim, pair_no, a.finding_id AS ia, b.finding_id AS ib, a.w AS wa, b.w AS wb, a.family AS ga, b.family AS gb, a.confidence AS ta, b.confidence AS tb, a.description AS da, b.description AS db
        FROM (SELECT * FROM p WHERE pool_origin = 'A') a FULL JOIN (SELECT * FROM p WHERE pool_origin = 'B') b USING (case_id, tool_call_id, artifact_path, mitre_technique, claim, pair_no)),
  k AS (SELECT j.*, ca, cb, ia IS NOT NULL AND ib IS NOT NULL AS paired, ia IS NOT NULL AND ib IS NOT NULL AND (len(list_filter(fa, lambda f: f IS DISTINCT FROM coalesce(ga, gb))) > 0 OR len(list_filter(fb, lambda f: f IS DISTINCT FROM coalesce(ga, gb))) > 0) AS corroborated FROM j JOIN fam USING (case_id)),
  s AS (SELECT *, coalesce(wa * ca, 0) * CASE WHEN corroborated THEN 1.2 ELSE 1.0 END AS score_a, coalesce(wb * cb, 0) * CASE WHEN corroborated THEN 1.2 ELSE 1.0 END AS score_b FROM k),
  m AS (SELECT *, (score_a + score_b) / greatest(ca + cb, 1e-9) AS merged, CASE WHEN ia IS NOT NULL AND (ib IS NULL OR length(da) >= length(db)) THEN ia ELSE ib END AS chosen, coalesce(ta, tb) AS solo FROM s)"""


@query(
    "judged_claims",
    _JUDGE + """ SELECT case_id, claim, pair_no, chosen AS finding_id, CASE WHEN NOT paired AND solo IN ('CONFIRMED', 'INFERRED') THEN solo WHEN merged >= 0.8 THEN 'CONFIRMED' WHEN merged >= 0.5 THEN 'INFERRED' ELSE 'HYPOTHESIS' END AS confidence,
      CASE WHEN paired THEN 'merged' WHEN ia IS NOT NULL THEN 'A' ELSE 'B' END AS pool_origin, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, round(merged, 6) AS merged_confidence, corroborated FROM m""",
    uses=("findings",),
)
def _(src):
    f = src.findings
    out = judging.judge(f, _actions(f)).withColumns({c: F.round(c, 6) for c in ("score_a", "score_b", "merged_confidence")})
    return out.select("case_id", "claim", "pair_no", "finding_id", "confidence", "pool_origin", "score_a", "score_b", "merged_confidence", "corroborated")


@query(
    "paired_positions",
    """, p AS (SELECT case_id, artifact_path, pool_origin, finding_id, row_number() OVER (PARTITION BY case_id, artifact_path, pool_origin ORDER BY seq, finding_id) AS pair_no FROM findings)
       SELECT case_id, artifact_path, pair_no, max(CASE WHEN pool_origin = 'A' THEN finding_id END) AS a_id, max(CASE WHEN pool_origin = 'B' THEN finding_id END) AS b_id FROM p GROUP BY 1, 2, 3""",
    uses=("findings",),
)
def _(src):
    from tracewright.operators.windows import pair_positions

    rows = src.findings.select("case_id", "artifact_path", "pool_origin", "seq", "finding_id")
    out = pair_positions(rows, ["case_id", "artifact_path"], "pool_origin", ["seq", "finding_id"], F.floor(F.col("seq") / 100_000))
    return out.select("case_id", "artifact_path", "pair_no", F.col("a.finding_id").alias("a_id"), F.col("b.finding_id").alias("b_id"))


_PAIRS = f""", t AS (SELECT *, {_words_sql('description')} AS w, {_RANK.format('confidence')} AS rk FROM findings),
  pr AS (SELECT a.case_id, a.finding_id, b.finding_id AS partner_id, CASE WHEN a.tool_call_id <> '' AND a.tool_call_id = b.tool_call_id AND abs(a.rk - b.rk) >= 2 THEN 'opposite_tier'
      WHEN a.tool_call_id <> '' AND a.tool_call_id = b.tool_call_id AND a.artifact_path = b.artifact_path AND a.mitre_technique <> '' AND b.mitre_technique <> '' AND a.mitre_technique <> b.mitre_technique THEN 'other_technique'
      WHEN a.artifact_path <> '' AND a.artifact_path = b.artifact_path AND len(list_intersect(a.w, b.w)) < 0.3 * len(list_distinct(list_concat(a.w, b.w))) THEN 'low_overlap' END AS reason
    FROM t a JOIN t b ON a.case_id = b.case_id AND a.pool_origin = 'A' AND b.pool_origin = 'B'),
  cn AS (SELECT f.case_id, f.finding_id, count(*) FILTER (WHERE reason = 'opposite_tier') AS opposite_tier, count(*) FILTER (WHERE reason = 'other_technique') AS other_technique, count(*) FILTER (WHERE reason = 'low_overlap') AS low_overlap
    FROM findings f LEFT JOIN pr ON f.case_id = pr.case_id AND f.finding_id = pr.finding_id WHERE f.pool_origin = 'A' GROUP BY 1, 2)"""


@query("contradictions", _PAIRS + " SELECT * FROM cn", uses=("findings",))
def _(src):
    return joins.contradictions(src.findings)


@query("contradiction_partners", _PAIRS + " SELECT pr.* FROM pr JOIN findings f ON pr.case_id = f.case_id AND pr.finding_id = f.finding_id WHERE reason IS NOT NULL AND f.confidence = 'HYPOTHESIS'", uses=("findings",))
def _(src):
    f = src.findings
    return joins.contradiction_partners(f, f.where("confidence = 'HYPOTHESIS'"))


@query(
    "contradiction_rows",
    _PAIRS + """, e AS (SELECT case_id, finding_id, 1 AS n, 'opposite_tier' AS reason, opposite_tier AS partners FROM cn UNION ALL SELECT case_id, finding_id, 2, 'other_technique', other_technique FROM cn UNION ALL SELECT case_id, finding_id, 3, 'low_overlap', low_overlap FROM cn)
       SELECT case_id, finding_id, reason, partners, printf('ctr-%04d', row_number() OVER (PARTITION BY case_id ORDER BY finding_id, n)) AS contradiction_id FROM e WHERE partners > 0""",
    uses=("findings",),
)
def _(src):
    return judging.contradiction_rows(joins.contradictions(src.findings))


_CORR = """, d AS (SELECT *, lower(description) AS l FROM findings),
  q AS (SELECT *, regexp_matches(l, '\\bamcache\\b') AS am, regexp_matches(l, '\\bprefetch\\b') AS pf, regexp_matches(l, '\\b(?:shimcache|appcompatcache)\\b') AS sh, regexp_matches(l, '\\buserassist\\b') AS ua, regexp_matches(l, '\\b(?:sysmon|edr|carbon[\\s-]?black|crowdstrike)\\b') AS te,
     regexp_matches(l, '\\bexecut(?:ed|ion|ing)\\b|\\bran\\b|\\brun count\\b|\\bprocess creation\\b|\\binvok(?:ed|ation|ing)\\b|\\blaunch(?:ed|ing)\\b|\\bspawn(?:ed|ing)\\b|\\bstarted\\b') OR regexp_matches(mitre_technique, '^(T1059|T1106|T1129|T1203|T1543|T1547|T1053)') AS is_execution FROM d),
  z AS (SELECT *, CASE WHEN NOT is_execution THEN 'not_execution' WHEN am AND NOT pf AND NOT sh AND NOT te THEN 'catalogue_only' WHEN (pf AND (am OR sh OR ua)) OR te THEN 'corroborated' ELSE 'single_class' END AS reason FROM q),
  corr AS (SELECT *, CASE WHEN reason IN ('not_execution', 'corroborated') THEN 'kept' ELSE 'downgraded' END AS action FROM z)"""


@query(
    "correlated_findings",
    _CORR + " SELECT case_id, finding_id, is_execution, action, reason, CASE WHEN action = 'kept' THEN confidence WHEN confidence = 'CONFIRMED' THEN 'INFERRED' ELSE 'HYPOTHESIS' END AS correlated_confidence FROM corr",
    uses=("findings",),
)
def _(src):
    return judging.correlate(src.findings).select("case_id", "finding_id", "is_execution", "action", "reason", "correlated_confidence")


@query(
    "replay_agreement",
    _CORR + " SELECT case_id, count(*) AS compared, count(*) FILTER (WHERE action = 'kept') AS matches, round_even(count(*) FILTER (WHERE action = 'kept') / count(*), 4) AS agreement FROM corr GROUP BY 1",
    uses=("findings",),
)
def _(src):
    f = src.findings
    now = judging.correlate(f, exact_path_counts=False).select("case_id", "finding_id", "action")
    recorded = f.select("case_id", "finding_id", F.lit("kept").alias("action"))
    return joins.replay_agreement(now, recorded)


@query(
    "case_outcomes",
    """, g AS (SELECT case_id, bool_or(confidence = 'CONFIRMED' OR (confidence = 'INFERRED' AND mitre_technique IN ('T1014', 'T1055'))) AS evil, count(*) AS findings FROM findings WHERE verifier_action <> 'rejected' AND host NOT IN ('host-2', 'host-5') GROUP BY 1)
       SELECT c.case_id, coalesce(findings, 0) AS findings, CASE WHEN evil THEN 'SUSPICIOUS' WHEN findings > 0 THEN 'INDETERMINATE' WHEN substantive THEN 'NO_EVIL' ELSE 'INDETERMINATE' END AS outcome FROM cases c LEFT JOIN g ON c.case_id = g.case_id""",
    uses=("findings", "cases"),
)
def _(src):
    kept = src.findings.where("verifier_action <> 'rejected' AND host NOT IN ('host-2', 'host-5')")
    return aggregates.case_outcome(kept, src.cases)


@query(
    "trust_scores",
    """, g AS (SELECT c.case_id, count(f.finding_id) AS n, count(*) FILTER (WHERE tool_call_id <> '') AS cited, count(replay_matched) AS tried, count(*) FILTER (WHERE replay_matched) AS passed, count(*) FILTER (WHERE confidence = 'CONFIRMED') AS confirmed,
         count(*) FILTER (WHERE confidence = 'INFERRED') AS inferred, count(*) FILTER (WHERE confidence = 'HYPOTHESIS') AS hypothesis, count(*) FILTER (WHERE verifier_action = 'approved') AS approved,
         count(*) FILTER (WHERE verifier_action = 'approved' AND NOT coalesce(replay_matched, FALSE)) AS approved_without_replay FROM cases c LEFT JOIN findings f ON c.case_id = f.case_id GROUP BY 1)
       SELECT case_id, n AS findings, CASE WHEN n = 0 THEN 1.0 ELSE round_even(cited / n, 4) END AS citation_coverage, CASE WHEN tried = 0 THEN 1.0 ELSE round_even(passed / tried, 4) END AS replay_pass_rate, confirmed, inferred, hypothesis, approved, approved_without_replay FROM g""",
    uses=("findings", "cases"),
)
def _(src):
    return aggregates.trust_score(src.findings, src.cases)


_CLASSED = """, fx AS (SELECT f.*, concat('tc-', CAST((seq * 7) % 997 AS STRING)) AS other_call, concat('tc-', CAST(seq % 499 AS STRING)) AS own_call FROM findings f),
  ids AS (SELECT case_id, finding_id, own_call AS tc FROM fx WHERE tool_call_id <> '' UNION SELECT case_id, finding_id, other_call FROM fx),
  kc AS (SELECT DISTINCT tool_call_id, artifact_class FROM calls), cs AS (SELECT case_id, finding_id, list_sort(list(DISTINCT artifact_class)) AS classes FROM ids JOIN kc ON tc = kc.tool_call_id GROUP BY 1, 2),
  classed AS (SELECT fx.*, coalesce(cs.classes, []) AS classes FROM fx LEFT JOIN cs ON fx.case_id = cs.case_id AND fx.finding_id = cs.finding_id)"""


def _classed(src):
    f = src.findings
    own = F.when(F.col("tool_call_id") != "", F.concat(F.lit("tc-"), (F.col("seq") % 499).cast("string"))).otherwise("")
    rows = f.withColumn("tool_call_id", own).withColumn("derived_from", F.array(F.concat(F.lit("tc-"), ((F.col("seq") * 7) % 997).cast("string"))))
    calls = src.calls.select("tool_call_id", "artifact_class").distinct()
    cases = f.select("case_id").distinct()
    # Calls in this derivation belong to every case, so the case comes from the finding's side.
    ids = rows.select("case_id", F.explode(F.array_append("derived_from", F.col("tool_call_id"))).alias("tool_call_id")).distinct()
    return joins.finding_classes(rows, ids.join(calls, "tool_call_id").join(cases, "case_id"))


@query("finding_classes", _CLASSED + " SELECT case_id, finding_id, array_to_string(classes, ',') AS classes, len(classes) AS class_count FROM classed", uses=("findings", "calls"))
def _(src):
    return _classed(src).select("case_id", "finding_id", F.array_join("classes", ",").alias("classes"), F.col("class_count").cast("long").alias("class_count"))


_EXEC = "(regexp_matches(description, '(?i)\\bexecut(?:ed|ion|ing)\\b|\\bran\\b|\\brun count\\b|\\bprocess creation\\b|\\binvok(?:ed|ation|ing)\\b|\\blaunch(?:ed|ing)\\b|\\bspawn(?:ed|ing)\\b|\\bstarted\\b') OR regexp_matches(mitre_technique, '^(T1059|T1106|T1129|T1203|T1543|T1547|T1053)'))"


@query(
    "corroboration_report",
    _CLASSED + f""", e AS (SELECT *, {_EXEC} AS x, len(classes) >= 2 AS two, confidence = 'CONFIRMED' AS sure FROM classed)
       SELECT case_id, count(*) AS findings, count(*) FILTER (WHERE x) AS execution_claims, count(*) FILTER (WHERE x AND two) AS execution_two_class, count(*) FILTER (WHERE x AND sure) AS confirmed_execution,
              count(*) FILTER (WHERE x AND sure AND two) AS confirmed_two_class, count(*) FILTER (WHERE x AND sure AND NOT two) AS confirmed_one_class FROM e GROUP BY 1""",
    uses=("findings", "calls"),
)
def _(src):
    return aggregates.corroboration_report(judging.correlate(_classed(src)))


@query("class_histogram", _CLASSED + f" SELECT len(classes) AS class_count, count(*) AS claims FROM classed WHERE {_EXEC} GROUP BY 1", uses=("findings", "calls"))
def _(src):
    out = aggregates.class_histogram(judging.correlate(_classed(src)))
    return out.withColumn("class_count", F.col("class_count").cast("long"))


@query(
    "class_ablation",
    _CLASSED + f""", e AS (SELECT case_id, finding_id, classes, d.c AS dropped_class FROM classed, (SELECT unnest(['evtx', 'mft', 'memory', 'network']) AS c) d WHERE confidence = 'CONFIRMED' AND {_EXEC})
       SELECT case_id, finding_id, dropped_class, 'CONFIRMED' AS from_tier, 'INFERRED' AS to_tier FROM e WHERE len(classes) >= 2 AND len(list_filter(classes, lambda x: x <> dropped_class)) < 2""",
    uses=("findings", "calls"),
)
def _(src):
    return judging.ablate(judging.correlate(_classed(src)), ["evtx", "mft", "memory", "network"])


@query(
    "exfiltration_gate",
    _CLASSED + """, g AS (SELECT case_id, finding_id, list_has_any(classes, ['mft', 'registry', 'usnjrnl', 'prefetch', 'memory']) AS presence, list_has_any(classes, ['network']) AS egress FROM classed WHERE mitre_technique = 'T1055')
       SELECT case_id, finding_id, presence, egress, presence AND egress AS stands FROM g""",
    uses=("findings", "calls"),
)
def _(src):
    rows = _classed(src).withColumn("description", F.concat("description", F.when(F.col("mitre_technique") == "T1055", " data was Uploaded").otherwise("")))
    return judging.exfil_gate(rows).select("case_id", "finding_id", "prongs.presence", "prongs.egress", "stands")


@query(
    "corroborated_claims",
    _CLASSED + """, c AS (SELECT case_id, finding_id, classes, CASE mitre_technique WHEN 'T1059.001' THEN 'execution' WHEN 'T1055' THEN 'injection' WHEN 'T1070.001' THEN 'deletion' WHEN 'T1547.001' THEN 'service_persistence' ELSE 'other' END AS claim FROM classed)
       SELECT case_id, finding_id, claim, CASE claim WHEN 'execution' THEN list_has_all(classes, ['prefetch', 'evtx']) WHEN 'deletion' THEN list_has_all(classes, ['usnjrnl', 'mft']) WHEN 'service_persistence' THEN list_has_all(classes, ['registry', 'evtx']) ELSE FALSE END AS corroborated FROM c""",
    uses=("findings", "calls"),
)
def _(src):
    t = F.col("mitre_technique")
    claim = F.when(t == "T1059.001", "execution").when(t == "T1055", "injection").when(t == "T1070.001", "deletion").when(t == "T1547.001", "service_persistence").otherwise("other")
    return joins.corroborated(_classed(src).withColumn("claim", claim)).select("case_id", "finding_id", "claim", "corroborated")


@query(
    "report_checks",
    _CLASSED + """, q AS (SELECT case_id, count(*) FILTER (WHERE tool_call_id = '') AS uncited_finding,
         count(*) FILTER (WHERE regexp_matches(description, '(?i)\\bexecut(?:ed|ion|ing)\\b|\\bran\\b|\\brun count\\b|\\bprocess creation\\b|\\binvok(?:ed|ation|ing)\\b|\\blaunch(?:ed|ing)\\b|\\bspawn(?:ed|ing)\\b|\\bstarted\\b') AND confidence = 'CONFIRMED' AND len(classes) < 2) AS single_class_execution,
         0::BIGINT AS one_prong_exfiltration, count(*) FILTER (WHERE confidence = 'HYPOTHESIS') AS unmarked_hypothesis, 0::BIGINT AS uncited_event FROM classed GROUP BY 1),
       e AS (UNPIVOT (SELECT * FROM q UNION ALL SELECT DISTINCT case_id, 0, 0, 0, 0, 0 FROM timeline WHERE case_id NOT IN (SELECT case_id FROM q)) ON uncited_finding, single_class_execution, one_prong_exfiltration, unmarked_hypothesis, uncited_event INTO NAME "check" VALUE offending)
       SELECT case_id, "check", offending, CASE WHEN offending = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM e""",
    uses=("findings", "calls", "timeline"),
)
def _(src):
    rows = _classed(src)
    return judging.report_qa(rows, src.timeline)


# Planted: a third of the findings has one class, memory, network or pattern matches alone, at every tier.
_PLANTED = _CLASSED + """, pl AS (SELECT *, CASE seq % 9 WHEN 0 THEN ['memory'] WHEN 3 THEN ['network'] WHEN 6 THEN ['yara'] ELSE classes END AS kinds,
         CASE WHEN seq % 6 = 3 THEN concat('data was exfiltrated, ', description) ELSE description END AS said FROM classed),
       t AS (SELECT *, regexp_matches(said, '(?i)\\bexecut(?:ed|ion|ing)\\b|\\bran\\b|\\brun count\\b|\\bprocess creation\\b|\\binvok(?:ed|ation|ing)\\b|\\blaunch(?:ed|ing)\\b|\\bspawn(?:ed|ing)\\b|\\bstarted\\b') AS x,
         seq % 6 = 3 AND NOT (list_has_any(kinds, ['mft', 'registry', 'usnjrnl', 'prefetch', 'memory']) AND list_has_any(kinds, ['network'])) AS ex FROM pl),
       o AS (SELECT case_id, finding_id, confidence, unnest(list_filter([
           CASE WHEN x AND len(kinds) < 2 THEN 'execution_requires_two_classes' END, CASE WHEN x AND kinds = ['yara'] THEN 'pattern_only_execution' END,
           CASE WHEN x AND kinds = ['memory'] THEN 'memory_only_execution' END, CASE WHEN x AND kinds = ['evtx'] THEN 'log_only_execution' END,
           CASE WHEN x AND kinds = ['network'] THEN 'network_only_execution' END, CASE WHEN ex AND kinds = ['network'] THEN 'network_only_exfiltration' END,
           CASE WHEN ex THEN 'exfiltration_requires_two_prongs' END, CASE WHEN own_call IS NULL OR tool_call_id = '' THEN 'uncited_finding' END,
           CASE WHEN confidence = 'HYPOTHESIS' AND NOT starts_with(lower(said), 'hypothesis:') THEN 'unmarked_hypothesis' END], lambda c: c IS NOT NULL)) AS "check" FROM t
         UNION ALL SELECT case_id, CAST(event_id AS VARCHAR), NULL, 'uncited_event' FROM timeline WHERE event_id % 50 = 0)"""


def _planted(src):
    m, said = F.col("seq") % 9, F.col("description")
    one = lambda c: F.array(F.lit(c))
    kinds = F.when(m == 0, one("memory")).when(m == 3, one("network")).when(m == 6, one("yara")).otherwise(F.col("classes"))
    return _classed(src).withColumns({"classes": kinds, "description": F.when(F.col("seq") % 6 == 3, F.concat(F.lit("data was exfiltrated, "), said)).otherwise(said)})


def _loose_events(src):
    """A timeline of which one row in fifty cites no call."""
    return src.timeline.withColumn("tool_call_id", F.when(F.col("event_id") % 50 == 0, "").otherwise(F.col("tool_call_id")))


@query("report_offences", _PLANTED + """ SELECT case_id, "check", finding_id AS offender, confidence FROM o""", uses=("findings", "calls", "timeline"))
def _(src):
    rows = judging.report_offences(_planted(src), _loose_events(src))
    return rows.select("case_id", "check", "offender", "confidence")


@query(
    "report_checks_by_rule",
    _PLANTED + """, n AS (SELECT unnest(['execution_requires_two_classes', 'pattern_only_execution', 'memory_only_execution', 'log_only_execution', 'network_only_execution', 'network_only_exfiltration', 'exfiltration_requires_two_prongs', 'uncited_finding', 'unmarked_hypothesis', 'uncited_event']) AS "check"),
       c AS (SELECT case_id FROM classed UNION SELECT case_id FROM timeline), k AS (SELECT case_id, "check", count(*) AS offending FROM o GROUP BY 1, 2)
       SELECT c.case_id, n."check", coalesce(k.offending, 0) AS offending, CASE WHEN coalesce(k.offending, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c CROSS JOIN n LEFT JOIN k ON k.case_id = c.case_id AND (k."check") = n."check" """,
    uses=("findings", "calls", "timeline"),
)
def _(src):
    rows = _planted(src)
    offences = judging.report_offences(rows, _loose_events(src))
    cases = rows.select("case_id").unionByName(src.timeline.select("case_id"))
    return judging.report_status(offences, cases, judging.report_rules(src.spark))


@query(
    "coverage_manifest",
    """, inv AS (SELECT concat('case-', CAST(c_custkey % 40 AS STRING)) AS case_id, CASE c_nationkey % 8 WHEN 0 THEN 'evtx' WHEN 1 THEN 'mft' WHEN 2 THEN 'usnjrnl' WHEN 3 THEN 'unknown' WHEN 4 THEN 'browser_db' ELSE 'memory' END AS artifact_class FROM customer),
       a AS (SELECT case_id, artifact_class, count(*) AS available FROM inv GROUP BY 1, 2),
       b AS (SELECT case_id, artifact_class, count(*) AS attempted, count(*) FILTER (WHERE error IS NULL) AS parsed, count(error) AS failed, CAST(sum(records_seen) AS BIGINT) AS records_seen, CAST(sum(parse_errors) AS BIGINT) AS parse_errors FROM calls GROUP BY 1, 2)
       SELECT case_id, artifact_class, coalesce(available, 0) AS available, coalesce(attempted, 0) AS attempted, coalesce(parsed, 0) AS parsed, coalesce(failed, 0) AS failed, coalesce(records_seen, 0) AS records_seen, coalesce(parse_errors, 0) AS parse_errors,
              CASE WHEN coalesce(available, 0) = 0 THEN 'not_supplied' WHEN artifact_class = 'unknown' THEN 'unsupported' WHEN parsed > 0 THEN 'parsed' WHEN failed > 0 THEN 'failed' ELSE 'available' END AS status FROM a FULL JOIN b USING (case_id, artifact_class)""",
    uses=("calls",),
)
def _(src):
    k = F.col("c_nationkey") % 8
    cls = F.when(k == 0, "evtx").when(k == 1, "mft").when(k == 2, "usnjrnl").when(k == 3, "unknown").when(k == 4, "browser_db").otherwise("memory")
    inv = src.given("customer").select(F.concat(F.lit("case-"), (F.col("c_custkey") % 40).cast("string")).alias("case_id"), cls.alias("artifact_class"))
    return aggregates.coverage_manifest(inv, src.calls)


_TARGETS = """(SELECT DISTINCT case_id, t.technique_id, t.artifact_class FROM findings, (VALUES ('T1014', 'memory'), ('T1055', 'memory'), ('T1070.001', 'evtx'), ('T1041', 'pcap'), ('T1053.005', 'registry')) t(technique_id, artifact_class))"""


def _targets(src):
    listed = F.explode(F.array(*[F.struct(F.lit(a).alias("technique_id"), F.lit(b).alias("artifact_class")) for a, b in (("T1014", "memory"), ("T1055", "memory"), ("T1070.001", "evtx"), ("T1041", "pcap"), ("T1053.005", "registry"))]))
    return src.findings.select("case_id").distinct().select("case_id", listed.alias("t")).select("case_id", "t.*")


@query(
    "technique_coverage",
    f""", best AS (SELECT case_id, mitre_technique AS technique_id, max({_RANK.format('confidence')}) AS best_rank FROM findings GROUP BY 1, 2), ran AS (SELECT DISTINCT case_id, artifact_class FROM calls WHERE error IS NULL)
       SELECT t.case_id, t.technique_id, t.artifact_class, CAST(best_rank AS BIGINT) AS best_rank, CASE WHEN best_rank IS NOT NULL THEN 'finding' WHEN ran.case_id IS NOT NULL THEN 'covered_no_finding' ELSE 'blind_spot' END AS status
       FROM {_TARGETS} t LEFT JOIN ran ON t.case_id = ran.case_id AND t.artifact_class = ran.artifact_class LEFT JOIN best ON t.case_id = best.case_id AND t.technique_id = best.technique_id""",
    uses=("findings", "calls"),
)
def _(src):
    return aggregates.technique_coverage(_targets(src), src.calls, src.findings).withColumn("best_rank", F.col("best_rank").cast("long"))


_TECH = f""", u AS (SELECT case_id, mitre_technique AS technique_id, finding_id, confidence, TRUE AS claimed FROM findings WHERE mitre_technique <> '' UNION ALL SELECT case_id, technique_id, NULL, NULL, FALSE FROM {_TARGETS}),
  tech AS (SELECT case_id, technique_id, bool_or(claimed) AS claimed, count(DISTINCT finding_id) AS claimed_by, max(CASE WHEN confidence IS NOT NULL THEN {_RANK.format('confidence')} END) AS best_rank FROM u GROUP BY 1, 2),
  kb AS (SELECT * FROM (VALUES ('T1014', 'T1014', 'Rootkit'), ('T1055', 'T1055', 'Process Injection'), ('T1059.001', 'T1059.001', 'PowerShell'), ('T1070.001', 'T1685.005', 'Clear Logs')) t(technique_id, current_id, name)),
  gt AS (SELECT tech.*, kb.technique_id IS NOT NULL AS found, current_id, coalesce(current_id = tech.technique_id, FALSE) AS id_match FROM tech LEFT JOIN kb ON tech.technique_id = kb.technique_id),
  gr AS (SELECT *, CASE WHEN found THEN 'supported' ELSE 'contradicted' END AS status, NOT found AS possible_hallucination, CASE WHEN found AND NOT id_match THEN 'renumbered' ELSE 'current' END AS id_status FROM gt WHERE claimed)"""


def _techniques(src):
    f = src.findings
    return aggregates.collect_techniques(f, f.where("confidence = 'CONFIRMED'"), _targets(src))


def _grounded(src):
    kb = src.spark.sql("SELECT * FROM VALUES ('t1014', 'T1014', 'Rootkit'), ('T1055', 'T1055', 'Process Injection'), ('T1059.001', 'T1059.001', 'PowerShell'), ('T1070.001', 'T1685.005', 'Clear Logs') AS t(technique_id, current_id, name)")
    return joins.ground_techniques(_techniques(src), kb)


@query("collected_techniques", _TECH + " SELECT case_id, technique_id, claimed, claimed_by, CAST(best_rank AS BIGINT) AS best_rank FROM tech", uses=("findings",))
def _(src):
    return _techniques(src).withColumn("best_rank", F.col("best_rank").cast("long"))


@query("grounded_techniques", _TECH + " SELECT case_id, technique_id, status, possible_hallucination, id_status, current_id FROM gr", uses=("findings",))
def _(src):
    return judging.ground(_grounded(src)).select("case_id", "technique_id", "status", "possible_hallucination", "id_status", "current_id")


@query("grounding_summary", _TECH + " SELECT count(*) AS claims_judged, count(*) FILTER (WHERE status = 'supported') AS supported, count(*) FILTER (WHERE status = 'contradicted') AS contradicted, count(*) FILTER (WHERE possible_hallucination) AS possible_hallucinations FROM gr", uses=("findings",))
def _(src):
    return aggregates.grounding_summary(judging.ground(_grounded(src)))


@query(
    "recommended_actions",
    _TECH + """, o AS (SELECT case_id, CASE WHEN bool_or(confidence = 'CONFIRMED') THEN 'SUSPICIOUS' ELSE 'INDETERMINATE' END AS outcome FROM findings WHERE mitre_technique = 'T1014' GROUP BY 1),
       x AS (SELECT gr.*, coalesce(outcome, 'INDETERMINATE') AS outcome FROM gr LEFT JOIN o ON gr.case_id = o.case_id)
       SELECT case_id, technique_id, CASE WHEN status = 'supported' AND outcome = 'SUSPICIOUS' THEN 'act' ELSE 'review' END AS route, CASE WHEN possible_hallucination THEN concat('Re-check finding for ', technique_id) WHEN outcome <> 'SUSPICIOUS' THEN concat('Corroborate the lead for ', technique_id)
         WHEN technique_id = 'T1014' THEN 'Compare loaded drivers with a clean build' WHEN technique_id = 'T1055' THEN 'Dump the region and find its writer'
         WHEN technique_id = 'T1070.001' THEN 'Fetch the forwarded copy of the log' ELSE 'Look at the finding with a second analyst' END AS action FROM x""",
    uses=("findings",),
)
def _(src):
    o = src.findings.where("mitre_technique = 'T1014'").groupBy("case_id").agg(F.bool_or(F.col("confidence") == "CONFIRMED").alias("evil"))
    g = judging.ground(_grounded(src)).join(o, "case_id", "left").withColumn("outcome", F.when(F.col("evil"), "SUSPICIOUS").otherwise("INDETERMINATE"))
    actions = src.spark.sql("SELECT * FROM VALUES ('T1014', 'Compare loaded drivers with a clean build'), ('t1055', 'Dump the region and find its writer'), ('T1070', 'Fetch the forwarded copy of the log') AS t(technique_id, action)")
    return joins.derive_actions(g, actions)


@query("unrecovered_tools", "SELECT case_id, tool FROM calls GROUP BY 1, 2 HAVING bool_or(error IS NOT NULL AND NOT rejected AND NOT skipped) AND NOT bool_or(error IS NULL)", uses=("calls",))
def _(src):
    return setops.unrecovered(src.calls)


@query(
    "completed_runs",
    """, u AS (SELECT case_id, tool FROM calls GROUP BY 1, 2 HAVING bool_or(error IS NOT NULL AND NOT rejected AND NOT skipped) AND NOT bool_or(error IS NULL)), n AS (SELECT case_id, count(*) AS k FROM u GROUP BY 1)
       SELECT c.case_id, coalesce(k, 0) AS unrecovered_tools, substantive AND coalesce(k, 0) = 0 AS run_completed FROM cases c LEFT JOIN n ON c.case_id = n.case_id""",
    uses=("calls", "cases"),
)
def _(src):
    cases = src.cases.select("case_id", (~F.col("substantive")).alias("terminated_partial"))
    return scoring.run_completed(src.calls, cases).select("case_id", "unrecovered_tools", "run_completed")


@query(
    "linked_timeline",
    f""", g AS (SELECT concat('case-', CAST(seq % 30 AS STRING)) AS case_id, concat('tc-', CAST(seq % 150 AS STRING)) AS tool_call_id, count(DISTINCT finding_id) AS linked_findings, max({_RANK.format('confidence')}) AS r, min(finding_id) AS first_finding_id FROM findings GROUP BY 1, 2)
       SELECT t.case_id, t.event_id, coalesce(linked_findings, 0) AS linked_findings, first_finding_id, CASE r WHEN 2 THEN 'CONFIRMED' WHEN 1 THEN 'INFERRED' WHEN 0 THEN 'HYPOTHESIS' END AS confidence, CASE WHEN linked_findings > 0 THEN 'finding_support' ELSE significance END AS significance
       FROM timeline t LEFT JOIN g ON t.case_id = g.case_id AND t.tool_call_id = g.tool_call_id""",
    uses=("findings", "timeline"),
)
def _(src):
    f = src.findings.select("finding_id", "confidence", F.concat(F.lit("case-"), (F.col("seq") % 30).cast("string")).alias("case_id"), F.concat(F.lit("tc-"), (F.col("seq") % 150).cast("string")).alias("tool_call_id"))
    return joins.link_timeline(src.timeline, f).select("case_id", "event_id", "linked_findings", "first_finding_id", "confidence", "significance")


@query(
    "merged_timeline",
    """, a AS (SELECT case_id, tool_call_id, event_id FROM timeline WHERE significance = 'finding_support' AND source_ip <> ''), p AS (SELECT case_id, tool_call_id, event_id FROM timeline WHERE significance = 'triage_lead')
       SELECT * FROM a UNION ALL SELECT * FROM p WHERE (case_id, tool_call_id) NOT IN (SELECT (case_id, tool_call_id) FROM a)""",
    uses=("timeline",),
)
def _(src):
    t = src.timeline.select("case_id", "tool_call_id", "event_id", "significance", "source_ip")
    cols = ("case_id", "tool_call_id", "event_id")
    return joins.merge_timeline(t.where("significance = 'triage_lead'").select(*cols), t.where("significance = 'finding_support' AND source_ip <> ''").select(*cols))


@query(
    "enriched_iocs",
    """WITH i AS (SELECT DISTINCT 'domains' AS kind, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS value FROM pages), f AS (SELECT 'domains' AS kind, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS value, concat('feed', CAST(length(html) % 3 AS STRING)) AS provider, length(url) % 2 = 0 AS found, length(url) % 4 = 0 AS malicious FROM pages),
       g AS (SELECT kind, value, bool_or(found) AS found, count(*) FILTER (WHERE malicious) AS malicious_sources, count(DISTINCT CASE WHEN found THEN provider END) AS providers FROM f GROUP BY 1, 2)
       SELECT i.kind, i.value, found, malicious_sources, providers, CASE WHEN NOT found THEN 'unknown' WHEN malicious_sources > 0 THEN 'malicious' ELSE 'clean' END AS status FROM i JOIN g ON i.value = g.value""",
)
def _(src):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    rows = src.given("pages").select(F.lit("domains").alias("kind"), host.alias("value"), F.concat(F.lit("feed"), (F.length("html") % 3).cast("string")).alias("provider"), (F.length("url") % 2 == 0).alias("found"), (F.length("url") % 4 == 0).alias("malicious"))
    out = joins.enrich(rows.select("kind", "value").distinct(), rows)
    return out.withColumn("status", judging.ioc_status(F.col("found"), F.col("malicious_sources")))


@query(
    "revisions",
    """SELECT case_id, finding_id, confidence AS from_tier, CASE WHEN verifier_action = 'downgraded' AND confidence = 'CONFIRMED' THEN 'INFERRED' ELSE 'HYPOTHESIS' END AS to_tier, tool_call_id AS trigger_tool_call_id FROM findings WHERE tool_call_id <> '' AND verifier_action = 'downgraded' AND confidence <> 'HYPOTHESIS'""",
    uses=("findings",),
)
def _(src):
    f = src.findings
    after = f.withColumn("confidence", F.when(F.col("verifier_action") == "downgraded", labels.downgrade(F.col("confidence"))).otherwise(F.col("confidence")))
    return joins.revisions(f, after)


_REPLAY = """, rp AS (SELECT DISTINCT case_id, tool_call_id, md5(tool_call_id) AS e, CASE WHEN length(tool_call_id) % 2 = 0 THEN md5(tool_call_id) ELSE md5(artifact_path) END AS a, CASE WHEN artifact_path LIKE '%mail%' THEN 'tool failed' END AS error FROM findings WHERE tool_call_id <> '' AND host <> 'host-3'),
  rq AS (SELECT case_id, tool_call_id, max(e) AS e, max(a) AS a, max(error) AS error FROM rp GROUP BY 1, 2)"""


def _replays(src):
    f = src.findings.where("tool_call_id <> '' AND host <> 'host-3'")
    even = F.length("tool_call_id") % 2 == 0
    return f.groupBy("case_id", "tool_call_id").agg(
        F.max(F.md5("tool_call_id")).alias("expected_sha256"),
        F.max(F.when(even, F.md5("tool_call_id")).otherwise(F.md5("artifact_path"))).alias("actual_sha256"),
        F.max(F.when(F.col("artifact_path").contains("mail"), "tool failed")).alias("error"),
    )


@query(
    "verified_findings",
    _REPLAY + """, v AS (SELECT f.case_id, f.finding_id, f.confidence, CASE WHEN f.tool_call_id = '' THEN 'missing_citation' WHEN rq.e IS NULL THEN 'missing_audit_record' WHEN rq.error IS NOT NULL THEN 'replay_error' WHEN rq.e <> rq.a THEN 'drift' ELSE 'match' END AS reason
         FROM findings f LEFT JOIN rq ON f.case_id = rq.case_id AND f.tool_call_id = rq.tool_call_id)
       SELECT *, CASE WHEN reason IN ('missing_citation', 'missing_audit_record', 'replay_error') THEN 'rejected' WHEN reason = 'drift' THEN CASE WHEN confidence = 'CONFIRMED' THEN 'rejected' ELSE 'downgraded' END ELSE 'approved' END AS action FROM v""",
    uses=("findings",),
)
def _(src):
    return judging.verify(src.findings, _replays(src))


@query("drift_classes", _REPLAY + " SELECT case_id, tool_call_id, CASE WHEN error IS NOT NULL THEN 'replay_error' WHEN e = a THEN 'exact_match' ELSE 'material_drift' END AS drift FROM rq", uses=("findings",))
def _(src):
    return _replays(src).select("case_id", "tool_call_id", judging.drift(F.col("expected_sha256"), F.col("actual_sha256"), F.col("error")).alias("drift"))


@query(
    "rebound_artifacts",
    "SELECT case_id, finding_id, regexp_extract(artifact_path, '([^/]+)$', 1) = CAST(conv AS STRING) AS rebinds FROM (SELECT case_id, finding_id, artifact_path, seq % 40 AS conv FROM findings)",
    uses=("findings",),
)
def _(src):
    read = F.array(F.lit("/mnt/x/none"), F.concat(F.lit("D:\\cases\\"), (F.col("seq") % 40).cast("string")))
    return src.findings.select("case_id", "finding_id", judging.rebinds(F.col("artifact_path"), read).alias("rebinds"))


def _asserted(src):
    """Events as findings that assert values of their own tool output, some of them wrong."""
    e = spread(src.given("events"))
    eid, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    output = F.concat(F.lit('{"rows":[{"id":'), eid, F.lit(',"user":"u'), user, F.lit('","sha":"'), F.md5("event_type"), F.lit('","at":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"},{"id":'), (F.col("event_id") + 1).cast("string"), F.lit(',"user":"u'), user, F.lit('"}],"kind":"'), "event_type", F.lit('"}'))

    def value(path, expected, mode, count=None):
        return F.struct(F.lit(path).alias("path"), expected.cast("string").alias("expected"), F.lit(mode).alias("match"), F.lit(count).cast("int").alias("count"))

    wrong = F.col("event_type") == "error"
    values = F.array(
        value("rows[*].id", F.when(F.col("value") > 50, F.lit("-5")).otherwise(F.concat(F.lit("0x"), F.hex("event_id"))), "int"),
        value("rows[0].sha", F.when(wrong, F.md5(F.lit("x"))).otherwise(F.md5("event_type")), "exact"),
        value("rows[*].user", F.concat(F.lit("U"), user), "contains", 2),
        value("rows[0].at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), "iso_ts"),
        value("rows[*]", F.concat(F.lit('{"user":"u'), user, F.lit('","id":"'), eid, F.lit('"}')), "record"),
        value("kind", F.when(F.col("event_type") == "view", F.lit("gone.exe")).otherwise(F.col("event_type")), "exact", None),
    )
    findings = e.select(F.lit("c").alias("case_id"), F.concat(F.lit("f-"), eid).alias("finding_id"), F.concat(F.lit("tc-"), eid).alias("tool_call_id"), values.alias("asserted_values"),
                        F.when(F.col("event_type") != "click", value("rows[0].user", F.when(F.col("value") > 80, F.lit("nobody")).otherwise(F.concat(F.lit("u"), user)), "exact")).alias("expectation"))
    outputs = e.select(F.lit("c").alias("case_id"), F.concat(F.lit("tc-"), eid).alias("tool_call_id"), output.alias("output"))
    return findings, outputs


@query(
    "entailment",
    """SELECT concat('f-', CAST(event_id AS STRING)) AS finding_id, 6::BIGINT AS asserted, CAST(value > 50 AS BIGINT) + CAST(event_type = 'error' AS BIGINT) + CAST(event_type = 'view' AS BIGINT) AS misses, CAST(value > 50 AS BIGINT) + CAST(event_type = 'error' AS BIGINT) + CAST(event_type = 'view' AS BIGINT) AS hard_misses,
       CAST(event_type = 'error' AS BIGINT) AS identity_misses, 0::BIGINT AS over_counts FROM events""",
)
def _(src):
    findings, outputs = _asserted(src)
    return judging.check_entailment(findings, outputs).drop("case_id")


@query("expectations", "SELECT concat('f-', CAST(event_id AS STRING)) AS finding_id, value > 80 AS refuted FROM events WHERE event_type <> 'click'")
def _(src):
    findings, outputs = _asserted(src)
    return judging.check_expectation(findings, outputs).drop("case_id")


@query(
    "eligible_pairs",
    f"""WITH e AS (SELECT item_id AS expected_id, {_tokens_sql('text')} AS t FROM benchmark), d AS (SELECT doc_id AS finding_id, {_tokens_sql('text')} AS u FROM documents),
        p AS (SELECT expected_id, finding_id, len(list_intersect(t, u)) AS shared, len(t) AS n FROM e, d)
        SELECT expected_id, finding_id, shared, round(shared / n, 6) AS coverage FROM p WHERE shared >= 3 AND shared >= 0.5 * n""",
)
def _(src):
    exp = src.given("benchmark").select(F.lit("c").alias("case_id"), F.col("item_id").alias("expected_id"), F.col("text").alias("description"), F.lit(None).cast("string").alias("artifact_hint"))
    run = src.given("documents").select(F.lit("c").alias("case_id"), F.col("doc_id").alias("finding_id"), F.col("text").alias("description"), F.lit(None).cast("string").alias("artifact_path"))
    return joins.eligible(exp, run).select("expected_id", "finding_id", F.col("shared").cast("long").alias("shared"), F.round("coverage", 6).alias("coverage"))


def _scores(src):
    """Documents as run findings of eight cases, benchmark items as their answer keys."""
    case = lambda c: F.concat(F.lit("case-"), (F.col(c) % 8).cast("string"))
    bench = src.given("benchmark").select(case("item_id").alias("case_id"), F.col("item_id").cast("string").alias("expected_id"), F.col("item_id").alias("expected_order"), F.col("text").alias("description"), F.lit("").alias("artifact_hint"))
    docs = src.given("documents").select(case("doc_id").alias("case_id"), F.col("doc_id").cast("string").alias("finding_id"), F.col("doc_id").alias("finding_order"), F.col("text").alias("description"), F.lit("").alias("artifact_path"))
    cases = bench.select("case_id").distinct()
    last = F.substring("case_id", -1, 1)
    runs = cases.withColumn("run_outcome", F.when(last.isin("1", "3"), "INDETERMINATE").otherwise("SUSPICIOUS"))
    keys = cases.select("case_id", F.when(last == "2", "NO_EVIL").when(last == "3", "UNKNOWN").otherwise("CONFIRMED_EVIL").alias("key_outcome"), (last == "4").alias("exhaustive"), F.lit(20).alias("min_recall_percent"), F.when(last == "5", "not_ready").otherwise("ready").alias("scoring_status"))
    anti = bench.withColumn("case_id", F.concat(F.lit("case-"), ((F.col("expected_order") + 1) % 8).cast("string")))
    known = bench.withColumn("case_id", F.concat(F.lit("case-"), ((F.col("expected_order") + 2) % 8).cast("string")))
    deny = cases.select("case_id", F.explode(F.array(F.lit("license"), F.lit("zzqq"))).alias("term"))
    done = cases.select("case_id", (last != "6").alias("run_completed"))
    return scoring.score_runs(runs, docs, keys, bench, anti, known, deny, done)


_SCORE_COLUMNS = ("case_id", "expected_n", "recalled_n", "recall_percent", "run_finding_n", "extra_n", "false_positives", "fp_planted", "precision_percent", "f1", "hallucination_rate", "outcome_match", "controls_total", "controls_respected", "control_coverage_percent", "pass")


@query("golden_scores")
def _(src):
    return _scores(src).select(*_SCORE_COLUMNS)


@query("score_bounds")
def _(src):
    return scoring.check_bounds(_scores(src), {"min_recall_percent": 36, "min_precision_percent": 90, "max_hallucination_rate": 0, "max_fp_planted": 0, "require_outcome_match": True})


_WORDS = "CONFIRMED_EVIL SUSPICIOUS NO_EVIL BENIGN UNKNOWN INDETERMINATE OTHER".split()


@query(
    "outcome_consistency",
    """WITH w AS (SELECT c_custkey, ['CONFIRMED_EVIL', 'SUSPICIOUS', 'NO_EVIL', 'BENIGN', 'UNKNOWN', 'INDETERMINATE', 'OTHER'][1 + c_custkey % 7] AS r, ['CONFIRMED_EVIL', 'SUSPICIOUS', 'NO_EVIL', 'BENIGN', 'UNKNOWN', 'INDETERMINATE', 'OTHER'][1 + c_nationkey % 7] AS k FROM customer),
       p AS (SELECT *, CASE WHEN r IN ('CONFIRMED_EVIL', 'SUSPICIOUS') THEN 'e' WHEN r IN ('NO_EVIL', 'BENIGN') THEN 'b' WHEN r IN ('UNKNOWN', 'INDETERMINATE') THEN 'n' ELSE r END AS a, CASE WHEN k IN ('CONFIRMED_EVIL', 'SUSPICIOUS') THEN 'e' WHEN k IN ('NO_EVIL', 'BENIGN') THEN 'b' WHEN k IN ('UNKNOWN', 'INDETERMINATE') THEN 'n' ELSE k END AS b FROM w)
       SELECT c_custkey, r AS run, k AS key, a = b AS consistent FROM p""",
)
def _(src):
    pick = lambda c: F.array(*[F.lit(w) for w in _WORDS])[(F.col(c) % 7).cast("int")]
    rows = src.given("customer").select("c_custkey", pick("c_custkey").alias("run"), pick("c_nationkey").alias("key"))
    return rows.withColumn("consistent", scoring.outcome_consistent(F.lower("run"), F.col("key")))


@query(
    "negative_controls",
    """WITH t AS (SELECT p_partkey, p_size % 4 AS t1, p_size % 3 AS t2, p_partkey % 3 AS t3, p_size % 7 AS av, p_partkey % 5 AS kv, p_size % 2 AS da FROM part), s AS (SELECT *, t1 + t2 + t3 AS total, least(av, t1) + least(kv, t2) + least(da, t3) AS bad FROM t)
       SELECT p_partkey, total AS controls_total, total - bad AS controls_respected, CASE WHEN total = 0 THEN 100.0 ELSE round_even((total - bad) * 100 / total, 0) END AS control_coverage_percent FROM s""",
)
def _(src):
    s, p = F.col("p_size"), F.col("p_partkey")
    rows = src.given("part").select("p_partkey", (s % 4).cast("long").alias("anti_fact_total"), (s % 3).cast("long").alias("known_negative_total"), (p % 3).alias("denylist_terms_total"), (s % 7).cast("long").alias("anti_fact_violations"), (p % 5).alias("known_negative_violations"), (s % 2).cast("long").alias("denylist_terms_asserted"))
    return scoring.negative_coverage(rows).select("p_partkey", "controls_total", "controls_respected", "control_coverage_percent")


@query(
    "planted_bait",
    "SELECT case_id, count(*) AS planted FROM (SELECT DISTINCT case_id, finding_id, description FROM findings WHERE mitre_technique = 'T1014' OR contains(lower(description), 'amcache')) GROUP BY 1",
    uses=("findings",),
)
def _(src):
    f = src.findings
    return setops.bait_set(f.where("mitre_technique = 'T1014'"), f.where(F.contains(F.lower("description"), F.lit("amcache"))))


@query(
    "expert_miss_rate",
    """, e AS (SELECT *, 1706745600000000 - 10 * 86400000000 AS cut FROM timeline), r AS (SELECT CASE WHEN significance = 'context' THEN 'unknown' ELSE significance END AS edit_type, case_id FROM e WHERE us >= cut AND account <> '')
       SELECT edit_type, count(*) AS misses, (SELECT count(DISTINCT case_id) FROM r) AS cases, round(count(*) / (SELECT count(DISTINCT case_id) FROM r), 6) AS rate_per_case FROM r GROUP BY 1""",
    uses=("timeline",),
)
def _(src):
    ledger = src.timeline.select("case_id", "us", F.when(F.col("significance") != "context", F.col("significance")).alias("edit_type"), F.when(F.col("account") != "", "expert_miss").otherwise("note").alias("kind"))
    return aggregates.miss_rate(ledger, F.lit(1706745600000000), 10).withColumn("rate_per_case", F.round("rate_per_case", 6))


@query(
    "self_scores",
    """, c AS (SELECT case_id, tool_call_id AS tc, bool_or(kind = 'tool_call_start' AND tool_call_id <> '') AS st, bool_or(kind = 'tool_call_output' AND output_hash <> '') AS ou, count(*) FILTER (WHERE kind = 'finding_approved') AS f, count(*) FILTER (WHERE kind = 'finding_approved' AND confidence = 'CONFIRMED') AS cc,
         count(*) FILTER (WHERE kind = 'finding_approved' AND confidence = 'INFERRED') AS ci, count(*) FILTER (WHERE kind = 'finding_approved' AND confidence = 'HYPOTHESIS') AS ch, count(*) FILTER (WHERE kind = 'verifier_action' AND action = 'rejected') AS rj, count(*) FILTER (WHERE kind = 'course_correction') AS co FROM audit GROUP BY 1, 2)
       SELECT case_id, CAST(sum(f) AS BIGINT) AS findings, count(*) FILTER (WHERE st AND NOT ou) AS failures, CAST(sum(co) AS BIGINT) AS corrections, CAST(sum(rj) AS BIGINT) AS rejected, CAST(sum(CASE WHEN tc <> '' THEN f ELSE 0 END) AS BIGINT) AS cited, CAST(sum(CASE WHEN st AND tc <> '' THEN f ELSE 0 END) AS BIGINT) AS traced,
         CAST(floor(sum(cc) * 100 / greatest(sum(f), 1)) AS BIGINT) AS confirmed_percent, CAST(floor(sum(ci) * 100 / greatest(sum(f), 1)) AS BIGINT) AS inferred_percent, CAST(floor(sum(ch) * 100 / greatest(sum(f), 1)) AS BIGINT) AS hypothesis_percent, count(*) FILTER (WHERE st) > 0 AND count(*) FILTER (WHERE st AND NOT ou) = 0 AS reproducible FROM c GROUP BY 1""",
    uses=("audit",),
)
def _(src):
    return aggregates.self_score(src.audit)


_MEMORY = """WITH m AS (SELECT doc_id AS memory_id, regexp_extract_all(lower(concat_ws(' ', source, lang, text)), '[\\p{L}\\p{N}]+') AS w, doc_id * 3600000000 AS us FROM documents), md AS (SELECT *, concat(' ', array_to_string(w, '  '), ' ') AS t, len(w) AS l FROM m),
  q AS (SELECT item_id AS query_id, concat(' ', array_to_string(regexp_extract_all(lower(split_part(text, '.', 1)), '[\\p{L}\\p{N}]+'), '  '), ' ') AS p FROM benchmark),
  h AS (SELECT query_id, memory_id, us, l, (length(t) - length(replace(t, p, ''))) / length(p) AS f FROM q JOIN md ON contains(t, p)),
  s AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS nq, (SELECT count(*) FROM md) AS n, (SELECT avg(l) FROM md) AS av FROM h),
  z AS (SELECT *, greatest(ln((n - nq + 0.5) / (nq + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / av)) AS score FROM s),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS r FROM z)"""


def _recalled(src):
    memory = src.given("documents").select(F.col("doc_id").alias("memory_id"), F.lit("c").alias("case_id"), F.col("source").alias("kind"), F.col("lang").alias("key"), F.col("text").alias("value"), (F.col("doc_id") * 3600000000).alias("us"))
    asked = src.given("benchmark").select(F.col("item_id").alias("query_id"), F.substring_index("text", ".", 1).alias("phrase"))
    return recall.recall(memory, asked, F.lit(7776000000000))


@query("memory_recall", _MEMORY + " SELECT query_id, memory_id, round(score, 6) AS score, round(exp(-greatest(0.0, (7776000000000 - us) / 86400000000.0) / 90.0) / (1 + score), 6) AS confidence FROM k WHERE r <= 10")
def _(src):
    return _recalled(src).select("query_id", "memory_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@query(
    "remembered_findings",
    "SELECT case_id, 'finding_summary' AS kind, CASE WHEN mitre_technique <> '' THEN mitre_technique ELSE finding_id END AS key, concat('sha256:', sha256(description)) AS sha256, 5 AS us FROM findings WHERE confidence = 'CONFIRMED'",
    uses=("findings",),
)
def _(src):
    return recall.remember(src.findings, F.lit(5)).drop("value")


@query("memory_meta", "SELECT case_id, min(us) AS first_seen_us, max(us) AS last_updated_us, count(*) AS memories FROM findings GROUP BY 1", uses=("findings",))
def _(src):
    return recall.memory_meta(src.findings)


@query("prior_observations", _MEMORY + " SELECT i.item_id AS query_id, count(k.memory_id) AS prior FROM benchmark i LEFT JOIN (SELECT * FROM k WHERE r <= 10) k ON i.item_id = k.query_id GROUP BY 1")
def _(src):
    hits = _recalled(src).select(F.lit("c").alias("case_id"), F.col("query_id").alias("finding_id"), F.concat(F.lit("doc-"), F.col("memory_id").cast("string")).alias("prior_case_id"), F.col("us").alias("ts"), "confidence")
    findings = src.given("benchmark").select(F.lit("c").alias("case_id"), F.col("item_id").alias("finding_id"))
    return joins.attach_prior(findings, hits).select(F.col("finding_id").alias("query_id"), F.size("prior_observations").cast("long").alias("prior"))


@query(
    "benchmark_rows",
    """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_acctbal WHEN c_custkey % 2 = 0 THEN c_nationkey * 1.0 END AS recall, c_mktsegment AS run_name FROM customer""",
)
def _(src):
    from tracewright.sources.writers import benchmark_rows

    rows = src.given("customer").select("c_custkey", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("recall_percent"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey") * 1.0).alias("recall"), F.col("c_mktsegment").alias("run"))
    return benchmark_rows(rows, {"recall": ["recall_percent", "recall"], "run_name": ["run_name", "run"]}, keep=["c_custkey"])
