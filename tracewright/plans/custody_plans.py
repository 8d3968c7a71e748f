"""Custody queries over run logs: chains, leaves, roots, proofs, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.hashing import canonical_json
from tracewright.operators import custody, joins, windows
from tracewright.plans.catalog import query
from tracewright.session import cut_lineage

_STATE = """, st AS (SELECT case_id, record_no, line, value, sha256(line) AS line_hash, row_number() OVER (PARTITION BY case_id ORDER BY record_no) - 1 AS position, coalesce(lag(sha256(line)) OVER (PARTITION BY case_id ORDER BY record_no), '') AS expected_prev FROM audit),
  ck AS (SELECT *, CASE WHEN value > 260 THEN 'sequence' WHEN value > 230 THEN 'prev_hash' WHEN value > 200 THEN 'not_canonical' END AS reason FROM st)"""


def _checked(src):
    # Declared values are those of an intact chain, except on lines with unusually large values.
    state = custody.chain_state(src.audit, order="record_no")
    seq = F.when(F.col("value") > 260, F.col("position") + 1).otherwise(F.col("position"))
    prev = F.when(F.col("value") > 230, F.lit("0")).otherwise(F.col("expected_prev"))
    return custody.chain_breaks(state, seq, prev, canonical_json(F.col("line")))


@query("chain_lines", _STATE + " SELECT case_id, record_no, line_hash, position, expected_prev, reason FROM ck", uses=("audit",))
def _(src):
    return _checked(src).select("case_id", "record_no", "line_hash", "position", "expected_prev", "reason")


@query(
    "chain_breaks",
    _STATE + " SELECT case_id, count(*) AS records, min(CASE WHEN reason IS NOT NULL THEN position END) AS break_at, arg_min(reason, position) FILTER (WHERE reason IS NOT NULL) AS reason, arg_max(line_hash, position) AS final_hash, count(reason) = 0 AS chain_ok FROM ck GROUP BY 1",
    uses=("audit",),
)
def _(src):
    return custody.first_breaks(_checked(src))


_LEAVES = """, lv AS (SELECT case_id, record_no AS seq, CASE WHEN kind = 'tool_call_output' THEN 'tool_call_output' ELSE 'finding' END AS kind, CASE WHEN kind = 'tool_call_output' AND output_hash <> '' THEN output_hash ELSE sha256(line) END AS digest_hex,
    CASE WHEN kind = 'tool_call_output' THEN tool_call_id ELSE finding_id END AS record_id, row_number() OVER (PARTITION BY case_id ORDER BY record_no) - 1 AS leaf_idx FROM audit WHERE kind IN ('tool_call_output', 'finding_approved'))"""

_ROOT = _LEAVES + """, tree AS (SELECT case_id, 0 AS lvl, leaf_idx AS idx, digest_hex AS h, count(*) OVER (PARTITION BY case_id) AS n FROM lv
  UNION ALL SELECT case_id, lvl + 1, idx // 2, sha256(unhex(concat(max(CASE WHEN idx % 2 = 0 THEN h END), coalesce(max(CASE WHEN idx % 2 = 1 THEN h END), max(CASE WHEN idx % 2 = 0 THEN h END))))), CAST(ceil(n / 2.0) AS BIGINT) FROM tree WHERE n > 1 GROUP BY case_id, lvl, idx // 2, n),
  roots AS (SELECT case_id, h AS merkle_root FROM tree WHERE n = 1)"""


def _leaves(src):
    return custody.leaves(src.audit.withColumn("seq", F.col("record_no")))


@query("sealed_leaves", _LEAVES + " SELECT * FROM lv", uses=("audit",))
def _(src):
    return _leaves(src)


@query("merkle_roots", _ROOT + " SELECT r.case_id, merkle_root, n AS leaf_count FROM roots r JOIN (SELECT case_id, count(*) AS n FROM lv GROUP BY 1) c ON r.case_id = c.case_id", uses=("audit",))
def _(src):
    return custody.merkle_root(_leaves(src))


@query(
    "order_merkle_roots",
    """WITH RECURSIVE lv AS (SELECT o_orderpriority AS case_id, sha256(CAST(o_orderkey AS VARCHAR)) AS digest_hex, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS leaf_idx FROM orders)"""
    + _ROOT[len(_LEAVES):] + " SELECT case_id, merkle_root FROM roots",
)
def _(src):
    from tracewright.operators.ordered import dense_index

    rows = src.given("orders").select(F.col("o_orderpriority").alias("case_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("digest_hex"), "o_orderkey")
    indexed = dense_index(rows, ["case_id"], ["o_orderkey"], F.floor(F.col("o_orderkey") / 4096), "leaf_idx")
    return custody.merkle_root(indexed).select("case_id", "merkle_root")


@query("inclusion_proofs", _ROOT + " SELECT lv.case_id, leaf_idx, TRUE AS proof_ok, merkle_root AS root FROM lv JOIN roots ON lv.case_id = roots.case_id WHERE kind = 'finding'", uses=("audit",))
def _(src):
    leaves = _leaves(src)
    proofs = custody.inclusion_proofs(leaves, leaves.where("kind = 'finding'").select("case_id", "leaf_idx"))
    return custody.check_proofs(proofs).select("case_id", "leaf_idx", "proof_ok", "root")


@query(
    "leaf_differences",
    _LEAVES + """, rw AS (SELECT l.*, a.value FROM lv l JOIN audit a ON l.case_id = a.case_id AND l.seq = a.record_no)
       SELECT case_id, leaf_idx, digest_hex AS derived, CASE WHEN value > 150 THEN md5(digest_hex) END AS declared FROM rw WHERE value > 120""",
    uses=("audit",),
)
def _(src):
    derived = _leaves(src)
    tagged = derived.join(src.audit.select("case_id", F.col("record_no").alias("seq"), "value"), ["case_id", "seq"])
    # Declared leaves miss some records and carry wrong digests for others.
    declared = tagged.where("value <= 120 OR value > 150").withColumn("digest_hex", F.when(F.col("value") > 150, F.md5("digest_hex")).otherwise(F.col("digest_hex")))
    out = joins.leaf_diff(declared, derived)
    return out.select("case_id", "leaf_idx", F.col("derived.digest_hex").alias("derived"), F.col("declared.digest_hex").alias("declared"))


@query(
    "manifest_checks",
    _ROOT + _STATE.replace(", st AS", ", st AS", 1) + """, c AS (SELECT case_id, count(*) AS records, count(reason) = 0 AS chain_ok, min(CASE WHEN reason IS NOT NULL THEN position END) AS break_at, arg_min(reason, position) FILTER (WHERE reason IS NOT NULL) AS reason FROM ck GROUP BY 1)
       SELECT c.case_id, chain_ok, records % 3 > 0 AS count_ok, TRUE AS final_ok, TRUE AS leaves_ok, records % 2 = 0 AS root_ok, TRUE AS leaf_count_ok, records % 5 > 0 AS signature_present, chain_ok AND records % 3 > 0 AND records % 2 = 0 AND records % 5 > 0 AS overall, break_at, reason FROM c""",
    uses=("audit",),
)
def _(src):
    leaves, chain = _leaves(src), custody.first_breaks(_checked(src))
    roots = custody.merkle_root(leaves)
    n = F.col("records")
    manifest = roots.join(chain.select("case_id", "records", "final_hash"), "case_id").select(
        "case_id", "leaf_count", F.col("final_hash").alias("audit_log_final_hash"),
        F.when(n % 3 > 0, n).otherwise(n + 1).alias("audit_log_record_count"), F.when(n % 2 == 0, F.col("merkle_root")).otherwise(F.lit("0")).alias("merkle_root_hex"), (n % 5 > 0).alias("signature_present"),
    )
    return custody.compare_manifest(manifest, leaves, chain, leaves)


@query(
    "finding_traces",
    """, pc AS (SELECT case_id, tool_call_id, min(CASE WHEN kind = 'tool_call_start' THEN record_no END) AS ss, min(CASE WHEN kind = 'tool_call_output' THEN record_no END) AS os, max(CASE WHEN kind = 'tool_call_output' AND output_hash <> '' THEN output_hash END) AS dg FROM audit WHERE tool_call_id <> '' GROUP BY 1, 2),
       ap AS (SELECT case_id, finding_id, min(record_no) AS s FROM audit WHERE kind = 'finding_approved' GROUP BY 1, 2), f AS (SELECT case_id, finding_id, tool_call_id FROM audit WHERE kind IN ('finding_approved', 'verifier_action'))
       SELECT f.case_id, f.finding_id, f.tool_call_id <> '' AS has_citation, ss IS NOT NULL AS has_start, os IS NOT NULL AS has_output, dg IS NOT NULL AS has_digest, ap.s IS NOT NULL AS is_approved,
              coalesce(f.tool_call_id <> '' AND ss IS NOT NULL AND os IS NOT NULL AND dg IS NOT NULL AND ap.s IS NOT NULL AND os < ap.s, FALSE) AS traced
       FROM f LEFT JOIN pc ON f.case_id = pc.case_id AND f.tool_call_id = pc.tool_call_id LEFT JOIN ap ON f.case_id = ap.case_id AND f.finding_id = ap.finding_id""",
    uses=("audit",),
)
def _(src):
    audit = src.audit.withColumn("seq", F.col("record_no"))
    findings = audit.where("kind IN ('finding_approved', 'verifier_action')").select("case_id", "finding_id", "tool_call_id")
    return joins.trace(findings, audit).select("case_id", "finding_id", "has_citation", "has_start", "has_output", "has_digest", "is_approved", "traced")


@query(
    "uncited_findings",
    """, m AS (SELECT case_id, tool_call_id, min(record_no) AS o FROM audit WHERE kind = 'tool_call_output' AND tool_call_id <> '' GROUP BY 1, 2)
       SELECT a.case_id, finding_id, record_no AS seq, a.tool_call_id FROM audit a LEFT JOIN m ON a.case_id = m.case_id AND a.tool_call_id = m.tool_call_id WHERE kind = 'finding_approved' AND (o IS NULL OR o >= record_no)""",
    uses=("audit",),
)
def _(src):
    return joins.uncited(src.audit.withColumn("seq", F.col("record_no")))


@query("latest_output_hash", "SELECT case_id, arg_max(output_hash, record_no) AS output_hash, max(record_no) AS seq FROM audit WHERE kind = 'tool_call_output' GROUP BY 1", uses=("audit",))
def _(src):
    return windows.latest_of_kind(src.audit.withColumn("seq", F.col("record_no")), "tool_call_output", "output_hash")


@query(
    "trace_files",
    _STATE + " SELECT case_id AS file, count(*) AS records, count(reason) = 0 AS chain_ok FROM ck GROUP BY 1",
    uses=("audit",),
)
def _(src):
    return custody.first_breaks(_checked(src).withColumnRenamed("case_id", "file"), keys=("file",)).select("file", "records", "chain_ok")


@query(
    "finding_leaves",
    _LEAVES + """, t AS (SELECT *, CAST(regexp_extract(case_id, '[0-9]+') AS INTEGER) % 3 = 0 AND seq % 11 = 1 AS bad, seq % 7 = 3 AS nameless FROM lv),
       tc AS (SELECT case_id, count(*) FILTER (WHERE bad) AS nbad FROM t GROUP BY 1),
       fl AS (SELECT case_id, kind, record_id, min(leaf_idx) AS leaf_idx, arg_min(bad, leaf_idx) AS bad FROM t WHERE NOT nameless AND record_id <> '' GROUP BY 1, 2, 3),
       pc AS (SELECT case_id, tool_call_id, count(*) FILTER (WHERE kind = 'tool_call_start') > 0 AS ss, count(*) FILTER (WHERE kind = 'tool_call_output') > 0 AS os FROM audit WHERE tool_call_id <> '' GROUP BY 1, 2),
       f AS (SELECT case_id, finding_id, tool_call_id, kind = 'finding_approved' AS ap FROM audit WHERE kind IN ('finding_approved', 'verifier_action'))
       SELECT f.case_id, f.finding_id, c.leaf_idx AS call_leaf_idx, coalesce(NOT c.bad, FALSE) AS call_leaf_ok, coalesce(nbad - CAST(c.bad AS INTEGER) = 0, FALSE) AS call_proof_ok,
              g.leaf_idx AS finding_leaf_idx, coalesce(NOT g.bad, FALSE) AS finding_leaf_ok, coalesce(nbad - CAST(g.bad AS INTEGER) = 0, FALSE) AS finding_proof_ok,
              f.tool_call_id <> '' AND coalesce(ss AND os, FALSE) AND ap AND c.leaf_idx IS NOT NULL AND g.leaf_idx IS NOT NULL AS traced_to_leaf
       FROM f LEFT JOIN tc ON f.case_id = tc.case_id LEFT JOIN pc ON f.case_id = pc.case_id AND f.tool_call_id = pc.tool_call_id
         LEFT JOIN fl c ON c.kind = 'tool_call_output' AND c.case_id = f.case_id AND c.record_id = f.tool_call_id LEFT JOIN fl g ON g.kind = 'finding' AND g.case_id = f.case_id AND g.record_id = f.finding_id""",
    uses=("audit",),
)
def _(src):
    # Sealed leaves, roots and proofs all read the numbered leaves, so these are stored once.
    audit, leaves = src.audit.withColumn("seq", F.col("record_no")), cut_lineage(_leaves(src))
    # Every third case seals wrong digests; some leaves of all cases name no record.
    bad = (F.regexp_extract("case_id", "[0-9]+", 0).cast("int") % 3 == 0) & (F.col("seq") % 11 == 1)
    sealed = leaves.withColumn("digest_hex", F.when(bad, F.sha2("digest_hex", 256)).otherwise(F.col("digest_hex"))).withColumn("record_id", F.when(F.col("seq") % 7 == 3, "").otherwise(F.col("record_id")))
    roots = custody.merkle_root(leaves).withColumnRenamed("merkle_root", "merkle_root_hex")
    findings = audit.where("kind IN ('finding_approved', 'verifier_action')").select("case_id", "finding_id", "tool_call_id")
    flags = [f"{side}_{flag}" for side in ("call", "finding") for flag in ("leaf_idx", "leaf_ok", "proof_ok")]
    return custody.trace_to_leaves(findings, audit, sealed, roots).select("case_id", "finding_id", *flags, "traced_to_leaf")


@query(
    "sealed_slices",
    """SELECT case_id, record_no AS seq, finding_id AS subject, 2 AS matched, CASE WHEN value > 120 THEN 'value no longer holds at tier' WHEN record_no % 5 = 0 AND record_no % 7 < 4 THEN 'marked passed but lists failures' END AS slice_reason
       FROM audit WHERE kind = 'verifier_action'""",
    uses=("audit",),
)
def _(src):
    tier = F.col("confidence")
    entry = lambda path, expected, actual, mode: F.struct(F.lit(path).alias("path"), expected.alias("expected"), actual.alias("actual"), F.lit(mode).alias("match"))
    # Slices of large values were changed after sealing; some say that they passed although they list failures.
    slice_ = F.struct(
        F.array(F.to_json(entry("number", F.concat(F.lit("0x"), F.lower(F.hex("record_no"))), F.col("record_no"), "int")), F.to_json(entry("tier", tier, F.when(F.col("value") > 120, "changed").otherwise(tier), "exact"))).alias("matched"),
        (F.col("record_no") % 7 < 4).alias("passed"),
    )
    shown = F.concat(F.lit('{"matched":['), F.array_join(slice_["matched"], ","), F.lit('],"passed":'), slice_["passed"].cast("string"), F.when(F.col("record_no") % 5 == 0, ',"failures":[{"path":"tier"}]}').otherwise(',"failures":[]}'))
    line = F.concat(F.lit('{"kind":"replay","seq":'), F.col("record_no").cast("string"), F.lit(',"payload":{"finding_id":"'), F.col("finding_id"), F.lit('","replay_artifact":{"entailment":'), shown, F.lit("}}}"))
    return custody.recheck_slices(src.audit.where("kind = 'verifier_action'").withColumn("line", line))


@query(
    "committed_traces",
    """WITH e AS (SELECT event_id // 2 AS pair, event_id % 2 AS half, user_id, value FROM events),
       p AS (SELECT pair, count(*) AS n, max(CASE WHEN half = 1 THEN value END) AS value, min(half) AS start, min(user_id) AS owner FROM e GROUP BY 1)
       , r AS (SELECT *, CASE WHEN pair % 13 = 0 THEN 'no_summary' WHEN pair % 2 = 0 AND value > 120 AND n = 2 THEN 'prev_hash' WHEN pair % 2 = 0 AND owner % 5 = 0 THEN 'file_digest' WHEN pair % 2 = 0 THEN NULL
              WHEN start = 1 THEN 'sequence' WHEN n < 2 OR owner % 5 = 0 THEN 'record_count' WHEN value > 150 THEN 'spot_tool' WHEN value > 120 THEN 'spot_digest' END AS reason FROM p)
       SELECT concat('pair-', pair) AS file, CASE WHEN pair % 2 = 0 THEN 'chained' ELSE 'flat' END AS format, n AS records, CASE reason WHEN 'prev_hash' THEN 1 WHEN 'sequence' THEN 0 END AS break_at, reason, reason IS NULL AS ok FROM r""",
)
def _(src):
    """Two events make an excerpt: even pairs are chained, odd ones flat; large values stand for changes after publication."""
    rows = src.given("events").select(F.floor(F.col("event_id") / 2).alias("pair"), (F.col("event_id") % 2).alias("half"), "event_id", "event_type", "user_id", "value")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    chained = lambda prev: text('{"kind":"', F.col("event_type"), '","prev_hash":"', prev, '","seq":', F.col("event_id"), "}")
    digest = F.sha2(F.col("event_type").cast("binary"), 256)
    flat = text('{"kind":"tool_call_output","output_hash":"', digest, '","seq":', F.col("half"), ',"tool":"', F.col("event_type"), '"}')
    before = rows.where("half = 0").select("pair", F.sha2(chained(F.lit("")).cast("binary"), 256).alias("prev"))
    linked = rows.join(before, "pair", "left")
    prev = F.when(F.col("half") == 0, "").when(F.col("value") > 120, "0").otherwise(F.coalesce("prev", F.lit("")))
    file = text("pair-", F.col("pair"))
    lines = linked.select(file.alias("file"), F.col("half").alias("line_no"), F.when(F.col("pair") % 2 == 0, chained(prev)).otherwise(flat).alias("line"))
    late = F.col("half") == 1
    said = rows.where("pair % 13 <> 0").groupBy("pair").agg(
        F.min("user_id").alias("owner"), F.max(F.when(late, F.col("value"))).alias("value"), F.max(F.when(late, F.col("event_type"))).alias("tool"), F.max(F.when(late, digest)).alias("digest")
    )
    odd = F.col("owner") % 5 == 0
    summaries = said.select(
        file.alias("file"), F.sha2(file, 256).alias("file_sha256"), F.when(odd, "0").otherwise(F.sha2(file, 256)).alias("excerpt_sha256"), F.when(odd, 3).otherwise(2).cast("long").alias("record_count"), F.lit(1).cast("long").alias("tool_output_seq"),
        F.when(F.col("value") > 150, "other").otherwise(F.col("tool")).alias("tool_name"), F.when(F.col("value") > 120, "0").otherwise(F.col("digest")).alias("tool_output_sha256"), F.lit(None).cast("string").alias("evidence_sha256"),
    )
    return custody.committed_traces(lines, summaries)
