"""Fleet queries: processes across hosts, clusters in time, densities, host reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import aggregates, filters, joins, setops, topk, windows
from tracewright.operators.ordered import DAY_US, slot
from tracewright.plans.catalog import query

_COMMON = ", ".join("'" + n + "'" for n in sorted({p.strip().lower()[:14] for p in filters.COMMON_PROCESSES}))
_UNCOMMON = f"substring(lower(trim(image_name)), 1, 14) NOT IN ({_COMMON})"

CLUSTERS = """
  , ordered AS (SELECT us, host, CASE WHEN us - lag(us) OVER (ORDER BY us, event_id) <= 60000000 THEN 0 ELSE 1 END AS fresh, event_id FROM ps),
  chained AS (SELECT us, host, sum(fresh) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM ordered),
  clusters AS (SELECT min(us) AS first_us, max(us) AS last_us, max(us) - min(us) AS duration_us, count(DISTINCT host) AS host_count, count(*) AS events
  FROM chained GROUP BY chain HAVING count(DISTINCT host) >= 2)"""


@query("temporal_clusters", CLUSTERS + " SELECT * FROM clusters", uses=("ps",))
def _(src):
    return windows.temporal_clusters(src.ps)


@query(
    "cross_host_processes",
    f"""SELECT image_name, count(DISTINCT host) AS host_count, count(*) AS hits, min(host) AS first_host FROM ps
        WHERE {_UNCOMMON} GROUP BY image_name HAVING count(DISTINCT host) >= 2""",
    uses=("ps",),
)
def _(src):
    return aggregates.cross_host_processes(src.ps, filters.is_uncommon(F.col("image_name")))


@query(
    "cross_host_hits",
    f"""SELECT p.host, p.image_name, p.pid, p.us, n.host_count FROM ps p JOIN
        (SELECT image_name, count(DISTINCT host) AS host_count FROM ps WHERE {_UNCOMMON} GROUP BY image_name HAVING count(DISTINCT host) >= 2) n
        ON p.image_name = n.image_name""",
    uses=("ps",),
)
def _(src):
    return aggregates.cross_host_hits(src.ps, filters.is_uncommon(F.col("image_name"))).select("host", "image_name", "pid", "us", "host_count")


@query(
    "cross_host_parts",
    """SELECT concat('part-', CAST(l_partkey AS STRING)) AS image_name, count(DISTINCT l_suppkey) AS host_count, count(*) AS hits, min(concat('s', CAST(l_suppkey AS STRING))) AS first_host
       FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2""",
)
def _(src):
    rows = src.given("lineitem").select(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("image_name"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("host"))
    return aggregates.cross_host_processes(rows, F.lit(True))


@query(
    "uncommon_processes",
    f"SELECT host, image_name, pid, substring(lower(trim(image_name)), 1, 14) AS image14 FROM ps WHERE {_UNCOMMON}",
    uses=("ps",),
)
def _(src):
    from tracewright.functions.paths import image14

    return src.ps.where(filters.is_uncommon(F.col("image_name"))).select("host", "image_name", "pid", image14(F.col("image_name")).alias("image14"))


@query(
    "technique_density",
    "SELECT mitre_technique, count(DISTINCT host) AS hosts FROM findings WHERE mitre_technique <> '' GROUP BY mitre_technique",
    uses=("findings",),
)
def _(src):
    return aggregates.technique_density(src.findings)


@query(
    "outcome_distribution",
    """SELECT coalesce(outcome, '?') AS outcome, count(*) AS hosts FROM (SELECT CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 3000 THEN 'NO_EVIL' WHEN c_acctbal < 6000 THEN 'INDETERMINATE' ELSE 'SUSPICIOUS' END AS outcome FROM customer) GROUP BY 1""",
)
def _(src):
    bal = F.col("c_acctbal")
    rows = src.given("customer").select(F.when(bal < 0, None).when(bal < 3000, "NO_EVIL").when(bal < 6000, "INDETERMINATE").otherwise("SUSPICIOUS").alias("outcome"))
    return aggregates.outcome_distribution(rows)


@query(
    "distinct_roots",
    """SELECT c_nationkey, count(DISTINCT root) AS distinct_roots, count(*) AS total_roots
       FROM (SELECT c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE md5(CAST(c_custkey % 400 AS STRING)) END AS root FROM customer) WHERE coalesce(root, '') <> '' GROUP BY c_nationkey""",
)
def _(src):
    root = F.when(F.col("c_custkey") % 7 != 0, F.md5((F.col("c_custkey") % 400).cast("string")))
    return aggregates.distinct_roots(src.given("customer").withColumn("root", root), "root", ["c_nationkey"])


@query(
    "modal_answers",
    """, per AS (SELECT o_custkey % 200 AS criterion, o_orderpriority AS answer, count(*) AS n FROM orders GROUP BY 1, 2),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY n DESC, answer) AS r, sum(n) OVER (PARTITION BY criterion) AS total, count(*) OVER (PARTITION BY criterion) AS kinds FROM per)
       SELECT criterion, CAST(total AS BIGINT) AS host_count, answer AS modal_answer, n AS modal_share, kinds AS distinct_answers FROM ranked WHERE r = 1""".replace(", per", "WITH per", 1),
)
def _(src):
    rows = src.given("orders").select((F.col("o_custkey") % 200).alias("criterion"), F.col("o_orderpriority").alias("answer"))
    return aggregates.modal_answers(rows)


@query(
    "process_view_difference",
    """, a AS (SELECT host, pid, image_name FROM ps WHERE origin <> 'purchase'), b AS (SELECT host, pid, image_name FROM ps WHERE origin <> 'error'),
       c AS (SELECT host, pid, image_name, sum(x) AS in_a, sum(y) AS in_b FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0 AS x, 1 AS y FROM b) GROUP BY 1, 2, 3)
       SELECT host, pid, image_name, CAST(in_a AS BIGINT) AS in_a, CAST(in_b AS BIGINT) AS in_b,
              CASE WHEN in_a = 0 THEN 'scan_only' WHEN in_b = 0 THEN 'list_only' ELSE 'count_differs' END AS difference FROM c WHERE in_a <> in_b""",
    uses=("ps",),
)
def _(src):
    ps = src.ps
    return joins.view_diff(ps.where("origin <> 'purchase'"), ps.where("origin <> 'error'"))


@query(
    "hidden_processes",
    """, a AS (SELECT host, pid, image_name FROM ps WHERE origin <> 'purchase'), b AS (SELECT host, pid, image_name FROM ps WHERE origin <> 'error')
       SELECT DISTINCT host, pid, image_name, 'T1014' AS technique, 'INFERRED' AS confidence FROM b WHERE (host, pid, image_name) NOT IN (SELECT (host, pid, image_name) FROM a)""",
    uses=("ps",),
)
def _(src):
    from tracewright.operators.detect_events import hidden_processes

    ps = src.ps
    return hidden_processes(ps.where("origin <> 'purchase'"), ps.where("origin <> 'error'"))


@query(
    "process_view_minus",
    """, a AS (SELECT host, image_name FROM ps WHERE origin <> 'purchase'), b AS (SELECT host, image_name FROM ps WHERE origin <> 'click')
       SELECT host, image_name FROM a EXCEPT SELECT host, image_name FROM b""",
    uses=("ps",),
)
def _(src):
    ps = src.ps
    return setops.view_minus(ps.where("origin <> 'purchase'"), ps.where("origin <> 'click'"), ["host", "image_name"])


@query("processes_by_pid", "SELECT host, pid, image_name FROM ps WHERE pid IN (1004, 1100, 1399)", uses=("ps",))
def _(src):
    return filters.filter_ids(src.ps, [1004, 1100, 1399], "pid").select("host", "pid", "image_name")


@query(
    "host_groups",
    """SELECT case_id, host, count(*) AS finding_count, count(*) FILTER (WHERE confidence = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE confidence = 'INFERRED') AS inferred,
       count(*) FILTER (WHERE confidence = 'HYPOTHESIS') AS hypothesis, min(us) AS first_us, max(us) AS last_us, count(DISTINCT artifact_path) AS sources FROM findings GROUP BY 1, 2""",
    uses=("findings",),
)
def _(src):
    return aggregates.host_groups(src.findings)


@query(
    "image_hosts",
    """SELECT CASE WHEN regexp_extract(path, '(?i)/extracted/[^/]+/([^/]+)/', 1) <> '' THEN regexp_extract(path, '(?i)/extracted/[^/]+/([^/]+)/', 1) ELSE s_name END AS host, count(*) AS artifacts
       FROM (SELECT s_name, CASE WHEN s_suppkey % 3 = 0 THEN concat('/evidence/', s_name, '.evtx') ELSE concat('cases/x/Extracted/disk/d', CAST(s_nationkey AS STRING), '/mft/$MFT') END AS path FROM supplier) GROUP BY 1""",
)
def _(src):
    path = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("/evidence/"), "s_name", F.lit(".evtx"))).otherwise(
        F.concat(F.lit("cases/x/Extracted/disk/d"), F.col("s_nationkey").cast("string"), F.lit("/mft/$MFT"))
    )
    rows = src.given("supplier").select(aggregates.image_host(path, F.col("s_name")).alias("host"))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("artifacts"))


@query(
    "dense_period",
    CLUSTERS + """, m AS (SELECT (year(make_timestamp(us)) * 12 + month(make_timestamp(us)) - 1) AS month_no, count(*) AS n FROM usn GROUP BY 1),
       p AS (SELECT month_no AS pk, n AS pn FROM m ORDER BY n DESC, month_no LIMIT 1),
       k AS (SELECT month_no, n, month_no - row_number() OVER (ORDER BY month_no) AS run FROM m, p WHERE n >= greatest(1, pn * 0.2))
       SELECT min(month_no) AS from_month, max(month_no) AS to_month, max(pk) AS peak_month, CAST(sum(n) AS BIGINT) AS clusters FROM k, p WHERE run = (SELECT run FROM k, p WHERE month_no = pk)""",
    uses=("ps", "usn"),
)
def _(src):
    return windows.dense_period(src.usn, us="us")


@query(
    "attack_chain",
    """, f AS (SELECT case_id, host, finding_id, us, CASE mitre_technique WHEN 'T1059.001' THEN 'execution' WHEN 'T1055' THEN 'defense-evasion' WHEN 'T1014' THEN 'defense-evasion'
         WHEN 'T1070.001' THEN 'impact' WHEN 'T1547.001' THEN 'persistence' ELSE 'unknown' END AS phase FROM findings),
       g AS (SELECT *, CASE phase WHEN 'execution' THEN 2 WHEN 'persistence' THEN 3 WHEN 'defense-evasion' THEN 5 WHEN 'impact' THEN 12 ELSE 99 END AS phase_rank FROM f)
       SELECT case_id, host, finding_id, phase, CAST(phase_rank AS BIGINT) AS phase_rank, row_number() OVER (PARTITION BY case_id, host ORDER BY phase_rank, us, finding_id) AS step FROM g""",
    uses=("findings",),
)
def _(src):
    t = F.col("mitre_technique")
    phase = F.when(t == "T1059.001", "execution").when(t.isin("T1055", "T1014"), "defense-evasion").when(t == "T1070.001", "impact").when(t == "T1547.001", "persistence").otherwise("unknown")
    rows = src.findings.select("case_id", "host", "finding_id", "us", phase.alias("phase"))
    return windows.attack_chain(rows).drop("us")


@query(
    "entity_index",
    """, e AS (SELECT us, event_id, 'account' AS kind, account AS value FROM timeline UNION ALL SELECT us, event_id, 'source_ip', source_ip FROM timeline)
       SELECT kind, value, count(*) AS events, min(us) AS first_us, max(us) AS last_us, count(DISTINCT event_id % 50) AS linked_findings FROM e WHERE value <> '' GROUP BY 1, 2""",
    uses=("timeline",),
)
def _(src):
    rows = src.timeline.withColumn("entities", F.create_map(F.lit("account"), F.col("account"), F.lit("source_ip"), F.col("source_ip"))).withColumn("f", F.col("event_id") % 50)
    return aggregates.entity_index(rows, finding="f")


@query(
    "key_events",
    """, s AS (SELECT *, CASE WHEN account <> '' OR source_ip <> '' THEN 0 WHEN significance = 'triage_lead' THEN 1 ELSE 2 END AS priority FROM timeline
         WHERE significance IN ('finding_support', 'triage_lead') OR account <> '' OR source_ip <> ''),
       f AS (SELECT *, row_number() OVER (PARTITION BY case_id, summary ORDER BY event_id) AS r FROM s),
       p AS (SELECT case_id, summary, us, event_id, priority, row_number() OVER (PARTITION BY case_id ORDER BY priority, us, event_id) AS pick FROM f WHERE r = 1)
       SELECT case_id, summary, us, event_id, CAST(priority AS BIGINT) AS priority, pick FROM p WHERE pick <= 12""",
    uses=("timeline",),
)
def _(src):
    rows = src.timeline.withColumn("entities", F.create_map(F.lit("account"), F.col("account"), F.lit("source_ip"), F.col("source_ip")))
    out = windows.key_events(rows)
    return out.withColumn("priority", F.col("priority").cast("long")).withColumn("pick", F.col("pick").cast("long"))


@query(
    "numbered_timeline",
    """SELECT case_id, event_id, printf('timeline-%04d', n) AS row_id
       FROM (SELECT case_id, event_id, row_number() OVER (PARTITION BY case_id ORDER BY us, event_id) AS n FROM timeline)""",
    uses=("timeline",),
)
def _(src):
    return windows.number_rows(src.timeline.select("case_id", "event_id", "us"), ["case_id"], ["us", "event_id"], slot("us", DAY_US), "timeline").drop("us")


@query(
    "artifact_selection",
    """, c AS (SELECT s.s_nationkey % 3 AS tier, p.p_size % 4 AS class_priority, p.p_partkey % 10 AS sub_rank, p.p_size AS partition_rank, concat(p.p_name, '/', CAST(p.p_partkey AS STRING)) AS path, p.p_partkey % 5 AS k
         FROM part p JOIN supplier s ON p.p_partkey % 100 = s.s_suppkey),
       t AS (SELECT *, row_number() OVER (PARTITION BY k, tier, class_priority ORDER BY sub_rank, partition_rank, path) AS turn FROM c),
       q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, turn, class_priority, path) AS pick FROM t)
       SELECT k, tier, class_priority, path, turn, pick FROM q WHERE pick <= 25""".replace(", c", "WITH c", 1),
)
def _(src):
    part, supplier = src.given("part"), src.given("supplier")
    c = part.join(supplier, F.col("p_partkey") % 100 == F.col("s_suppkey")).select(
        (F.col("s_nationkey") % 3).alias("tier"), (F.col("p_size") % 4).alias("class_priority"), (F.col("p_partkey") % 10).alias("sub_rank"),
        F.col("p_size").alias("partition_rank"), F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_partkey") % 5).alias("k"),
    )
    out = topk.round_robin(c, 25, ["k"])
    return out.select("k", "tier", "class_priority", "path", F.col("turn").cast("long").alias("turn"), F.col("pick").cast("long").alias("pick"))


@query(
    "impossible_travel",
    """, p AS (SELECT *, lag(us) OVER w AS pu, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lag(source_ip) OVER w AS pi FROM signins WINDOW w AS (PARTITION BY actor ORDER BY us, event_id)),
       d AS (SELECT *, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - pa) / 2), 2) + cos(radians(pa)) * cos(radians(lat)) * pow(sin(radians(lon - po) / 2), 2)))) AS km FROM p WHERE pu IS NOT NULL AND us > pu)
       SELECT actor, event_id, us, pi AS from_ip, source_ip AS to_ip, round(km, 3) AS distance_km, round(km / ((us - pu) / 3600000000.0), 3) AS velocity_kmh
       FROM d WHERE km / ((us - pu) / 3600000000.0) > 1000""",
    uses=("signins",),
)
def _(src):
    return windows.impossible_travel(src.signins).withColumn("distance_km", F.round("distance_km", 3)).withColumn("velocity_kmh", F.round("velocity_kmh", 3))


_BURST = """, d AS (SELECT actor, us, event_id, count(*) OVER (PARTITION BY actor ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM signins WHERE outcome = '500121'),
       b AS (SELECT *, EXISTS (SELECT 1 FROM signins s WHERE s.actor = d.actor AND s.outcome = '0' AND s.us > d.us AND s.us <= d.us + 86400000000) AS ok FROM d WHERE n >= 7)"""


@query("prompt_bursts", _BURST + " SELECT actor, us, event_id, n AS prompt_count, ok AS accepted_after_denials FROM b", uses=("signins",))
def _(src):
    return windows.prompt_bursts(src.signins, F.col("outcome") == "500121", F.col("outcome") == "0", prompts=7, minutes=1440)


@query(
    "mfa_fatigue",
    _BURST + " SELECT actor, max(n) AS prompt_count, min(us) AS first_us, bool_or(ok) AS accepted_after_denials, 'T1621' AS technique FROM b GROUP BY actor",
    uses=("signins",),
)
def _(src):
    from tracewright.operators.detect_web import fatigue_leads

    return fatigue_leads(src.signins, prompts=7, minutes=1440)


@query(
    "process_parents",
    """, c AS (SELECT * FROM event_log WHERE eid = 4688)
       SELECT c.host, c.record_id, c.parent_pid, p.process_name AS parent_process_name, p.record_id AS parent_record_id
       FROM c ASOF LEFT JOIN c p ON c.host = p.host AND c.parent_pid = p.new_pid AND c.us > p.us""",
    uses=("event_log",),
)
def _(src):
    out = joins.process_parents(src.event_log.where("eid = 4688"))
    return out.select("host", "record_id", "parent_pid", "parent_process_name", "parent_record_id")


@query(
    "union_timeline",
    """, u AS (SELECT us, host, 'process' AS artifact, image_name AS subject, pid, CAST(NULL AS BIGINT) AS mft_entry FROM ps UNION ALL SELECT us, host, 'journal', filename, NULL, mft_entry FROM usn)
       SELECT artifact, host, count(*) AS n, count(pid) AS with_pid, count(mft_entry) AS with_entry, min(us) AS first_us, max(us) AS last_us FROM u GROUP BY 1, 2""",
    uses=("ps", "usn"),
)
def _(src):
    a = src.ps.select("us", "host", F.lit("process").alias("artifact"), F.col("image_name").alias("subject"), "pid")
    b = src.usn.select("us", "host", F.lit("journal").alias("artifact"), F.col("filename").alias("subject"), "mft_entry")
    return setops.union_timeline(a, b).groupBy("artifact", "host").agg(
        F.count(F.lit(1)).alias("n"), F.count("pid").alias("with_pid"), F.count("mft_entry").alias("with_entry"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )


@query(
    "capped_hits",
    "SELECT event_id, host, image_name, count(*) OVER (PARTITION BY host) AS total, count(*) OVER (PARTITION BY host) > 100 AS truncated FROM ps QUALIFY row_number() OVER (PARTITION BY host ORDER BY us, event_id) <= 100",
    uses=("ps",),
)
def _(src):
    return topk.capped(src.ps.select("event_id", "host", "image_name", "us"), ["us", "event_id"], 100, keys=("host",)).drop("us")


@query("top_processes", "SELECT image_name AS value, count(*) AS count FROM ps WHERE image_name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", uses=("ps",))
def _(src):
    return aggregates.value_counts(src.ps, F.col("image_name"), 10)


@query(
    "notable_applications",
    """, n AS (SELECT host, CASE event_id % 9 WHEN 0 THEN 'Chrome.exe' WHEN 1 THEN 'KeePass.exe' WHEN 2 THEN 'mspaint.exe' ELSE image_name END AS image_name, origin FROM ps),
       v AS (SELECT host, lower(trim(image_name)) AS image_name, 'list' AS view FROM n WHERE origin <> 'view' UNION ALL SELECT host, lower(trim(image_name)), 'scan' FROM n WHERE origin <> 'signup'),
       c AS (SELECT *, CASE image_name WHEN 'chrome.exe' THEN 'browser' WHEN 'keepass.exe' THEN 'credential_store' WHEN 'mspaint.exe' THEN 'user_application' END AS category FROM v)
       SELECT host, category, image_name, bool_or(view = 'list') AS in_list, bool_or(view = 'scan') AS in_scan, count(*) AS sightings,
              CASE WHEN category = 'credential_store' THEN 'T1555' END AS technique, 'INFERRED' AS confidence FROM c WHERE category IS NOT NULL GROUP BY 1, 2, 3""",
    uses=("ps",),
)
def _(src):
    from tracewright.operators.detect_events import notable_applications

    e = F.col("event_id") % 9
    name = F.when(e == 0, "Chrome.exe").when(e == 1, "KeePass.exe").when(e == 2, "mspaint.exe").otherwise(F.col("image_name"))
    rows = src.ps.withColumn("image_name", name)
    return notable_applications(rows.where("origin <> 'view'"), rows.where("origin <> 'signup'"))


@query(
    "cluster_events",
    CLUSTERS + """, kept AS (SELECT chain, min(us) AS first_us, max(us) AS last_us FROM chained GROUP BY chain HAVING count(DISTINCT host) >= 2),
       named AS (SELECT event_id, sum(fresh) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM ordered)
       SELECT p.event_id, p.host, p.image_name, p.pid, p.us, k.first_us AS cluster_first_us, k.last_us AS cluster_last_us FROM ps p JOIN named n ON p.event_id = n.event_id JOIN kept k ON n.chain = k.chain""",
    uses=("ps",),
)
def _(src):
    return windows.cluster_events(src.ps).select("event_id", "host", "image_name", "pid", "us", "cluster_first_us", "cluster_last_us")
