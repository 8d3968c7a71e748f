"""Event-log queries: filters, summaries and leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import aggregates, detect_events, filters
from tracewright.plans.catalog import query


@query("events_by_id", "SELECT record_id, eid, channel, host FROM event_log WHERE eid IN (1102, 4624, 7045)", uses=("event_log",))
def _(src):
    return filters.filter_ids(src.event_log, [1102, 4624, 7045], "eid").select("record_id", "eid", "channel", "host")


@query("event_summary", "SELECT channel, eid, count(*) AS records, min(us) AS first_us, max(us) AS last_us FROM event_log GROUP BY 1, 2", uses=("event_log",))
def _(src):
    return aggregates.event_summary(src.event_log)


@query(
    "parse_stats",
    """SELECT user_id, count(*) AS records_seen, count(*) FILTER (WHERE ok AND k >= 50) AS row_count, count(*) FILTER (WHERE NOT ok) AS parse_errors, count(*) FILTER (WHERE ok) = 0 AS all_failed
       FROM (SELECT user_id, event_id % 9 > 0 AS ok, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events) GROUP BY 1""",
)
def _(src):
    rows = src.given("events").withColumn("doc", F.when(F.col("event_id") % 9 > 0, F.col("props")))
    k = F.get_json_object("doc", "$.k").cast("long")
    return filters.parse_stats(rows, ["user_id"], F.col("doc").isNotNull(), F.coalesce(k >= 50, F.lit(False)))


@query(
    "network_filter",
    """, n AS (SELECT *, CASE WHEN logon_type = '10' THEN NULL ELSE us END AS t, concat('10.0.0.', CAST(length(payload) % 5 AS STRING)) AS dip, CASE WHEN length(account) = 5 THEN 443 ELSE 80 END AS dport FROM event_log)
       SELECT record_id, host FROM n WHERE eid IN (3, 22) AND (t IS NULL OR (t >= 1704412800000000 AND t <= 1705881600000000)) AND contains(lower(process_name), 'tools') AND dip = '10.0.0.3' AND dport = 80""",
    uses=("event_log",),
)
def _(src):
    rows = src.event_log.withColumn("image", F.col("process_name")).withColumns({
        "us": F.when(F.col("logon_type") != "10", F.col("us")), "event_id": F.col("eid"), "destination_ip": F.concat(F.lit("10.0.0."), (F.length("payload") % 5).cast("string")),
        "destination_port": F.when(F.length("account") == 5, 443).otherwise(80),
    })
    return filters.network_filter(rows, (3, 22), F.lit(1704412800000000), F.lit(1705881600000000), "TOOLS", "10.0.0.3", 80).select("record_id", "host")


@query(
    "minimum_level",
    """SELECT o_orderkey, level FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'informational' WHEN 1 THEN 'LOW' WHEN 2 THEN 'medium' WHEN 3 THEN 'High' WHEN 4 THEN 'critical' ELSE 'odd' END AS level FROM orders)
       WHERE lower(level) IN ('medium', 'high', 'critical')""",
)
def _(src):
    k = F.col("o_orderkey") % 6
    level = F.when(k == 0, "informational").when(k == 1, "LOW").when(k == 2, "medium").when(k == 3, "High").when(k == 4, "critical").otherwise("odd")
    return filters.min_level(src.given("orders").select("o_orderkey", level.alias("level")), "medium")


@query(
    "first_present_key",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'r0' WHEN event_id % 3 = 1 THEN 'r1' END AS rule, CASE WHEN event_id % 2 = 0 THEN event_type END AS level, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS STRING) AS detail_k FROM events""",
)
def _(src):
    e = F.col("event_id")
    named = F.when(e % 3 == 0, F.lit('"RuleTitle":"r0",')).when(e % 3 == 1, F.lit('"rule":"r1",')).otherwise("")
    leveled = F.when(e % 2 == 0, F.concat(F.lit('"Level":"'), "event_type", F.lit('",'))).otherwise("")
    doc = F.concat(F.lit("{"), named, leveled, F.substr("props", F.lit(2)))
    rows = src.given("events").select("event_id", doc.alias("raw"))
    out = filters.project_first(rows, "raw", {"rule": ["rule", "RuleTitle", "Rule"], "level": ["level", "Level"]})
    return out.select("event_id", "rule", "level", F.col("details")["k"].alias("detail_k"))


@query(
    "event_data_fields",
    """SELECT event_id, concat('user', CAST(user_id AS STRING)) AS account, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS BIGINT) END AS logon_type FROM events""",
)
def _(src):
    user = F.col("user_id").cast("string")
    second = F.when(F.col("event_id") % 2 == 0, user).otherwise("n/a")
    doc = F.concat(F.lit('{"Event":{"EventData":{"Data":[{"@Name":"TargetUserName","#text":"user'), user, F.lit('"},{"@Name":"LogonType","#text":"'), second, F.lit('"}]}}}'))
    out = filters.event_data(src.given("events").select("event_id", doc.alias("raw")))
    return out.select("event_id", F.col("fields")["TargetUserName"].alias("account"), F.col("fields")["LogonType"].try_cast("long").alias("logon_type"))


_LEAD = "host, '{kind}' AS kind, '{tech}' AS technique, '{conf}' AS confidence, {subject} AS subject, CAST({evidence} AS VARCHAR) AS evidence, {us} AS us"


def _lead_sql(kind, tech, conf, subject, evidence, us="us"):
    return _LEAD.format(kind=kind, tech=tech, conf=conf, subject=subject, evidence=evidence, us=us)


_FIRST = """, r AS ({rows}), f AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY us, evidence) AS rn, count(*) OVER (PARTITION BY {keys}) AS occurrences FROM r)
  SELECT host, kind, technique, confidence, subject, evidence, us, occurrences FROM f WHERE rn = 1"""


@query(
    "log_cleared",
    _FIRST.format(rows="SELECT " + _lead_sql("log_cleared", "T1070.001", "CONFIRMED", "channel", "record_id") + " FROM event_log WHERE eid = 1102", keys="host, kind, subject"),
    uses=("event_log",),
)
def _(src):
    return detect_events.log_cleared(src.event_log)


@query(
    "scheduled_tasks",
    "SELECT " + _lead_sql("scheduled_task", "T1053.005", "INFERRED", "service_name", "payload") + " FROM event_log WHERE eid = 4698 AND regexp_matches(payload, '(?i)-enc(odedcommand)?\\b|powershell|cmd(\\.exe)?\\s+/c|wscript|mshta|rundll32|frombase64string|https?://')",
    uses=("event_log",),
)
def _(src):
    return detect_events.scheduled_tasks(src.event_log)


@query(
    "management_children",
    """, c AS (SELECT * FROM event_log WHERE eid = 4688),
       j AS (SELECT c.host, c.process_name, c.us, p.process_name AS pn, p.record_id AS pr FROM c ASOF LEFT JOIN c p ON c.host = p.host AND c.parent_pid = p.new_pid AND c.us > p.us)
       SELECT host, 'management_child' AS kind, 'T1047' AS technique, 'HYPOTHESIS' AS confidence, process_name AS subject, CAST(pr AS VARCHAR) AS evidence, us FROM j WHERE lower(pn) LIKE '%\\wmiprvse.exe'""",
    uses=("event_log",),
)
def _(src):
    return detect_events.management_children(src.event_log)


@query(
    "service_installs",
    "SELECT " + _lead_sql("service_install", "T1543.003", "INFERRED", "service_name", "payload") + " FROM event_log WHERE eid = 7045 AND regexp_matches(payload, '(?i)\\b(cmd|powershell|pwsh|wscript|cscript|mshta|rundll32)\\.exe\\b')",
    uses=("event_log",),
)
def _(src):
    return detect_events.service_installs(src.event_log)


@query(
    "remote_desktop",
    _FIRST.format(
        rows="""SELECT host, CASE WHEN eid = 4624 THEN 'rdp_logon' ELSE 'rdp_session' END AS kind, 'T1021.001' AS technique, 'HYPOTHESIS' AS confidence, account AS subject, CAST(record_id AS VARCHAR) AS evidence, us
                FROM event_log WHERE (eid = 4624 AND logon_type = '10') OR (eid IN (21, 22, 25) AND channel LIKE '%TerminalServices-LocalSessionManager%')""",
        keys="host, kind, subject",
    ),
    uses=("event_log",),
)
def _(src):
    return detect_events.remote_desktop(src.event_log)


@query(
    "brute_force",
    "SELECT host, source_ip, count(*) AS failures, count(DISTINCT account) AS accounts, min(us) AS first_us, max(us) AS last_us FROM event_log WHERE eid = 4625 AND source_ip <> '' GROUP BY 1, 2 HAVING count(*) >= 2",
    uses=("event_log",),
)
def _(src):
    return aggregates.brute_force(src.event_log, least=2)


@query(
    "failed_logon_bursts",
    "SELECT " + _lead_sql("brute_force", "T1110", "HYPOTHESIS", "source_ip", "n", "first_us") + " FROM (SELECT host, source_ip, count(*) AS n, min(us) AS first_us FROM event_log WHERE eid = 4625 AND source_ip <> '' GROUP BY 1, 2 HAVING count(*) >= 3)",
    uses=("event_log",),
)
def _(src):
    return detect_events.failed_logon_bursts(src.event_log, least=3)


@query(
    "directory_dump",
    "SELECT " + _lead_sql("directory_dump", "T1003.003", "HYPOTHESIS", "database", "record_id") + " FROM event_log WHERE channel = 'Application' AND eid IN (216, 325, 327) AND contains(lower(database), 'ntds')",
    uses=("event_log",),
)
def _(src):
    return detect_events.directory_dump(src.event_log)


@query(
    "legacy_logons",
    _FIRST.format(rows="SELECT " + _lead_sql("logon", "T1078.001", "HYPOTHESIS", "account", "eid") + " FROM event_log WHERE eid IN (528, 540, 672, 680, 4624, 4768)", keys="host, kind, evidence, subject"),
    uses=("event_log",),
)
def _(src):
    return detect_events.legacy_logons(src.event_log)


@query(
    "service_recon",
    """, t AS (SELECT host, count(*) AS tools FROM registry WHERE regexp_matches(key_path, '(?i)\\\\services\\\\(npf|npcap|rpcapd|winpcap)$') AND regexp_matches(value_data, '(?i)(^|\\\\)(npf|npcap)\\.sys|rpcapd\\.exe') GROUP BY 1),
       c AS (SELECT host, service_name, eid, min(us) AS us FROM event_log WHERE eid IN (7035, 7036) GROUP BY 1, 2, 3)
       SELECT c.host, 'service_recon' AS kind, 'T1046' AS technique, 'HYPOTHESIS' AS confidence, service_name AS subject, CAST(tools AS VARCHAR) AS evidence, us FROM c JOIN t ON c.host = t.host""",
    uses=("event_log", "registry"),
)
def _(src):
    from tracewright.operators.detect_disk import capture_services

    return detect_events.service_recon(src.event_log, capture_services(src.registry))


@query(
    "recovered_commands",
    """, c AS (SELECT host, record_id AS pid, 'command_line' AS source, payload AS command, 'T1059.003' AS technique FROM event_log WHERE eid = 4688 AND (payload LIKE 'powershell.exe -%' OR payload LIKE 'C:\\Windows\\System32\\cmd.exe /c %')),
       h AS (SELECT host, record_id AS pid, 'console_history' AS source, concat('net user ', account) AS command, 'T1059.003' AS technique FROM event_log WHERE eid = 4634 AND record_id % 3 > 0)
       SELECT * FROM c UNION ALL SELECT * FROM h""",
    uses=("event_log",),
)
def _(src):
    log = src.event_log
    name = F.when(F.col("payload").startswith("powershell"), "powershell.exe").when(F.col("payload").contains("cmd.exe"), "cmd.exe").otherwise("app.exe")
    lines = log.where("eid = 4688").select("host", F.col("record_id").alias("pid"), name.alias("image_name"), F.col("payload").alias("command_line"))
    history = log.where("eid = 4634").select(
        "host", F.col("record_id").alias("pid"), F.lit("_COMMAND_HISTORY.CommandHistory").alias("property"),
        F.when(F.col("record_id") % 3 > 0, F.concat(F.lit("net user "), "account")).otherwise("  ").alias("data"),
    )
    return detect_events.recovered_commands(lines, history)
