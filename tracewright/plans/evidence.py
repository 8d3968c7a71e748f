"""Evidence tables derived from the given tables.

Each derivation is SQL that Spark and an ANSI engine read alike; the few words that differ are written as
macros: US(x) is the microseconds of a timestamp, SHA(x) a SHA-256 in hex.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.session import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

EVIDENCE = {
    "ps": """
        SELECT concat('host-', CAST(user_id % 20 AS STRING)) AS host,
               CASE event_type WHEN 'view' THEN 'svchost.exe' WHEN 'signup' THEN 'ManagementAgentHost.exe'
                    ELSE concat(event_type, '_', CAST(event_id % 211 AS STRING), '.exe') END AS image_name,
               CAST(1000 + event_id % 400 AS BIGINT) AS pid, CAST(1000 + (event_id * 7) % 400 AS BIGINT) AS ppid,
               US(ts) AS us, event_id, event_type AS origin
        FROM events""",
    "event_log": """
        SELECT event_id AS record_id, US(ts) AS us, concat('host-', CAST(user_id % 20 AS STRING)) AS host,
               CAST(CASE event_id % 14 WHEN 0 THEN 1102 WHEN 1 THEN 4698 WHEN 2 THEN 4688 WHEN 3 THEN 7045 WHEN 4 THEN 4624
                    WHEN 5 THEN 4625 WHEN 6 THEN 21 WHEN 7 THEN 325 WHEN 8 THEN 528 WHEN 9 THEN 7036 WHEN 10 THEN 4634
                    WHEN 11 THEN 22 WHEN 12 THEN 680 ELSE 3 END AS BIGINT) AS eid,
               CASE WHEN event_id % 14 IN (3, 9) THEN 'System' WHEN event_id % 14 = 7 THEN 'Application'
                    WHEN event_id % 14 IN (6, 11) AND event_id % 3 > 0 THEN 'Microsoft-Windows-TerminalServices-LocalSessionManager/Operational'
                    ELSE 'Security' END AS channel,
               concat('user', CAST(user_id AS STRING)) AS account,
               CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('10.0.', CAST(user_id % 7 AS STRING), '.', CAST(event_id % 19 AS STRING)) END AS source_ip,
               CASE WHEN event_id % 4 = 0 THEN '10' ELSE '3' END AS logon_type,
               CASE WHEN event_id % 6 = 1 THEN 'powershell.exe -EncodedCommand SQBFAFgA'
                    WHEN event_id % 6 = 3 THEN concat('C:\\\\Windows\\\\System32\\\\cmd.exe /c ', event_type)
                    ELSE concat('C:\\\\Program Files\\\\', event_type, '\\\\', event_type, '.exe') END AS payload,
               concat(event_type, '_svc') AS service_name,
               CASE WHEN event_id % 8 = 7 THEN 'C:\\\\Windows\\\\NTDS\\\\ntds.dit' ELSE 'C:\\\\ProgramData\\\\Search\\\\Windows.edb' END AS database,
               CAST(1000 + (event_id * 3) % 400 AS BIGINT) AS new_pid, CAST(1000 + (event_id * 7) % 400 AS BIGINT) AS parent_pid,
               CASE WHEN event_id % 9 = 2 THEN 'C:\\\\Windows\\\\System32\\\\wbem\\\\WmiPrvSE.exe' ELSE concat('C:\\\\Tools\\\\', event_type, '.exe') END AS process_name
        FROM events""",
    "signins": """
        SELECT event_id, concat('u', CAST(user_id % 40 AS STRING), '@corp.example') AS actor, US(ts) AS us,
               CAST(-60 + (event_id * 37) % 120 AS DOUBLE) AS lat, CAST(-180 + (event_id * 91) % 360 AS DOUBLE) AS lon,
               concat('203.0.', CAST(user_id % 11 AS STRING), '.', CAST(event_id % 23 AS STRING)) AS source_ip,
               CASE WHEN event_type IN ('error', 'click') THEN '500121' WHEN event_type = 'view' THEN '0' ELSE '50126' END AS outcome
        FROM events""",
    "packets": """
        SELECT concat('10.1.', CAST(l_suppkey % 8 AS STRING), '.', CAST(l_orderkey % 25 AS STRING)) AS src,
               concat('172.16.', CAST(l_partkey % 6 AS STRING), '.', CAST(l_suppkey % 10 AS STRING)) AS dst,
               CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(80 + l_linenumber AS STRING) END AS tcp_port,
               CASE WHEN l_linenumber % 3 = 0 THEN '53' ELSE '' END AS udp_port,
               CASE WHEN l_linenumber % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS proto,
               CASE WHEN l_linenumber % 3 = 1 THEN concat('www', CAST(l_partkey % 3 AS STRING), '.site', CAST(l_partkey % 17 AS STRING), '.example') ELSE '' END AS http_host,
               CASE WHEN l_linenumber % 3 <> 1 THEN '' WHEN l_returnflag = 'R' THEN 'POST' ELSE 'GET' END AS http_method,
               concat('/item/', CAST(l_partkey AS STRING), '?o=', CAST(l_orderkey AS STRING)) AS http_uri,
               CASE WHEN l_linenumber % 2 = 0 THEN concat('sid=', CAST(l_orderkey AS STRING), '; k = ', l_linestatus, ';;flag') ELSE '' END AS cookie,
               CASE WHEN l_linenumber = 7 THEN CAST(0 AS DOUBLE) ELSE US(l_shipdate) / 1000000.0 END AS ts,
               l_orderkey * 8 + l_linenumber AS pkt_no
        FROM lineitem""",
    "zeek": """
        SELECT CASE l_linenumber % 4 WHEN 0 THEN 'conn' WHEN 1 THEN 'dns' WHEN 2 THEN 'http' ELSE 'ssl' END AS log_kind,
               concat('10.1.', CAST(l_suppkey % 8 AS STRING), '.', CAST(l_orderkey % 25 AS STRING)) AS orig_h,
               CASE WHEN l_orderkey % 9 = 0 THEN '-' ELSE concat('172.16.', CAST(l_partkey % 6 AS STRING), '.1') END AS resp_h,
               concat('q', CAST(l_partkey % 61 AS STRING), '.example') AS query,
               CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat('h', CAST(l_suppkey AS STRING), '.example') END AS http_host,
               concat('tls', CAST(l_partkey % 13 AS STRING), '.example') AS server_name,
               US(l_shipdate) AS us
        FROM lineitem""",
    "usn": """
        SELECT concat('host-', CAST(o_orderkey % 20 AS STRING)) AS host,
               concat('job', CAST(o_orderkey % 700 AS STRING), CASE CAST(floor(o_orderkey / 7) AS BIGINT) % 5 WHEN 0 THEN '.zip' WHEN 1 THEN '.docx' WHEN 2 THEN '.cab' WHEN 3 THEN '.xlsx' ELSE '.rar' END) AS filename,
               CAST(256 AS BIGINT) AS reason_mask, US(o_orderdate) AS us, o_orderkey AS mft_entry, o_orderkey * 10 AS usn
        FROM orders
        UNION ALL
        SELECT concat('host-', CAST(l_orderkey % 20 AS STRING)) AS host,
               concat('job', CAST(l_orderkey % 700 AS STRING), CASE CAST(floor(l_orderkey / 7) AS BIGINT) % 5 WHEN 0 THEN '.zip' WHEN 1 THEN '.docx' WHEN 2 THEN '.cab' WHEN 3 THEN '.xlsx' ELSE '.rar' END) AS filename,
               CAST(CASE WHEN l_linenumber % 2 = 0 THEN 512 ELSE 2 END AS BIGINT) AS reason_mask,
               US(l_shipdate) + l_linenumber * 1000000 AS us, l_orderkey AS mft_entry, l_orderkey * 10 + l_linenumber AS usn
        FROM lineitem""",
    "findings": """
        SELECT concat('case-', CAST(conv_id % 40 AS STRING)) AS case_id,
               concat('host-', CAST(conv_id % 17 AS STRING)) AS host,
               concat(CASE WHEN role = 'user' THEN 'f-A-' ELSE 'f-B-' END, CAST(conv_id AS STRING), '-', CAST(CAST(floor(turn / 2) AS BIGINT) AS STRING)) AS finding_id,
               conv_id * 1000 + turn AS seq,
               CASE WHEN role = 'user' THEN 'A' ELSE 'B' END AS pool_origin,
               CASE WHEN (conv_id + turn) % 13 = 0 THEN '' ELSE concat('tc-', CAST(CAST(floor(conv_id / 2) AS BIGINT) AS STRING)) END AS tool_call_id,
               concat('/evidence/', CASE conv_id % 5 WHEN 0 THEN 'registry' WHEN 1 THEN 'prefetch' WHEN 2 THEN 'Security.evtx' WHEN 3 THEN 'memory.raw' ELSE 'mail' END, '/', CAST(conv_id % 40 AS STRING)) AS artifact_path,
               CASE (conv_id * 3 + turn * 2) % 5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'INFERRED' WHEN 2 THEN 'HYPOTHESIS' WHEN 3 THEN 'INFERRED' ELSE 'CONFIRMED' END AS confidence,
               CASE (CASE WHEN conv_id % 3 = 0 THEN conv_id + turn ELSE conv_id + CAST(floor(turn / 2) AS BIGINT) END) % 6 WHEN 0 THEN 'T1059.001' WHEN 1 THEN 'T1055' WHEN 2 THEN 'T1014' WHEN 3 THEN 'T1070.001' WHEN 4 THEN '' ELSE 'T1547.001' END AS mitre_technique,
               concat(text, CASE (conv_id * 5 + turn) % 7 WHEN 0 THEN ' It executed: Prefetch and Amcache agree.' WHEN 1 THEN ' Amcache shows it ran.'
                    WHEN 2 THEN ' Sysmon saw it launched.' WHEN 3 THEN ' UserAssist run count 3.' ELSE '' END) AS description,
               CASE (conv_id + turn) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'downgraded' WHEN 2 THEN 'rejected' ELSE 'approved' END AS verifier_action,
               CASE (conv_id + turn * 3) % 5 WHEN 0 THEN CAST(NULL AS BOOLEAN) WHEN 1 THEN FALSE ELSE TRUE END AS replay_matched,
               (conv_id * 977 + turn * 13) % 100000 * 1000000 AS us
        FROM conversations""",
    "cases": """
        SELECT concat('case-', CAST(c_custkey AS STRING)) AS case_id, c_custkey % 3 > 0 AS substantive
        FROM customer""",
    "calls": """
        SELECT concat('case-', CAST(o_custkey % 40 AS STRING)) AS case_id, concat('tc-', CAST(o_orderkey AS STRING)) AS tool_call_id,
               concat('tool_', CAST(o_orderkey % 9 AS STRING)) AS tool,
               CASE o_orderkey % 9 WHEN 0 THEN 'evtx' WHEN 1 THEN 'mft' WHEN 2 THEN 'prefetch' WHEN 3 THEN 'registry' WHEN 4 THEN 'memory'
                    WHEN 5 THEN 'network' WHEN 6 THEN 'usnjrnl' WHEN 7 THEN 'unknown' ELSE 'network' END AS artifact_class,
               CASE WHEN (o_custkey + o_orderkey) % 4 = 0 OR o_orderkey % 9 = 6 THEN 'failed' ELSE CAST(NULL AS STRING) END AS error,
               o_orderkey % 11 = 0 AS rejected, o_orderkey % 13 = 0 AS skipped,
               CAST(o_orderkey % 1000 AS BIGINT) AS records_seen, CAST(o_orderkey % 7 AS BIGINT) AS parse_errors
        FROM orders""",
    "requests": """
        SELECT page_id AS line_number, concat('198.51.100.', CAST(page_id % 30 AS STRING)) AS client_ip,
               concat(url, CASE page_id % 10
                    WHEN 0 THEN '&id=1%27%20UnIoN%20SELECT%20name%20from%20information_schema.tables--%20'
                    WHEN 1 THEN '&q=x%2527' WHEN 2 THEN '&f=..%2F..%2Fetc%2Fpasswd' WHEN 3 THEN '&c=a%3Bcat+/etc/passwd'
                    WHEN 4 THEN '&id=1+or+1%3D1' WHEN 5 THEN '&n=100%25&z=%zz' ELSE '' END) AS target,
               CASE WHEN page_id % 12 = 7 THEN 'sqlmap/1.5' ELSE 'Mozilla/5.0' END AS user_agent
        FROM pages""",
    "mft": """
        SELECT concat('host-', CAST(p_partkey % 20 AS STRING)) AS host, p_partkey AS record_number,
               concat(CASE p_partkey % 6 WHEN 0 THEN 'Program Files/' WHEN 1 THEN 'Users/bob/Desktop/' WHEN 2 THEN 'Windows/System32/'
                    WHEN 3 THEN 'Users/Public/Downloads/' WHEN 4 THEN 'Windows/Prefetch/' ELSE 'Users/amy/Google Drive/' END,
                    CASE p_partkey % 11 WHEN 0 THEN 'Eraser/Eraser' WHEN 1 THEN 'ethereal-setup' WHEN 2 THEN 'CCleaner64' WHEN 3 THEN 'googledrivesync'
                    WHEN 4 THEN 'nmap' WHEN 5 THEN 'MEGAsync' ELSE replace(p_name, ' ', '_') END,
                    CASE WHEN p_partkey % 6 = 4 THEN '.EXE-1C148EEF.pf' WHEN p_size % 2 = 0 THEN '.exe' ELSE '.dll' END) AS full_path,
               p_partkey % 7 > 0 AS is_allocated,
               CASE WHEN p_partkey % 10 = 0 THEN CAST(NULL AS BIGINT) ELSE p_partkey * 86400000000 END AS si_modified,
               p_partkey * 86400000000 AS si_created, p_partkey * 86400000000 - (p_size % 5) * 1000000 AS fn_created
        FROM part""",
    "registry": """
        SELECT concat('host-', CAST(p_partkey % 20 AS STRING)) AS host, p_partkey AS row_no,
               CASE p_partkey % 8 WHEN 0 THEN 'Software\\\\Microsoft\\\\Windows\\\\CurrentVersion\\\\Run'
                    WHEN 1 THEN concat('ControlSet001\\\\Services\\\\Svc', CAST(p_partkey % 50 AS STRING))
                    WHEN 2 THEN 'HKLM\\\\SYSTEM\\\\ControlSet001\\\\Services\\\\PortProxy\\\\v4tov4\\\\tcp'
                    WHEN 3 THEN concat('ControlSet001\\\\Enum\\\\USBSTOR\\\\Disk&Ven_Maker', CAST(p_partkey % 5 AS STRING), '&Prod_Stick&Rev_1\\\\', CAST(p_partkey AS STRING), '&0')
                    WHEN 4 THEN concat('SAM\\\\Domains\\\\Account\\\\Users\\\\Names\\\\', CASE p_partkey % 3 WHEN 0 THEN 'Mr. Evil' WHEN 1 THEN 'Administrator' ELSE 'alice' END)
                    WHEN 5 THEN 'Software\\\\Microsoft\\\\Windows\\\\CurrentVersion\\\\Explorer\\\\ComDlg32\\\\OpenSaveMRU\\\\exe'
                    WHEN 6 THEN 'ControlSet001\\\\Services\\\\NPF'
                    ELSE 'Software\\\\Microsoft\\\\Windows\\\\CurrentVersion\\\\Explorer\\\\UserAssist\\\\Count' END AS key_path,
               CASE WHEN p_partkey % 8 IN (1, 6) THEN 'ImagePath' ELSE concat('v', CAST(p_partkey % 40 AS STRING)) END AS value_name,
               CASE p_partkey % 5 WHEN 0 THEN concat('C:\\\\Users\\\\bob\\\\AppData\\\\Roaming\\\\', replace(p_name, ' ', '_'), '.exe')
                    WHEN 1 THEN concat('C:\\\\Windows\\\\System32\\\\', replace(p_name, ' ', '_'), '.exe') WHEN 2 THEN 'C:\\\\Tools\\\\CAIN.EXE'
                    WHEN 3 THEN '\\\\\\\\10.0.0.5\\\\share\\\\report.doc' ELSE 'system32\\\\drivers\\\\npf.sys' END AS value_data,
               p_partkey * 3600000000 AS last_write_us
        FROM part""",
    "mail": """
        SELECT o_orderkey AS msg_id, concat('case-', CAST(o_custkey % 6 AS STRING)) AS case_id, US(o_orderdate) AS us,
               CASE WHEN o_orderkey % 3 = 0 THEN concat('peer', CAST(o_custkey % 90 AS STRING), '@mailhost.example')
                    ELSE concat('staff', CAST(o_custkey % 50 AS STRING), '@corp.example') END AS from_address,
               CASE WHEN o_orderkey % 12 = 0 THEN concat('staff', CAST(o_custkey % 50 AS STRING), '@corp.example')
                    WHEN o_orderkey % 12 < 4 THEN concat('Person ', CAST(o_custkey % 50 AS STRING)) ELSE '' END AS from_display,
               CASE WHEN o_orderkey % 14 = 1 THEN concat('staff', CAST(o_custkey % 50 AS STRING), '@other.example')
                    WHEN o_orderkey % 14 = 2 THEN concat('x@n.', 'corp.example') ELSE '' END AS reply_to_address,
               CASE WHEN o_orderkey % 3 = 1 THEN concat('peer', CAST(o_custkey % 90 AS STRING), '@mailhost.example')
                    ELSE concat('staff', CAST(o_orderkey % 50 AS STRING), '@corp.example') END AS to_address,
               concat('order ', CAST(o_custkey % 30 AS STRING)) AS subject,
               CASE WHEN o_orderkey % 4 = 1 THEN 'roster.xls' WHEN o_orderkey % 4 = 2 THEN 'logo.png' ELSE '' END AS attachment
        FROM orders""",
    "lines": """
        SELECT page_id AS line_no, concat('/var/www/html/', CAST(page_id % 60 AS STRING), '.php') AS path,
               concat(html, CASE page_id % 9 WHEN 0 THEN ' <?php system($_GET[1]); ?>' WHEN 1 THEN ' eval($x)' WHEN 2 THEN ' base64_decode($y)'
                    WHEN 3 THEN ' move_uploaded_file(a)' ELSE '' END) AS line
        FROM pages""",
    "timeline": """
        SELECT event_id, concat('case-', CAST(user_id % 30 AS STRING)) AS case_id, US(ts) AS us,
               concat('tc-', CAST(user_id AS STRING)) AS tool_call_id,
               concat(event_type, ' seen ', CAST(event_id % 40 AS STRING)) AS summary,
               CASE WHEN event_type = 'error' THEN 'triage_lead' WHEN event_type = 'purchase' THEN 'finding_support' ELSE 'context' END AS significance,
               CASE WHEN event_id % 3 = 0 THEN concat('user', CAST(user_id AS STRING)) ELSE '' END AS account,
               CASE WHEN event_id % 4 = 1 THEN concat('10.0.0.', CAST(event_id % 50 AS STRING)) ELSE '' END AS source_ip
        FROM events""",
    "audit": """
        SELECT concat('case-', CAST(user_id % 30 AS STRING)) AS case_id, event_id AS record_no, US(ts) AS us,
               CASE event_id % 6 WHEN 0 THEN 'tool_call_start' WHEN 1 THEN 'tool_call_output' WHEN 2 THEN 'finding_approved'
                    WHEN 3 THEN 'verifier_action' WHEN 4 THEN 'course_correction' ELSE 'tool_call_output' END AS kind,
               CASE WHEN event_id % 17 = 2 THEN '' ELSE concat('tc-', CAST(user_id AS STRING), '-', CAST(CAST(floor(event_id / 2000) AS BIGINT) AS STRING)) END AS tool_call_id,
               CASE WHEN event_id % 6 = 1 AND event_id % 5 > 0 THEN SHA(concat('out', CAST(event_id AS STRING))) ELSE '' END AS output_hash,
               CASE event_id % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'INFERRED' ELSE 'HYPOTHESIS' END AS confidence,
               CASE WHEN event_id % 4 = 0 THEN 'rejected' ELSE 'approved' END AS action,
               concat('f-', CAST(event_id AS STRING)) AS finding_id,
               concat('{"kind":"', event_type, '","props":', CASE WHEN value > 200 THEN props ELSE replace(props, ' ', '') END, ',"seq":', CAST(event_id AS STRING), '}') AS line,
               value
        FROM events""",
}


def _dialect(sql: str, us: str, sha: str) -> str:
    return re.sub(r"\bSHA\(", sha + "(", re.sub(r"\bUS\(", us + "(", sql))


def spark_sql(name: str) -> str:
    sql = _dialect(EVIDENCE[name], "unix_micros", "sha2")
    return re.sub(r"sha2\((concat\([^()]*CAST\([^()]*\)\))\)", r"sha2(\1, 256)", sql)


def ansi_sql(name: str) -> str:
    return _dialect(EVIDENCE[name].replace("\\\\", "\\"), "epoch_us", "sha256")


def with_evidence(*names: str, body: str) -> str:
    """Check SQL: the derived tables as common table expressions, then the query."""
    ctes = ", ".join(f"{n} AS ({ansi_sql(n)})" for n in names)
    return f"WITH RECURSIVE {ctes} {body}" if names else body


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, with zone-less times read as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df
    # Text is costly per row, so a small text table is dealt out before it is worked on.
    return spread(df) if name in ("documents", "pages", "conversations") else df


def evidence(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived evidence table as a DataFrame."""
    # Braces are placeholders for tables in this call, so the text's own are doubled.
    sql = spark_sql(name).replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, folder, t) for t in used})
