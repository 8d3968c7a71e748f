"""Registry, file system, journal, prefetch and memory-region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import aggregates, detect_disk, detect_events, filters, joins, setops, topk
from tracewright.operators.ordered import DAY_US
from tracewright.plans.catalog import query

MONTH_US = 30 * DAY_US


@query("file_time_filter", "SELECT record_number, si_modified FROM mft WHERE si_modified IS NULL OR (si_modified >= 2592000000000 AND si_modified <= 86400000000000)", uses=("mft",))
def _(src):
    return filters.file_time_filter(src.mft, F.lit(2592000000000), F.lit(86400000000000)).select("record_number", "si_modified")


@query("journal_filter", "SELECT usn, filename FROM usn WHERE us >= 883612800000000 AND us <= 946684800000000 AND reason_mask IN (256, 512)", uses=("usn",))
def _(src):
    return filters.journal_filter(src.usn, F.lit(883612800000000), F.lit(946684800000000), ["FILE_CREATE", "file_delete"]).select("usn", "filename")


@query("time_difference", "SELECT record_number, si_created - fn_created AS si_minus_fn_us FROM mft WHERE si_created <> fn_created", uses=("mft",))
def _(src):
    return src.mft.select("record_number", (F.col("si_created") - F.col("fn_created")).alias("si_minus_fn_us")).where("si_minus_fn_us <> 0")


_STAGED = """, made AS (SELECT host, filename, us, usn FROM usn WHERE reason_mask = 256 AND regexp_matches(filename, '\\.(zip|rar|cab)$')),
  gone AS (SELECT host, filename, us AS d, usn AS du FROM usn WHERE reason_mask = 512),
  staged AS (SELECT m.host, m.filename, m.us, m.usn, min(g.d) AS deleted_us FROM made m JOIN gone g ON m.host = g.host AND m.filename = g.filename AND g.d > m.us AND g.d <= m.us + 2592000000000 GROUP BY 1, 2, 3, 4)"""


@query("staged_archives", _STAGED + " SELECT * FROM staged", uses=("usn",))
def _(src):
    return joins.staged_archives(src.usn, MONTH_US).select("host", "filename", "us", "usn", "deleted_us")


@query("archive_staging", _STAGED + " SELECT host, filename, usn, 'T1560.001' AS technique FROM staged WHERE deleted_us - us <= 86400000000", uses=("usn",))
def _(src):
    return detect_disk.archive_staging(src.usn).select("host", "filename", "usn", "technique")


@query(
    "post_staging_deletions",
    _STAGED + """, docs AS (SELECT host, filename, us, usn FROM usn WHERE reason_mask = 512 AND regexp_matches(filename, '\\.(docx|xlsx)$'))
       SELECT d.host, d.filename, d.us, d.usn, max(s.us) AS staged_us FROM docs d JOIN staged s ON d.host = s.host AND s.us < d.us GROUP BY 1, 2, 3, 4 HAVING d.us - max(s.us) <= 259200000000""",
    uses=("usn",),
)
def _(src):
    staged = joins.staged_archives(src.usn, MONTH_US)
    return joins.post_staging_deletions(src.usn, staged, 3 * DAY_US).select("host", "filename", "us", "usn", "staged_us")


@query(
    "renamed_files",
    """SELECT concat('host-', CAST(o_orderkey % 20 AS STRING)) AS host, o_orderkey AS mft_entry, concat('new', CAST(o_orderkey AS STRING), '.zip') AS filename, CASE WHEN o_orderstatus <> 'P' THEN concat('old', CAST(o_orderkey AS STRING), '.pptx') END AS renamed_from FROM orders""",
)
def _(src):
    key = F.col("o_orderkey").cast("string")
    base = src.given("orders").select(F.concat(F.lit("host-"), (F.col("o_orderkey") % 20).cast("string")).alias("host"), F.col("o_orderkey").alias("mft_entry"), F.unix_micros("o_orderdate").alias("us"), "o_orderstatus", key.alias("k"))
    old = base.where("o_orderstatus <> 'P'").select("host", "mft_entry", "us", F.concat(F.lit("old"), "k", F.lit(".pptx")).alias("filename"), F.lit(joins.OLD_NAME).alias("reason_mask"), (F.col("mft_entry") * 2).alias("usn"))
    new = base.select("host", "mft_entry", "us", F.concat(F.lit("new"), "k", F.lit(".zip")).alias("filename"), F.lit(joins.NEW_NAME).alias("reason_mask"), (F.col("mft_entry") * 2 + 1).alias("usn"))
    return joins.renamed_from(old.unionByName(new)).select("host", "mft_entry", "filename", "renamed_from")


_ENTRIES = """, e AS (SELECT p_partkey AS entry_id, concat('host-', CAST(p_partkey % 20 AS STRING)) AS host, concat(CASE p_size % 3 WHEN 0 THEN 'C:\\Users\\Public\\' WHEN 1 THEN 'C:\\Tools\\' ELSE 'D:\\Temp\\' END, replace(p_name, ' ', '_'), '.exe') AS program_path, p_partkey * 1000 AS last_run_us FROM part),
  f AS (SELECT p_partkey AS record_number, concat('host-', CAST(p_partkey % 20 AS STRING)) AS host, CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'D' END AS volume, concat(CASE p_size % 3 WHEN 0 THEN 'Users/Public/' WHEN 1 THEN 'Tools/' ELSE 'Temp/' END, replace(p_name, ' ', '_'), '.exe') AS full_path,
        p_retailprice < 1000 AS is_allocated, CASE WHEN p_size < 10 THEN p_partkey * 1100 END AS si_modified FROM part),
  hit AS (SELECT e.*, f.record_number FROM e JOIN f ON e.host = f.host AND upper(left(program_path, 1)) = f.volume AND lower(replace(substring(program_path, 3), '\\', '/')) = lower(concat('/', full_path)) WHERE is_allocated OR coalesce(si_modified >= last_run_us, FALSE)),
  pf AS (SELECT concat('host-', CAST(p_partkey % 20 AS STRING)) AS host, upper(concat(replace(p_name, ' ', '_'), '.exe')) AS executable_name, p_size % 4 AS run_count FROM part)"""


def _entries(src):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".exe"))
    host = F.concat(F.lit("host-"), (F.col("p_partkey") % 20).cast("string"))
    s = F.col("p_size") % 3
    part = src.given("part")
    root = F.when(s == 0, "C:\\Users\\Public\\").when(s == 1, "C:\\Tools\\").otherwise("D:\\Temp\\")
    entries = part.select(F.col("p_partkey").alias("entry_id"), host.alias("host"), F.concat(root, name).alias("program_path"), (F.col("p_partkey") * 1000).alias("last_run_us"), F.lit("").alias("encoded_name"))
    folder = F.when(s == 0, "Users/Public/").when(s == 1, "Tools/").otherwise("Temp/")
    files = part.select(
        F.col("p_partkey").alias("record_number"), host.alias("host"), F.when(F.col("p_size") % 2 == 0, "C").otherwise("D").alias("volume"), F.concat(folder, name).alias("full_path"),
        (F.col("p_retailprice") < 1000).alias("is_allocated"), F.when(F.col("p_size") < 10, F.col("p_partkey") * 1100).alias("si_modified"),
    )
    prefetch = part.select(host.alias("host"), F.upper(name).alias("executable_name"), (F.col("p_size") % 4).alias("run_count"))
    return entries, files, prefetch


@query("run_entries_in_files", _ENTRIES + " SELECT entry_id, host, program_path, record_number FROM hit", uses=("ps",))
def _(src):
    entries, files, _pf = _entries(src)
    return joins.run_entries_in_files(entries, files).select("entry_id", "host", "program_path", "record_number")


_PF = ", g AS (SELECT host, lower(executable_name) AS exe, max(run_count) AS run_count FROM pf WHERE run_count > 0 GROUP BY 1, 2), ph AS (SELECT e.entry_id, e.host, g.exe, g.run_count FROM e JOIN g ON e.host = g.host AND lower(split_part(program_path, '\\', -1)) = g.exe)"


@query("run_entries_in_prefetch", _ENTRIES + _PF + " SELECT entry_id, host, exe, CAST(run_count AS BIGINT) AS run_count FROM ph", uses=("ps",))
def _(src):
    entries, _f, prefetch = _entries(src)
    return joins.run_entries_in_prefetch(entries, prefetch).select("entry_id", "host", "exe", F.col("run_count").cast("long").alias("run_count"))


@query(
    "shared_root_runs",
    _ENTRIES + _PF + """ SELECT entry_id, host, entry_id IN (SELECT entry_id FROM hit) AS in_mft, entry_id IN (SELECT entry_id FROM ph) AS in_prefetch,
       CASE WHEN entry_id IN (SELECT entry_id FROM hit) OR entry_id IN (SELECT entry_id FROM ph) THEN 'CONFIRMED' ELSE 'HYPOTHESIS' END AS confidence FROM e WHERE NOT program_path LIKE 'C:\\Tools\\%'""",
    uses=("ps",),
)
def _(src):
    entries, files, prefetch = _entries(src)
    return detect_disk.shared_root_runs(entries, files, prefetch).select("entry_id", "host", "in_mft", "in_prefetch", "confidence")


@query(
    "autostarts",
    """, r AS (SELECT *, key_path LIKE '%CurrentVersion\\Run' AS run, regexp_matches(key_path, 'Services\\\\(Svc[0-9]+|NPF)$') AND value_name = 'ImagePath' AS svc FROM registry)
       SELECT host, row_no, CASE WHEN run THEN 'run_key' ELSE 'service' END AS kind, CASE WHEN run THEN 'T1547.001' ELSE 'T1543.003' END AS technique,
              CASE WHEN run THEN value_name ELSE split_part(key_path, '\\', -1) END AS subject, value_data AS target FROM r WHERE (run OR svc) AND (value_data LIKE 'C:\\Users\\bob\\AppData\\%' OR value_data = 'C:\\Tools\\CAIN.EXE')""",
    uses=("registry",),
)
def _(src):
    return detect_disk.autostarts(src.registry).select("host", "row_no", "kind", "technique", "subject", "target")


@query("port_proxies", "SELECT host, 'T1090.001' AS technique, value_name AS listen, value_data AS connect, last_write_us AS us FROM registry WHERE key_path LIKE '%PortProxy%' AND value_data <> ''", uses=("registry",))
def _(src):
    return detect_disk.port_proxies(src.registry)


@query(
    "usb_devices",
    """SELECT host, regexp_extract(key_path, 'Ven_([^&]*)', 1) AS vendor, regexp_extract(key_path, 'Prod_([^&]*)', 1) AS product, split_part(key_path, '\\', -1) AS serial, last_write_us AS us, 'HYPOTHESIS' AS confidence FROM registry WHERE key_path LIKE '%USBSTOR%'""",
    uses=("registry",),
)
def _(src):
    return detect_disk.usb_devices(src.registry).select("host", "vendor", "product", "serial", "us", "confidence")


@query("local_accounts", "SELECT host, 'Mr. Evil' AS account, min(last_write_us) AS us, count(*) AS occurrences FROM registry WHERE key_path LIKE '%Names\\Mr. Evil' GROUP BY 1", uses=("registry",))
def _(src):
    return detect_disk.local_accounts(src.registry).select("host", "account", "us", "occurrences")


@query(
    "recent_use",
    """SELECT host, 'opened_file' AS kind, value_data AS value, min(last_write_us) AS us, count(*) AS occurrences FROM registry WHERE key_path LIKE '%OpenSaveMRU%' AND (value_data LIKE '\\\\%' OR value_data = 'C:\\Tools\\CAIN.EXE') GROUP BY 1, 3""",
    uses=("registry",),
)
def _(src):
    return detect_disk.recent_use(src.registry.withColumn("value_type", F.lit("REG_SZ"))).select("host", "kind", "value", "us", "occurrences")


@query("capture_services", "SELECT host, split_part(key_path, '\\', -1) AS service_name, value_data AS image_path, last_write_us AS us FROM registry WHERE regexp_matches(key_path, 'Services\\\\[^\\\\]+$') AND value_data LIKE '%npf.sys'", uses=("registry",))
def _(src):
    return detect_disk.capture_services(src.registry)


_FILES = ", m AS (SELECT *, lower(concat('/', full_path)) AS low, lower(split_part(full_path, '/', -1)) AS name FROM mft)"


@query(
    "hacking_tools",
    _FILES + """, t AS (SELECT *, CASE WHEN low LIKE '%ethereal%' THEN 'ethereal' WHEN regexp_matches(low, '(^|[^a-z0-9])nmap') THEN 'nmap' END AS tool FROM m WHERE regexp_matches(low, '/(program files|desktop|downloads?)/') AND NOT name LIKE '%.pf'),
       r AS (SELECT *, row_number() OVER (PARTITION BY host, tool ORDER BY si_created, record_number) AS rn, count(*) OVER (PARTITION BY host, tool) AS occurrences FROM t WHERE tool IS NOT NULL)
       SELECT host, tool, full_path, occurrences FROM r WHERE rn = 1""",
    uses=("mft",),
)
def _(src):
    return detect_disk.hacking_tools(src.mft).select("host", "tool", "full_path", "occurrences")


@query(
    "wipers_on_disk",
    _FILES + """, t AS (SELECT *, CASE WHEN name LIKE '%eraser%' THEN 'eraser' WHEN name LIKE '%ccleaner%' THEN 'ccleaner' END AS tool, CASE WHEN name LIKE '%.pf' THEN 'prefetch_residue' ELSE 'installed' END AS presence FROM m WHERE regexp_matches(low, '/(program files|desktop|downloads?)/') OR name LIKE '%.pf'),
       r AS (SELECT *, row_number() OVER (PARTITION BY host, tool ORDER BY presence, record_number) AS rn, count(*) OVER (PARTITION BY host, tool) AS occurrences FROM t WHERE tool IS NOT NULL)
       SELECT host, tool, presence, full_path, occurrences, 'T1070.004' AS technique FROM r WHERE rn = 1""",
    uses=("mft",),
)
def _(src):
    return detect_disk.wipers_on_disk(src.mft).select("host", "tool", "presence", "full_path", "occurrences", "technique")


_PREFETCH = """WITH pf AS (SELECT concat('host-', CAST(p_partkey % 20 AS STRING)) AS host, CASE p_size % 10 WHEN 0 THEN 'ERASER.EXE' WHEN 1 THEN 'GOOGLEDRIVESYNC.EXE' WHEN 2 THEN 'GPG2.EXE' WHEN 3 THEN 'VERACRYPT.EXE' WHEN 4 THEN 'BDESVC.DLL' WHEN 5 THEN 'KLEOPATRA.EXE'
  ELSE upper(replace(p_name, ' ', '_')) END AS executable_name, CAST(p_partkey % 3 AS BIGINT) AS run_count FROM part)"""


def _prefetch(src):
    k = F.col("p_size") % 10
    name = F.coalesce(*[F.when(k == i, n) for i, n in enumerate(("ERASER.EXE", "GOOGLEDRIVESYNC.EXE", "GPG2.EXE", "VERACRYPT.EXE", "BDESVC.DLL", "KLEOPATRA.EXE"))], F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
    return src.given("part").select(F.concat(F.lit("host-"), (F.col("p_partkey") % 20).cast("string")).alias("host"), name.alias("executable_name"), (F.col("p_partkey") % 3).alias("run_count"))


@query("wiper_runs", _PREFETCH + " SELECT host, 'eraser' AS tool, CAST(sum(run_count) AS BIGINT) AS run_count FROM pf WHERE executable_name = 'ERASER.EXE' AND run_count > 0 GROUP BY 1")
def _(src):
    return detect_disk.wiper_runs(_prefetch(src))


@query(
    "encryption_tooling",
    _PREFETCH + """ SELECT host, CASE executable_name WHEN 'VERACRYPT.EXE' THEN 'container' ELSE 'openpgp' END AS family, count(DISTINCT executable_name) AS programs, max(run_count) AS max_runs, 'INFERRED' AS confidence FROM pf
       WHERE executable_name IN ('GPG2.EXE', 'KLEOPATRA.EXE', 'VERACRYPT.EXE') GROUP BY 1, 2""",
)
def _(src):
    return detect_disk.encryption_tooling(_prefetch(src))


_VISITS = """, vis AS (SELECT concat('host-', CAST(page_id % 20 AS STRING)) AS host, CASE length(url) % 5 WHEN 0 THEN 'https://drive.google.com/drive/my' WHEN 1 THEN 'https://mail.google.com/mail/u/0/' WHEN 2 THEN 'https://www.google.com/webhp' ELSE url END AS url, page_id AS us FROM pages),
  cv AS (SELECT *, CASE WHEN url LIKE 'https://drive%' THEN 'google drive' WHEN url LIKE 'https://mail.google%' THEN 'gmail' END AS service, CASE WHEN url LIKE 'https://drive%' THEN 'cloud_storage' WHEN url LIKE 'https://mail.google%' THEN 'webmail' END AS kind FROM vis)"""


def _visits(src):
    k = F.length("url") % 5
    url = F.when(k == 0, "https://drive.google.com/drive/my").when(k == 1, "https://mail.google.com/mail/u/0/").when(k == 2, "https://www.google.com/webhp").otherwise(F.col("url"))
    return src.given("pages").select(F.concat(F.lit("host-"), (F.col("page_id") % 20).cast("string")).alias("host"), url.alias("url"), F.col("page_id").alias("us"))


@query("cloud_visits", _VISITS + " SELECT host, us, url, service, kind FROM cv WHERE service IS NOT NULL", uses=("mft",))
def _(src):
    return detect_disk.cloud_visits(_visits(src)).select("host", "us", "url", "service", "kind")


@query(
    "sync_channels",
    _FILES + ", " + _PREFETCH.removeprefix("WITH ") + _VISITS + """, s AS (
         SELECT host, CASE WHEN name LIKE '%googledrivesync%' THEN 'google drive' WHEN name LIKE '%megasync%' THEN 'mega' WHEN low LIKE '%/google drive/%' THEN 'google drive' END AS service, 'disk' AS source FROM m
         UNION ALL SELECT host, 'google drive', 'prefetch' FROM pf WHERE executable_name = 'GOOGLEDRIVESYNC.EXE' AND run_count > 0
         UNION ALL SELECT host, service, 'browser' FROM cv WHERE kind = 'cloud_storage')
       SELECT host, service, bool_or(source = 'disk') AS on_disk, bool_or(source = 'prefetch') AS was_run, bool_or(source = 'browser') AS visited, count(*) AS sightings, 'T1567.002' AS technique FROM s WHERE service IS NOT NULL GROUP BY 1, 2""",
    uses=("mft",),
)
def _(src):
    return detect_disk.sync_channels(src.mft, _prefetch(src), _visits(src))


@query("recent_history", _VISITS + " SELECT host, us, url FROM vis QUALIFY row_number() OVER (PARTITION BY host ORDER BY us DESC NULLS LAST, url) <= 40", uses=("mft",))
def _(src):
    return topk.recent_history(_visits(src), 40, keys=("host",)).select("host", "us", "url")


@query(
    "illicit_downloads",
    """WITH h AS (SELECT concat('host-', CAST(page_id % 20 AS STRING)) AS host, CASE WHEN length(url) % 3 = 0 THEN concat(split_part(split_part(url, '?', 1), '#', 1), '/setup.exe') ELSE url END AS url, page_id AS us FROM pages)
       SELECT host, url, count(*) AS hits, min(us) AS us FROM h WHERE url LIKE '%/setup.exe' GROUP BY 1, 2""",
)
def _(src):
    plain = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    hit = F.when(F.length("url") % 3 == 0, F.concat(F.when(F.col("page_id") % 2 == 0, "Visited: Mr. X@").otherwise(""), plain, F.lit("/setup.exe"))).otherwise(F.col("url"))
    rows = src.given("pages").select(F.concat(F.lit("host-"), (F.col("page_id") % 20).cast("string")).alias("host"), hit.alias("url"), F.col("page_id").alias("us"))
    return detect_disk.illicit_downloads(rows)


@query(
    "removable_shortcuts",
    """SELECT s_suppkey, CASE WHEN s_acctbal < 3000 THEN 'volume' ELSE 'path_name' END AS basis FROM supplier WHERE s_acctbal < 3000 OR s_acctbal > 8000""",
)
def _(src):
    rows = src.given("supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") < 3000, "Removable").alias("drive_type"),
        F.when(F.col("s_acctbal") > 8000, "Users\\x\\NetHood\\staging share\\target.lnk").otherwise("Recent\\calc.lnk").alias("source_file"),
    )
    return detect_disk.removable_shortcuts(rows).select("s_suppkey", "basis")


@query("recycled_tools", "SELECT record_number, host, CASE WHEN lower(full_path) LIKE '%ethereal%' THEN 'ethereal' ELSE 'nmap' END AS tool FROM mft WHERE lower(full_path) LIKE '%/ethereal%' OR lower(full_path) LIKE '%/nmap%'", uses=("mft",))
def _(src):
    rows = src.mft.withColumnRenamed("full_path", "filename")
    return detect_disk.recycled_tools(rows).select("record_number", "host", "tool")


@query(
    "triage_order",
    """SELECT p_partkey, [0, 1, 2, 0, 1, 2, 0, 2, 1, 4, 0][1 + p_size % 11]::BIGINT AS rank FROM part""",
)
def _(src):
    names = (
        "logs/Security.evtx", "logs/Application.evtx", "logs/Microsoft-Windows-Foo%4Operational.evtx", "var/www/uploads/s.php", "srv/htdocs/i.php", "var/www/app/lib/x.php",
        "u/NetHood/staging share/t.lnk", "Start Menu/Calc.lnk", "config/SOFTWARE", "u/NTUSER.DAT", "x/readme.txt",
    )
    path = F.array(*[F.lit(n) for n in names])[F.col("p_size") % 11]
    return topk.triage_order(src.given("part").select("p_partkey", path.alias("path"))).select("p_partkey", F.col("rank").cast("long").alias("rank"))


_REGIONS = """WITH reg AS (SELECT concat('host-', CAST(l_suppkey % 10 AS STRING)) AS host, l_suppkey % 50 AS pid, l_partkey * 4096 + l_orderkey * 1048576 AS vad_start, l_partkey * 4096 + l_orderkey * 1048576 + CAST(l_quantity AS BIGINT) * 65536 AS vad_end FROM lineitem),
  mat AS (SELECT concat('host-', CAST(o_custkey % 10 AS STRING)) AS host, o_custkey % 50 AS pid, o_orderkey * 1048576 + o_custkey * 512 AS off, o_orderstatus AS rule_name FROM orders)"""


@query("regions_with_matches", _REGIONS + " SELECT m.host, m.pid, m.off AS offset, m.rule_name, r.vad_end FROM mat m JOIN reg r ON m.host = r.host AND m.pid = r.pid AND r.vad_start <= m.off AND m.off < r.vad_end")
def _(src):
    li, o = src.given("lineitem"), src.given("orders")
    start = F.col("l_partkey") * 4096 + F.col("l_orderkey") * 1048576
    reg = li.select(F.concat(F.lit("host-"), (F.col("l_suppkey") % 10).cast("string")).alias("host"), (F.col("l_suppkey") % 50).alias("pid"), start.alias("vad_start"), (start + F.col("l_quantity").cast("long") * 65536).alias("vad_end"))
    mat = o.select(F.concat(F.lit("host-"), (F.col("o_custkey") % 10).cast("string")).alias("host"), (F.col("o_custkey") % 50).alias("pid"), (F.col("o_orderkey") * 1048576 + F.col("o_custkey") * 512).alias("offset"), F.col("o_orderstatus").alias("rule_name"))
    return joins.regions_with_matches(reg, mat).select("host", "pid", "offset", "rule_name", "vad_end")


@query(
    "region_hints",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_size % 5 = 0 THEN 'possible_av_emulation' WHEN p_size % 5 = 1 THEN 'possible_benign_jit_runtime' END AS hint FROM part""",
)
def _(src):
    k = F.col("p_size") % 5
    owner = F.when(k == 0, "MsMpEng.exe").when(k == 1, "W3WP.EXE").when(k == 2, "powershell.exe").otherwise("unknown.exe")
    sample = F.when(F.col("p_size") % 4 == 3, "fce8000000005b00").otherwise("48895c240857")
    return src.given("part").select("p_partkey", filters.region_hint(owner, F.lit(False), sample).alias("hint"))


@query(
    "injected_regions",
    """SELECT p_partkey, 'T1055' AS technique, CASE WHEN p_size % 3 = 0 THEN 'INFERRED' ELSE 'HYPOTHESIS' END AS confidence FROM part WHERE p_type <> 'SMALL' AND (p_size % 3 = 0 OR p_size % 5 > 1)""",
)
def _(src):
    k = F.col("p_size") % 5
    owner = F.when(k == 0, "MsMpEng.exe").when(k == 1, "W3WP.EXE").otherwise("unknown.exe")
    prot = F.when(F.col("p_type") == "SMALL", "PAGE_READONLY").otherwise("PAGE_EXECUTE_READWRITE")
    rows = src.given("part").select("p_partkey", owner.alias("image_name"), (F.col("p_size") % 3 == 0).alias("mz_match"), F.lit("48895c").alias("sample_hex"), prot.alias("protection"))
    return detect_events.injected_regions(rows).select("p_partkey", "technique", "confidence")


@query(
    "region_iocs",
    """SELECT host, pid, kind, value, 'HYPOTHESIS' AS confidence FROM (SELECT p_partkey AS pid, concat('host-', CAST(p_partkey % 20 AS STRING)) AS host, unnest(['ips', 'paths', 'urls']) AS kind, unnest([concat('10.9.', CAST(p_size AS STRING), '.7'), 'drop.exe', concat('http://c2.example/', CAST(p_partkey AS STRING))]) AS value FROM part)
       UNION ALL SELECT concat('host-', CAST(p_partkey % 20 AS STRING)), p_partkey, 'domains', 'beacon.example.net', 'HYPOTHESIS' FROM part""",
)
def _(src):
    said = F.concat(F.lit("http://c2.example/"), F.col("p_partkey").cast("string"), F.lit("\x00\x01call 10.9."), F.col("p_size").cast("string"), F.lit(".7 then drop.exe\x00beacon.example.net"))
    rows = src.given("part").select(F.concat(F.lit("host-"), (F.col("p_partkey") % 20).cast("string")).alias("host"), F.col("p_partkey").alias("pid"), F.lit(0).alias("vad_start"), F.hex(F.encode(said, "ISO-8859-1")).alias("sample_hex"))
    return aggregates.region_iocs(rows).drop("vad_start")


@query(
    "deduplicated_leads",
    """, r AS (SELECT host, filename, us, usn, row_number() OVER (PARTITION BY host, filename ORDER BY us, usn) AS rn, count(*) OVER (PARTITION BY host, filename) AS occurrences FROM usn) SELECT host, filename, us, usn, occurrences FROM r WHERE rn = 1""",
    uses=("usn",),
)
def _(src):
    return setops.dedup_leads(src.usn.select("host", "filename", "us", "usn"), ["host", "filename"], ["us", "usn"])
