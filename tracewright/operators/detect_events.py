"""Leads from event logs and process tables. Every lead row: host, kind, technique, confidence, subject, evidence, us."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.aggregates import brute_force
from tracewright.operators.filters import region_hint
from tracewright.operators.joins import process_parents, view_diff
from tracewright.operators.setops import dedup_leads

# Script payloads, shells, sessions and logon events.
PAYLOAD = r"(?i)-enc(odedcommand)?\b|powershell|cmd(\.exe)?\s+/c|wscript|mshta|rundll32|frombase64string|https?://"
SHELL_IMAGE = r"(?i)\b(cmd|powershell|pwsh|wscript|cscript|mshta|rundll32)\.exe\b"
SESSION_CHANNEL = "TerminalServices-LocalSessionManager"
SESSION_EVENTS = (21, 22, 25)
DATABASE_EVENTS = (216, 325, 327)
LOGON_EVENTS = (528, 540, 672, 680, 4624, 4768)
SERVICE_CONTROL_EVENTS = (7035, 7036)
CAPTURE_SERVICES = ("npf", "npcap", "rpcapd", "winpcap")

LEAD = ("host", "kind", "technique", "confidence", "subject", "evidence", "us")


def leads(df: DataFrame, kind: str, technique: str | None, confidence: str, subject: Column, proof: Column, us: str = "us") -> DataFrame:
    return df.select(
        "host", F.lit(kind).alias("kind"), F.lit(technique).cast("string").alias("technique"), F.lit(confidence).alias("confidence"),
        subject.cast("string").alias("subject"), proof.cast("string").alias("evidence"), F.col(us).alias("us"),
    )


def log_cleared(log: DataFrame) -> DataFrame:
    """Security audit log cleared: one confirmed lead per host and channel, with its first record."""
    rows = leads(log.where("eid = 1102"), "log_cleared", "T1070.001", "CONFIRMED", F.col("channel"), F.col("record_id"))
    return dedup_leads(rows, ["host", "kind", "subject"], ["us", "evidence"])


def scheduled_tasks(log: DataFrame) -> DataFrame:
    return leads(log.where((F.col("eid") == 4698) & F.col("payload").rlike(PAYLOAD)), "scheduled_task", "T1053.005", "INFERRED", F.col("service_name"), F.col("payload"))


def management_children(log: DataFrame) -> DataFrame:
    """Processes whose parent, found by pid and time, is the remote management host."""
    made = process_parents(log.where("eid = 4688"))
    hosts = F.lower("parent_process_name").rlike(r"(^|\\)wmiprvse\.exe$")
    return leads(made.where(hosts), "management_child", "T1047", "HYPOTHESIS", F.col("process_name"), F.col("parent_record_id"))


def service_installs(log: DataFrame) -> DataFrame:
    return leads(log.where((F.col("eid") == 7045) & F.col("payload").rlike(SHELL_IMAGE)), "service_install", "T1543.003", "INFERRED", F.col("service_name"), F.col("payload"))


def remote_desktop(log: DataFrame) -> DataFrame:
    """Remote desktop logons and session-manager events, one lead per host, account and kind."""
    logon = (F.col("eid") == 4624) & (F.col("logon_type") == "10")
    session = F.col("eid").isin(*SESSION_EVENTS) & F.col("channel").contains(SESSION_CHANNEL)
    rows = log.where(logon | session)
    kind = F.when(F.col("eid") == 4624, "rdp_logon").otherwise("rdp_session")
    out = rows.select("host", kind.alias("kind"), F.lit("T1021.001").alias("technique"), F.lit("HYPOTHESIS").alias("confidence"), F.col("account").alias("subject"), F.col("record_id").cast("string").alias("evidence"), "us")
    return dedup_leads(out, ["host", "kind", "subject"], ["us", "evidence"])


def failed_logon_bursts(log: DataFrame, least: int = 5) -> DataFrame:
    return leads(brute_force(log, least), "brute_force", "T1110", "HYPOTHESIS", F.col("source_ip"), F.col("failures"), "first_us")


def directory_dump(log: DataFrame) -> DataFrame:
    """Database engine events about the directory store."""
    rows = log.where((F.col("channel") == "Application") & F.col("eid").isin(*DATABASE_EVENTS) & F.contains(F.lower("database"), F.lit("ntds")))
    return leads(rows, "directory_dump", "T1003.003", "HYPOTHESIS", F.col("database"), F.col("record_id"))


def legacy_logons(log: DataFrame) -> DataFrame:
    rows = log.where(F.col("eid").isin(*LOGON_EVENTS)).select("host", F.lit("logon").alias("kind"), F.lit("T1078.001").alias("technique"), F.lit("HYPOTHESIS").alias("confidence"), F.col("account").alias("subject"), F.col("eid").cast("string").alias("evidence"), "us")
    return dedup_leads(rows, ["host", "kind", "evidence", "subject"], ["us"])


def service_recon(log: DataFrame, services: DataFrame) -> DataFrame:
    """Service-control events on hosts that also have a packet-capture service."""
    tools = services.where(F.lower("service_name").isin(*CAPTURE_SERVICES)).groupBy("host").agg(F.count(F.lit(1)).alias("tools"))
    control = log.where(F.col("eid").isin(*SERVICE_CONTROL_EVENTS)).groupBy("host", "service_name", "eid").agg(F.min("us").alias("us"))
    return leads(control.join(tools, "host"), "service_recon", "T1046", "HYPOTHESIS", F.col("service_name"), F.col("tools"))


# Applications worth naming when seen in memory, and command interpreters.
NOTABLE = {
    "browser": ("chrome.exe", "firefox.exe", "msedge.exe", "iexplore.exe", "opera.exe", "brave.exe", "tor.exe"),
    "credential_store": ("keepass.exe", "keepassxc.exe", "1password.exe", "bitwarden.exe", "lastpass.exe", "dashlane.exe"),
    "user_application": ("mspaint.exe", "notepad.exe", "winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "wordpad.exe", "winrar.exe", "7zfm.exe"),
}
INTERPRETERS = ("cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe")


def notable_applications(listed: DataFrame, scanned: DataFrame) -> DataFrame:
    """Application presence by category, naming only the views that saw it; never confirmed."""
    both = listed.select("host", "image_name", F.lit("list").alias("view")).unionByName(scanned.select("host", "image_name", F.lit("scan").alias("view")))
    low = F.lower(F.trim("image_name"))
    category = F.coalesce(*[F.when(F.substring(low, 1, 14).isin([n[:14] for n in names]), c) for c, names in NOTABLE.items()])
    rows = both.withColumn("category", category).where("category IS NOT NULL")
    out = rows.groupBy("host", "category", low.alias("image_name")).agg(F.bool_or(F.col("view") == "list").alias("in_list"), F.bool_or(F.col("view") == "scan").alias("in_scan"), F.count(F.lit(1)).alias("sightings"))
    technique = F.when(F.col("category") == "credential_store", "T1555")
    return out.withColumn("technique", technique).withColumn("confidence", F.lit("INFERRED"))


def recovered_commands(command_lines: DataFrame, history: DataFrame) -> DataFrame:
    """Commands from console history, and interpreters started with a payload; a bare shell says nothing."""
    low = F.lower(F.trim("image_name"))
    rest = F.trim(F.regexp_replace("command_line", r'^\s*("[^"]*"|\S+)\s*', ""))
    typed = command_lines.where(low.isin(*INTERPRETERS) & (rest != "") & rest.rlike(r"^[/-]|\.(ps1|bat|vbs|js|hta)\b"))
    a = typed.select("host", "pid", F.lit("command_line").alias("source"), F.col("command_line").alias("command"))
    lines = history.where(F.col("property").contains("CommandHistory") & (F.trim("data") != ""))
    b = lines.select("host", "pid", F.lit("console_history").alias("source"), F.trim("data").alias("command"))
    return a.unionByName(b).withColumn("technique", F.lit("T1059.003"))


def hidden_processes(listed: DataFrame, scanned: DataFrame) -> DataFrame:
    """Processes only the scan saw."""
    out = view_diff(listed, scanned).where("difference = 'scan_only'")
    return out.select("host", "pid", "image_name", F.lit("T1014").alias("technique"), F.lit("INFERRED").alias("confidence"))


def injected_regions(regions: DataFrame) -> DataFrame:
    """Writable-executable regions without a benign reading; a header makes them inferred, else a hypothesis."""
    hint = region_hint(F.col("image_name"), F.col("mz_match"), F.col("sample_hex"))
    rows = regions.where(F.col("protection").contains("EXECUTE") & F.col("protection").contains("WRITE")).withColumn("hint", hint).where("hint IS NULL")
    return rows.withColumn("technique", F.lit("T1055")).withColumn("confidence", F.when(F.col("mz_match"), "INFERRED").otherwise("HYPOTHESIS")).drop("hint")
