"""Leads from registry, file system, journal, prefetch and browser tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.paths import base_name, run_entry_path, slashed
from tracewright.operators.filters import COMMON_PROCESSES
from tracewright.operators.joins import post_staging_deletions, run_entries_in_files, run_entries_in_prefetch, staged_archives
from tracewright.operators.setops import dedup_leads

# Places ordinary users can write, stock autostart values, and tool names by kind.
WRITABLE = r"(?i)\\(users|documents and settings)\\[^\\]+\\(appdata|application data|local settings|desktop|downloads|temp)\\|\\users\\public\\|\\programdata\\|\\temp\\|\\windows\\temp\\"
STOCK_VALUES = ("securityhealth", "onedrive", "vmware user process", "ctfmon.exe", "msmsgs", "srfirstrun", "schedulingagent")
ATTACK_TOOLS = ("cain", "ethereal", "wireshark", "nmap", "netstumbler", "lookatlan", "anonymizer", "netcat", "mimikatz", "psexec", "pwdump", "ghostware", "mirc", "whois", "123wasp")
WIPERS = (("eraser", "eraser"), ("ccleaner", "ccleaner"), ("ccsetup", "ccleaner"), ("sdelete", "sdelete"), ("bleachbit", "bleachbit"), ("wipe", "wipe"), ("cipherwipe", "cipherwipe"))
SYNC_CLIENTS = (("googledrivesync", "google drive"), ("dropbox", "dropbox"), ("megasync", "mega"), ("boxsync", "box"), ("rclone", "rclone"))
SYNC_FOLDERS = (("/google drive/", "google drive"), ("/dropbox/", "dropbox"), ("/megasync/", "mega"), ("/box sync/", "box"))
CLOUD_HOSTS = (
    ("drive.google.com", "google drive", "cloud_storage"), ("docs.google.com", "google drive", "cloud_storage"),
    ("www.dropbox.com", "dropbox", "cloud_storage"), ("dropbox.com", "dropbox", "cloud_storage"),
    ("mega.nz", "mega", "cloud_storage"), ("onedrive.live.com", "onedrive", "cloud_storage"), ("app.box.com", "box", "cloud_storage"),
    ("mail.google.com", "gmail", "webmail"), ("outlook.live.com", "outlook", "webmail"), ("mail.yahoo.com", "yahoo", "webmail"), ("mail.proton.me", "proton", "webmail"),
)
ENCRYPTION_TOOLS = (
    ("gpg", "openpgp"), ("gnupg", "openpgp"), ("kleopatra", "openpgp"), ("veracrypt", "container"), ("truecrypt", "container"),
    ("axcrypt", "container"), ("bdeunlock", "bitlocker"), ("bitlockerwizard", "bitlocker"),
)
BUILTIN_ACCOUNTS = ("administrator", "guest", "defaultaccount", "wdagutilityaccount", "krbtgt", "helpassistant")
ACCOUNT_TELL = r"(?i)evil|hack|backdoor|pwn|r00t|\$$|^(test|temp)admin"
CAPTURE_DRIVERS = r"(?i)(^|\\)(npf|npcap)\.sys|rpcapd\.exe"


def _token(text: Column, table) -> Column:
    """First listed needle in the text, as its label."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(n)), label) for n, label in table])


def _tool(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(rf"(^|[^a-z0-9]){t}"), t) for t in ATTACK_TOOLS])


def autostarts(registry: DataFrame) -> DataFrame:
    """Run keys and services that start something from a writable place, or a known tool."""
    key, data = F.col("key_path"), F.regexp_replace("value_data", '^"([^"]+)".*$', "$1")
    run = key.rlike(r"(?i)\\run(once)?$")
    service = key.rlike(r"(?i)\\services\\[^\\]+$") & (F.lower("value_name") == "imagepath")
    file = F.lower(F.regexp_extract(F.replace(data, F.lit("/"), F.lit("\\")), r"([^\\]+)$", 1))
    common = F.lower(file).isin([p.lower() for p in COMMON_PROCESSES])
    stock = F.lower("value_name").isin(*STOCK_VALUES)
    tell = data.rlike(WRITABLE) | _tool(file).isNotNull()
    rows = registry.where((run | service) & tell & ~stock & ~(common & data.rlike(r"(?i)^(c:\\windows|%systemroot%)\\")))
    return rows.select(
        "host", F.when(run, "run_key").otherwise("service").alias("kind"), F.when(run, "T1547.001").otherwise("T1543.003").alias("technique"),
        F.when(run, F.col("value_name")).otherwise(F.regexp_extract(key, r"([^\\]+)$", 1)).alias("subject"), data.alias("target"), F.col("last_write_us").alias("us"), "row_no",
    )


def port_proxies(registry: DataFrame) -> DataFrame:
    rows = registry.where(F.col("key_path").rlike(r"(?i)\\portproxy\\v[46]tov[46]\\") & (F.coalesce("value_data", F.lit("")) != ""))
    return rows.select("host", F.lit("T1090.001").alias("technique"), F.col("value_name").alias("listen"), F.col("value_data").alias("connect"), F.col("last_write_us").alias("us"))


def usb_devices(registry: DataFrame) -> DataFrame:
    """Serial-level device keys with vendor and product, one row per device and host."""
    shape = r"(?i)\\usbstor\\disk&ven_([^&\\]*)&prod_([^&\\]*)[^\\]*\\([^\\]+)$"
    part = lambda i: F.regexp_extract("key_path", shape, i)
    rows = registry.where(F.col("key_path").rlike(shape)).select("host", part(1).alias("vendor"), part(2).alias("product"), part(3).alias("serial"), F.col("last_write_us").alias("us"), "row_no")
    out = dedup_leads(rows, ["host", "serial"], ["us", "row_no"])
    return out.withColumn("technique", F.lit("T1052.001")).withColumn("confidence", F.lit("HYPOTHESIS"))


def local_accounts(registry: DataFrame) -> DataFrame:
    """Account names with a naming tell, built-in ones aside."""
    shape = r"(?i)^sam\\(?:sam\\)?domains\\account\\users\\names\\([^\\]+)$"
    name = F.regexp_extract("key_path", shape, 1)
    builtin = F.lower(name).isin(*BUILTIN_ACCOUNTS) | F.lower(name).startswith("support_")
    rows = registry.where((name != "") & ~builtin & name.rlike(ACCOUNT_TELL))
    out = rows.select("host", name.alias("account"), F.col("last_write_us").alias("us"), "row_no")
    return dedup_leads(out, ["host", "account"], ["us", "row_no"]).withColumn("technique", F.lit("T1136.001"))


@F.pandas_udf(T.StringType())
def decode_utf16_hex(data: pd.Series) -> pd.Series:
    """Text before the first terminator of a UTF-16LE blob given in hex; null when it is not hex or empty."""

    def one(value):
        try:
            return bytes.fromhex(value).decode("utf-16-le", "ignore").split("\0")[0] or None
        except (TypeError, ValueError):
            return None

    return data.map(one)


def recent_use(registry: DataFrame) -> DataFrame:
    """Search terms, opened files, recent documents, folders and mounts that carry a tell, one row per value."""
    key = F.lower("key_path")
    binary = F.lower(F.coalesce("value_type", F.lit("regsz"))).isin("reg_binary", "regbinary")
    family = (
        F.when(key.rlike(r"\\acmru\\|\\wordwheelquery"), "search_term")
        .when(key.rlike(r"\\(opensavemru|opensavepidlmru|lastvisitedmru)(\\|$)"), "opened_file")
        .when(key.contains("\\recentdocs"), "recent_doc")
        .when(key.contains("\\bagmru"), "shellbag")
        .when(key.endswith("mounteddevices"), "mounted_device")
    )
    ordering = F.lower("value_name").isin("mrulist", "mrulistex", "nodeslot", "nodeslots")
    wide = decode_utf16_hex(F.col("value_data"))
    narrow = F.array_join(F.regexp_extract_all(F.decode(F.unhex(F.when(F.col("value_data").rlike(r"^(?:[0-9a-fA-F]{2})+$"), F.col("value_data"))), "ISO-8859-1"), F.lit("([\\x20-\\x7e]{4,})"), F.lit(1)), " ")
    text = (
        F.when(~binary, F.col("value_data"))
        .when(family.isin("search_term", "recent_doc", "mounted_device") & ~key.contains("\\acmru\\"), wide)
        .when(family == "shellbag", narrow)
    )
    rows = registry.withColumn("kind", family).withColumn("value", text).where(F.col("kind").isNotNull() & ~ordering & (F.coalesce("value", F.lit("")) != ""))
    low = F.lower("value")
    network = F.col("value").startswith("\\\\")
    program = low.rlike(r"\.(exe|scr|bat|ps1|msi)$") & low.rlike(r"\\(desktop|downloads?|temp|public)\\")
    removable = low.rlike("usbstor|removable")
    tell = (
        (F.col("kind") == "search_term")
        | (F.col("kind").isin("opened_file", "recent_doc", "shellbag") & (network | program | _tool(low).isNotNull()))
        | ((F.col("kind") == "mounted_device") & removable)
    )
    out = rows.where(tell).select("host", "kind", "value", F.col("key_path"), F.col("last_write_us").alias("us"), "row_no")
    return dedup_leads(out, ["host", "kind", "value"], ["us", "row_no"])


def capture_services(registry: DataFrame) -> DataFrame:
    rows = registry.where(F.col("key_path").rlike(r"(?i)\\services\\[^\\]+$") & F.col("value_data").rlike(CAPTURE_DRIVERS))
    return rows.select("host", F.regexp_extract("key_path", r"([^\\]+)$", 1).alias("service_name"), F.col("value_data").alias("image_path"), F.col("last_write_us").alias("us"))


SHARED_ROOT = r"(?i)^[a-z]:\\(users\\public|programdata|temp|perflogs|windows\\temp|\$recycle\.bin)\\"


def shared_root_runs(entries: DataFrame, files: DataFrame, prefetch: DataFrame) -> DataFrame:
    """Programs run from a root every user can write; confirmed only with a second artifact class."""
    key = ["host", "entry_id"]
    rows = entries.withColumn("program_path", F.coalesce("program_path", run_entry_path(F.col("encoded_name")))).where(F.col("program_path").rlike(SHARED_ROOT))
    in_files = run_entries_in_files(rows, files).select(*key).distinct().withColumn("in_mft", F.lit(True))
    in_prefetch = run_entries_in_prefetch(rows, prefetch).select(*key).distinct().withColumn("in_prefetch", F.lit(True))
    out = rows.join(in_files, key, "left").join(in_prefetch, key, "left").na.fill(False, ["in_mft", "in_prefetch"])
    tier = F.when(F.col("in_mft") | F.col("in_prefetch"), "CONFIRMED").otherwise("HYPOTHESIS")
    return out.withColumn("confidence", tier).withColumn("technique", F.lit("T1204.002"))


def hacking_tools(files: DataFrame) -> DataFrame:
    """Known tools under program, desktop or download folders, one row per host and tool."""
    low, name = F.concat(F.lit("/"), slashed(F.col("full_path"))), base_name(F.col("full_path"))
    tool = _tool(low)
    rows = files.where(low.rlike(r"/(program files|desktop|downloads?)( \(x86\))?/") & ~name.endswith(".pf") & tool.isNotNull())
    return dedup_leads(rows.select("host", tool.alias("tool"), "full_path", "si_created", "record_number"), ["host", "tool"], ["si_created", "record_number"])


def wipers_on_disk(files: DataFrame) -> DataFrame:
    low, name = F.concat(F.lit("/"), slashed(F.col("full_path"))), base_name(F.col("full_path"))
    tool = _token(name, WIPERS)
    residue = name.endswith(".pf")
    rows = files.where(tool.isNotNull() & (residue | low.rlike(r"/(program files|desktop|downloads?)( \(x86\))?/")))
    kind = F.when(residue, "prefetch_residue").otherwise("installed")
    out = rows.select("host", tool.alias("tool"), kind.alias("presence"), "full_path", "record_number")
    return dedup_leads(out, ["host", "tool"], ["presence", "record_number"]).withColumn("technique", F.lit("T1070.004"))


def wiper_runs(prefetch: DataFrame) -> DataFrame:
    tool = _token(F.lower("executable_name"), WIPERS)
    return prefetch.where(tool.isNotNull() & (F.col("run_count") > 0)).groupBy("host", tool.alias("tool")).agg(F.sum("run_count").alias("run_count"))


def sync_channels(files: DataFrame, prefetch: DataFrame, visits: DataFrame) -> DataFrame:
    """Cloud-sync services by client, folder, run or visit, merged to one row per host and service."""
    low = F.concat(F.lit("/"), slashed(F.col("full_path")), F.lit("/"))
    by_file = files.select("host", F.coalesce(_token(base_name(F.col("full_path")), SYNC_CLIENTS), _token(low, SYNC_FOLDERS)).alias("service"), F.lit("disk").alias("source"))
    by_run = prefetch.where("run_count > 0").select("host", _token(F.lower("executable_name"), SYNC_CLIENTS).alias("service"), F.lit("prefetch").alias("source"))
    by_visit = cloud_visits(visits).where("kind = 'cloud_storage'").select("host", "service", F.lit("browser").alias("source"))
    rows = reduce(lambda a, b: a.unionByName(b), (by_file, by_run, by_visit)).where("service IS NOT NULL")
    has = lambda s: F.bool_or(F.col("source") == s)
    out = rows.groupBy("host", "service").agg(has("disk").alias("on_disk"), has("prefetch").alias("was_run"), has("browser").alias("visited"), F.count(F.lit(1)).alias("sightings"))
    return out.withColumn("technique", F.lit("T1567.002"))


def cloud_visits(visits: DataFrame) -> DataFrame:
    """Visits to cloud storage or webmail hosts; the host list is short and fixed."""
    web_host = F.lower(F.regexp_extract("url", r"^[a-z]+://(?:[^@/]*@)?([^/:?#]+)", 1))
    row = F.coalesce(*[F.when(web_host == h, F.struct(F.lit(s).alias("service"), F.lit(k).alias("kind"))) for h, s, k in CLOUD_HOSTS])
    return visits.withColumn("__c", row).where("__c IS NOT NULL").select(*visits.columns, "__c.service", "__c.kind")


def archive_staging(journal: DataFrame) -> DataFrame:
    return staged_archives(journal).withColumn("technique", F.lit("T1560.001"))


def cleanup_after_staging(journal: DataFrame, window_us: int = 3_600_000_000) -> DataFrame:
    return post_staging_deletions(journal, staged_archives(journal), window_us).withColumn("technique", F.lit("T1070"))


def removable_shortcuts(links: DataFrame) -> DataFrame:
    """Shortcuts to removable volumes, or with a staging tell in their path."""
    path = F.lower(F.coalesce("source_file", F.lit("")))
    removable = F.lower(F.coalesce("drive_type", F.lit(""))).contains("removable")
    tell = path.rlike(r"[\\/](recent|nethood)[\\/].*staging")
    return links.where(removable | tell).withColumn("basis", F.when(removable, "volume").otherwise("path_name"))


def recycled_tools(items: DataFrame) -> DataFrame:
    """Deleted items that carry a tool name."""
    return items.withColumn("tool", _tool(base_name(F.col("filename")))).where("tool IS NOT NULL")


def encryption_tooling(prefetch: DataFrame) -> DataFrame:
    """Encryption programs by family from prefetch names; presence only, never confirmed."""
    name = base_name(F.col("executable_name"))
    family = F.coalesce(*[F.when(name.startswith(p), f) for p, f in ENCRYPTION_TOOLS])
    return prefetch.withColumn("family", family).where("family IS NOT NULL").groupBy("host", "family").agg(F.count_distinct(name).alias("programs"), F.max("run_count").alias("max_runs")).withColumn("confidence", F.lit("INFERRED"))


def illicit_downloads(history: DataFrame) -> DataFrame:
    """Executable or archive downloads in browser history; the 'Visited:' copy of an address is the same address."""
    url = F.regexp_replace("url", r"^(?i)visited:\s*[^@]*@", "")
    hit = F.lower(url).rlike(r"\.(exe|msi|scr|zip|rar|7z)(\?|#|$)|/(warez|crack|keygen)s?/")
    return history.withColumn("url", url).where(hit).groupBy("host", "url").agg(F.count(F.lit(1)).alias("hits"), F.min("us").alias("us"))
