"""Path columns: artifact classes, evidence types, registry program paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and names per artifact class.
MEMORY_EXTS = (".mem", ".raw", ".vmem", ".dmp", ".img", ".lime")
RAW_DISK_EXTS = (".e01", ".dd", ".aff", ".aff4", ".001")
PCAP_EXTS = (".pcap", ".pcapng", ".cap")
PATTERN_TARGET_EXTS = (
    ".bat", ".cmd", ".dll", ".doc", ".docm", ".docx", ".exe", ".hta", ".js", ".jse", ".lnk", ".msi",
    ".ps1", ".scr", ".vbe", ".vbs", ".xls", ".xlsm", ".xlsx",
)
HIVE_NAMES = ("software", "system", "security", "sam", "default", "ntuser.dat", "usrclass.dat", "amcache.hve")
BROWSER_DB_NAMES = ("places.sqlite", "web data", "cookies", "login data")
BROWSER_PROFILE_MARKERS = (
    "chrome", "chromium", "brave", "user data", "opera software", "vivaldi", "microsoft/edge", "mozilla", "firefox",
)
WEBROOT_SCRIPT_EXTS = (
    ".php", ".php3", ".php4", ".php5", ".php7", ".phps", ".phtml", ".asp", ".aspx", ".ashx", ".asmx",
    ".jsp", ".jspx", ".jspf", ".cfm", ".cgi",
)
WEB_ROOT_MARKERS = ("htdocs/", "wwwroot/", "inetpub/", "public_html/", "www/", "webapps/", "webroot/")
WEB_LOG_NAMES = (
    "access.log", "access_log", "error.log", "error_log", "ssl_access.log", "ssl_request.log",
    "other_vhosts_access.log",
)
WEB_LOG_DIR_MARKERS = (
    "/apache/logs/", "/apache2/", "/httpd/", "/nginx/", "/lighttpd/", "/logs/w3svc", "inetpub/logs/",
)


def _ends(name: Column, suffixes) -> Column:
    return name.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def _has(path: Column, words) -> Column:
    return path.rlike("|".join(w.replace(".", r"\.") for w in words))


def slashed(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def base_name(path: Column) -> Column:
    """Last component, lower case, for either slash."""
    return F.substring_index(slashed(path), "/", -1)


def is_web_log(path: Column) -> Column:
    low, name = slashed(path), base_name(path)
    in_dir = low.startswith("apache/logs/") | _has(low, WEB_LOG_DIR_MARKERS)
    known = name.isin(*WEB_LOG_NAMES) | name.rlike(r"^(access\.log|access_log)\.") | name.rlike(r"^u_ex.*\.log$")
    return (in_dir & known) | name.endswith(".access")


def is_webroot_script(path: Column) -> Column:
    low, name = slashed(path), base_name(path)
    in_root = low.rlike("(^|/)(" + "|".join(WEB_ROOT_MARKERS) + ")")
    return in_root & _ends(name, WEBROOT_SCRIPT_EXTS)


def detect_evidence_type(path: Column) -> Column:
    name = base_name(path)
    return (
        F.when(_ends(name, MEMORY_EXTS), "memory")
        .when(name.endswith(".evtx") & name.contains("sysmon"), "network")
        .when(name.endswith(".evtx"), "evtx")
        .when(_ends(name, PCAP_EXTS), "network")
        .when(_ends(name, RAW_DISK_EXTS), "disk")
        .when(name.endswith(".zip"), "velociraptor")
        .otherwise("unknown")
    )


def classify_path(path: Column) -> Column:
    """Artifact class of a path; the first rule that holds wins."""
    low, name = slashed(path), base_name(path)
    rules = (
        ("memory", _ends(name, MEMORY_EXTS)),
        ("sysmon_network", name.endswith(".evtx") & name.contains("sysmon")),
        ("evtx", name.endswith(".evtx")),
        ("pcap", _ends(name, PCAP_EXTS)),
        ("zeek", name.isin("conn.log", "dns.log", "http.log", "ssl.log", "tls.log") | (name.endswith(".log") & low.contains("zeek"))),
        ("raw_disk", _ends(name, RAW_DISK_EXTS)),
        ("mft", name.isin("$mft", "mft") | name.endswith(".mft")),
        ("prefetch", name.endswith(".pf")),
        ("amcache", name == "amcache.hve"),
        ("registry", name.isin(*HIVE_NAMES)),
        ("srum", name == "srudb.dat"),
        ("usnjrnl", name.isin("$j", "$usnjrnl", "usnjrnl", "usnjrnl.j") | name.endswith(".usnjrnl") | name.endswith(".j") | low.contains("$extend/$usnjrnl")),
        ("legacy_evt", name.endswith(".evt")),
        ("lnk", name.endswith(".lnk")),
        ("jumplist", name.endswith(".automaticdestinations-ms") | name.endswith(".customdestinations-ms")),
        ("recyclebin", (name == "info2") | (name.startswith("$i") & low.contains("$recycle.bin"))),
        ("ie_history", (name == "index.dat") & low.contains("history.ie5")),
        ("thumbnail", (name == "thumbs.db") | name.endswith(".thumbcache")),
        ("browser_db", name.isin(*BROWSER_DB_NAMES) | name.endswith(".sqlite") | ((name == "history") & _has(low, BROWSER_PROFILE_MARKERS))),
        ("web_log", is_web_log(path)),
        ("webroot_script", is_webroot_script(path)),
        ("yara_target", _ends(name, PATTERN_TARGET_EXTS)),
        ("velociraptor", name.endswith(".zip")),
    )
    chain = F.when(rules[0][1], rules[0][0])
    for label, test in rules[1:]:
        chain = chain.when(test, label)
    return chain.otherwise("unknown")


def image14(name: Column) -> Column:
    """Process name as kernel structures keep it: trimmed, lower case, 14 characters."""
    return F.substring(F.lower(F.trim(name)), 1, 14)


def rot13(text: Column) -> Column:
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return F.translate(text, plain, plain[13:26] + plain[:13] + plain[39:] + plain[26:39])


# Known-folder ids that open a program path in run-count entries.
KNOWN_FOLDERS = (
    ("{6D809377-6AF0-444B-8957-A3773F02200E}", "C:\\Program Files"),
    ("{7C5A40EF-A0FB-4BFC-874A-C0F2E0B9FA8E}", "C:\\Program Files (x86)"),
    ("{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}", "C:\\Windows\\System32"),
    ("{D65231B0-B2F1-4857-A4CE-A8E7C6EA7D27}", "C:\\Windows\\SysWOW64"),
    ("{F38BF404-1D43-42F2-9305-67DE0B28FC23}", "C:\\Windows"),
)


def run_entry_path(name: Column) -> Column:
    """Registry run-count entry name: ROT13, prefix dropped, known folders resolved; null for non-paths."""
    plain = F.regexp_replace(rot13(name), "^UEME_RUNPATH:", "")
    for guid, folder in KNOWN_FOLDERS:
        plain = F.when(plain.startswith(guid), F.concat(F.lit(folder), F.substr(plain, F.lit(len(guid) + 1)))).otherwise(plain)
    return F.when(plain.rlike(r"^[A-Za-z]:\\|^\\\\") & plain.rlike(r"(?i)\.[a-z0-9]{2,4}$"), plain)


def relative_path(path: Column, base: Column) -> Column:
    """Absolute paths under the base become relative; everything else is unchanged."""
    root = F.regexp_replace(base, "/+$", "")
    inside = path.startswith(F.concat(root, F.lit("/")))
    return F.when(inside, F.substr(path, F.length(root) + 2)).when(path == root, F.lit(".")).otherwise(path)


def host_of_label(label: Column) -> Column:
    return F.regexp_replace(label, "^(mem|disk|xart):", "")


def registrable_domain(host: Column) -> Column:
    """Last two labels of a host name, lower case, without port or trailing dot."""
    bare = F.regexp_replace(F.lower(F.trim(host)), r":\d+$|\.$", "")
    return F.substring_index(bare, ".", -2)
