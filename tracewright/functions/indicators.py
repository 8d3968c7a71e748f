"""Indicators: web requests and scripts, observables in prose, archives in cookies, change-journal flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.text import contains_any, let, percent_decode2

# Needles for each web request and script indicator.
TAUTOLOGIES = ("or1=1", "or1=1--", "or'1'='1", 'or"1"="1', "or1<2", "or1like1", "')or('")
META_FUNCTIONS = (
    "version()", "database()", "user()", "@@version", "load_file(", "into outfile", "into dumpfile",
    "group_concat(", "sleep(", "benchmark(", "extractvalue(", "updatexml(",
)
SCANNER_AGENTS = (
    "sqlmap", "nikto", "havij", "acunetix", "nessus", "dirbuster", "gobuster", "wpscan", "masscan", "zgrab",
    "openvas", "w3af", "hydra", "metasploit", "nmap scripting engine",
)
COMMAND_TOKENS = (
    "whoami", "ipconfig", "ifconfig", "/bin/sh", "/bin/bash", "cmd.exe", "powershell", "net user",
    "cat /etc/passwd", "wget http", "curl http", "nc -e",
)
COMMAND_PARAMETERS = ("cmd=", "command=", "exec=", "shell=", "act=", "download=")
SHELL_METACHARACTERS = (";", "|", "&&", "`", "$(")
SCRIPT_EXTENSIONS = ("php", "php3", "php4", "php5", "php7", "phps", "phtml", "asp", "aspx", "ashx", "asmx", "jsp", "jspx", "jspf", "cfm", "cgi")
SCRIPT_INDICATORS = {
    "php_command_exec": ("system(", "shell_exec(", "passthru(", "popen(", "proc_open(", "pcntl_exec(", "exec("),
    "php_eval": ("eval(", "assert(", "create_function(", "preg_replace"),
    "obfuscated_decode": ("base64_decode(", "gzinflate(", "gzuncompress(", "str_rot13(", "hex2bin("),
    "reverse_shell_socket": ("fsockopen", "pfsockopen", "stream_socket_client", "socket_create", "socket_connect"),
    "error_suppression": ("error_reporting(0)", "@eval(", "@system(", "@shell_exec("),
    "dotnet_process_start": ("process.start(", "wscript.shell", "cmd.exe /c", "runtime.getruntime().exec"),
    "asp_eval": ("eval(request", "execute(request", "executeglobal("),
    "file_upload_primitive": ("move_uploaded_file(", "file_put_contents("),
}
REQUEST_INPUTS = (
    "$_get", "$_post", "$_request", "$_cookie", "$_files", "$_server['http_", "request.querystring",
    "request.form", 'request["', "request.getparameter(",
)
EXEC_PRIMITIVES = (
    "system(", "shell_exec(", "passthru(", "popen(", "proc_open(", "pcntl_exec(", "exec(", "eval(", "assert(",
    "create_function(", "process.start(", "wscript.shell",
)

# Change-journal reason bits.
USN_REASONS = {
    "DATA_OVERWRITE": 0x00000001,
    "DATA_EXTEND": 0x00000002,
    "DATA_TRUNCATION": 0x00000004,
    "NAMED_DATA_OVERWRITE": 0x00000010,
    "NAMED_DATA_EXTEND": 0x00000020,
    "NAMED_DATA_TRUNCATION": 0x00000040,
    "FILE_CREATE": 0x00000100,
    "FILE_DELETE": 0x00000200,
    "EA_CHANGE": 0x00000400,
    "SECURITY_CHANGE": 0x00000800,
    "RENAME_OLD_NAME": 0x00001000,
    "RENAME_NEW_NAME": 0x00002000,
    "INDEXABLE_CHANGE": 0x00004000,
    "BASIC_INFO_CHANGE": 0x00008000,
    "HARD_LINK_CHANGE": 0x00010000,
}


def request_indicators(target: Column, agent: Column) -> Column:
    """Sorted exploit indicators of one request; an encoded quote or comment end needs another beside it."""
    raw = F.lower(target)
    decoded = percent_decode2(raw)
    squeezed = F.regexp_replace(decoded, r"\s", "")
    path = F.substring_index(decoded, "?", 1)
    query = F.when(F.instr(decoded, "?") > 0, F.substr(decoded, F.instr(decoded, "?") + 1)).otherwise("")
    script = path.rlike(r"\.(" + "|".join(SCRIPT_EXTENSIONS) + ")$") & (query != "")
    structural = {
        "sqli_union_select": decoded.rlike("(?s)union.*select"),
        "sqli_boolean_tautology": contains_any(squeezed, TAUTOLOGIES),
        "sqli_information_schema": F.contains(decoded, F.lit("information_schema")),
        "sqli_meta_function": contains_any(decoded, META_FUNCTIONS),
        "path_traversal": contains_any(decoded, ("../", "..\\")),
        "webshell_invocation": script & (contains_any(query, COMMAND_PARAMETERS) | contains_any(query, COMMAND_TOKENS)),
        "command_injection": contains_any(decoded, SHELL_METACHARACTERS) & contains_any(decoded, COMMAND_TOKENS),
        "scanner_user_agent": contains_any(F.lower(F.coalesce(agent, F.lit(""))), SCANNER_AGENTS),
    }
    beside = {
        "encoded_quote": contains_any(raw, ("%27", "%22", "%2527")),
        "sql_comment_terminator": contains_any(decoded, ("-- ", "/*!")) | decoded.endswith("--"),
    }
    main = F.array_compact(F.array(*[F.when(test, name) for name, test in structural.items()]))
    extra = F.array_compact(F.array(*[F.when(test, name) for name, test in beside.items()]))
    return F.when(F.size(main) > 0, F.array_sort(F.concat(main, extra))).otherwise(F.array().cast("array<string>"))


def script_indicators(line: Column) -> Column:
    """Indicators raised by one script line."""
    low = F.lower(line)
    tests = [F.when(contains_any(low, needles), name) for name, needles in SCRIPT_INDICATORS.items()]
    tests.append(F.when(contains_any(low, REQUEST_INPUTS) & contains_any(low, EXEC_PRIMITIVES), "request_driven_exec"))
    return F.array_compact(F.array(*tests))


def reason_names(mask: Column) -> Column:
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(bit) != 0, name) for name, bit in USN_REASONS.items()]))


def reason_mask(names: Column) -> Column:
    total = F.lit(0)
    for name, bit in USN_REASONS.items():
        total = total + F.when(F.array_contains(names, name), bit).otherwise(0)
    return total.cast("long")


# First bytes of archive containers, hex.
ARCHIVE_MAGIC = (("504B0304", "zip"), ("526172211A07", "rar"), ("377ABCAF271C", "7z"), ("1F8B08", "gzip"), ("425A68", "bzip2"), ("FD377A585A00", "xz"))
MIN_COOKIE_BASE64 = 32


def cookie_archive(value: Column) -> Column:
    """(container, member) when a cookie value is base64 of an archive, tail cuts included; else null."""

    def read(data: Column) -> Column:
        head = F.hex(F.substring(data, 1, 8))
        kind = F.coalesce(*[F.when(head.startswith(magic), name) for magic, name in ARCHIVE_MAGIC])
        size = F.conv(F.concat(F.hex(F.substring(data, 28, 1)), F.hex(F.substring(data, 27, 1))), 16, 10).cast("int")
        member = F.when((kind == "zip") & (size > 0), F.make_valid_utf8(F.substr(data, F.lit(31), size).cast("string")))
        return F.when(kind.isNotNull(), F.struct(kind.alias("container"), member.alias("member")))

    plain = F.regexp_replace(F.trim(value), "=+$", "")
    whole = F.substr(plain, F.lit(1), F.length(plain) - F.length(plain) % 4)
    ok = (F.length(plain) >= MIN_COOKIE_BASE64) & ~plain.rlike("[^A-Za-z0-9+/]")
    return let(F.try_to_binary(F.when(ok, whole), F.lit("base64")), read)


def printable_strings(data: Column, shortest: int = 4) -> Column:
    return F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit("([\\x20-\\x7e]{" + str(shortest) + ",})"), F.lit(1))


def windows_paths(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(" + DRIVE_PATH + ")"), F.lit(1))


CVE_SHAPE = r"((?i)CVE-\d{4}-\d{4,7})"


def extract_cves(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CVE_SHAPE), F.lit(1)), F.upper))


# Our choice of shapes for observables in prose.
FILE_EXTENSIONS = (
    "exe", "dll", "sys", "bat", "cmd", "ps1", "vbs", "vbe", "js", "jse", "hta", "scr", "msi", "lnk", "pf", "dit", "rar",
    "zip", "7z", "gz", "tar", "cab", "iso", "txt", "log", "doc", "docx", "docm", "xls", "xlsx", "xlsm", "ppt", "pptx",
    "pdf", "csv", "evtx", "evt", "dat", "db", "sqlite", "php", "asp", "aspx", "jsp", "tmp", "bin", "ini", "xml", "json",
    "pst", "ost", "dbx", "pcap", "dmp", "raw", "mem", "img", "png", "jpg", "jpeg", "gif", "hve", "inf", "cpl", "html", "htm",
)
_EXT = "(?:" + "|".join(FILE_EXTENSIONS) + ")"
_SEGMENTS = r"""(?:[^\\/:*?"<>|\r\n;,]+\\)*[^\\/:*?"<>|\s;,]+"""
DRIVE_PATH = r"[A-Za-z]:\\" + _SEGMENTS
UNC_PATH = r"\\\\[^\\\s;,]+\\" + _SEGMENTS
UNIX_PATH = r"(?<![\w/:.])/(?:[\w.\-]+/)+[\w.\-]+"
URL = r"""https?://[^\s"'<>)\]]+"""
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
HEX_DIGEST = r"\b(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b"
REGISTRY_KEY = r"\b(?:HK(?:LM|CU|CR|U|CC)|HKEY_[A-Z_]+)\\[^\s,;]+"
CONTROL_SET_KEY = r"(?<![\\\w])(?:CurrentControlSet|ControlSet\d{3})\\[^\s,;]+"
BARE_FILE = r"(?<![\\/\w.@\-])[\w\-$~]+(?:\.[\w\-]+)*\.(?i:" + _EXT + r")(?![\w\\/]|\.\w)"
DOMAIN = r"(?<![@\w./\\\-])(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w\\/@]|\.\w)"
CLAUSE_BREAK = r"(?<=[.;!?])\s+|\n+|,?\s+but\s+|(?<=not (?:observed|present|found|seen))\s+and\s+"
NEGATION = r"(?i)\b(?:not|no|never|neither|nor|without|didn't|wasn't|weren't)\b"
# Every observable has a separator inside it, or is a long run of hex digits; other clauses are skipped early.
OBSERVABLE_HINT = r"[\\/@]|[A-Za-z0-9_]\.[A-Za-z0-9]|[0-9a-fA-F]{32}"
HASH_LABEL = r"(?i)\b(?:sha-?(?:1|256)|md5)\b"


def _every(text: Column, shape: str) -> Column:
    found = F.regexp_extract_all(text, F.lit("(" + shape + ")"), F.lit(1))
    return F.transform(found, lambda v: F.regexp_replace(v, r"[.,;:!?)\]]+$", ""))


def _kinds(prose: Column, hashed: Column) -> Column:
    rest = prose
    for shape in (URL, EMAIL, REGISTRY_KEY, CONTROL_SET_KEY):
        rest = F.regexp_replace(rest, shape, " ")

    def rest_kinds(r: Column) -> Column:
        names = r
        for shape in (UNC_PATH, DRIVE_PATH, UNIX_PATH):
            names = F.regexp_replace(names, shape, " ")
        return let(names, lambda n: F.array(
            _every(F.regexp_replace(n, BARE_FILE, " "), DOMAIN),
            F.concat(_every(r, DRIVE_PATH), _every(r, UNC_PATH), _every(F.regexp_replace(r, UNC_PATH, " "), UNIX_PATH), _every(n, BARE_FILE)),
        ))

    control = F.transform(_every(prose, CONTROL_SET_KEY), lambda k: F.concat(F.lit("HKLM\\SYSTEM\\"), k))

    def gather(found: Column) -> Column:
        kinds = {
            "urls": _every(prose, URL),
            "emails": _every(F.regexp_replace(prose, URL, " "), EMAIL),
            "ips": _every(prose, IPV4),
            "domains": found[0],
            "paths": found[1],
            "registry": F.concat(_every(prose, REGISTRY_KEY), control),
            "hashes": F.transform(_every(hashed, HEX_DIGEST), F.lower),
        }
        return F.create_map(*[part for kind, vals in kinds.items() for part in (F.lit(kind), F.array_sort(F.array_distinct(vals)))])

    return let(rest, lambda r: let(rest_kinds(r), gather))


def extract_iocs(text: Column, bare_hashes: bool = True) -> Column:
    """Observables as a map of kind to sorted distinct values; negated clauses give nothing."""
    kept = F.filter(F.split(text, CLAUSE_BREAK), lambda c: c.rlike(OBSERVABLE_HINT) & ~c.rlike(NEGATION))

    def read(clauses: Column) -> Column:
        labelled = clauses if bare_hashes else F.filter(clauses, lambda c: c.rlike(HASH_LABEL))
        return let(F.array_join(clauses, "\n"), lambda prose: _kinds(prose, F.array_join(labelled, "\n")))

    return let(kept, read)


def recall_terms(technique: Column, text: Column) -> Column:
    """Technique, then file names and addresses, each once, in order."""
    first = F.array_compact(F.array(F.when(technique != "", technique)))
    found = F.regexp_extract_all(text, F.lit("(" + BARE_FILE + "|" + IPV4 + ")"), F.lit(1))
    return F.array_distinct(F.concat(first, found))
