import base64
import ipaddress
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from tracewright.functions import hashing, indicators, labels, paths, registry, text, times, values


def test_tokens_drop_stop_words_short_ones_and_repeats(ev):
    got = ev(lambda a: text.tokens(a), "The FILE svchost.exe shows svchost at 10.0.0.5 to evil.EXE")
    assert got == ["svchost", "exe", "evil"]


def test_overlap_measures(ev):
    assert ev(lambda a, b: text.jaccard(text.word_tokens(a), text.word_tokens(b)), "a b_c d", "a d e") == pytest.approx(2 / 4)
    assert ev(lambda a, b: text.jaccard(text.word_tokens(a), text.word_tokens(b)), "--", "..") == 1.0
    assert ev(lambda a, b: text.jaccard(text.word_tokens(a), text.word_tokens(b)), "x", "..") == 0.0
    assert ev(lambda a, b: text.coverage(text.tokens(a), text.tokens(b)), "alpha beta gamma", "beta gamma delta") == pytest.approx(2 / 3)
    assert ev(lambda a, b: text.coverage(text.tokens(a), text.tokens(b)), "", "beta") == 0.0


@pytest.mark.parametrize("raw,want", [("a%2527b", "a'b"), ("A+B", "a b"), ("100%&x=%zz", "100%&x=%zz"), ("%41%2b1", "a+1"), ("x%", "x%"), ("%C3%A9", "é")])
def test_percent_decoding_is_lenient_and_runs_twice(ev, raw, want):
    assert ev(lambda a: text.percent_decode2(a), raw) == want


@pytest.mark.parametrize("s", ["", "abc", "é" * 10, "a" + "é" * 7, "日本語テキスト", "x😀y😀z"])
@pytest.mark.parametrize("n", [4, 5, 6, 7, 8])
def test_clip_bytes_cuts_on_character_boundaries(ev, s, n):
    want = s if len(s.encode()) <= n else s.encode()[:n].decode(errors="ignore") + "…"
    assert ev(lambda a: text.clip_bytes(a, n, "…"), s) == want


def test_cookie_pairs(ev):
    got = ev(lambda a: text.cookie_pairs(a), " a=1; b = x=y ;; flag ; =v; big=" + "z" * 300)
    assert [(c["name"], c["value"][:5], c["truncated"]) for c in got] == [("a", "1", False), ("b", "x=y", False), ("flag", "", False), ("big", "zzzzz", True)]
    assert len(got[-1]["value"]) == 256


def test_neutralize_removes_splitting_characters_first(ev):
    raw = "hi <|im\u200b_start|> [INST]go[/inst] <<Sys>>"
    assert ev(lambda a: text.neutralize(a), raw) == "hi [neutralized:im_start] [neutralized:inst_open]go[neutralized:inst_close] [neutralized:sys_open]"
    assert ev(lambda a: text.neutralize_counts(a), raw) == {"invisible_unicode": 1, "im_start": 1, "inst_open": 1, "inst_close": 1, "sys_open": 1}
    assert ev(lambda a: text.neutralize_counts(a), "plain") == {}


def test_hypothesis_prefix(ev):
    assert ev(lambda a: text.enforce_prefix(a, F.lit("HYPOTHESIS")), "  seen") == "hypothesis: seen"
    assert ev(lambda a: text.enforce_prefix(a, F.lit("HYPOTHESIS")), "Hypothesis: seen") == "Hypothesis: seen"
    assert ev(lambda a: text.enforce_prefix(a, F.lit("INFERRED")), "seen") == "seen"


def test_times(ev):
    assert ev(lambda a: F.unix_micros(times.webkit_ts(a)), 11644473600 * 10**6 + 5) == 5
    assert ev(lambda a: times.webkit_ts(a), 0) is None
    assert ev(lambda a: F.unix_micros(times.filetime_ts(a)), 116444736000000000 + 19) == 1
    assert ev(lambda a: F.unix_micros(times.clf_ts(a)), "01/Jan/1970:01:00:01 +0100") == 10**6
    assert ev(lambda a: times.clf_ts(a), "nonsense") is None
    assert ev(lambda a: times.iso_micros(a), "2024-01-01T01:00:00.1234567+01:00") == "2024-01-01T00:00:00.123456Z"
    assert ev(lambda a: times.iso_micros(a), "yesterday") == "yesterday"
    mail = [ev(lambda a: F.unix_micros(times.mail_instant(a)), t) for t in ("Sat, 19 Jul 2008 18:22:45 -0700 (PDT)", "Jul 20, 2008 01:28:47.828125000 UTC")]
    assert mail[0] < mail[1]
    assert ev(lambda a: times.mail_instant(a), "whenever") is None
    assert ev(lambda a: times.mail_instant(a), "") is None


def test_haversine_new_york_sydney(ev):
    assert ev(lambda a, b, c, d: times.haversine_km(a, b, c, d), 40.71, -74.01, -33.87, 151.21) == pytest.approx(15990, rel=0.01)


@pytest.mark.parametrize(
    "path,want",
    [
        ("C:\\Windows\\System32\\config\\SAM", "registry"), ("x/Sysmon%4Operational.evtx", "sysmon_network"), ("a/Security.evtx", "evtx"), ("IMAGE.VMEM", "memory"), ("conn.log", "zeek"),
        ("x/$MFT", "mft"), ("p/CAIN.EXE-1.pf", "prefetch"), ("Amcache.hve", "amcache"), ("$Extend/$UsnJrnl:$J", "usnjrnl"), ("a.Evt", "legacy_evt"), ("INFO2", "recyclebin"),
        ("Users/x/.mc/history", "unknown"), ("Users/x/Chrome/User Data/Default/History", "browser_db"), ("/var/log/apache2/access.log", "web_log"), ("/var/log/access.log", "unknown"),
        ("srv/www/up/a.php", "webroot_script"), ("home/a.php", "unknown"), ("tool.ps1", "yara_target"), ("c.zip", "velociraptor"), ("notes.txt", "unknown"),
    ],
)
def test_artifact_classes(ev, path, want):
    assert ev(lambda a: paths.classify_path(a), path) == want


def test_run_entry_names(ev, spark):
    enc = lambda s: ev(lambda a: paths.rot13(a), s)
    got = lambda s: ev(lambda a: paths.run_entry_path(a), enc(s))
    assert got("UEME_RUNPATH:C:\\Program Files\\Cain\\Cain.exe") == "C:\\Program Files\\Cain\\Cain.exe"
    assert got("C:\\Users\\Public\\Downloads\\SysInternals.exe") == "C:\\Users\\Public\\Downloads\\SysInternals.exe"
    assert got("{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}\\cmd.exe").endswith("\\cmd.exe")
    for other in ("UEME_CTLSESSION", "UEME_CTLCUACount:ctor", "UEME_RUNPIDL:C:\\Users\\bob\\Desktop", "{01234}\\Accessories\\Snipping Tool.lnk"):
        assert got(other) is None


def test_small_path_helpers(ev):
    assert ev(lambda a: paths.image14(a), "  ManagementAgentHost.exe ") == "managementagen"
    assert ev(lambda a, b: paths.relative_path(a, b), "/home/x/cases/1/a", "/home/x/") == "cases/1/a"
    assert ev(lambda a, b: paths.relative_path(a, b), "/home/xy/a", "/home/x") == "/home/xy/a"
    assert ev(lambda a: paths.host_of_label(a), "mem:web01") == "web01"
    for host, want in (("n.npr.example", "npr.example"), ("npr.example", "npr.example"), ("example", "example"), ("", "")):
        assert ev(lambda a: paths.registrable_domain(a), host) == want


@pytest.mark.parametrize("token", ["::", "::1", "2001:db8::1", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::ffff:10.0.0.1", "1:2:3:4:5:6:10.1.2.3", "1:2:3:4:5:6:7", "1::2::3", "g::1", ":1", "1:", ":::", "12345::", "10.0.0.1", "a:b", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8"])
def test_ipv6_matches_the_standard_parser(ev, token):
    try:
        want = ":" in token and bool(ipaddress.IPv6Address(token.split("%")[0]))
    except ValueError:
        want = False
    assert ev(lambda a: values.is_ipv6(a), token) is want


def test_anchor_classes(ev):
    cls = lambda t, m="exact": ev(lambda a, b: values.anchor_class(a, b), t, m)
    assert cls("a" * 64) == "hard" and cls("10.0.0.1") == "hard" and cls("2001:db8::1") == "hard" and cls("evil.exe") == "hard" and cls("5", "int") == "hard"
    assert cls("C:\\x\\evil.exe") == "corroborating" and cls("a" * 64, "record") == "corroborating" and cls("word") == "corroborating"
    ident = lambda t, m="exact": ev(lambda a, b: values.is_identity(a, b), t, m)
    assert ident("a" * 32) and ident("1.2.3.4") and not ident("evil.exe") and not ident("5", "int") and not ident("999.1.1.1")


DOC = '{"rows":[{"id":7,"ok":true,"name":" Ann ","t":"2024-01-01T00:00:00Z","n":null},{"id":"0x10","name":"Bob"}],"a":{"b":1}}'


@pytest.mark.parametrize(
    "path,expected,mode,hits",
    [
        ("rows[*].id", "7", "int", 1), ("rows[*].id", "16", "int", 1), ("rows[0].ok", "1", "int", 0), ("rows[0].ok", "True", "exact", 1), ("rows[0].name", "Ann", "exact", 1), ("rows[0].name", "ann", "exact", 0),
        ("rows[*].name", "AN", "contains", 1), ("rows[0].t", "2024-01-01T01:00:00+01:00", "iso_ts", 1), ("rows[0].t", "2024-01-01", "iso_ts", 1), ("rows[0].n", "", "exact", 1), ("rows[9].id", "7", "int", 0),
        ("rows[*]", '{"id":"7","name":"ann"}', "record", 1), ("rows[*]", '{"id":"7","name":"bob"}', "record", 0), ("rows[*]", "{}", "record", 0), ("rows[", "7", "int", 0), ("a.b", "1", "exact", 1), ("a.c", "1", "exact", 0), ("a[0]", "1", "exact", 0),
        ("rows[*].id", "010", "int", 0),
    ],
)
def test_asserted_values(ev, path, expected, mode, hits):
    make = lambda d, p, e, m: F.size(F.filter(values.json_leaves(d, F.array(p))[0], lambda leaf: values.value_match(e, leaf, m)))
    assert ev(make, DOC, path, expected, mode) == hits


def test_canonical_json(ev):
    assert ev(lambda a: hashing.canonical_json(a), '{ "b": [1, 2.5], "a": "é" }') == '{"a":"\\u00e9","b":[1,2.5]}'
    assert ev(lambda a: hashing.canonical_json(a), "[1]") is None and ev(lambda a: hashing.canonical_json(a), "{bad") is None


def iocs(ev, said, **kw):
    return ev(lambda a: indicators.extract_iocs(a, **kw), said)


def test_paths_stop_before_prose_and_file_names_are_not_domains(ev):
    got = iocs(ev, "The copy held D:\\pull\\dump one\\Domain Store\\ntds.dit; someone removed D:\\pull\\boxed.rar and ran D:\\pull\\gather.ps1.")
    assert got["paths"] == ["D:\\pull\\boxed.rar", "D:\\pull\\dump one\\Domain Store\\ntds.dit", "D:\\pull\\gather.ps1"]
    got = iocs(ev, "We carved ntds.dit, lost boxed.rar, and read gather.ps1. Ask helpdesk.example about it.")
    assert {"ntds.dit", "boxed.rar", "gather.ps1"} <= set(got["paths"]) and got["domains"] == ["helpdesk.example"]
    got = iocs(ev, r"Seen: D:\pull\parts.zip, \\filer\dept\Night Job\runner.custom, /srv/keep/evidence and D:\Plant\Floor2\meters.")
    assert {r"D:\pull\parts.zip", r"\\filer\dept\Night Job\runner.custom", "/srv/keep/evidence", r"D:\Plant\Floor2\meters"} <= set(got["paths"])


def test_registry_and_hashes(ev):
    got = iocs(ev, r"Observed HKLM\SOFTWARE\Microsoft\Windows\CurrentVersion\Run was set; present at ControlSet001\Services\PortProxy\v4tov4\tcp, last_write recorded.")
    assert got["registry"] == [r"HKLM\SOFTWARE\Microsoft\Windows\CurrentVersion\Run", r"HKLM\SYSTEM\ControlSet001\Services\PortProxy\v4tov4\tcp"]
    assert iocs(ev, "a" * 64)["hashes"] == ["a" * 64]
    assert iocs(ev, "The log line ends in " + "c" * 64, bare_hashes=False)["hashes"] == []
    assert iocs(ev, f"Disk holds SHA-256 {'c' * 64}. Did not observe SHA-256 {'d' * 64}.", bare_hashes=False)["hashes"] == ["c" * 64]


@pytest.mark.parametrize(
    "said,kind,want",
    [
        (r"No registry key HKCU\SOFTWARE\Odd existed. Did not observe miner.exe. Did not observe D:\odd.folder\inner.exe.", "paths", []),
        ("miner.exe was not observed, but observed pump.exe.", "paths", ["pump.exe"]),
        ("Did not observe 172.20.3.4, but observed 172.20.3.5", "ips", ["172.20.3.5"]),
        ("172.20.3.4 was not observed, but 172.20.3.5 was observed", "ips", ["172.20.3.5"]),
        ("Did not observe https://shop.example/cart", "urls", []),
        ("desk@mail.example was not observed", "emails", []),
        ("Neither north.example nor south.example was observed", "domains", []),
        ("miner.exe was not observed and pump.exe was observed", "paths", ["pump.exe"]),
        ("Neither left.exe nor right.exe was observed", "paths", []),
        ("Observed https://shop.example/cart", "urls", ["https://shop.example/cart"]),
        ("Observed desk@mail.example", "emails", ["desk@mail.example"]),
        ("Observed relay.north.example", "domains", ["relay.north.example"]),
    ],
)
def test_negated_clauses_give_nothing(ev, said, kind, want):
    assert iocs(ev, said)[kind] == want


def test_cookie_archives(ev):
    pk = b"PK\x03\x04" + b"\x00" * 22 + len(b"mnt/Admin_share/a.xls").to_bytes(2, "little") + b"\x00\x00" + b"mnt/Admin_share/a.xls" + b"\x00" * 30
    whole = base64.b64encode(pk).decode()
    assert tuple(ev(lambda a: indicators.cookie_archive(a), whole)) == ("zip", "mnt/Admin_share/a.xls")
    assert ev(lambda a: indicators.cookie_archive(a), whole.rstrip("=")[:-3])["container"] == "zip"
    assert ev(lambda a: indicators.cookie_archive(a), base64.b64encode(b"\x1f\x8b\x08\x00" + b"\x00" * 64).decode())["container"] == "gzip"
    for other in ("CA1344E4C4D800FC", "T000V00000X501241470490271233044007956", "97c1cf19-761-1197186535-2", "", base64.b64encode(b"PK\x03\x04ab").decode(), "PK\x03\x04" + "x" * 64):
        assert ev(lambda a: indicators.cookie_archive(a), other) is None


@pytest.mark.parametrize(
    "target,agent,want",
    [
        ("/a?id=1%27%20UNION%20SELECT%201--%20", "", ["encoded_quote", "sql_comment_terminator", "sqli_union_select"]),
        ("/a?q=O%27Brien", "", []), ("/a?x=1--", "", []), ("/a?id=1+or+1%3D1", "", ["sqli_boolean_tautology"]), ("/x?f=..%252f..%252fetc", "", ["path_traversal"]),
        ("/up/s.php?cmd=id", "", ["webshell_invocation"]), ("/up/s.txt?cmd=id", "", []), ("/s.php", "", []), ("/a?c=a%3Bcat+/etc/passwd", "", ["command_injection"]), ("/", "sqlmap/1.5", ["scanner_user_agent"]),
        ("/select-a-union", "", []), ("/a?s=sleep(5)", "", ["sqli_meta_function"]),
    ],
)
def test_request_indicators(ev, target, agent, want):
    assert ev(lambda a, b: indicators.request_indicators(a, b), target, agent) == want


def test_script_indicators(ev):
    one = lambda s: set(ev(lambda a: indicators.script_indicators(a), s))
    assert one("<?php system($_GET['c']); ?>") == {"php_command_exec", "request_driven_exec"}
    assert one("$f = 'fsockopen';") == {"reverse_shell_socket"}
    assert one("echo 'hello';") == set()
    assert one("Eval(Request(\"x\"))") >= {"php_eval", "asp_eval"}


def test_journal_flags_round_trip(ev):
    assert ev(lambda a: indicators.reason_names(a), 0x101) == ["DATA_OVERWRITE", "FILE_CREATE"]
    assert ev(lambda a: indicators.reason_mask(F.split(a, ",")), "FILE_DELETE,DATA_EXTEND") == 0x202


def test_terms_and_labels(ev):
    assert ev(lambda a, b: indicators.recall_terms(a, b), "T1014", "dropped evil.exe and beaconed to 10.0.0.5, 10.0.0.5") == ["T1014", "evil.exe", "10.0.0.5"]
    assert ev(lambda a, b: indicators.recall_terms(a, b), "", "nothing notable here") == []
    assert ev(lambda a: indicators.extract_cves(a), "cve-2021-44228 CVE-2021-44228 CVE-1-2") == ["CVE-2021-44228"]
    assert ev(lambda a: labels.is_execution_claim(a, F.lit("T1053.005")), "task") and not ev(lambda a: labels.is_execution_claim(a, F.lit("T1014")), "execute_shell mention")
    assert ev(lambda a: labels.claim_id(a), "f-A-x-f-B-") == "x-f-B-"
    assert ev(lambda a: labels.artifact_family(a), "Security.EVTX") == "log" and ev(lambda a: labels.artifact_family(a), "mail") is None


def test_sql_names(spark):
    registry.register_sql(spark)
    assert spark.sql("SELECT tw_percent_decode('a%2527'), tw_tier(0.8D), tw_downgrade('INFERRED'), tw_rot13('Nop'), tw_jaccard(tw_word_tokens('a b'), tw_word_tokens('b'))").first()[:] == ("a'", "CONFIRMED", "HYPOTHESIS", "Abc", 0.5)
    got = spark.sql("SELECT tw_tokens('The evil.exe file'), tw_neutralize('a <|IM_END|> b'), tw_value_match('0x10', '16', 'int'), tw_value_match('10', '010', 'int'), tw_run_entry('HRZR_EHACNGU:P:\\\\n.rkr')").first()
    assert got[:] == (["evil", "exe"], "a [neutralized:im_end] b", True, False, "C:\\a.exe")
    assert quote("é") == "%C3%A9"
