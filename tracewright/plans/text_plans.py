"""Text queries over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import hashing, indicators, labels, paths, text, times, values
from tracewright.operators import joins
from tracewright.plans.catalog import query

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _tokens_sql(expr: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({expr}), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({_STOP})))"


def _words_sql(expr: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({expr}), '[a-z0-9_]+'))"


@query("document_tokens", f"SELECT doc_id, len(t) AS tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents)")
def _(src):
    rows = src.given("documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query(
    "turn_overlap",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {_words_sql('a.text')} AS x, {_words_sql('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
        SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard,
               round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(x) END, 6) AS coverage FROM p""",
)
def _(src):
    rows = src.given("conversations").select("conv_id", "turn", text.word_tokens(F.col("text")).alias("x"))
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    both = rows.join(nxt, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(text.coverage(F.col("x"), F.col("y")), 6).alias("coverage"))


_PLANTED = "concat(text, CASE conv_id % 5 WHEN 0 THEN ' <|im_start|>sys' WHEN 1 THEN ' [INST] go [/inst]' WHEN 2 THEN concat(' <<SY', chr(8203), 'S>> x') ELSE '' END)"


def _planted():
    c = F.col("conv_id") % 5
    tail = F.when(c == 0, " <|im_start|>sys").when(c == 1, " [INST] go [/inst]").when(c == 2, " <<SY\u200bS>> x").otherwise("")
    return F.concat("text", tail)


def _neutral_sql(expr: str) -> str:
    out = f"regexp_replace({expr}, '[\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    for name, token in text.CONTROL_TOKENS:
        quoted = "".join("\\" + ch if ch in "<|>[]/" else ch for ch in token)
        out = f"regexp_replace({out}, '(?i){quoted}', '[neutralized:{name}]', 'g')"
    return out


@query("neutralized_turns", f"SELECT conv_id, turn, md5(n) AS digest, CAST((length(n) - length(replace(n, '[neutralized:', ''))) / 13 AS BIGINT) AS markers FROM (SELECT conv_id, turn, {_neutral_sql(_PLANTED)} AS n FROM conversations)")
def _(src):
    rows = src.given("conversations").select("conv_id", "turn", text.neutralize(_planted()).alias("n"))
    return rows.select("conv_id", "turn", F.md5("n").alias("digest"), F.regexp_count("n", F.lit(r"\[neutralized:")).cast("long").alias("markers"))


@query(
    "neutralized_counts",
    """SELECT pattern, count(*) AS turns FROM (SELECT unnest(CASE conv_id % 5 WHEN 0 THEN ['im_start'] WHEN 1 THEN ['inst_open', 'inst_close'] WHEN 2 THEN ['invisible_unicode', 'sys_open'] ELSE [] END) AS pattern FROM conversations) GROUP BY 1""",
)
def _(src):
    rows = src.given("conversations").select(F.explode(text.neutralize_counts(_planted())).alias("pattern", "n"))
    return rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("turns"))


@query("marked_hypotheses", "SELECT finding_id, case_id, CASE WHEN confidence = 'HYPOTHESIS' AND NOT starts_with(lower(ltrim(description)), 'hypothesis:') THEN md5(concat('hypothesis: ', ltrim(description))) ELSE md5(description) END AS digest FROM findings", uses=("findings",))
def _(src):
    return src.findings.select("finding_id", "case_id", F.md5(text.enforce_prefix(F.col("description"), F.col("confidence"))).alias("digest"))


@query(
    "clipped_texts",
    """WITH c AS (SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE concat(left(text, list_max(list_filter(range(0, 201), lambda n: strlen(left(text, CAST(n AS BIGINT))) <= 200))), '...') END AS t FROM documents)
       SELECT doc_id, strlen(t) AS bytes, md5(t) AS digest FROM c""",
)
def _(src):
    clipped = text.clip_bytes(F.col("text"), 200, "...")
    return src.given("documents").select("doc_id", F.octet_length(clipped).cast("long").alias("bytes"), F.md5(clipped).alias("digest"))


@query(
    "ioc_tokens",
    """WITH t AS (SELECT unnest(regexp_extract_all(text, '[^\\s,;()<>"]+')) AS token FROM documents),
       k AS (SELECT trim(token) AS s FROM t)
       SELECT CASE WHEN regexp_matches(s, '^https?://') THEN 'urls' WHEN regexp_matches(s, '^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$') THEN 'hashes'
              WHEN regexp_matches(s, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN 'ips' ELSE 'domains' END AS kind, count(*) AS tokens FROM k GROUP BY 1""",
)
def _(src):
    tokens = src.given("documents").select(F.explode(F.regexp_extract_all("text", F.lit('([^\\s,;()<>"]+)'), F.lit(1))).alias("token"))
    return tokens.select(values.ioc_kind(F.col("token")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("tokens"))


@query(
    "document_addresses",
    """SELECT doc_id, lower(e) AS email FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}')) AS e FROM documents)""",
)
def _(src):
    found = F.regexp_extract_all("text", F.lit("(" + indicators.EMAIL + ")"), F.lit(1))
    return src.given("documents").select("doc_id", F.explode(F.array_distinct(found)).alias("e")).select("doc_id", F.lower("e").alias("email"))


@query("extracted_iocs", None)
def _(src):
    rows = src.given("documents").select("doc_id", F.explode(indicators.extract_iocs(F.col("text"))).alias("kind", "found"))
    return rows.select("doc_id", "kind", F.explode("found").alias("value"))


@query(
    "page_urls_decoded",
    """SELECT page_id, lower(url) AS decoded FROM pages""",
)
def _(src):
    # Percent-encode every separator twice, then decode: the round trip must give the address back.
    once = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%", "%25"), "/", "%2F"), r"\?", "%3f")
    twice = F.regexp_replace(once, "%", "%25")
    return src.given("pages").select("page_id", text.percent_decode2(twice).alias("decoded"))


@query("page_domains", "SELECT regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '([^.]+\\.[^.]+)$', 1) AS domain, count(*) AS pages FROM pages GROUP BY 1")
def _(src):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return src.given("pages").select(paths.registrable_domain(host).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("pages"))


_PATHS = {
    0: "C:\\Windows\\System32\\winevt\\Logs\\Security.evtx", 1: "/case/Sysmon%4Operational.evtx", 2: "mem/IMAGE.VMEM", 3: "x/capture.pcapng", 4: "zeek/2024/weird.log",
    5: "disk.E01", 6: "C:\\$MFT", 7: "Prefetch\\CAIN.EXE-1.pf", 8: "Amcache.hve", 9: "config/SAM", 10: "$Extend/$UsnJrnl", 11: "SecEvent.Evt", 12: "Recent/a.lnk",
    13: "u.automaticDestinations-ms", 14: "C:\\$Recycle.Bin\\S-1\\$IABC.txt", 15: "History.IE5/index.dat", 16: "Thumbs.db", 17: "Users/a/AppData/Chrome/User Data/Default/History",
    18: "var/log/nginx/access.log.1", 19: "xampp/htdocs/up/shell.php", 20: "tools/run.ps1", 21: "coll.zip", 22: "notes.txt", 23: ".mc/history", 24: "srudb.dat", 25: "site.access",
}
_CLASSES = ("evtx", "sysmon_network", "memory", "pcap", "zeek", "raw_disk", "mft", "prefetch", "amcache", "registry", "usnjrnl", "legacy_evt", "lnk", "jumplist", "recyclebin", "ie_history", "thumbnail",
            "browser_db", "web_log", "webroot_script", "yara_target", "velociraptor", "unknown", "unknown", "srum", "web_log")
_TYPES = ("evtx", "network", "memory", "network", "unknown", "disk", *["unknown"] * 15, "velociraptor", *["unknown"] * 4)


@query(
    "artifact_classes",
    "SELECT artifact_class, evidence_type, count(*) AS files FROM (SELECT CASE p_partkey % 26 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES)) + " END AS artifact_class, CASE p_partkey % 26 "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_TYPES)) + " END AS evidence_type FROM part) GROUP BY 1, 2",
)
def _(src):
    k = F.col("p_partkey") % 26
    path = F.coalesce(*[F.when(k == i, p) for i, p in _PATHS.items()])
    path = F.concat(F.col("p_name"), F.lit("/"), path)
    rows = src.given("part").select(paths.classify_path(path).alias("artifact_class"), paths.detect_evidence_type(path).alias("evidence_type"))
    return rows.groupBy("artifact_class", "evidence_type").agg(F.count(F.lit(1)).alias("files"))


@query(
    "web_paths",
    "SELECT p_partkey, p_partkey % 26 IN (18, 25) AS web_log, p_partkey % 26 = 19 AS webroot_script FROM part",
)
def _(src):
    k = F.col("p_partkey") % 26
    path = F.coalesce(*[F.when(k == i, p) for i, p in _PATHS.items()])
    return src.given("part").select("p_partkey", paths.is_web_log(path).alias("web_log"), paths.is_webroot_script(path).alias("webroot_script"))


@query(
    "execution_claims",
    """SELECT finding_id, case_id, regexp_matches(description, '(?i)\\bexecut(?:ed|ion|ing)\\b|\\bran\\b|\\brun count\\b|\\bprocess creation\\b|\\binvok(?:ed|ation|ing)\\b|\\blaunch(?:ed|ing)\\b|\\bspawn(?:ed|ing)\\b|\\bstarted\\b')
       OR regexp_matches(mitre_technique, '^(T1059|T1106|T1129|T1203|T1543|T1547|T1053)') AS is_claim FROM findings""",
    uses=("findings",),
)
def _(src):
    return src.findings.select("finding_id", "case_id", labels.is_execution_claim(F.col("description"), F.col("mitre_technique")).alias("is_claim"))


@query(
    "anchor_classes",
    """WITH t AS (SELECT doc_id, unnest([md5(text), concat('10.', CAST(doc_id % 256 AS STRING), '.3.4'), concat('f', CAST(doc_id AS STRING), '.exe'), concat('C:\\x\\', lang), '2001:db8::1', lang]) AS token, unnest(['hash', 'v4', 'file', 'path', 'v6', 'word']) AS shape FROM documents)
       SELECT doc_id, token, CASE WHEN shape IN ('path', 'word') THEN 'corroborating' ELSE 'hard' END AS anchor, shape IN ('hash', 'v4', 'v6') AS identity FROM t""",
)
def _(src):
    d = F.col("doc_id")
    tokens = F.array(F.md5("text"), F.concat(F.lit("10."), (d % 256).cast("string"), F.lit(".3.4")), F.concat(F.lit("f"), d.cast("string"), F.lit(".exe")), F.concat(F.lit("C:\\x\\"), "lang"), F.lit("2001:db8::1"), F.col("lang"))
    rows = src.given("documents").select("doc_id", F.explode(tokens).alias("token"))
    mode = F.lit("exact")
    return rows.select("doc_id", "token", values.anchor_class(F.col("token"), mode).alias("anchor"), values.is_identity(F.col("token"), mode).alias("identity"))


@query(
    "confidence_steps",
    """SELECT finding_id, case_id, CASE confidence WHEN 'CONFIRMED' THEN 'INFERRED' WHEN 'INFERRED' THEN 'HYPOTHESIS' ELSE confidence END AS lowered,
       regexp_replace(finding_id, '^f-[ABab]-', '') AS claim, CASE WHEN regexp_matches(lower(concat(artifact_path, ' ', description)), 'disk|filesystem|registry|mft|prefetch|amcache|shimcache|usnjrnl') THEN 'disk'
       WHEN regexp_matches(lower(concat(artifact_path, ' ', description)), 'log|evtx|sysmon|iis|powershell') THEN 'log' WHEN regexp_matches(lower(concat(artifact_path, ' ', description)), 'memory|volatility|vad') THEN 'memory' END AS family,
       CASE WHEN (seq % 100) / 100.0 >= 0.8 THEN 'CONFIRMED' WHEN (seq % 100) / 100.0 >= 0.5 THEN 'INFERRED' ELSE 'HYPOTHESIS' END AS tier FROM findings""",
    uses=("findings",),
)
def _(src):
    f = src.findings
    return f.select(
        "finding_id", "case_id", labels.downgrade(F.col("confidence")).alias("lowered"), labels.claim_id(F.col("finding_id")).alias("claim"),
        labels.artifact_family(F.concat_ws(" ", "artifact_path", "description")).alias("family"), labels.tier_for((F.col("seq") % 100) / 100.0).alias("tier"),
    )


@query("cited_findings", "SELECT finding_id, case_id FROM findings WHERE coalesce(trim(tool_call_id), '') <> ''", uses=("findings",))
def _(src):
    from tracewright.operators.filters import cited

    return cited(src.findings).select("finding_id", "case_id")


@query(
    "forensic_epochs",
    """SELECT event_id, epoch_us(ts) AS webkit_us, epoch_us(ts) AS filetime_us, epoch_us(ts) AS unix_us, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000 AS clf_us, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000 AS w3c_us,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM events""",
)
def _(src):
    us = F.unix_micros("ts")
    e = src.given("events")
    clf = F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000"))
    return e.select(
        "event_id",
        F.unix_micros(times.webkit_ts(us + times.SECONDS_1601_TO_1970 * 1_000_000)).alias("webkit_us"),
        F.unix_micros(times.filetime_ts(us * 10 + times.TICKS_1601_TO_1970)).alias("filetime_us"),
        F.unix_micros(times.micros_ts(us)).alias("unix_us"),
        F.unix_micros(times.clf_ts(clf)).alias("clf_us"),
        F.unix_micros(times.w3c_ts(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"))).alias("w3c_us"),
        times.iso_micros(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("iso"),
    )


@query("mail_dates", "SELECT o_orderkey, epoch_us(o_orderdate) + 25200000000 AS transport_us, epoch_us(o_orderdate) AS stored_us FROM orders")
def _(src):
    transport = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" -0700 (PDT)"))
    stored = F.concat(F.date_format("o_orderdate", "MMM d, yyyy HH:mm:ss"), F.lit(".828125000 UTC"))
    return src.given("orders").select("o_orderkey", F.unix_micros(times.mail_instant(transport)).alias("transport_us"), F.unix_micros(times.mail_instant(stored)).alias("stored_us"))


@query("canonical_props", "SELECT event_id, sha256(concat('{\"event\":\"', event_type, '\",\"k\":', regexp_extract(props, '\"k\": ([0-9]+)', 1), '}')) AS digest FROM events")
def _(src):
    doc = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(', "event": "'), "event_type", F.lit('" }'))
    return src.given("events").select("event_id", hashing.sha256_hex(hashing.canonical_json(doc)).alias("digest"))


@query(
    "journal_reasons",
    """SELECT o_orderkey, list_count(list_filter([1,2,4,16,32,64,256,512,1024,2048,4096,8192,16384,32768,65536], lambda b: (o_orderkey % 131072) & b <> 0)) AS flags,
       list_sum(list_filter([0,1,2,4,16,32,64,256,512,1024,2048,4096,8192,16384,32768,65536], lambda b: (o_orderkey % 131072) & b <> 0 OR b = 0))::BIGINT AS known_mask FROM orders""",
)
def _(src):
    names = indicators.reason_names(F.col("o_orderkey") % 131072)
    return src.given("orders").select("o_orderkey", F.size(names).cast("long").alias("flags"), indicators.reason_mask(names).alias("known_mask"))


@query(
    "run_entry_names",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('C:\\Tools\\', replace(p_name, ' ', '_'), '.exe') WHEN 1 THEN concat('C:\\Windows\\System32\\', replace(p_name, ' ', '_'), '.exe') WHEN 2 THEN concat('D:\\', replace(p_name, ' ', '_'), '.exe') END AS program_path FROM part""",
)
def _(src):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".exe"))
    k = F.col("p_partkey") % 4
    plain = (
        F.when(k == 0, F.concat(F.lit("UEME_RUNPATH:C:\\Tools\\"), name))
        .when(k == 1, F.concat(F.lit("{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}\\"), name))
        .when(k == 2, F.concat(F.lit("D:\\"), name))
        .otherwise("UEME_CTLSESSION")
    )
    return src.given("part").select("p_partkey", paths.run_entry_path(paths.rot13(plain)).alias("program_path"))


@query(
    "relative_paths",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN concat('cases/', s_name) ELSE concat('/evidence/', s_name) END AS path, concat('h', CAST(s_nationkey AS STRING)) AS host FROM supplier""",
)
def _(src):
    even = F.col("s_suppkey") % 2 == 0
    path = F.when(even, F.concat(F.lit("/home/ir/cases/"), "s_name")).otherwise(F.concat(F.lit("/evidence/"), "s_name"))
    label = F.concat(F.when(even, "mem:").otherwise("disk:"), F.lit("h"), F.col("s_nationkey").cast("string"))
    return src.given("supplier").select("s_suppkey", paths.relative_path(path, F.lit("/home/ir/")).alias("path"), paths.host_of_label(label).alias("host"))


@query(
    "recall_terms",
    """SELECT finding_id, case_id, array_to_string(list_filter([mitre_technique, concat('f', CAST(seq % 9 AS STRING), '.exe'), '10.0.0.5'], lambda x: x <> ''), ' ') AS terms FROM findings""",
    uses=("findings",),
)
def _(src):
    # The planted names stand alone, so the finding's own prose adds no term of its own.
    said = F.concat(F.lit("dropped f"), (F.col("seq") % 9).cast("string"), F.lit(".exe and beaconed to 10.0.0.5 then 10.0.0.5"))
    return src.findings.select("finding_id", "case_id", F.array_join(indicators.recall_terms(F.col("mitre_technique"), said), " ").alias("terms"))


@query(
    "cve_mentions",
    """, f AS (SELECT case_id, finding_id, unnest(CASE seq % 3 WHEN 0 THEN ['CVE-2021-44228', 'CVE-2017-0144'] WHEN 1 THEN ['CVE-2020-1472'] ELSE [] END) AS cve_id FROM findings)
       SELECT case_id, cve_id, count(DISTINCT finding_id) AS findings, CASE WHEN cve_id = 'CVE-2020-1472' THEN NULL ELSE 'CRITICAL' END AS severity, CASE WHEN cve_id = 'CVE-2020-1472' THEN 'unsupported' ELSE 'supported' END AS status FROM f GROUP BY 1, 2""",
    uses=("findings",),
)
def _(src):
    k = F.col("seq") % 3
    tail = F.when(k == 0, " see cve-2021-44228, CVE-2017-0144 and CVE-2021-44228.").when(k == 1, " (CVE-2020-1472)").otherwise("")
    findings = src.findings.withColumn("description", F.concat("description", tail))
    nvd = src.spark.sql("SELECT * FROM VALUES ('CVE-2021-44228', 'CRITICAL'), ('CVE-2017-0144', 'CRITICAL') AS t(cve_id, severity)")
    return joins.ground_cves(findings, nvd)


@query(
    "signature_profiles",
    """SELECT finding_id, case_id, CASE WHEN regexp_matches(description, '(?i)amcache') THEN 'program catalogue entry' END AS signature, CASE WHEN regexp_matches(description, '(?i)amcache') THEN 'T1204' END AS signature_technique FROM findings""",
    uses=("findings",),
)
def _(src):
    return joins.apply_signatures(src.findings).select("finding_id", "case_id", "signature", "signature_technique")


@query("cookie_archives", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'zip' END AS container, CASE WHEN doc_id % 2 = 0 THEN 'notes.txt' END AS member FROM documents")
def _(src):
    # Each document's own bytes behind an archive header, as a cookie would carry them.
    zip_head = F.unhex(F.lit("504B0304" + "00" * 22 + "09000000" + "6E6F7465732E747874"))
    value = F.base64(F.concat(zip_head, F.encode("text", "UTF-8")))
    value = F.regexp_replace(F.when(F.col("doc_id") % 2 == 0, value).otherwise(F.base64(F.encode("text", "UTF-8"))), r"\s", "")
    hit = indicators.cookie_archive(value)
    return src.given("documents").select("doc_id", hit["container"].alias("container"), hit["member"].alias("member"))


@query("printable_strings", "SELECT doc_id, length(text) - length(replace(text, ' ', '')) > 0 AS has_blank, len(regexp_extract_all(regexp_replace(text, '[^\\x20-\\x7e]', chr(10), 'g'), '[\\x20-\\x7e]{6,}')) AS strings FROM documents")
def _(src):
    found = indicators.printable_strings(F.encode("text", "UTF-8"), 6)
    return src.given("documents").select("doc_id", F.col("text").contains(" ").alias("has_blank"), F.size(found).cast("long").alias("strings"))
