"""Web, network, cloud and mail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import indicators, text
from tracewright.operators import aggregates, detect_web, filters, joins, topk
from tracewright.plans.catalog import query

_PORT = "CASE WHEN tcp_port <> '' THEN tcp_port ELSE udp_port END"


@query("conversations", f"SELECT src, dst, {_PORT} AS dst_port, proto, count(*) AS packets FROM packets GROUP BY 1, 2, 3, 4", uses=("packets",))
def _(src):
    return aggregates.conversations(src.packets)


@query(
    "top_conversations",
    f"SELECT pkt_no % 4 AS case_id, src, dst, {_PORT} AS dst_port, proto, count(*) AS packets FROM packets GROUP BY 1, 2, 3, 4, 5 QUALIFY row_number() OVER (PARTITION BY pkt_no % 4 ORDER BY count(*) DESC, src, dst, {_PORT}, proto) <= 50",
    uses=("packets",),
)
def _(src):
    return topk.top_conversations(aggregates.conversations(_in_cases(src.packets), ("case_id",)), keys=("case_id",))


def _in_cases(packets):
    return packets.withColumn("case_id", F.col("pkt_no") % 4)


_HTTP = """, h AS (SELECT src, dst, http_host AS host, http_method AS method, arg_min(http_uri, struct_pack(a := pkt_no, b := http_uri)) AS uri, bool_or(cookie <> '') AS has_cookie, count(*) AS requests,
       min(CASE WHEN ts > 0 THEN ts END) AS first_ts, max(CASE WHEN ts > 0 THEN ts END) AS last_ts FROM packets WHERE http_method <> '' GROUP BY 1, 2, 3, 4)"""


@query("http_requests", _HTTP + " SELECT * FROM h", uses=("packets",))
def _(src):
    return aggregates.http_requests(src.packets)


_CASE_HTTP = _HTTP.replace("SELECT src, dst", "SELECT pkt_no % 4 AS case_id, src, dst").replace("GROUP BY 1, 2, 3, 4", "GROUP BY 1, 2, 3, 4, 5")


@query("top_requests", _CASE_HTTP + " SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY has_cookie DESC, CASE WHEN method = 'POST' THEN 0 ELSE 1 END, requests DESC, host, src, dst, method) <= 300", uses=("packets",))
def _(src):
    return topk.top_requests(aggregates.http_requests(_in_cases(src.packets), ("case_id",)), keys=("case_id",))


@query(
    "top_cookies",
    """, c AS (SELECT DISTINCT src, dst, trim(split_part(trim(p), '=', 1)) AS name, CASE WHEN contains(p, '=') THEN trim(split_part(trim(p), '=', 2)) ELSE '' END AS value
         FROM (SELECT src, dst, unnest(string_split(cookie, ';')) AS p FROM packets WHERE cookie <> '') WHERE trim(p) <> ''),
       r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY strlen(value) DESC, name DESC, value DESC) AS rank FROM c)
       SELECT * FROM r WHERE rank <= 8""",
    uses=("packets",),
)
def cookies_of_requests(src):
    each = src.packets.where("cookie <> ''").select("src", "dst", F.explode(text.cookie_pairs(F.col("cookie"), None, None)).alias("c")).select("src", "dst", "c.name", "c.value")
    return topk.top_cookies(each, ["src", "dst"]).withColumn("rank", F.col("rank").cast("long"))


@query(
    "multiplexed_destinations",
    """SELECT dst, count(DISTINCT concat(split_part(http_host, '.', -2), '.', split_part(http_host, '.', -1))) AS domains, count(*) AS requests FROM packets WHERE http_host <> ''
       GROUP BY 1 HAVING count(DISTINCT concat(split_part(http_host, '.', -2), '.', split_part(http_host, '.', -1))) >= 5""",
    uses=("packets",),
)
def _(src):
    return aggregates.multiplexed(src.packets.withColumnRenamed("http_host", "host"))


@query(
    "page_multiplexing",
    """, p AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, concat('net', CAST(length(url) % 7 AS STRING)) AS dst FROM pages)
       SELECT dst, count(DISTINCT concat(split_part(lower(host), '.', -2), '.', split_part(lower(host), '.', -1))) AS domains, count(*) AS requests FROM p GROUP BY 1
       HAVING count(DISTINCT concat(split_part(lower(host), '.', -2), '.', split_part(lower(host), '.', -1))) >= 2""".replace(", p AS", "WITH p AS", 1),
)
def _(src):
    rows = src.given("pages").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.concat(F.lit("net"), (F.length("url") % 7).cast("string")).alias("dst"))
    return aggregates.multiplexed(rows, least=2)


@query(
    "covert_cookies",
    """, m AS (SELECT dst, count(DISTINCT concat(split_part(http_host, '.', -2), '.', split_part(http_host, '.', -1))) AS domains FROM packets WHERE http_host <> '' GROUP BY 1 HAVING count(DISTINCT concat(split_part(http_host, '.', -2), '.', split_part(http_host, '.', -1))) >= 5)
       SELECT p.pkt_no, p.dst, 'zip' AS container, CASE WHEN p.tcp_port = '81' THEN 'x/c$/a' ELSE 'notes.txt' END AS member, m.domains, 'CONFIRMED' AS confidence, p.tcp_port = '81' AS from_admin_share
       FROM packets p JOIN m ON p.dst = m.dst WHERE http_method = 'POST' AND http_host <> ''""",
    uses=("packets",),
)
def _(src):
    pk = src.packets.withColumnRenamed("http_host", "host")
    share = F.unhex(F.lit("504B0304" + "00" * 22 + "06000000" + "782F63242F61" + "00" * 8))
    plain = F.unhex(F.lit("504B0304" + "00" * 22 + "09000000" + "6E6F7465732E747874" + "00" * 8))
    value = F.when(F.col("http_method") == "POST", F.base64(F.when(F.col("tcp_port") == "81", share).otherwise(plain))).otherwise("97c1cf19-761-1197186535-2")
    cookies = pk.where("host <> ''").select("pkt_no", "dst", value.alias("value"))
    return detect_web.covert_cookies(cookies, pk).drop("value")


@query(
    "anonymous_mail",
    """, r AS (SELECT pkt_no, http_method AS method, CASE WHEN src LIKE '10.1.1.%' THEN 'www.WillSelfDestruct.com' WHEN src LIKE '10.1.2.%' THEN 'willselfdestruct.com.example' ELSE http_host END AS host FROM packets WHERE http_host <> '')
       SELECT pkt_no, host, method, CASE WHEN method = 'POST' THEN 'CONFIRMED' ELSE 'HYPOTHESIS' END AS confidence FROM r WHERE host = 'www.WillSelfDestruct.com'""",
    uses=("packets",),
)
def _(src):
    host = F.when(F.col("src").startswith("10.1.1."), "www.WillSelfDestruct.com").when(F.col("src").startswith("10.1.2."), "willselfdestruct.com.example").otherwise(F.col("http_host"))
    rows = src.packets.where("http_host <> ''").select("pkt_no", F.col("http_method").alias("method"), host.alias("host"))
    return detect_web.anonymous_mail(rows)


@query(
    "zeek_counts",
    "SELECT count(*) AS rows_seen, count(*) FILTER (WHERE log_kind = 'conn') AS conn_count, count(*) FILTER (WHERE log_kind = 'dns') AS dns_count, count(*) FILTER (WHERE log_kind = 'http') AS http_count, count(*) FILTER (WHERE log_kind IN ('ssl', 'tls')) AS tls_count FROM zeek",
    uses=("zeek",),
)
def _(src):
    return aggregates.zeek_counts(src.zeek)


@query(
    "zeek_top_hosts",
    """, h AS (SELECT orig_h AS value FROM zeek WHERE log_kind = 'conn' UNION ALL SELECT resp_h FROM zeek WHERE log_kind = 'conn' UNION ALL SELECT server_name FROM zeek WHERE log_kind IN ('ssl', 'tls'))
       SELECT value, count(*) AS count FROM h WHERE value <> '' AND value <> '-' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    uses=("zeek",),
)
def _(src):
    return aggregates.zeek_top_hosts(src.zeek)


@query("zeek_top_queries", "SELECT query AS value, count(*) AS count FROM zeek WHERE log_kind = 'dns' AND query <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", uses=("zeek",))
def _(src):
    return aggregates.zeek_top_queries(src.zeek)


# The same for each host that connects or asks.
@query(
    "zeek_top_hosts_by_host",
    """, h AS (SELECT orig_h AS host, orig_h AS value FROM zeek WHERE log_kind = 'conn' UNION ALL SELECT orig_h, resp_h FROM zeek WHERE log_kind = 'conn' UNION ALL SELECT orig_h, server_name FROM zeek WHERE log_kind IN ('ssl', 'tls'))
       SELECT host, value, count(*) AS count FROM h WHERE value <> '' AND value <> '-' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, value) <= 10""",
    uses=("zeek",),
)
def _(src):
    return aggregates.zeek_top_hosts(src.zeek.withColumn("host", F.col("orig_h")), keys=("host",))


@query("zeek_top_queries_by_host", "SELECT orig_h AS host, query AS value, count(*) AS count FROM zeek WHERE log_kind = 'dns' AND query <> '' AND query <> '-' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY orig_h ORDER BY count(*) DESC, query) <= 10", uses=("zeek",))
def _(src):
    return aggregates.zeek_top_queries(src.zeek.withColumn("host", F.col("orig_h")), keys=("host",))


_INDICATORS = """, x AS (SELECT *, CASE page_id % 10 WHEN 0 THEN ['encoded_quote', 'sql_comment_terminator', 'sqli_information_schema', 'sqli_union_select'] WHEN 2 THEN ['path_traversal']
         WHEN 3 THEN ['command_injection'] WHEN 4 THEN ['sqli_boolean_tautology'] ELSE [] END AS base FROM requests r JOIN (SELECT page_id FROM pages) p ON r.line_number = p.page_id),
       y AS (SELECT line_number, client_ip, list_sort(list_concat(list_concat(base, CASE WHEN page_id % 12 = 7 THEN ['scanner_user_agent'] ELSE [] END), CASE WHEN page_id % 10 = 1 AND page_id % 12 = 7 THEN ['encoded_quote'] ELSE [] END)) AS hits FROM x)"""


@query("web_exploits", _INDICATORS + " SELECT line_number, client_ip, array_to_string(hits, ',') AS indicators, 'T1190' AS technique FROM y WHERE len(hits) > 0", uses=("requests",))
def _(src):
    return detect_web.web_exploits(src.requests).select("line_number", "client_ip", F.array_join("indicators", ",").alias("indicators"), "technique")


@query(
    "web_summary",
    _INDICATORS + """, e AS (SELECT 'indicator' AS kind, unnest(hits) AS value FROM y UNION ALL SELECT 'client', client_ip FROM y WHERE len(hits) > 0) SELECT kind, value, count(*) AS hits FROM e GROUP BY 1, 2""",
    uses=("requests",),
)
def _(src):
    return aggregates.web_summary(src.requests)


_SCRIPT = """, s AS (SELECT path, lower(line) AS l FROM lines),
  t AS (SELECT path, contains(l, 'system(') OR contains(l, 'shell_exec(') OR contains(l, 'passthru(') OR contains(l, 'popen(') OR contains(l, 'proc_open(') OR contains(l, 'exec(') AS ce,
      contains(l, 'eval(') OR contains(l, 'assert(') OR contains(l, 'create_function(') OR contains(l, 'preg_replace') AS ev,
      contains(l, 'base64_decode(') OR contains(l, 'gzinflate(') OR contains(l, 'gzuncompress(') OR contains(l, 'str_rot13(') OR contains(l, 'hex2bin(') AS od,
      contains(l, 'fsockopen') OR contains(l, 'stream_socket_client') OR contains(l, 'socket_create') OR contains(l, 'socket_connect') AS rs,
      contains(l, 'error_reporting(0)') OR contains(l, '@eval(') OR contains(l, '@system(') OR contains(l, '@shell_exec(') AS es,
      contains(l, 'process.start(') OR contains(l, 'wscript.shell') OR contains(l, 'cmd.exe /c') OR contains(l, 'runtime.getruntime().exec') AS dp,
      contains(l, 'eval(request') OR contains(l, 'execute(request') OR contains(l, 'executeglobal(') AS ae,
      contains(l, 'move_uploaded_file(') OR contains(l, 'file_put_contents(') AS fu,
      contains(l, '$_get') AS input FROM s),
  u AS (SELECT *, input AND (ce OR ev) AS rd FROM t),
  v AS (SELECT path, sum(CAST(ce AS INT) + CAST(ev AS INT) + CAST(od AS INT) + CAST(rs AS INT) + CAST(es AS INT) + CAST(dp AS INT) + CAST(ae AS INT) + CAST(fu AS INT) + CAST(rd AS INT))::BIGINT AS indicator_hits,
      bool_or(ce) AS ce, bool_or(ev) AS ev, bool_or(od) AS od, bool_or(rs) AS rs, bool_or(es) AS es, bool_or(dp) AS dp, bool_or(ae) AS ae, bool_or(fu) AS fu, bool_or(rd) AS rd FROM u GROUP BY 1),
  w AS (SELECT *, rd OR dp OR ae OR ((ev OR ce) AND (od OR rs OR es)) AS probable_webshell FROM v)"""


@query("script_summary", _SCRIPT + " SELECT path, indicator_hits, ce AS php_command_exec, ev AS php_eval, od AS obfuscated_decode, fu AS file_upload_primitive, rd AS request_driven_exec, probable_webshell FROM w", uses=("lines",))
def _(src):
    cols = ("php_command_exec", "php_eval", "obfuscated_decode", "file_upload_primitive", "request_driven_exec", "probable_webshell")
    return aggregates.script_summary(src.lines).select("path", F.col("indicator_hits").cast("long").alias("indicator_hits"), *cols)


@query("webshells", _SCRIPT + " SELECT path, indicator_hits, FALSE AS writable_location, 'T1505.003' AS technique FROM w WHERE probable_webshell", uses=("lines",))
def _(src):
    return detect_web.webshells(src.lines).select("path", F.col("indicator_hits").cast("long").alias("indicator_hits"), "writable_location", "technique")


@query("script_indicator_counts", _SCRIPT + ", c AS (SELECT unnest([CASE WHEN ce THEN 'php_command_exec' END, CASE WHEN ev THEN 'php_eval' END, CASE WHEN od THEN 'obfuscated_decode' END, CASE WHEN fu THEN 'file_upload_primitive' END, CASE WHEN rd THEN 'request_driven_exec' END]) AS indicator FROM u) SELECT indicator, count(*) AS hits FROM c WHERE indicator IS NOT NULL GROUP BY 1", uses=("lines",))
def _(src):
    each = src.lines.select(F.explode(indicators.script_indicators(F.col("line"))).alias("indicator"))
    return topk.rank_counts(each.groupBy("indicator").agg(F.count(F.lit(1)).alias("hits")), "hits", "indicator")


@query(
    "cloud_envelopes",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN event_type = 'view' THEN concat('u', CAST(user_id AS STRING)) ELSE concat('arn:', CAST(user_id AS STRING)) END AS actor,
       CASE WHEN event_type <> 'click' THEN concat('10.0.0.', CAST(user_id % 200 AS STRING)) END AS source_ip, event_type AS action, 's3' AS resource, CASE WHEN event_type = 'error' THEN CAST(user_id AS STRING) END AS outcome FROM events""",
)
def _(src):
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    actor = F.when(kind == "view", F.concat(F.lit('{"arn":"","userName":"u'), user, F.lit('"}'))).otherwise(F.concat(F.lit('{"arn":"arn:'), user, F.lit('"}')))
    ip = F.when(kind == "click", F.lit('{"nested":1}')).otherwise(F.concat(F.lit('"10.0.0.'), (F.col("user_id") % 200).cast("string"), F.lit('"')))
    code = F.when(kind == "error", F.concat(F.lit(',"errorCode":'), user)).otherwise(F.lit(',"errorCode":true'))
    doc = F.concat(
        F.lit('{"eventTime":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('","userIdentity":'), actor, F.lit(',"sourceIPAddress":'), ip,
        F.lit(',"eventName":"'), kind, F.lit('","eventSource":"s3"'), code, F.lit("}"),
    )
    return filters.cloud_envelope(src.given("events").select("event_id", doc.alias("raw")), "cloudtrail").drop("raw")


@query(
    "illicit_consents",
    """SELECT event_id, concat('u', CAST(user_id AS STRING), '@corp.example') AS actor, CASE WHEN event_type = 'signup' THEN 'Mail.Read offline_access' ELSE 'openid Files.ReadWrite.All' END AS scopes, 'oauth_consent' AS kind FROM events WHERE event_type IN ('signup', 'purchase')""",
)
def _(src):
    kind = F.col("event_type")
    scope = F.when(kind == "signup", "Mail.Read offline_access").when(kind == "purchase", "openid Files.ReadWrite.All").otherwise("openid profile email")
    raw = F.concat(F.lit('{"additionalDetails":[{"key":"ConsentAction","value":"Allowed"},{"key":"Scope","value":"'), scope, F.lit('"}]}'))
    action = F.when(kind == "view", "Sign-in activity").otherwise("Consent to application")
    rows = src.given("events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@corp.example")).alias("actor"), action.alias("action"), raw.alias("raw"))
    return detect_web.illicit_consents(rows).drop("action", "raw")


@query(
    "forwarding_rules",
    """SELECT event_id, concat('u', CAST(user_id AS STRING), '@corp.example') AS actor, CASE WHEN event_type = 'error' THEN 'out@gmail.com' ELSE 'exfil@proton.me' END AS external_target, 'inbox_rule' AS kind FROM events WHERE event_type IN ('error', 'click')""",
)
def _(src):
    kind = F.col("event_type")
    params = (
        F.when(kind == "error", '[{"Name":"ForwardTo","Value":"out@gmail.com"}]')
        .when(kind == "click", '[{"Name":"ForwardingSmtpAddress","Value":"smtp:exfil@proton.me"}]')
        .when(kind == "view", '[{"Name":"ForwardTo","Value":"mate@corp.example"}]')
        .otherwise('[{"Name":"DeleteMessage","Value":"True"}]')
    )
    action = F.when(kind == "click", "Set-Mailbox").otherwise("New-InboxRule")
    raw = F.concat(F.lit('{"Parameters":'), params, F.lit("}"))
    rows = src.given("events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@corp.example")).alias("actor"), action.alias("action"), raw.alias("raw"))
    return detect_web.forwarding_rules(rows).drop("action", "raw")


_DOM = "CASE WHEN contains({0}, '@') THEN concat(split_part(split_part(lower({0}), '@', -1), '.', -2), '.', split_part(split_part(lower({0}), '@', -1), '.', -1)) END"
_INSIDE = f""", a AS (SELECT case_id, {_DOM.format('from_address')} AS d FROM mail UNION ALL SELECT case_id, {_DOM.format('to_address')} FROM mail),
  n AS (SELECT case_id, d AS domain, count(*) AS addresses FROM a WHERE d IS NOT NULL GROUP BY 1, 2), inside AS (SELECT * FROM n QUALIFY rank() OVER (PARTITION BY case_id ORDER BY addresses DESC) = 1)"""


def _internal(mail):
    return aggregates.internal_domains(mail.withColumn("to", F.array("to_address")))


@query("internal_domains", _INSIDE + " SELECT * FROM inside", uses=("mail",))
def _(src):
    return _internal(src.mail)


_DIVERGING = f""", v AS (
  SELECT msg_id, 'reply_to_vs_from' AS basis, from_address AS displayed, reply_to_address AS actual FROM mail WHERE reply_to_address <> '' AND {_DOM.format('reply_to_address')} <> {_DOM.format('from_address')}
  UNION ALL SELECT msg_id, 'sender_display_vs_from', from_display, from_address FROM mail WHERE contains(from_display, '@') AND from_display <> from_address AND {_DOM.format('from_display')} <> {_DOM.format('from_address')})"""


@query("reply_divergence", _DIVERGING + " SELECT * FROM v", uses=("mail",))
def _(src):
    return detect_web.reply_divergence(src.mail).select("msg_id", "basis", "displayed", "actual")


@query(
    "impersonation",
    _INSIDE + f""", m AS (SELECT *, {_DOM.format('from_address')} AS fd, CASE WHEN reply_to_address <> '' THEN {_DOM.format('reply_to_address')} END AS rd, {_DOM.format('from_display')} AS sd FROM mail),
       t AS (SELECT m.*, EXISTS (SELECT 1 FROM inside i WHERE i.case_id = m.case_id AND i.domain = fd) AS fi, EXISTS (SELECT 1 FROM inside i WHERE i.case_id = m.case_id AND i.domain = rd) AS ri, EXISTS (SELECT 1 FROM inside i WHERE i.case_id = m.case_id AND i.domain = sd) AS si FROM m),
       k AS (SELECT DISTINCT case_id, lower(from_display) AS nm FROM t WHERE fi AND from_display <> '' AND NOT contains(from_display, '@')),
       b AS (SELECT t.msg_id, CASE WHEN NOT fi AND si THEN 'internal_display_address_external_sender' WHEN NOT fi AND k.nm IS NOT NULL THEN 'internal_display_name_external_sender'
              WHEN fi AND rd IS NOT NULL AND NOT ri THEN 'internal_sender_external_reply_to' END AS basis FROM t LEFT JOIN k ON t.case_id = k.case_id AND lower(t.from_display) = k.nm)
       SELECT * FROM b WHERE basis IS NOT NULL""",
    uses=("mail",),
)
def _(src):
    return detect_web.impersonation(src.mail, _internal(src.mail)).select("msg_id", "basis")


@query(
    "spreadsheet_egress",
    _INSIDE + f""" SELECT msg_id, attachment, to_address FROM mail m WHERE attachment = 'roster.xls' AND EXISTS (SELECT 1 FROM inside i WHERE i.case_id = m.case_id AND i.domain = {_DOM.format('from_address')})
       AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.case_id = m.case_id AND i.domain = {_DOM.format('to_address')})""",
    uses=("mail",),
)
def _(src):
    return detect_web.spreadsheet_egress(src.mail, _internal(src.mail)).select("msg_id", "attachment", "to_address")


@query(
    "reply_to_spoof",
    """, l AS (SELECT case_id, lower(from_display) AS address, lower(subject) AS topic, min(us) AS lure_us, count(DISTINCT from_address) AS actual_senders, min(from_address) AS first_sender FROM mail
         WHERE contains(from_display, '@') AND lower(from_display) <> from_address GROUP BY 1, 2, 3)
       SELECT m.case_id, msg_id, attachment, address AS displayed, actual_senders, first_sender FROM mail m JOIN l ON m.case_id = l.case_id AND m.to_address = l.address AND lower(m.subject) = l.topic WHERE attachment = 'roster.xls' AND us > lure_us""",
    uses=("mail",),
)
def _(src):
    return joins.reply_to_spoof(src.mail)


_EXCHANGE = _INSIDE + f""", m AS (SELECT *, lower(from_display) AS sh, lower(subject) AS topic FROM mail),
  t AS (SELECT m.*, EXISTS (SELECT 1 FROM inside i WHERE i.case_id = m.case_id AND i.domain = {_DOM.format('from_address')}) AS fi, EXISTS (SELECT 1 FROM inside i WHERE i.case_id = m.case_id AND i.domain = {_DOM.format('to_address')}) AS ti FROM m),
  l AS (SELECT case_id, sh AS address, topic, arg_min(from_address, us) AS lured, min(us) AS lu FROM t WHERE NOT fi AND contains(sh, '@') AND sh <> from_address GROUP BY 1, 2, 3),
  x AS (SELECT t.*, CASE WHEN NOT fi THEN from_address WHEN NOT ti THEN to_address WHEN us > lu THEN lured END AS counterparty, NOT fi AS inbound, NOT fi AND contains(sh, '@') AND sh <> from_address AS diverging
        FROM t LEFT JOIN l ON t.case_id = l.case_id AND t.to_address = l.address AND t.topic = l.topic),
  g AS (SELECT case_id, counterparty, count(*) AS message_count, count(*) FILTER (WHERE inbound) AS inbound_count, count(*) FILTER (WHERE NOT inbound) AS outbound_count, count(*) FILTER (WHERE diverging) AS diverging_count,
        count(*) FILTER (WHERE NOT inbound AND attachment <> '') AS outbound_attachments, count(DISTINCT subject) AS subjects, min(us) AS first_us, max(us) AS last_us FROM x WHERE counterparty IS NOT NULL GROUP BY 1, 2)"""


@query("mail_escalation", _EXCHANGE + " SELECT * FROM g WHERE message_count >= 2 AND ((inbound_count > 0 AND outbound_count > 0) OR diverging_count > 0)", uses=("mail",))
def _(src):
    mail = src.mail
    # A lure tie in time is broken by address, as the check does.
    return detect_web.mail_escalation(detect_web.mail_exchanges(mail, _internal(mail)), instant=F.col("us"))
