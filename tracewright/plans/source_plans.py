"""Reader queries: Spark writes a given table in an evidence format to the shared folder, the reader reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.plans.catalog import query
from tracewright.session import shared_folder
from tracewright.sources import readers


def _folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/source-{uuid.uuid4().hex}"


def as_lines(df: DataFrame, line: Column) -> str:
    path = _folder(df)
    df.select(line.alias("value")).write.text(path)
    return path


def with_head(df: DataFrame, head: str, line: Column) -> str:
    """Text files that each start with a head line, written by all tasks."""
    path = _folder(df)
    plain = {"sep": "\u0001", "quote": "\u0000", "escape": "\u0002", "comment": "\u0003"}
    df.select(line.alias(head)).write.options(header=True, **plain).csv(path)
    return path


def text_of(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def n(col: str) -> Column:
    return F.col(col).cast("string")


@query("read_event_log", "SELECT event_id AS record_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id + 4000 END AS event_id, event_type AS channel, epoch_us(ts) AS us FROM events")
def _(src):
    e = src.given("events")
    eid = F.when(F.col("event_type") == "click", text_of('"', (F.col("user_id") + 4000).cast("string"), '"')).when(F.col("event_type") == "view", text_of('{"#text":', (F.col("user_id") + 4000).cast("string"), "}")).when(F.col("event_type") == "error", '"none"').otherwise((F.col("user_id") + 4000).cast("string"))
    line = text_of('{"Event":{"System":{"EventID":', eid, ',"Channel":"', F.col("event_type"), '","EventRecordID":', n("event_id"), ',"TimeCreated":{"#attributes":{"SystemTime":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '7Z"}}}}}')
    out = readers.read_event_log(src.spark, as_lines(e, line))
    return out.select("record_id", "event_id", "channel", F.unix_micros("ts").alias("us"))


@query("read_json_lines", "SELECT event_type <> 'error' AS parsed, count(*) AS records FROM events GROUP BY 1")
def _(src):
    line = F.when(F.col("event_type") == "error", "{broken").otherwise(F.col("props"))
    return readers.read_json_container(src.spark, as_lines(src.given("events"), line), lines=True).groupBy("parsed").agg(F.count(F.lit(1)).alias("records"))


@query(
    "read_json_documents",
    """SELECT event_id, event_type AS kind, user_id AS item FROM events WHERE event_type <> 'error'
       UNION ALL SELECT event_id, event_type, 1000 FROM events WHERE event_type NOT IN ('error', 'click', 'view')
       UNION ALL SELECT NULL, NULL, count(*) FROM events WHERE event_type = 'error'""",
)
def _(src):
    # One layout per kind: an array, a wrapper (whose other list is no container), pages of a second key, and broken values between.
    e = src.given("events")
    record = lambda item: text_of('{"event_id":', n("event_id"), ',"kind":"', F.col("event_type"), '","item":', item, ',"note":"}] {\\""}')
    one, two = record(n("user_id")), record(F.lit("1000"))
    line = (
        F.when(F.col("event_type") == "error", '{"event_id": none}')
        .when(F.col("event_type") == "click", text_of("[", one, "]"))
        .when(F.col("event_type") == "view", one)
        .otherwise(text_of('{"other":[0],"items":[7],"Records":[', one, ",", two, "]}"))
    )
    rows = readers.read_json_documents(src.spark, as_lines(e, line))
    v = lambda name, kind: F.try_variant_get(F.try_parse_json("raw"), "$." + name, kind)
    good = rows.where("parsed").select(v("event_id", "long").alias("event_id"), v("kind", "string").alias("kind"), v("item", "long").alias("item"))
    bad = rows.where("NOT parsed").agg(F.count(F.lit(1)).alias("item")).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("kind"), "item")
    return good.unionByName(bad)


@query("read_m365_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS operation, o_orderpriority AS priority FROM orders")
def _(src):
    o = src.given("orders")
    path = _folder(o)
    inner = F.to_json(F.struct(F.col("o_orderstatus").alias("Operation"), n("o_orderkey").alias("Id")))
    o.select(F.lit("FromColumn").alias("Operation"), F.col("o_orderpriority").alias("Priority"), inner.alias("AuditData")).write.option("header", True).option("escape", '"').csv(path)
    raw = readers.read_m365_csv(src.spark, path)
    return raw.select(*[F.get_json_object("raw", "$." + k).alias(a) for k, a in (("Id", "id"), ("Operation", "operation"), ("Priority", "priority"))])


@query("read_vpc_flow", "SELECT concat('10.0.0.', CAST(l_suppkey AS VARCHAR)) AS srcaddr, count(*) AS flows FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def _(src):
    full = F.concat_ws(" ", F.lit("2"), n("l_orderkey"), F.lit("eni-1"), text_of("10.0.0.", n("l_suppkey")), F.lit("10.1.1.1 1 2 6 3 4 5 6 ACCEPT OK"))
    line = F.when(F.col("l_returnflag") == "N", "2 1 eni short").otherwise(full)
    return readers.read_vpc_flow(src.spark, as_lines(src.given("lineitem"), line)).groupBy("srcaddr").agg(F.count(F.lit(1)).alias("flows"))


@query("read_access_log", "SELECT page_id, url AS target, CASE WHEN length(url) % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, 1704067200000000 + page_id * 1000000 AS us FROM pages")
def _(src):
    p = src.given("pages")
    stamp = F.date_format(F.timestamp_micros(F.lit(1704067200000000) + F.col("page_id") * 1000000), "dd/MMM/yyyy:HH:mm:ss")
    line = text_of("10.0.0.1 - u [", stamp, ' +0000] "', F.when(F.length("url") % 2 == 0, "GET").otherwise("POST"), " ", F.col("url"), ' HTTP/1.1" 200 12 "-" "agent ', n("page_id"), '"')
    out = readers.read_access_log(src.spark, as_lines(p, line)).where("parsed")
    return out.select(F.regexp_extract("user_agent", r"(\d+)$", 1).cast("long").alias("page_id"), "target", "method", F.unix_micros("ts").alias("us"))


@query("read_w3c_log", "SELECT event_id, concat('/', event_type, '?id=', CAST(event_id AS VARCHAR)) AS target, epoch_us(date_trunc('second', ts)) AS us, concat('A ', event_type) AS user_agent FROM events")
def _(src):
    e = src.given("events")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("1.2.3.4 GET"), text_of("/", F.col("event_type")), text_of("id=", n("event_id")), F.lit("200"), text_of("A+", F.col("event_type")))
    path = with_head(e, "#Fields: date time c-ip cs-method cs-uri-stem cs-uri-query sc-status cs(User-Agent)", line)
    out = readers.read_w3c_log(src.spark, path)
    return out.select(F.regexp_extract("target", r"id=(\d+)", 1).cast("long").alias("event_id"), "target", F.unix_micros("ts").alias("us"), "user_agent")


# Each file's later half comes under other headers with the same number of fields: address and method change places.
@query(
    "read_w3c_changing_headers",
    "SELECT 'e' || event_id AS target, CASE WHEN event_type = 'error' THEN '10.1.1.1' ELSE '10.0.0.' || (user_id % 250) END AS client_ip, CASE WHEN event_type = 'view' THEN 'POST' ELSE 'GET' END AS method FROM events",
)
def _(src):
    e = src.given("events")
    stem = text_of("e", n("event_id"))
    ip = F.when(F.col("event_type") == "error", "10.1.1.1").otherwise(text_of("10.0.0.", (F.col("user_id") % 250).cast("string")))
    verb = F.when(F.col("event_type") == "view", "POST").otherwise("GET")
    first = F.concat_ws("\n", F.lit("#Fields: c-ip cs-method cs-uri-stem"), F.concat_ws(" ", ip, verb, stem))
    other = F.concat_ws("\n", F.lit("#Fields: cs-method c-ip cs-uri-stem"), F.concat_ws(" ", verb, ip, stem))
    # Some rows stand under the header that an earlier row has brought, which is one of their own kind.
    kinds = e.select(F.when(F.col("event_id") % 2 == 0, first).otherwise(other).alias("value"))
    path = _folder(e)
    kinds.write.text(path)
    return readers.read_w3c_log(src.spark, path).select("target", "client_ip", "method")


@query("read_linux_audit", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, concat('u', CAST(user_id AS VARCHAR)) AS uid FROM events")
def _(src):
    line = text_of("type=", F.col("event_type"), " msg=audit(1:", n("event_id"), "): uid=x id=", n("event_id"), " uid=u", n("user_id"))
    out = readers.read_linux_audit(src.spark, as_lines(src.given("events"), line))
    return out.select(F.col("fields")["id"].alias("id"), F.col("fields")["type"].alias("kind"), F.col("fields")["uid"].alias("uid"))


@query("read_logins", "SELECT concat('u', CAST(event_id AS VARCHAR)) AS user, CASE WHEN event_type = 'view' THEN '' ELSE concat('10.0.0.', CAST(user_id AS VARCHAR)) END AS host, CASE WHEN event_type = 'error' THEN NULL ELSE 'Mon Jan 1 11:00:00 2024' END AS logout FROM events")
def _(src):
    kind = F.col("event_type")
    host = F.when(kind == "view", "").otherwise(text_of(" 10.0.0.", n("user_id")))
    tail = F.when(kind == "error", "still logged in").otherwise("- Mon Jan 1 11:00:00 2024 (01:00)")
    line = text_of("u", n("event_id"), " pts/0", host, " Mon Jan 1 10:00:00 2024 ", tail)
    return readers.read_logins(src.spark, as_lines(src.given("events"), line)).select("user", "host", "logout")


@query("read_alerts", "SELECT event_id, event_type AS rule, CASE WHEN value > 50 THEN 'high' END AS level, regexp_extract(props, '\"k\": ([0-9]+)', 1) AS k FROM events")
def _(src):
    e = src.given("events")
    level = F.when(F.col("value") > 50, F.lit('"Level":"high",')).otherwise("")
    rule = F.when(F.col("user_id") > 50, text_of('"RuleTitle":"', F.col("event_type"), '",')).otherwise(text_of('"rule":"', F.col("event_type"), '",'))
    line = text_of("{", level, rule, '"EventID":', n("event_id"), ",", F.substr("props", F.lit(2)))
    return readers.read_alerts(src.spark, as_lines(e, line)).select("event_id", "rule", "level", F.col("details")["k"].alias("k"))


@query("read_journal", "SELECT event_type AS message, count(*) AS rows FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE value > 50) GROUP BY 1")
def _(src):
    one = text_of('{"MESSAGE":"', F.col("event_type"), '"}')
    line = F.when(F.col("value") > 50, text_of("[", one, ",", one, "]")).otherwise(one)
    return readers.read_journal(src.spark, as_lines(src.given("events"), line)).groupBy("message").agg(F.count(F.lit(1)).alias("rows"))


@query("read_eve", "SELECT event_type, epoch_us(date_trunc('second', ts)) AS us, concat('10.0.0.', CAST(user_id AS VARCHAR)) AS src_ip FROM events")
def _(src):
    line = text_of('{"event_type":"', F.col("event_type"), '","timestamp":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), '+00:00","src_ip":"10.0.0.', n("user_id"), '"}')
    return readers.read_eve(src.spark, as_lines(src.given("events"), line)).select("event_type", F.unix_micros("ts").alias("us"), "src_ip")


@query("read_netflow", "SELECT CAST(l_suppkey AS VARCHAR) AS src, count(*) AS flows FROM lineitem GROUP BY 1")
def _(src):
    line = F.to_json(F.struct(n("l_suppkey").alias("src4_addr"), F.col("l_quantity").alias("in_packets")))
    return readers.read_netflow(src.spark, as_lines(src.given("lineitem"), line)).groupBy(F.col("row")["src4_addr"].alias("src")).agg(F.count(F.lit(1)).alias("flows"))


@query("read_decoded_csv", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, 'amcache' AS tool FROM part")
def _(src):
    p = src.given("part")
    path = _folder(p)
    p.select(n("p_partkey").alias("Record Id"), F.col("p_name").alias("Program Name")).write.option("header", True).csv(path)
    out = readers.read_decoded_csv(src.spark, path, "amcache")
    return out.select(F.col("row")["Record Id"].alias("id"), F.col("row")["Program Name"].alias("name"), "tool")


@query("read_super_timeline", "SELECT concat('/evidence/', CAST(event_id AS VARCHAR)) AS filename, event_type AS parser, epoch_us(ts) AS us FROM events")
def _(src):
    line = text_of('{"timestamp":', F.unix_micros("ts").cast("string"), ',"parser":"', F.col("event_type"), '","filename":"/tmp/run-7/', n("event_id"), '"}')
    return readers.read_super_timeline(src.spark, as_lines(src.given("events"), line), "/tmp/run-7").select("filename", "parser", F.unix_micros("ts").alias("us"))


@query("read_audit", "SELECT event_id AS seq, event_type AS kind, concat('tc-', CAST(user_id AS VARCHAR)) AS tool_call_id FROM events")
def _(src):
    line = text_of('{"kind":"', F.col("event_type"), '","payload":{"tool_call_id":"tc-', n("user_id"), '"},"prev_hash":"","seq":', n("event_id"), "}")
    return readers.read_audit(src.spark, as_lines(src.given("events"), line)).select("seq", "kind", "tool_call_id")


@query("read_fleet_results", "SELECT c_name AS host, CASE WHEN c_acctbal > 0 THEN 'ok' ELSE 'failed' END AS status FROM customer")
def _(src):
    line = F.to_json(F.struct(text_of("mem:", F.col("c_name")).alias("label"), F.when(F.col("c_acctbal") > 0, n("c_custkey")).alias("case_id")))
    return readers.read_fleet_results(src.spark, as_lines(src.given("customer"), line)).select("host", "status")


@query("normalized_browser", """SELECT url, browser_family, count(*) AS n, max(us) AS us FROM (SELECT url, 'chromium' AS browser_family, page_id * 1000 + 1 AS us FROM pages UNION ALL SELECT url, 'firefox', page_id * 2000 + 1 FROM pages UNION ALL SELECT url, 'firefox', CASE WHEN length(html) > 1000 THEN page_id * 3000 + 2 END FROM pages) GROUP BY 1, 2""")
def _(src):
    p = src.given("pages").select("url", F.col("html").alias("title"), F.col("page_id"), F.length("html").alias("len"))
    urls = p.select("url", "title", (F.col("page_id") * 1000 + 1 + F.lit(11644473600 * 1000000)).alias("last_visit_time"), F.lit(1).alias("visit_count"))
    places = p.select("url", "title", (F.col("page_id") * 2000 + 1).alias("last_visit_date"), F.lit(1).alias("visit_count"))
    old = p.select(F.col("page_id").alias("id"), "url", "title", F.lit(1).alias("visit_count"))
    visits = p.where("len > 1000").select(F.col("page_id").alias("place_id"), F.explode(F.array(F.col("page_id") * 3000 + 2, F.col("page_id") * 3000 + 1)).alias("visit_date"))
    out = readers.normalize_browser(urls, places, old, visits)
    return out.groupBy("url", "browser_family").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("last_visit")).alias("us"))


@query("line_numbers", "SELECT count(*) AS lines, TRUE AS dense, TRUE AS in_order FROM events")
def _(src):
    e = src.given("events")
    path = _folder(e)
    e.repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select(n("event_id").alias("value")).write.text(path)
    lines = src.spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    numbered = readers.with_line_numbers(lines).withColumn("seq", F.col("line").cast("long"))
    # Each file holds a run of ids, so a line's number is its distance from the first id of the file.
    per = numbered.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"), F.min("seq").alias("lo"), F.min(F.col("seq") - F.col("line_no")).alias("a"), F.max(F.col("seq") - F.col("line_no")).alias("b"))
    return per.agg(F.sum("n").alias("lines"), F.bool_and(F.col("last") + 1 == F.col("n")).alias("dense"), F.bool_and((F.col("a") == F.col("lo")) & (F.col("b") == F.col("lo"))).alias("in_order"))


@query("read_zeek", "SELECT event_type <> 'error' AS parsed, CASE WHEN event_type <> 'error' THEN event_type END AS service, count(*) AS rows FROM events GROUP BY 1, 2")
def _(src):
    tab = F.lit("\t")
    line = F.when(F.col("event_type") == "error", "short").otherwise(F.concat(n("event_id"), tab, text_of("10.0.0.", n("user_id")), tab, F.col("event_type")))
    path = with_head(src.given("events"), "#fields\tts\tid.orig_h\tservice", line)
    out = readers.read_zeek(src.spark, path)
    return out.groupBy("parsed", F.col("row")["service"].alias("service")).agg(F.count(F.lit(1)).alias("rows"))


@query("evidence_inventory")
def _(src):
    """Path, size and digest of the folder's files."""
    return readers.inventory(src.spark, src.folder)
