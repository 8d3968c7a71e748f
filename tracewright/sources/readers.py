"""Readers: decoded evidence files to typed tables.

Everything is read by Spark in splits; line-oriented formats are never loaded whole. Where a line's meaning depends on
the latest header before it in the file, headers are carried down each split and over split borders.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import times
from tracewright.operators.filters import cloud_envelope
from tracewright.session import broadcast_if_small
from tracewright.sources.json_values import read_values

# Names of the first flow-log tokens.
FLOW_FIELDS = ("version", "account_id", "interface_id", "srcaddr", "dstaddr", "srcport", "dstport", "protocol", "packets", "bytes", "start", "end", "action", "log_status")
# Alert column spellings.
ALERT_KEYS = {
    "timestamp": ("Timestamp", "timestamp", "datetime", "DateTime"),
    "rule": ("RuleTitle", "rule_title", "Rule", "rule", "title"),
    "level": ("Level", "level", "severity"),
    "channel": ("Channel", "channel"),
    "event_id": ("EventID", "event_id", "EventId", "eid"),
    "computer": ("Computer", "computer", "hostname"),
}
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and byte-order position inside a split."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, first byte of the split they are read in, and a number that grows along the split."""
    meta = F.col("_metadata")
    return spark.read.text(path).select(F.col("value").alias("line"), meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"))


def _carried_down(batches):
    """Each line's `head`: its own, or that of the nearest line before it in its split. Lines come split by split and in order."""
    place, head = None, None
    for rows in batches:
        if rows.empty:
            continue
        first = (rows["file"].iat[0], rows["split"].iat[0])
        heads = rows["head"].astype(object)
        if first == place and pd.isna(heads.iat[0]):
            heads.iat[0] = head
        heads = heads.groupby([rows["file"], rows["split"]], sort=False).ffill()
        # Lines without any header stay text: missing values alone would become a column of numbers, which is no text for Arrow.
        rows["head"] = pd.Series([None if pd.isna(h) else h for h in heads], index=rows.index, dtype=object)
        place, head = (rows["file"].iat[-1], rows["split"].iat[-1]), rows["head"].iat[-1]
        yield rows[["file", "split", "line", "head", "is_head"]]


def _under_headers(lines: DataFrame, header: Column) -> DataFrame:
    """Lines that are no headers, with `head`, the latest header line before each in its file (null: none), in this or an earlier split.

    One pass finds the last header of each split and puts them in order along the file: a row per split. Inside a split every line gets
    its header on the way, however often headers change; lines before the first one meet the header that an earlier split has left.
    """
    marked = lines.withColumn("is_head", F.coalesce(header, F.lit(False)))
    last = marked.groupBy("file", "split").agg(F.max_by("line", F.when(F.col("is_head"), F.col("at"))).alias("head"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    left = last.select("file", "split", F.last("head", ignorenulls=True).over(before).alias("left_head")).where("left_head IS NOT NULL")
    own = marked.select("file", "split", "line", F.when(F.col("is_head"), F.col("line")).alias("head"), "is_head")
    placed = own.mapInPandas(_carried_down, "file string, split long, line string, head string, is_head boolean").where("NOT is_head")
    return placed.join(broadcast_if_small(left), ["file", "split"], "left").select("file", "line", F.coalesce("head", "left_head").alias("head"))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Event records as JSON lines; the event id may be a number, text or an object with '#text'."""
    v = F.try_parse_json("line")
    rows = _lines(spark, path).where(F.trim("line") != "").withColumn("v", v)

    def first(*paths: str, kind: str = "string") -> Column:
        return F.coalesce(*[F.try_variant_get("v", p, kind) for p in paths])

    eid = F.coalesce(*[first(p).try_cast("long") for p in ("$.Event.System.EventID['#text']", "$.Event.System.EventID", "$.event_id", "$.EventID")])
    return rows.select(
        "file", eid.alias("event_id"),
        times.iso_ts(first("$.Event.System.TimeCreated['#attributes'].SystemTime", "$.Event.System.TimeCreated['@SystemTime']", "$.ts", "$.timestamp")).alias("ts"),
        first("$.Event.System.Channel", "$.channel").alias("channel"),
        first("$.Event.System.EventRecordID", "$.record_id").try_cast("long").alias("record_id"),
        F.col("line").alias("raw"), F.col("v").isNotNull().alias("parsed"),
    )


def read_json_lines(spark: SparkSession, path: str, name: str = "raw") -> DataFrame:
    """One record per line, kept as text with a parsed flag; blank lines are dropped."""
    rows = _lines(spark, path).where(F.trim("line") != "")
    return rows.select("file", F.col("line").alias(name), F.try_parse_json("line").isNotNull().alias("parsed"))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Records of arrays, wrapper objects and values one behind another, told by content; bad ones are rows that are not parsed.

    One record is held at a time. Line-delimited exports go through read_json_lines, which splits.
    """
    return read_values(spark, path)


def read_json_container(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Records of either form as (file, raw, parsed)."""
    return read_json_lines(spark, path) if lines else read_json_documents(spark, path)


def read_cloud(spark: SparkSession, path: str, provider: str, lines: bool) -> DataFrame:
    """Cloud audit records with their envelope columns."""
    return cloud_envelope(read_json_container(spark, path, lines).where("parsed"), provider)


def read_m365_csv(spark: SparkSession, path: str) -> DataFrame:
    """Audit CSV whose AuditData column is JSON; the other columns fill only keys it lacks."""
    rows = spark.read.option("header", True).option("multiLine", False).option("escape", '"').csv(path)
    inner = F.from_json("AuditData", "map<string,string>")
    outer = F.map_filter(F.create_map(*[x for c in rows.columns if c != "AuditData" for x in (F.lit(c), F.col(f"`{c}`"))]), lambda k, v: v.isNotNull())
    known = F.coalesce(inner, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    fill = F.map_filter(outer, lambda k, v: ~F.array_contains(F.map_keys(known), k))
    return rows.select(F.to_json(F.map_concat(known, fill)).alias("raw"), inner.isNotNull().alias("parsed"))


def read_vpc_flow(spark: SparkSession, path: str) -> DataFrame:
    """Flow lines of at least fourteen tokens, named; the header is skipped."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = _lines(spark, path).withColumn("p", parts).where((F.size("p") >= len(FLOW_FIELDS)) & (F.col("p")[0] != "version"))
    return rows.select("file", *[F.col("p")[i].alias(n) for i, n in enumerate(FLOW_FIELDS)])


def read_zeek(spark: SparkSession, path: str) -> DataFrame:
    """TSV logs as a string map per row, named by the latest '#fields' line before it; short rows are parse errors."""
    rows = _under_headers(_placed_lines(spark, path), F.col("line").startswith("#fields"))
    fields = F.filter(F.split(F.substr("head", F.lit(8)), "\t"), lambda f: f != "")
    data = rows.where(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumns({"fields": fields, "vals": F.split("line", "\t")})
    ok = F.col("fields").isNotNull() & (F.size("vals") >= F.size("fields"))
    name = F.lower(F.substring_index("file", "/", -1))
    return data.select(
        "file", F.regexp_extract(name, r"^(conn|dns|http|ssl|tls)\.log$", 1).alias("log_kind"), ok.alias("parsed"),
        F.when(ok, F.map_from_arrays("fields", F.slice("vals", F.lit(1), F.size("fields")))).alias("row"),
    )


COMBINED = r'^\s*([^\s\[]+)[^\[]*\[([^\]]*)\][^"]*"\s*([A-Za-z]+)(?=[\s"])\s*([^\s"]*)[^"]*"\s*([^\s"]*)[^"]*(?:"[^"]*"[^"]*"([^"]*)")?'


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Common and combined access logs; lines that do not fit are parse errors."""
    part = lambda i: F.regexp_extract("line", COMBINED, i)
    rows = _lines(spark, path).where(F.trim("line") != "")
    return rows.select("file", F.col("line").rlike(COMBINED).alias("parsed"), part(1).alias("client_ip"), part(2).alias("timestamp"), times.clf_ts(part(2)).alias("ts"), part(3).alias("method"), part(4).alias("target"), part(5).alias("status"), part(6).alias("user_agent"))


def read_w3c_log(spark: SparkSession, path: str) -> DataFrame:
    """W3C extended logs; the latest '#Fields:' line before a line names its values. A wrong number of values is a parse error."""
    rows = _under_headers(_placed_lines(spark, path), F.col("line").startswith("#Fields:"))
    fields = F.split(F.lower(F.trim(F.substr("head", F.lit(9)))), r"\s+")
    data = rows.where(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumns({"fields": fields, "vals": F.split(F.trim("line"), r"\s+")})
    row = F.map_from_arrays("fields", "vals")
    joined = data.withColumn("row", F.when(F.size("fields") == F.size("vals"), row))
    get = lambda k: F.nullif(F.col("row")[k], F.lit("-"))
    target = F.when(get("cs-uri-query").isNotNull(), F.concat(get("cs-uri-stem"), F.lit("?"), get("cs-uri-query"))).otherwise(get("cs-uri-stem"))
    return joined.select(
        "file", F.col("row").isNotNull().alias("parsed"), get("c-ip").alias("client_ip"), F.concat_ws(" ", get("date"), get("time")).alias("timestamp"),
        times.w3c_ts(get("date"), get("time")).alias("ts"), get("cs-method").alias("method"), target.alias("target"), get("sc-status").alias("status"), F.replace(get("cs(user-agent)"), F.lit("+"), F.lit(" ")).alias("user_agent"),
    )


def read_eve(spark: SparkSession, path: str) -> DataFrame:
    """Intrusion-detection events as JSON lines."""
    rows = read_json_lines(spark, path)
    return rows.select("*", F.get_json_object("raw", "$.event_type").alias("event_type"), times.iso_ts(F.get_json_object("raw", "$.timestamp")).alias("ts"), F.get_json_object("raw", "$.src_ip").alias("src_ip"), F.get_json_object("raw", "$.dest_ip").alias("dest_ip"))


def read_alerts(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Rule alerts from JSON lines, an array, or concatenated objects; spellings are projected, the rest goes to details."""
    from tracewright.operators.filters import project_first

    if lines:
        rows = read_json_lines(spark, path).where("parsed").select("file", "raw")
    else:
        rows = read_values(spark, path, keys=()).where("parsed").select("file", "raw")
    out = project_first(rows, "raw", ALERT_KEYS)
    return out.withColumn("event_id", F.col("event_id").try_cast("long")).withColumn("timestamp", times.iso_micros(F.col("timestamp")))


def read_netflow(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path).where("parsed").withColumn("row", F.from_json("raw", "map<string,string>"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """System journal rows from JSON lines; a line holding an array gives one row per element."""
    rows = _lines(spark, path).where(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))
    each = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    out = rows.select("file", F.explode(each).alias("r")).select("file", F.to_json("r").alias("raw"))
    at = F.get_json_object("raw", "$.__REALTIME_TIMESTAMP").try_cast("long")
    return out.select("*", times.micros_ts(at).alias("ts"), F.get_json_object("raw", "$._HOSTNAME").alias("host"), F.get_json_object("raw", "$.MESSAGE").alias("message"))


def read_linux_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit lines as key/value maps plus the raw line; separators are skipped, the last of equal keys is kept."""
    rows = _lines(spark, path).where((F.trim("line") != "") & ~F.col("line").rlike("^-+$"))
    words = F.filter(F.split(F.trim("line"), r"\s+"), lambda w: F.instr(w, "=") > 1)
    pairs = F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.substr(w, F.instr(w, "=") + 1).alias("v")))
    # A map takes each key once, so a pair is dropped when its key comes again further on.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return rows.select("file", F.col("line").alias("raw"), F.map_from_entries(last).alias("fields"))


def read_logins(spark: SparkSession, path: str) -> DataFrame:
    """Session table text: user, line, host up to the first weekday, login and logout stamps of five tokens."""
    tokens = F.split(F.trim("line"), r"\s+")
    rows = _lines(spark, path).where(~F.trim("line").rlike("^$|^[wb]tmp begins")).withColumn("t", tokens)
    days = F.transform("t", lambda x: F.when(x.isin(*WEEKDAYS), "day").otherwise(""))
    rows = rows.withColumn("days", days).withColumn("d", F.array_position("days", "day").cast("int"))
    left = F.greatest(F.size("t") - F.col("d") - 4, F.lit(0))
    again = F.array_position(F.slice("days", F.col("d") + 5, left), "day").cast("int")
    rows = rows.withColumn("e", F.when((F.col("d") > 0) & (again > 0), F.col("d") + 4 + again))

    def stamp(at: str) -> Column:
        return F.when((F.col(at) > 0) & (F.size("t") >= F.col(at) + 4), F.array_join(F.slice("t", F.col(at), F.lit(5)), " "))

    host = F.when(F.col("d") > 3, F.array_join(F.slice("t", F.lit(3), F.col("d") - 3), " ")).otherwise("")
    return rows.select("file", F.col("t")[0].alias("user"), F.coalesce(F.get("t", F.lit(1)), F.lit("")).alias("line"), host.alias("host"), stamp("d").alias("login"), stamp("e").alias("logout"), F.col("line").alias("raw"))


def normalize_browser(urls: DataFrame | None = None, places: DataFrame | None = None, old_places: DataFrame | None = None, visits: DataFrame | None = None) -> DataFrame:
    """Chromium, Firefox and old Firefox histories as one row shape; the old shape takes its last visit from the visit table."""
    parts = []
    if urls is not None:
        parts.append(urls.select("url", "title", times.webkit_ts(F.col("last_visit_time")).alias("last_visit"), F.col("visit_count").cast("long").alias("visit_count"), F.lit("chromium").alias("browser_family")))
    if places is not None:
        parts.append(places.select("url", "title", times.micros_ts(F.col("last_visit_date")).alias("last_visit"), F.col("visit_count").cast("long").alias("visit_count"), F.lit("firefox").alias("browser_family")))
    if old_places is not None:
        last = visits.groupBy(F.col("place_id").alias("id")).agg(F.max("visit_date").alias("visit_date"))
        parts.append(old_places.join(last, "id", "left").select("url", "title", times.micros_ts(F.col("visit_date")).alias("last_visit"), F.col("visit_count").cast("long").alias("visit_count"), F.lit("firefox").alias("browser_family")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


FLEET_FINDING = "struct<finding_id:string,tool_call_id:string,artifact_path:string,confidence:string,mitre_technique:string,description:string,verifier_action:string,replay_matched:boolean>"
FLEET_SCHEMA = f"case_id string, verdict string, findings array<{FLEET_FINDING}>, cryptographic_attestation struct<merkle_root_hex:string>"


def read_fleet(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per-host run documents under folder/<host>/: (hosts with outcome, findings, process scan rows).

    A document that does not parse is left out.
    """
    host = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("host")
    docs = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(FLEET_SCHEMA + ", _bad string").json(f"{folder}/*/verdict.json")
    docs = docs.select("*", host).where("_bad IS NULL")
    hosts = docs.select("host", "case_id", F.coalesce("verdict", F.lit("?")).alias("outcome"), F.col("cryptographic_attestation.merkle_root_hex").alias("merkle_root"))
    findings = docs.select("host", "case_id", F.explode("findings").alias("f")).select("host", "case_id", "f.*")
    scans = spark.read.text(f"{folder}/*/psscan.json", wholetext=True).select(F.col("value").alias("doc"), host)
    each = scans.select("host", F.explode(F.try_variant_get(F.try_parse_json("doc"), "$", "array<variant>")).alias("r"))
    get = lambda *keys: F.coalesce(*[F.try_variant_get("r", "$." + k, "string") for k in keys])
    procs = each.select("host", get("image_name", "ImageFileName", "name").alias("image_name"), get("pid", "PID").try_cast("long").alias("pid"), get("ppid", "PPID").try_cast("long").alias("ppid"), times.iso_ts(get("create_time_iso", "CreateTime", "create_time")).alias("created"))
    return hosts, findings, procs.withColumn("us", F.unix_micros("created"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Run-log lines with the record fields. Lines carry their own sequence number, which is their position in an intact log."""
    rows = _lines(spark, path).where(F.trim("line") != "")
    get = lambda p: F.get_json_object("line", p)
    return rows.select(
        "file", "line", get("$.seq").try_cast("long").alias("seq"), get("$.ts").alias("ts"), get("$.kind").alias("kind"), get("$.prev_hash").alias("prev_hash"), get("$.payload").alias("payload"),
        get("$.payload.tool_call_id").alias("tool_call_id"), get("$.payload.finding_id").alias("finding_id"), get("$.payload.output_hash").alias("output_hash"), get("$.payload.confidence").alias("confidence"), get("$.payload.action").alias("action"),
    )


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Line numbers in file order, from the read order of each file's splits.

    monotonically_increasing_id rises with the split and the row inside it, and splits of a file are read in order
    of their offset, so it orders the lines of one file; numbers are then made gap-free per file.
    """
    from tracewright.operators.ordered import dense_index

    marked = lines.withColumn("__at", F.monotonically_increasing_id())
    return dense_index(marked, ["file"], ["__at"], F.shiftright("__at", 16), "line_no").drop("__at")


def _digest(batches):
    for pdf in batches:
        out = []
        for path in pdf["path"]:
            # Any scheme Arrow can open: local, HDFS or object storage.
            system, inner = fs.FileSystem.from_uri(path)
            h = hashlib.sha256()
            with system.open_input_stream(inner) as handle:
                while chunk := handle.read(1 << 22):
                    h.update(chunk)
            out.append(h.hexdigest())
        yield pdf.assign(sha256=out)


# Files up to this size are hashed from their loaded content, larger ones in chunks.
WHOLE_FILE_BYTES = 256 << 20


def inventory(spark: SparkSession, folder: str, whole: int = WHOLE_FILE_BYTES) -> DataFrame:
    """Path, size and SHA-256 of every file; no file is left without a digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    small = files.where(F.col("length") <= whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select("path", F.col("length").alias("size")).repartition("path")
    return small.unionByName(large.mapInPandas(_digest, "path string, size long, sha256 string"))


def read_decoded_csv(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """Rows of a decoder's CSV as string maps, tagged with the tool."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    pairs = F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))])
    return rows.select(F.lit(tool).alias("tool"), F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("row"))


def read_super_timeline(spark: SparkSession, path: str, temp_prefix: str | None = None, stable_prefix: str = "/evidence") -> DataFrame:
    """Super-timeline events as JSON lines; the decoder's temporary folder is replaced by a stable one."""
    rows = read_json_lines(spark, path)
    if temp_prefix:
        rows = rows.withColumn("raw", F.replace("raw", F.lit(temp_prefix), F.lit(stable_prefix)))
    at = F.get_json_object("raw", "$.timestamp").try_cast("long")
    return rows.where("parsed").select("file", "raw", times.micros_ts(at).alias("ts"), F.get_json_object("raw", "$.data_type").alias("data_type"), F.get_json_object("raw", "$.parser").alias("parser"), F.get_json_object("raw", "$.filename").alias("filename"))


def read_fleet_results(spark: SparkSession, path: str) -> DataFrame:
    """Fleet result lines; a host is ok when a case came out of it."""
    rows = spark.read.schema("label string, host string, case_id string, case_dir string, error string").json(path)
    name = F.coalesce("host", F.regexp_replace("label", "^(mem|disk|xart):", ""))
    ok = (F.coalesce("case_id", "case_dir", F.lit("")) != "")
    return rows.select(name.alias("host"), "case_id", F.when(ok, "ok").otherwise("failed").alias("status"), "error")

