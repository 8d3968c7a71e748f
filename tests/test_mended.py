"""Null keys, undated rows, several cases, bad records and overlapping regions, for the operators that once lost or mixed them."""

import json

from pyspark.sql import functions as F

from tracewright.functions import values
from tracewright.operators import aggregates, custody, joins, ordered, topk
from tracewright.plans import catalog, traffic_plans
from tracewright.sources import readers


def test_positions_keep_null_keys_and_undated_rows(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), ("a", 1), (None, 2), (None, None)], "k string, t long")
    got = ordered.dense_index(df, ["k"], [F.col("t").asc_nulls_last()], F.floor(F.col("t") / 3), "i").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", 1, 0), ("a", 5, 1), ("a", None, 2), (None, 2, 0), (None, None, 1)], key=repr)
    lagged = ordered.previous_values(df, ["k"], ["t"], ["t"], F.floor(F.col("t") / 3)).where("k IS NULL AND t = 2").first()
    assert lagged["prev_t"] is None


def test_chain_keeps_lines_without_number(spark):
    df = spark.createDataFrame([("c", 1, "x"), ("c", None, "y"), (None, 1, "z")], "case_id string, line_no long, line string")
    got = {r["line"]: r["position"] for r in custody.chain_state(df).collect()}
    assert got == {"x": 0, "y": 1, "z": 0}


def test_limits_hold_for_each_key(spark):
    conv = spark.createDataFrame([(c, "s", f"d{i}", "80", "tcp", i) for c in ("a", "b") for i in range(4)], "case_id string, src string, dst string, dst_port string, proto string, packets long")
    assert {(r["case_id"], r["packets"]) for r in topk.top_conversations(conv, 2, ["case_id"]).collect()} == {(c, p) for c in "ab" for p in (2, 3)}
    cut = topk.capped(conv, [F.desc("packets")], 3, ["case_id"]).collect()
    assert len(cut) == 6 and {(r["total"], r["truncated"]) for r in cut} == {(4, True)}
    visits = spark.createDataFrame([("h1", 1, "u"), ("h1", None, "v"), ("h2", 2, "w")], "host string, us long, url string")
    assert {r["url"] for r in topk.recent_history(visits, 1, keys=["host"]).collect()} == {"u", "w"}
    counts = aggregates.value_counts(visits, F.col("url"), 1, ["host"]).collect()
    assert {(r["host"], r["value"]) for r in counts} == {("h1", "u"), ("h2", "w")}


def test_whole_numbers_of_every_base(spark):
    texts = ["-0x10", "0b101", "0o17", "1_000", "0x1F", "+7", "0", "007", "1__0", "_1", "0x", "12a", "", None, "-0", "0_0"]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(values.to_int(F.col("t")).alias("v")).collect()]
    assert [None if v is None else int(v) for v in got] == [-16, 5, 15, 1000, 31, 7, 0, None, None, None, None, None, None, None, 0, 0]


def test_every_region_of_a_match(spark):
    regions = spark.createDataFrame([("h", 1, 0, 100), ("h", 1, 10, 50), ("h", 1, 90, 400), ("h", 2, 0, 9)], "host string, pid long, vad_start long, vad_end long")
    matches = spark.createDataFrame([("h", 1, 20, "r"), ("h", 1, 399, "r"), ("h", 1, 400, "r"), ("h", 2, 9, "r")], "host string, pid long, offset long, rule_name string")
    got = joins.regions_with_matches(regions, matches, block=64).select("pid", "offset", "vad_start").collect()
    assert sorted(map(tuple, got)) == [(1, 20, 0), (1, 20, 10), (1, 399, 90)]


def test_alerts_after_a_bad_object(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"rule": "a"}) + "\n{bad\n" + json.dumps({"rule": "b"}) + "\n" + json.dumps({"rule": "c"}))
    assert readers.read_alerts(spark, str(tmp_path), lines=False).count() >= 3


def test_findings_without_artifact_contradict(spark):
    rows = [("c", "f1", "A", "call", None, "CONFIRMED", "T1001", "one"), ("c", "f2", "B", "call", None, "CONFIRMED", "T1002", "two")]
    df = spark.createDataFrame(rows, "case_id string, finding_id string, pool_origin string, tool_call_id string, artifact_path string, confidence string, mitre_technique string, description string")
    got = joins.contradictions(df).collect()
    assert [(r["finding_id"], r["other_technique"]) for r in got] == [("f1", 1)]


def test_long_addresses_and_cookies_stay_whole(spark):
    start = "z" * 300
    packets = spark.createDataFrame([(1, f"/login?{start}", f"id={start}1"), (2, "/later", f"id={start}22; {start}=x"), (3, "", f"id={start}1")], "pkt_no long, http_uri string, cookie string")
    packets = packets.selectExpr("*", "'s' AS src", "'d' AS dst", "'h' AS http_host", "'GET' AS http_method", "0.0 AS ts")
    assert aggregates.http_requests(packets).first()["uri"] == f"/login?{start}"
    source = catalog.Source(spark, "")
    source.packets = packets
    rows = traffic_plans.cookies_of_requests(source).orderBy("rank").collect()
    assert [(r["name"], r["value"]) for r in rows] == [("id", f"{start}22"), ("id", f"{start}1"), (start, "x")]


def test_top_queries_of_each_key(spark):
    rows = spark.createDataFrame([("a", "dns", "x"), ("a", "dns", "x"), ("a", "dns", "y"), ("b", "dns", "y"), ("b", "conn", "z"), ("b", "dns", "")], "case_id string, log_kind string, query string")
    assert {(r["case_id"], r["value"], r["count"]) for r in aggregates.zeek_top_queries(rows, 1, ["case_id"]).collect()} == {("a", "x", 2), ("b", "y", 1)}
