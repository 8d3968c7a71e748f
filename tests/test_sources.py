import hashlib
import json

from pyspark.sql import functions as F

from tracewright.functions.hashing import sha256_hex
from tracewright.operators import aggregates
from tracewright.sources import readers, writers


def put(tmp_path, name, body):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if isinstance(body, str) else "\n".join(body))
    return str(path)


def test_event_log_ids_in_three_shapes(spark, tmp_path):
    event = lambda i: json.dumps({"Event": {"System": {"EventID": i, "Channel": "Security", "EventRecordID": 7, "TimeCreated": {"#attributes": {"SystemTime": "2024-01-01T00:00:00.1234567Z"}}}}})
    path = put(tmp_path, "e.json", [event(4624), event("4625"), event({"#text": 1102}), "{bad", ""])
    out = readers.read_event_log(spark, path)
    assert sorted(r["event_id"] or 0 for r in out.collect()) == [0, 1102, 4624, 4625]
    assert out.where("parsed").select(F.unix_micros("ts").alias("u"), "channel", "record_id").first()[:] == (1704067200123456, "Security", 7)


def test_containers(spark, tmp_path):
    put(tmp_path, "d/a.json", '{"Records":[{"x":1},{"x":2}]}')
    put(tmp_path, "d/b.json", '[{"x":3}]')
    put(tmp_path, "d/c.json", '{"x":4}')
    out = readers.read_json_container(spark, str(tmp_path / "d"), lines=False)
    assert sorted(json.loads(r["raw"])["x"] for r in out.collect()) == [1, 2, 3, 4]
    path = put(tmp_path, "l.jsonl", ['{"eventTime":"t","userIdentity":{"arn":"a"}}', "", "oops"])
    assert sorted(r["parsed"] for r in readers.read_json_container(spark, path, lines=True).collect()) == [False, True]
    assert [r["actor"] for r in readers.read_cloud(spark, path, "cloudtrail", lines=True).collect()] == ["a"]


def test_audit_csv_columns_fill_only_missing_keys(spark, tmp_path):
    path = put(tmp_path, "m.csv", ["CreationDate,UserIds,Operation,AuditData", '2024,u,FromColumn,"{""Operation"":""FromJson"",""UserId"":""u@x""}"'])
    got = json.loads(readers.read_m365_csv(spark, path).first()["raw"])
    assert got == {"Operation": "FromJson", "UserId": "u@x", "CreationDate": "2024", "UserIds": "u"}


def test_flow_lines(spark, tmp_path):
    path = put(tmp_path, "f.log", ["version account-id interface-id srcaddr dstaddr srcport dstport protocol packets bytes start end action log-status", "2 1 eni 10.0.0.1 10.0.0.2 1 2 6 1 1 5 6 ACCEPT OK", "2 1 eni"])
    assert [(r["srcaddr"], r["log_status"]) for r in readers.read_vpc_flow(spark, path).collect()] == [("10.0.0.1", "OK")]


def test_zeek_and_its_summary(spark, tmp_path):
    head = "#separator x\n#fields\tts\tid.orig_h\tid.resp_h\tid.resp_p\n"
    put(tmp_path, "z/conn.log", head + "1\ta\tb\t80\n2\ta\t-\t80\nshort\tx\n")
    put(tmp_path, "z/dns.log", "#fields\tts\tquery\n1\tq.example\n2\t-\n")
    put(tmp_path, "z/ssl.log", "#fields\tts\tserver_name\n1\ta\n")
    put(tmp_path, "z/odd.log", "no header\n")
    rows = readers.read_zeek(spark, str(tmp_path / "z"))
    assert rows.where("NOT parsed").count() == 2
    flat = rows.where("parsed").select("log_kind", F.col("row")["id.orig_h"].alias("orig_h"), F.col("row")["id.resp_h"].alias("resp_h"), F.col("row")["server_name"].alias("server_name"), F.col("row")["query"].alias("query"))
    assert aggregates.zeek_counts(flat).first().asDict() == {"rows_seen": 5, "conn_count": 2, "dns_count": 2, "http_count": 0, "tls_count": 1}
    assert [tuple(r) for r in aggregates.zeek_top_hosts(flat).collect()] == [("a", 3), ("b", 1)]


def test_access_and_w3c_logs(spark, tmp_path):
    path = put(tmp_path, "access.log", ['1.2.3.4 - - [10/Oct/2023:13:55:36 +0200] "GET /a?x=1 HTTP/1.1" 200 5 "-" "curl/8"', '5.6.7.8 - bob [bad] "POST /b" 404 -', "junk"])
    out = {r["client_ip"]: r for r in readers.read_access_log(spark, path).where("parsed").select("*", F.unix_micros("ts").alias("u")).collect()}
    assert set(out) == {"1.2.3.4", "5.6.7.8"} and out["1.2.3.4"]["u"] == 1696938936000000 and out["1.2.3.4"]["user_agent"] == "curl/8" and out["5.6.7.8"]["u"] is None and out["5.6.7.8"]["target"] == "/b"
    path = put(tmp_path, "u_ex1.log", ["#Software: x", "#Fields: date time c-ip cs-method cs-uri-stem cs-uri-query sc-status cs(User-Agent)", "2024-01-02 03:04:05 9.9.9.9 GET /a q=1 200 Mozilla/5.0+(X)", "2024-01-02 03:04:05 9.9.9.9 GET /b - 200 x", "too few"])
    out = readers.read_w3c_log(spark, path)
    assert sorted((r["target"] or "", r["user_agent"] or "", r["parsed"]) for r in out.collect()) == [("", "", False), ("/a?q=1", "Mozilla/5.0 (X)", True), ("/b", "x", True)]


def test_alerts_in_three_layouts(spark, tmp_path):
    a = {"Timestamp": "2024-01-01T01:00:00+01:00", "RuleTitle": "r", "Level": "high", "EventID": 1, "Extra": "e"}
    lines = put(tmp_path, "l.jsonl", [json.dumps(a)])
    array = put(tmp_path, "a.json", json.dumps([a, a]))
    joined = put(tmp_path, "c.json", json.dumps(a) + "\n" + json.dumps(a, indent=1) + json.dumps(a) + "{bad")
    assert [readers.read_alerts(spark, lines).count(), readers.read_alerts(spark, array, lines=False).count(), readers.read_alerts(spark, joined, lines=False).count()] == [1, 2, 3]
    r = readers.read_alerts(spark, lines).first()
    assert (r["timestamp"], r["rule"], r["level"], r["event_id"], r["details"]) == ("2024-01-01T00:00:00.000000Z", "r", "high", 1, {"Extra": "e"})


def test_linux_formats(spark, tmp_path):
    path = put(tmp_path, "audit.log", ["----", 'type=SYSCALL msg=audit(1.1:2): a0=1 exe="/bin/sh" a0=2', ""])
    (r,) = readers.read_linux_audit(spark, path).collect()
    assert r["fields"]["exe"] == '"/bin/sh"' and r["fields"]["a0"] == "2" and r["fields"]["type"] == "SYSCALL"
    path = put(tmp_path, "j.json", ['{"__REALTIME_TIMESTAMP":"1000000","_HOSTNAME":"h","MESSAGE":"m"}', '[{"MESSAGE":"a"},{"MESSAGE":"b"}]'])
    assert sorted(r["message"] for r in readers.read_journal(spark, path).collect()) == ["a", "b", "m"]
    path = put(tmp_path, "last.txt", ["bob pts/0 10.0.0.1 Mon Jan 1 10:00:00 2024 - Mon Jan 1 11:00:00 2024 (01:00)", "reboot system boot 5.4 Tue Jan 2 10:00", "amy tty1 Wed Jan 3 09:00:00 2024 still logged in", "odd", "wtmp begins Mon Jan 1", ""])
    got = sorted((r["user"], r["line"], r["host"], r["login"], r["logout"]) for r in readers.read_logins(spark, path).collect())
    assert got == [
        ("amy", "tty1", "", "Wed Jan 3 09:00:00 2024", None), ("bob", "pts/0", "10.0.0.1", "Mon Jan 1 10:00:00 2024", "Mon Jan 1 11:00:00 2024"), ("odd", "", "", None, None), ("reboot", "system", "boot 5.4", None, None),
    ]
    path = put(tmp_path, "eve.json", ['{"event_type":"alert","timestamp":"2024-01-01T00:00:00+0000","src_ip":"1.1.1.1"}'])
    assert readers.read_eve(spark, path).first()["src_ip"] == "1.1.1.1"
    path = put(tmp_path, "nf.json", ['{"src4_addr":"1.1.1.1","in_packets":5}', "x"])
    assert [r["row"]["in_packets"] for r in readers.read_netflow(spark, path).collect()] == ["5"]


def test_browser_shapes(spark):
    urls = spark.createDataFrame([("u1", "t", 11644473600 * 10**6 + 1, 3), ("u0", "t", 0, 1)], "url string, title string, last_visit_time long, visit_count int")
    places = spark.createDataFrame([("u2", "t", 5, 1)], "url string, title string, last_visit_date long, visit_count int")
    old = spark.createDataFrame([(1, "u3", "t", 2), (2, "u4", "t", 0)], "id long, url string, title string, visit_count int")
    visits = spark.createDataFrame([(1, 7), (1, 9)], "place_id long, visit_date long")
    out = readers.normalize_browser(urls, places, old, visits).select("url", F.unix_micros("last_visit").alias("u"), "browser_family")
    assert sorted((r["url"], r["u"]) for r in out.collect()) == [("u0", None), ("u1", 1), ("u2", 5), ("u3", 9), ("u4", None)]


def test_fleet_folder(spark, tmp_path):
    put(tmp_path, "h1/verdict.json", json.dumps({"case_id": "c1", "verdict": "SUSPICIOUS", "findings": [{"finding_id": "f", "mitre_technique": "T1014"}], "cryptographic_attestation": {"merkle_root_hex": "aa"}}))
    put(tmp_path, "h2/verdict.json", "{broken")
    put(tmp_path, "h3/verdict.json", json.dumps({"case_id": "c3"}))
    put(tmp_path, "h1/psscan.json", json.dumps([{"image_name": "a.exe", "pid": 1, "create_time_iso": "2024-01-01T00:00:00Z"}, {"ImageFileName": "b.exe", "PID": 2, "CreateTime": None}]))
    hosts, found, procs = readers.read_fleet(spark, str(tmp_path))
    assert sorted((r["host"], r["outcome"]) for r in hosts.collect()) == [("h1", "SUSPICIOUS"), ("h3", "?")]
    assert [(r["host"], r["mitre_technique"]) for r in found.collect()] == [("h1", "T1014")]
    assert sorted((r["image_name"], r["pid"], r["us"] is None) for r in procs.collect()) == [("a.exe", 1, False), ("b.exe", 2, True)]
    path = put(tmp_path, "r.jsonl", ['{"label":"mem:web","case_id":"c"}', '{"host":"db","error":"x"}'])
    assert sorted((r["host"], r["status"]) for r in readers.read_fleet_results(spark, path).collect()) == [("db", "failed"), ("web", "ok")]


def test_audit_lines_inventory_and_csv(spark, tmp_path):
    path = put(tmp_path, "audit.jsonl", ["", *[json.dumps({"seq": i, "kind": "k", "prev_hash": "", "payload": {"tool_call_id": f"t{i}"}}) for i in range(5)]])
    log = readers.read_audit(spark, path)
    assert sorted(r["tool_call_id"] for r in log.collect()) == [f"t{i}" for i in range(5)]
    numbered = readers.with_line_numbers(log.select("file", "line", "seq"))
    assert all(r["line_no"] == r["seq"] for r in numbered.collect())
    assert readers.inventory(spark, str(tmp_path)).first()["sha256"] == hashlib.sha256((tmp_path / "audit.jsonl").read_bytes()).hexdigest()
    assert readers.inventory(spark, str(tmp_path), whole=0).first()["sha256"] == hashlib.sha256((tmp_path / "audit.jsonl").read_bytes()).hexdigest()
    path = put(tmp_path, "lnk.csv", ["Source File,Target Path", "a.lnk,"])
    assert readers.read_decoded_csv(spark, path, "lecmd").first()["row"] == {"Source File": "a.lnk"}
    path = put(tmp_path, "st.jsonl", ['{"timestamp":5,"filename":"/tmp/x1/SecEvent.Evt","parser":"winevt","data_type":"d"}'])
    assert readers.read_super_timeline(spark, path, "/tmp/x1").first()["filename"] == "/evidence/SecEvent.Evt"


def test_writers(spark, tmp_path):
    events = spark.createDataFrame([("e2", "2024-01-02", ["f1"], {"account": "a"}), ("e1", "2024-01-01", [], {})], "event_id string, timestamp_utc string, linked_finding_ids array<string>, entities map<string,string>")
    writers.write_timeline(events, str(tmp_path / "t"))
    back = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert tuple(back.columns) == writers.TIMELINE_COLUMNS and sorted(r["event_id"] for r in back.collect()) == ["e1", "e2"]
    writers.write_fleet({"density": spark.range(2)}, str(tmp_path / "fleet"))
    assert spark.read.json(str(tmp_path / "fleet/density")).count() == 2
    runs = spark.createDataFrame([(None, 5, "r")], "recall_percent int, recall int, run string")
    rows = writers.benchmark_rows(runs, {"recall": ["recall_percent", "recall"], "run": ["run_name", "run"], "none": ["absent"]})
    writers.write_benchmark(rows, str(tmp_path / "b"))
    assert rows.first()[:] == (5, "r", None)
    assert rows.select(sha256_hex(F.col("run"))).first()[0] == hashlib.sha256(b"r").hexdigest()
