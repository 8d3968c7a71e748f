"""Order inside files, paths of many findings, matching, report rules and cluster members."""

import json
import random

import pytest

from tracewright.functions import values
from tracewright.operators import aggregates, judging, ordered, scoring, windows
from tracewright.sources import readers


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_the_header_in_force_crosses_splits(spark, tmp_path, tiny_splits):
    rng = random.Random(5)
    want, folder = [], tmp_path / "logs"
    folder.mkdir()
    for f in range(3):
        lines, fields = [], None
        for i in range(120):
            if rng.random() < 0.04:
                fields = rng.choice([["c-ip", "cs-method", "cs-uri-stem"], ["cs-method", "c-ip", "cs-uri-stem"], ["cs-uri-stem", "c-ip"]])
                lines.append("#Fields: " + " ".join(fields))
                continue
            row = {"c-ip": f"10.0.0.{i}", "cs-method": rng.choice(["GET", "POST"]), "cs-uri-stem": f"/{f}/{i}"}
            names = fields or ["c-ip", "cs-method", "cs-uri-stem"]
            broken = rng.random() < 0.05
            lines.append(" ".join(row[n] for n in names) + (" more" if broken else ""))
            want.append((fields is not None and not broken, *(row[n] if fields and not broken and n in fields else None for n in ("c-ip", "cs-method", "cs-uri-stem"))))
        (folder / f"u{f}.log").write_text("\n".join(lines) + "\n")
    out = readers.read_w3c_log(spark, str(folder))
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 6
    assert sorted(map(repr, ((r["parsed"], r["client_ip"], r["method"], r["target"]) for r in out.collect()))) == sorted(map(repr, want))


@pytest.fixture
def tiny_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("early", [0, 400])
def test_w3c_splits_without_headers_come_in_many_batches(spark, tmp_path, tiny_splits, tiny_batches, early):
    lines = [f"10.0.{i // 250}.{i % 250} GET" for i in range(1200)]
    (tmp_path / "a.log").write_text("\n".join([*lines[:early], "#Fields: c-ip cs-method", *lines[early:]]) + "\n")
    got = [(r["parsed"], r["client_ip"], r["method"]) for r in readers.read_w3c_log(spark, str(tmp_path / "a.log")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(False, None, None)] * early + [(True, *x.split()) for x in lines[early:]]))


@pytest.mark.parametrize("early", [0, 400])
def test_zeek_splits_without_headers_come_in_many_batches(spark, tmp_path, tiny_splits, tiny_batches, early):
    lines = [f"10.0.{i // 250}.{i % 250}\t{i}" for i in range(1200)]
    (tmp_path / "conn.log").write_text("\n".join([*lines[:early], "#fields\tip\tn", *lines[early:]]) + "\n")
    got = [(r["parsed"], *[r["row"][k] for k in ("ip", "n") if r["row"]]) for r in readers.read_zeek(spark, str(tmp_path / "conn.log")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(False,)] * early + [(True, *x.split("\t")) for x in lines[early:]]))


def test_headers_of_equal_length_in_one_file(spark, tmp_path):
    (tmp_path / "a.log").write_text("#Fields: c-ip cs-method\n1.1.1.1 GET\n#Fields: cs-method c-ip\nPOST 2.2.2.2\n")
    out = {r["client_ip"]: r["method"] for r in readers.read_w3c_log(spark, str(tmp_path / "a.log")).collect()}
    assert out == {"1.1.1.1": "GET", "2.2.2.2": "POST"}
    (tmp_path / "conn.log").write_text("early\n#fields\ta\tb\n1\t2\n#close\n#fields\tb\ta\n3\t4\n")
    rows = sorted((r["parsed"], sorted((r["row"] or {}).items())) for r in readers.read_zeek(spark, str(tmp_path / "conn.log")).collect())
    assert rows == [(False, []), (True, [("a", "1"), ("b", "2")]), (True, [("a", "4"), ("b", "3")])]
    (tmp_path / "empty.log").write_text("")
    assert readers.read_w3c_log(spark, str(tmp_path / "empty.log")).collect() == []


def test_null_keys_carry_over_buckets(spark):
    left = spark.createDataFrame([(None, 50), (None, 150), ("k", 150)], "k string, us long")
    right = spark.createDataFrame([(None, 40, "p"), ("k", 10, "q")], "k string, us long, v string")
    out = ordered.asof_before(left, right, ["k"], "us", ["v"], 100)
    assert sorted(map(str, ((r["k"], r["us"], r["r_v"]) for r in out.collect()))) == sorted(map(str, [(None, 50, "p"), (None, 150, "p"), ("k", 150, "q")]))


def walked(doc, path):
    """Plain walk of one path."""
    level = [doc]
    for step in values.path_steps(path) or ["\0"]:
        if isinstance(step, str):
            level = [x[step] for x in level if isinstance(x, dict) and step in x]
        elif step is None:
            level = [i for x in level if isinstance(x, list) for i in x]
        else:
            level = [x[step] for x in level if isinstance(x, list) and step < len(x)]
    return level


def test_one_walk_for_all_paths():
    doc = {"a": [{"b": 1, "c": [1, 2, {"d": "x"}]}, {"b": None}, 5], "a b": {"b": {"e": True}}, "n": 1.5}
    paths = ["a", "a[*]", "a[*].b", "a[0].c[2].d", "a[*].c[*]", "a[9]", "a b.b.e", "a..b", "", "a[x]", "n", "n.q", "a[*].b", "missing"]
    assert values.trie_leaves(doc, paths) == [[values._leaf(v) for v in walked(doc, p)] for p in paths]


def test_an_output_of_many_findings_is_parsed_once(spark, monkeypatch):
    n = 3000
    doc = json.dumps({"rows": [{"v": i} for i in range(n)]})
    asserted = "array<struct<path:string,expected:string,match:string,count:int>>"
    findings = spark.createDataFrame([("c", f"f{i}", "t", [(f"rows[{i}].v", str(i if i % 3 else i + 1), "int", None), ("rows[*].v", "1", "int", 2)]) for i in range(n)], f"case_id string, finding_id string, tool_call_id string, asserted_values {asserted}")
    findings = findings.unionByName(spark.createDataFrame([("c", "lone", "none", [("x", "1", "exact", None)])], findings.schema))
    outputs = spark.createDataFrame([("c", "t", doc)], "case_id string, tool_call_id string, output string")
    held = judging._read(findings, outputs, findings["asserted_values"], ["case_id"])
    assert held.count() == 2 * n + 1
    rows = {r["finding_id"]: r for r in judging.check_entailment(findings, outputs).collect()}
    assert all((rows[f"f{i}"]["misses"], rows[f"f{i}"]["over_counts"]) == (int(i % 3 == 0), 1) for i in range(n)) and rows["lone"]["misses"] == 1


def plain_matching(options):
    taken = {}

    def place(item, seen):
        for f in options[item]:
            if f not in seen:
                seen.add(f)
                if f not in taken or place(taken[f], seen):
                    taken[f] = item
                    return True
        return False

    for e in options:
        place(e, set())
    return taken


def test_matching_is_the_largest_and_needs_no_recursion():
    rng = random.Random(1)
    for _ in range(300):
        options = {f"e{i}": rng.sample([f"f{j}" for j in range(8)], rng.randrange(0, 5)) for i in range(rng.randrange(1, 9))}
        assert scoring.largest_matching(options) == plain_matching(options)
    n = 5000
    chain = {f"e{k}": [f"f{k}", f"f{k + 1}"] for k in range(n)} | {"last": ["f0"]}
    assert len(scoring.largest_matching(chain)) == n + 1


def test_report_offences(spark):
    rows = [
        ("c", "yara", "YARA-only match proves the binary executed.", "INFERRED", "t", ["yara"]),
        ("c", "memory", "process evidence proves execution", "HYPOTHESIS", "t", ["memory"]),
        ("c", "two", "the payload executed", "CONFIRMED", "t", ["memory", "prefetch"]),
        ("c", "net", "outbound traffic proves data was exfiltrated", "INFERRED", "t", ["network"]),
        ("c", "both", "data was exfiltrated", "INFERRED", "t", ["mft", "network"]),
        ("d", "quiet", None, "INFERRED", None, None),
        ("d", "guess", "Hypothesis: a file was there", "HYPOTHESIS", "t", []),
    ]
    classed = spark.createDataFrame(rows, "case_id string, finding_id string, description string, confidence string, tool_call_id string, classes array<string>")
    timeline = spark.createDataFrame([("c", 7, ""), ("e", 8, "t")], "case_id string, event_id long, tool_call_id string")
    got = {(r["case_id"], r["check"], r["offender"]) for r in judging.report_offences(classed, timeline).collect()}
    assert got == {
        ("c", "execution_requires_two_classes", "yara"), ("c", "pattern_only_execution", "yara"), ("c", "execution_requires_two_classes", "memory"), ("c", "memory_only_execution", "memory"),
        ("c", "unmarked_hypothesis", "memory"), ("c", "network_only_exfiltration", "net"), ("c", "exfiltration_requires_two_prongs", "net"), ("d", "uncited_finding", "quiet"), ("c", "uncited_event", "7"),
    }
    status = judging.report_status(judging.report_offences(classed, timeline), timeline, judging.report_rules(spark))
    assert {r["status"] for r in status.where("case_id = 'e'").collect()} == {"PASS"} and status.where("case_id = 'c' AND status = 'FAIL'").count() == 7


def test_cluster_members_and_scripts_by_host(spark):
    minute = 60_000_000
    events = spark.createDataFrame([(i, h, t * minute // 2) for i, (h, t) in enumerate([("a", 0), ("b", 1), ("a", 2), ("a", 40), ("b", 41), ("c", 90), (None, 43)])], "event_id long, host string, us long")
    out = windows.cluster_events(events).select("event_id", "cluster_first_us", "cluster_last_us").collect()
    assert sorted(tuple(r) for r in out) == [(0, 0, minute), (1, 0, minute), (2, 0, minute), (3, 20 * minute, 43 * minute // 2), (4, 20 * minute, 43 * minute // 2), (6, 20 * minute, 43 * minute // 2)]
    lines = spark.createDataFrame([("h1", "/x.php", "<?php system($_GET[1]);"), ("h2", "/x.php", "nothing")], "host string, path string, line string")
    scripts = {r["host"]: r["indicator_hits"] for r in aggregates.script_summary(lines).collect()}
    assert scripts["h1"] > 0 and scripts["h2"] == 0
