"""Traces down to sealed leaves, sealed slices, committed excerpts, trees of any height."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tests.test_custody import canonical, chain, digests, root
from tracewright.operators import custody

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()
FIELDS = {"kind": "$.kind", "seq": "$.seq", "output_hash": "$.payload.output_hash", "tool_call_id": "$.payload.tool_call_id", "finding_id": "$.payload.finding_id"}


def test_a_tall_tree_has_one_root_and_proofs(spark):
    many = spark.range(1 << 13).select(F.lit("c").alias("case_id"), F.col("id").alias("leaf_idx"), F.sha2(F.concat(F.lit("leaf"), F.col("id").cast("string")), 256).alias("digest_hex"))
    want = root(digests(1 << 13))
    assert [(r["merkle_root"], r["leaf_count"]) for r in custody.merkle_root(many, bits=2).collect()] == [(want, 1 << 13)]
    proofs = custody.check_proofs(custody.inclusion_proofs(many, many.where("leaf_idx IN (0, 4097, 8191)"), bits=4)).collect()
    assert [(r["proof_ok"], r["root"], len(r["siblings"])) for r in proofs] == [(True, want, 13)] * 3
    assert custody.merkle_root(many.limit(0)).collect() == custody.inclusion_proofs(many.limit(0), many).collect() == []


@pytest.fixture(scope="module")
def sealed(spark):
    """A log, and the leaves and root its manifest seals; one digest and one record differ in the cases named so."""
    logs, rows, roots = [], [], []
    for case in ("fine", "changed", "missing", "reroot"):
        lines = [(case, n, line.replace(f'"f-{n}"', f'"f-{n // 3}"')) for _, n, line in chain(case, 12)]
        logs += lines
        mine = []
        for _, seq, line in lines:
            rec = json.loads(line)
            if rec["kind"] == "tool_call_output":
                mine.append([seq, rec["kind"], rec["payload"]["output_hash"], rec["payload"]["tool_call_id"]])
            elif rec["kind"] == "finding_approved":
                mine.append([seq, "finding", SHA(line), rec["payload"]["finding_id"]])
        if case == "missing":
            mine = [m for m in mine if m[3] != "f-2"] + [[99, "finding", SHA("x"), "f-none"]]
        if case in ("changed", "reroot"):
            sealed_root = root([m[2] for m in mine])
            mine[2][2] = SHA("other")
        rows += [(case, i, *m) for i, m in enumerate(mine)]
        roots.append((case, sealed_root if case == "changed" else root([m[2] for m in mine])))
    audit = spark.createDataFrame(logs, "case_id string, line_no long, line string")
    audit = audit.select("case_id", "line", *[F.get_json_object("line", p).alias(c) for c, p in FIELDS.items()]).withColumn("seq", F.col("seq").cast("long"))
    return audit, spark.createDataFrame(rows, "case_id string, leaf_idx long, seq long, kind string, digest_hex string, record_id string"), spark.createDataFrame(roots, "case_id string, merkle_root_hex string")


def test_findings_are_traced_to_their_leaves_and_proved(spark, sealed):
    audit, rows, roots = sealed
    asked = [(c, f"f-{i}", f"tc-{i}") for c in ("fine", "changed", "missing", "reroot") for i in range(4)] + [("fine", "f-none", "tc-0"), ("fine", "f-0", None), (None, "f-0", "tc-0")]
    findings = spark.createDataFrame(asked, "case_id string, finding_id string, tool_call_id string")
    got = {(r["case_id"], r["finding_id"], r["tool_call_id"]): r for r in custody.trace_to_leaves(findings, audit, rows, roots, bits=2).collect()}
    assert len(got) == len(asked)
    assert all(got["fine", f"f-{i}", f"tc-{i}"]["proved"] and got["fine", f"f-{i}", f"tc-{i}"]["traced_to_leaf"] for i in range(4))
    # The changed leaf is that of call 1: its own digest and, where the root is the old one, only its own proof from the log holds.
    changed = got["changed", "f-1", "tc-1"]
    assert changed["traced_to_leaf"] and not changed["call_leaf_ok"] and not changed["proved"]
    assert not any(got["changed", f"f-{i}", f"tc-{i}"]["proved"] for i in (0, 1))
    again = got["reroot", "f-1", "tc-1"]
    assert not again["call_leaf_ok"] and not again["call_proof_ok"] and again["finding_proof_ok"] and got["reroot", "f-3", "tc-3"]["proved"]
    gone = got["missing", "f-2", "tc-2"]
    assert not gone["finding_has_leaf"] and gone["call_proof_ok"] and not gone["traced_to_leaf"] and not gone["proved"] and got["missing", "f-3", "tc-3"]["proved"]
    assert not any(got[k]["traced_to_leaf"] for k in asked[-3:])
    assert [(r["case_id"], r["record_id"]) for r in custody.unresolved_leaves(rows, audit).collect()] == [("missing", "f-none")]
    assert custody.trace_to_leaves(findings.limit(0), audit, rows, roots).collect() == []


def replay(case, seq, slice_, **payload):
    return case, json.dumps({"kind": "replay", "seq": seq, "payload": {**payload, "replay_artifact": {"tool_call_id": f"tc-{seq}", "entailment": slice_}}})


def entry(expected, actual, match="exact", path="p"):
    return {"path": path, "expected": expected, "actual": actual, "match": match}


def test_sealed_slices_are_matched_again(spark):
    ok = entry("a", "a")
    lines = [
        replay("c", 1, {"matched": [ok, entry("10", 10, "int"), entry("0x0a", "10", "int"), entry("True", True), entry("EVIL", "an evil.exe", "contains"), entry('{"n": "X"}', {"n": "has x"}, "record")], "passed": True, "failures": []}),
        replay("c", 2, {"matched": [ok, entry("b", "changed", path="q[0].r"), entry("c", "d")]}, finding_id="f-2"),
        replay("c", 3, {"matched": [ok], "passed": True, "failures": [{"path": "x"}]}),
        replay("c", 4, {"matched": [ok], "passed": False, "failures": [{"path": "x"}]}),
        replay("c", 5, "text"),
        replay("c", 6, {"matched": ["text"]}),
        replay("c", 7, {"matched": [entry("no json", {"n": 1}, "record")]}),
        replay("c", 8, {"matched": [entry('{"n": "y"}', {"n": "x"}, "record")]}),
        replay("c", 9, None),
        ("c", json.dumps({"kind": "replay", "seq": 10, "payload": {}})),
        ("c", '{"kind": "replay"'),
        ("c", json.dumps({"kind": "other", "seq": 12, "note": "replay"})),
        replay("d", 1, {"matched": [entry("", "")]}),
        replay("d", 2, {}),
        replay(None, 3, {"matched": [entry("1", 2, "int")]}),
        ("c", None),
    ]
    audit = spark.createDataFrame(lines, "case_id string, line string")
    rows = {(r["case_id"], r["seq"]): r for r in custody.recheck_slices(audit).collect()}
    assert {k: r["slice_reason"] for k, r in rows.items()} == {
        ("c", 1): None, ("c", 2): "value no longer holds at q[0].r", ("c", 3): "marked passed but lists failures", ("c", 4): None, ("c", 5): "slice is not an object", ("c", 6): "malformed matched entry",
        ("c", 7): "expected is not JSON at p", ("c", 8): "record no longer holds at p", ("d", 1): None, ("d", 2): None, (None, 3): "value no longer holds at p",
    }
    assert rows["c", 2]["subject"] == "f-2" and rows["c", 1]["subject"] == "tc-1" and rows["c", 1]["matched"] == 6


def test_committed_traces(spark):
    window = [line for _, _, line in chain("c", 9)][3:]
    flat = [canonical({"seq": i, "kind": "tool_call_output", "tool": "case_open" if i == 0 else "scan", "output_hash": f"h{i}"}) for i in range(4)]
    spot = dict(record_count=4, tool_output_seq=2, tool_name="scan", tool_output_sha256="h2", evidence_sha256="h0")
    good = dict(file_sha256="s", excerpt_sha256="s")
    cases = {
        "chained": (window, good, None), "digest": (window, good | dict(file_sha256="t"), "file_digest"), "anchor": (window, {}, "no_anchor"),
        "edit": ([*window[:2], window[2].replace('"ts":"t"', '"ts":"u"'), *window[3:]], good, "prev_hash"), "gap": ([*window[:2], *window[3:]], good, "sequence"), "spaced": ([window[0], window[1].replace(",", ", ", 1), *window[2:]], good, "not_canonical"),
        "flat": (flat, spot, None), "count": (flat, spot | dict(record_count=5), "record_count"), "tool": (flat, spot | dict(tool_name="other"), "spot_tool"), "hash": (flat, spot | dict(tool_output_sha256="h3"), "spot_digest"),
        "open": (flat, spot | dict(evidence_sha256="e"), "evidence_digest"), "spotless": (flat, {}, "no_spot_check"), "beyond": (flat, spot | dict(tool_output_seq=9), "spot_missing"), "shifted": (flat[1:], spot, "sequence"), "broken": ([flat[0], "{bad"], spot, "not_json"),
        "lone": (flat, None, "no_summary"), "empty": ([], spot, "no_records"),
    }
    names = ("file_sha256", "excerpt_sha256", "record_count", "tool_output_seq", "tool_name", "tool_output_sha256", "evidence_sha256")
    lines = spark.createDataFrame([(f, n, line) for f, (body, _, _) in cases.items() for n, line in enumerate(body)], "file string, line_no long, line string")
    told = spark.createDataFrame([(f, *[s.get(n) for n in names]) for f, (_, s, _) in cases.items() if s is not None], "file string, file_sha256 string, excerpt_sha256 string, record_count long, tool_output_seq long, tool_name string, tool_output_sha256 string, evidence_sha256 string")
    rows = {r["file"]: r for r in custody.committed_traces(lines, told).collect()}
    assert {f: (r["reason"], r["ok"]) for f, r in rows.items()} == {f: (why, why is None) for f, (_, _, why) in cases.items()}
    assert rows["edit"]["break_at"] == 3 and rows["chained"]["format"] == "chained" and rows["flat"]["format"] == "flat" and rows["empty"]["format"] is None and rows["flat"]["records"] == 4
