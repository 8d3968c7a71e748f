"""Live run logs: tailing, provisional timeline, chain checks, clusters and bursts."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.hashing import sha256_hex
from tracewright.operators.ordered import slot
from tracewright.streaming.timed import in_order

# Our policy: events may be this late; later ones go to a side table.
WATERMARK = "10 minutes"


def tail_audit(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Log lines as they land. The landing job closes segment files, so a line is never seen in part."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    fields = "seq long, ts string, kind string, prev_hash string, payload string"
    rec = F.from_json("line", fields)
    lines = raw.where(F.trim("value") != "").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("segment"))
    case = F.coalesce(F.get_json_object("line", "$.payload.case_id"), F.regexp_extract("segment", r"([^/]+)/[^/]+$", 1))
    return lines.select("line", "segment", case.alias("case_id"), rec["seq"].alias("seq"), rec["ts"].alias("ts"), rec["kind"].alias("kind"), rec["prev_hash"].alias("prev_hash"), F.get_json_object("line", "$.payload").alias("payload"))


def provisional_timeline(stream: DataFrame) -> DataFrame:
    """Timeline rows of approved findings, before the authoritative timeline exists."""
    p = lambda name: F.get_json_object("payload", "$." + name)
    return stream.where("kind = 'finding_approved'").select(
        "case_id", F.col("ts").alias("timestamp_utc"), p("finding_id").alias("finding_id"), p("tool_call_id").alias("tool_call_id"),
        p("description").alias("summary"), p("confidence").alias("confidence"), F.lit(True).alias("provisional"),
    )


def reconcile(stream: DataFrame, authoritative: DataFrame) -> DataFrame:
    """Provisional rows whose call the authoritative table does not have yet."""
    have = authoritative.select("case_id", "tool_call_id", F.lit(True).alias("__have")).dropDuplicates(["case_id", "tool_call_id"])
    return stream.join(have, ["case_id", "tool_call_id"], "left").where("__have IS NULL").drop("__have")


def _check_lines(key, chunks, state):
    expected, last = state.get if state.exists else (0, "")
    rows = pd.concat(list(chunks)).sort_values("seq", kind="stable")
    out = []
    for seq, prev, line in zip(rows["seq"], rows["prev_hash"], rows["line"]):
        try:
            tight = json.dumps(json.loads(line), sort_keys=True, separators=(",", ":")) == line
        except ValueError:
            tight = False
        reason = "sequence" if seq != expected else "prev_hash" if prev != last else None if tight else "not_canonical"
        if reason:
            out.append((key[0], int(seq) if pd.notna(seq) else -1, reason))
        last = hashlib.sha256(line.encode()).hexdigest()
        expected += 1
    state.update((expected, last))
    yield pd.DataFrame(out, columns=["case_id", "seq", "reason"])


def verify_chain_stream(stream: DataFrame) -> DataFrame:
    """Lines that break their chain, with (next sequence, last digest) kept per case."""
    return stream.select("case_id", "seq", "prev_hash", "line").groupBy("case_id").applyInPandasWithState(
        _check_lines, "case_id string, seq long, reason string", "expected long, last string", "append", "NoTimeout"
    )


def cluster_cells_stream(stream: DataFrame, gap_seconds: int = 60, delay: str = WATERMARK) -> DataFrame:
    """Per gap-wide cell and host: earliest, latest, count. State is spread over cells and hosts, not held by one task."""
    us = F.unix_micros("ts")
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{gap_seconds} seconds").alias("w"), "host")
        .agg(F.min(us).alias("lo"), F.max(us).alias("hi"), F.count(F.lit(1)).alias("n"))
        .select(slot(F.unix_micros("w.start"), gap_seconds * 1_000_000).alias("cell"), "host", "lo", "hi", "n")
    )


def route_late(batch: DataFrame, closed_until_us: int) -> tuple[DataFrame, DataFrame]:
    """Rows still in time, and rows older than the closed watermark for the side table."""
    old = F.unix_micros("ts") < F.lit(closed_until_us)
    return batch.where(~old), batch.where(old)


def _burst(prompts: int, width_us: int):
    def step(memory, rows):
        us = rows[0][0]
        recent = [t for t in (memory[0] if memory else []) if t >= us - width_us] + [us for row in rows if row[1]]
        denied, approved = any(row[1] for row in rows), sum(bool(row[2]) and not row[1] for row in rows)
        out = []
        if len(recent) >= prompts:
            out = [(us, len(recent), False)] * sum(bool(row[1]) for row in rows) if denied else []
            out += [(us, len(recent), True)] * approved
        # Only one window of denials is ever kept.
        return (recent,), out

    return step


def bursts_stream(stream: DataFrame, prompts: int = 5, minutes: int = 10, delay: str = WATERMARK) -> DataFrame:
    """Denial bursts per actor, and approvals that end one, from columns actor, us, denied, approved in any order of arrival.

    Columns actor, us, prompt_count, accepted, late. Denials of one moment count together. Rows older than the watermark are late.
    """
    width = minutes * 60_000_000
    return in_order(stream, "actor", ["us", "denied", "approved"], "recent array<long>", "us long, prompt_count long, accepted boolean", _burst(prompts, width), width, delay)


def _travel(kmh: float):
    def step(memory, rows):
        out, last = [], memory
        for us, _, lat, lon, ip in rows:
            if last is not None and us > last[0]:
                a, b = math.radians(last[1]), math.radians(lat)
                half = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon - last[2]) / 2) ** 2
                speed = 2 * 6371.0 * math.asin(math.sqrt(min(half, 1.0))) / ((us - last[0]) / 3_600_000_000)
                if speed > kmh:
                    out.append((us, last[3], ip, speed))
            last = (us, lat, lon, ip)
        return last, out

    return step


def travel_stream(stream: DataFrame, kmh: float = 1000.0, delay: str = WATERMARK, keep_hours: int = 24 * 30, tie: str = "event_id") -> DataFrame:
    """Impossible travel per actor from columns actor, us, lat, lon, source_ip in any order of arrival.

    Columns actor, us, from_ip, to_ip, velocity_kmh, late. Sign-ins of one moment are ordered by `tie` if there is such a column, then
    by place and address. An actor's last sign-in is forgotten after `keep_hours` without another one.
    """
    rows = stream.where("lat IS NOT NULL AND lon IS NOT NULL")
    rows = rows.select("actor", "us", (F.col(tie) if tie in stream.columns else F.lit(0)).cast("long").alias("tie"), "lat", "lon", "source_ip")
    return in_order(rows, "actor", ["us", "tie", "lat", "lon", "source_ip"], "us long, lat double, lon double, ip string", "us long, from_ip string, to_ip string, velocity_kmh double", _travel(kmh), keep_hours * 3_600_000_000, delay)


def arrivals(stream: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """(host, us, late) of every row, in event-time order per host, for sinks that keep late rows apart."""
    return in_order(stream.select("host", F.unix_micros("ts").alias("us")), "host", ["us"], "n long", "us long", lambda memory, rows: ((0,), [(row[0],) for row in rows]), 0, delay)


def batch_cells(rows: DataFrame, gap_seconds: int = 60) -> DataFrame:
    """Cells of one batch of arrivals: partial (cell, host, lo, hi, n), which `merged_cells` adds up over batches."""
    return rows.groupBy(slot("us", gap_seconds * 1_000_000).alias("cell"), "host").agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n"))


def merged_cells(partial: DataFrame) -> DataFrame:
    return partial.groupBy("cell", "host").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def line_hashes(stream: DataFrame) -> DataFrame:
    """Digest of every line, for joining with a sealed leaf list."""
    return stream.select("case_id", "seq", sha256_hex(F.col("line")).alias("line_hash"))
