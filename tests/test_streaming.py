import json
import random

from pyspark.sql import functions as F

from tests.test_custody import chain
from tracewright.operators import windows
from tracewright.operators.ordered import trailing_count
from tracewright.plans.stream_plans import advance, drain, replay
from tracewright.streaming import live
from tracewright.streaming.timed import write_apart


def write_log(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_tail_timeline_and_chain(spark, tmp_path):
    case = tmp_path / "case-1"
    lines = [line for _, _, line in chain("c", 9)]
    write_log(case, "0001.jsonl", lines[:5])
    write_log(case, "0002.jsonl", lines[5:])
    log = live.tail_audit(spark, str(case), files_per_batch=1)
    assert drain(live.verify_chain_stream(log)).count() == 0
    made = drain(live.provisional_timeline(log))
    assert sorted(r["finding_id"] for r in made.collect()) == ["f-2", "f-5", "f-8"]
    have = spark.createDataFrame([("case-1", "tc-0")], "case_id string, tool_call_id string")
    left = drain(live.reconcile(live.provisional_timeline(log), have))
    assert sorted(r["finding_id"] for r in left.collect()) == ["f-5", "f-8"]
    bad = [lines[0], lines[1].replace('"ts":"t"', '"ts":"x"'), *lines[2:4]]
    write_log(tmp_path / "case-2", "0001.jsonl", bad)
    out = drain(live.verify_chain_stream(live.tail_audit(spark, str(tmp_path / "case-2")))).collect()
    assert [(r["seq"], r["reason"]) for r in out] == [(2, "prev_hash")]


def test_streamed_cells_give_the_batch_clusters(spark, tmp_path):
    folder = tmp_path / "ev"
    rows = [(t, f"h{i % 3}") for i, t in enumerate([0, 30, 59, 61, 200, 260, 321, 500, 505, 1000])]
    for k in range(2):
        write_log(folder, f"{k}.json", [json.dumps({"ts": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z", "host": h}) for t, h in rows[k::2]])
    schema = "ts timestamp, host string"
    cells = drain(live.cluster_cells_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), delay="1 hour"), "update")
    latest = cells.groupBy("cell", "host").agg(F.max_by(F.struct("lo", "hi", "n"), "batch").alias("c")).select("cell", "host", "c.*")
    batch = spark.read.schema(schema).json(str(folder)).withColumn("us", F.unix_micros("ts"))
    assert sorted(windows.clusters_from_cells(latest).collect()) == sorted(windows.temporal_clusters(batch).collect())


def test_late_rows_are_routed(spark):
    df = spark.createDataFrame([(1,), (100,)], "us long").withColumn("ts", F.timestamp_micros("us"))
    fresh, late = live.route_late(df, 50)
    assert [r["us"] for r in fresh.collect()] == [100] and [r["us"] for r in late.collect()] == [1]


def state_rows(spark, base, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{base}/state").count()


def test_bursts_and_travel_in_any_order_of_arrival(spark, tmp_path):
    """Rows of several actors over files in mixed order give what the batch operators give; in the end nothing is remembered."""
    rng = random.Random(3)
    minute = 60_000_000
    rows = [(i, f"u{i % 3}", 10**15 + rng.randrange(600) * minute, rng.random() < 0.6, rng.random() < 0.2, float(rng.randrange(-60, 60)), float(rng.randrange(-180, 180)), f"ip{i % 5}") for i in range(400)]
    schema = "event_id long, actor string, us long, denied boolean, approved boolean, lat double, lon double, source_ip string"
    df = spark.createDataFrame([(*r[:4], r[4] and not r[3], *r[5:]) for r in rows], schema)
    counted = trailing_count(df, ["actor"], "us", F.col("denied"), 10 * minute, "n")
    want = sorted((r["actor"], r["us"], r["n"], r["approved"]) for r in counted.where("(denied OR approved) AND n >= 3").collect())
    # The clock never passes a row's time by more than the delay, so no arrival order makes one late.
    slack = "12 hours"
    got, late = replay(df, lambda s: live.bursts_stream(s, 3, 10, slack), F.col("event_id") % 2 == 0)
    assert late.count() == 0 and sorted(tuple(r) for r in got.select("actor", "us", "prompt_count", "accepted").collect()) == want and want
    got, late = replay(df, lambda s: live.travel_stream(s, 1000.0, slack), F.col("event_id") % 3 == 0)
    batch = windows.impossible_travel(df).select("actor", "us", "from_ip", "to_ip", F.round("velocity_kmh", 3).alias("v"))
    assert late.count() == 0 and sorted(map(tuple, got.select("actor", "us", "from_ip", "to_ip", F.round("velocity_kmh", 3)).collect())) == sorted(map(tuple, batch.collect()))


def test_late_rows_and_expired_state(spark, tmp_path):
    base, minute = str(tmp_path), 60_000_000
    schema = "host string, us long"
    out = None

    def arrive(number, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/wave={number}")
        nonlocal out
        out = live.arrivals(spark.readStream.schema(schema).parquet(f"{base}/in/wave=*").withColumn("ts", F.timestamp_micros("us")))
        advance(out, f"{base}/state", write_apart(f"{base}/rows", f"{base}/late"))
        read = lambda name: sorted((r["host"], r["us"] // minute) for r in spark.read.schema(out.drop("late").schema).parquet(f"{base}/{name}/batch=*").collect())
        return read("rows"), read("late")

    # Up to the watermark (ten minutes behind the latest row) rows are released, the rest waits.
    assert arrive(0, [("a", 100 * minute), ("a", 95 * minute), ("b", 50 * minute)]) == ([("b", 50)], [])
    # 91 is behind 100 but not behind the watermark of 90; 80 is late.
    assert arrive(1, [("a", 91 * minute), ("a", 80 * minute), ("", 99 * minute)]) == ([("b", 50)], [("a", 80)])
    assert arrive(2, [("c", 300 * minute)]) == ([("", 99), ("a", 91), ("a", 95), ("a", 100), ("b", 50)], [("a", 80)])
    # Only the row that still waits is held, and nothing is remembered of hosts whose rows are all out.
    assert state_rows(spark, base, "memory") == 0
