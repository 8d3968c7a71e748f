"""Streaming queries: the given tables read as streams, results written by tasks to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import windows
from tracewright.plans.catalog import query
from tracewright.plans.fleet_plans import CLUSTERS
from tracewright.session import shared_folder
from tracewright.streaming import live
from tracewright.streaming.timed import END_OF_TIME, write_apart


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, one file or a folder of files, as a file stream, zone-less times read as UTC."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # The last letter as a pattern: a pattern may name a single file, and what is in a folder it names belongs to the stream.
    raw = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there; each batch is written with its number, and the written table is returned."""
    base = run_folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        # Overwriting the batch's own folder makes a retried batch land once.
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    advance(stream, f"{base}/state", write, mode)
    return written(stream.sparkSession, f"{base}/out", stream.schema)


def advance(stream: DataFrame, state: str, write, mode: str = "append") -> None:
    """Take in what has come since the last call with this state folder."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def written(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema("batch int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)).parquet(folder)


def replay(rows: DataFrame, make, split=None, shape=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(rows, late rows) that `make` gives for recorded rows arriving as files: all at once, or first those that `split` holds for.

    After the last of them a row at the end of time moves the clock, so no row is left waiting.
    """
    spark, base = rows.sparkSession, run_folder(rows.sparkSession)
    waves = [rows] if split is None else [rows.where(split), rows.where(~split)]
    over = F.lit(END_OF_TIME).cast("timestamp")
    clock = {"us": F.unix_micros(over), "ts": over, "lat": F.lit(0.0), "lon": F.lit(0.0)}
    end = spark.range(1).select(*[clock.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    write = write_apart(f"{base}/rows", f"{base}/late", shape)
    out = None
    for number, wave in enumerate([*waves, end]):
        wave.write.parquet(f"{base}/in/wave={number}")
        out = make(spark.readStream.schema(rows.schema).parquet(f"{base}/in/wave=*"))
        advance(out, f"{base}/state", write)
    kept = out.drop("late").schema
    shaped = shape(spark.createDataFrame([], kept)).schema
    return written(spark, f"{base}/rows", shaped).drop("batch"), written(spark, f"{base}/late", kept).drop("batch")


@query("stream_clusters", CLUSTERS + " SELECT * FROM clusters", uses=("ps",))
def _(src):
    events = stream_table(src.spark, src.folder, "events").select("ts", F.concat(F.lit("host-"), (F.col("user_id") % 20).cast("string")).alias("host"))
    cells = drain(live.cluster_cells_stream(events), "update")
    # An updated cell replaces what an earlier batch said about it.
    latest = cells.groupBy("cell", "host").agg(F.max_by(F.struct("lo", "hi", "n"), "batch").alias("c")).select("cell", "host", "c.*")
    return windows.clusters_from_cells(latest)


@query(
    "stream_provisional_timeline",
    """SELECT concat('case-', CAST(user_id % 30 AS STRING)) AS case_id, concat('f-', CAST(event_id AS STRING)) AS finding_id, concat('tc-', CAST(user_id AS STRING)) AS tool_call_id, event_type AS summary, 'INFERRED' AS confidence FROM events WHERE event_type IN ('purchase', 'signup') AND user_id NOT IN (SELECT user_id FROM events WHERE value > 200)""",
)
def _(src):
    e = stream_table(src.spark, src.folder, "events")
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "finding_approved").otherwise("tool_call_output")
    payload = F.to_json(F.struct(F.concat(F.lit("f-"), F.col("event_id").cast("string")).alias("finding_id"), F.concat(F.lit("tc-"), F.col("user_id").cast("string")).alias("tool_call_id"), F.col("event_type").alias("description"), F.lit("INFERRED").alias("confidence")))
    log = e.select(F.concat(F.lit("case-"), (F.col("user_id") % 30).cast("string")).alias("case_id"), F.col("ts").cast("string").alias("ts"), kind.alias("kind"), payload.alias("payload"))
    # Calls of users with a large value already have authoritative rows.
    have = src.given("events").where("value > 200").select(F.concat(F.lit("case-"), (F.col("user_id") % 30).cast("string")).alias("case_id"), F.concat(F.lit("tc-"), F.col("user_id").cast("string")).alias("tool_call_id"))
    return drain(live.reconcile(live.provisional_timeline(log), have)).select("case_id", "finding_id", "tool_call_id", "summary", "confidence")


@query(
    "stream_bursts",
    """, d AS (SELECT actor, us, count(*) OVER (PARTITION BY actor ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM signins WHERE outcome = '500121'),
       a AS (SELECT s.actor, s.us, (SELECT count(*) FROM signins d WHERE d.actor = s.actor AND d.outcome = '500121' AND d.us <= s.us AND d.us >= s.us - 86400000000) AS n FROM signins s WHERE outcome = '0')
       SELECT actor, us, n AS prompt_count, FALSE AS accepted FROM d WHERE n >= 7 UNION ALL SELECT actor, us, n, TRUE FROM a WHERE n >= 7""",
    uses=("signins",),
)
def _(src):
    e = src.given("events")
    rows = e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string"), F.lit("@corp.example")).alias("actor"), F.unix_micros("ts").alias("us"),
        F.col("event_type").isin("error", "click").alias("denied"), (F.col("event_type") == "view").alias("approved"),
    )
    return replay(rows, lambda s: live.bursts_stream(s, prompts=7, minutes=1440))[0]


@query(
    "stream_chain_check",
    """WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
       SELECT concat('c', CAST(conv_id AS STRING)) AS case_id, turn AS seq, CASE WHEN turn <> pos THEN 'sequence' ELSE 'prev_hash' END AS reason FROM p WHERE turn <> pos OR turn > 0""",
)
def _(src):
    c = stream_table(src.spark, src.folder, "conversations")
    line = F.concat(F.lit('{"seq":'), F.col("turn").cast("string"), F.lit("}"))
    rows = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("case_id"), F.col("turn").alias("seq"), F.lit("").alias("prev_hash"), line.alias("line"))
    # No line names its predecessor here, so every line after the first is a break.
    return drain(live.verify_chain_stream(rows)).drop("batch")


@query(
    "stream_travel",
    """, p AS (SELECT *, lag(us) OVER w AS pu, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lag(source_ip) OVER w AS pi FROM signins WINDOW w AS (PARTITION BY actor ORDER BY us, event_id)),
       d AS (SELECT *, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - pa) / 2), 2) + cos(radians(pa)) * cos(radians(lat)) * pow(sin(radians(lon - po) / 2), 2)))) / ((us - pu) / 3600000000.0) AS v FROM p WHERE pu IS NOT NULL AND us > pu)
       SELECT actor, us, pi AS from_ip, source_ip AS to_ip, round(v, 3) AS velocity_kmh FROM d WHERE v > 1000""",
    uses=("signins",),
)
def _(src):
    e = src.given("events")
    i, user = F.col("event_id"), F.col("user_id")
    rows = e.select(
        F.concat(F.lit("u"), (user % 40).cast("string"), F.lit("@corp.example")).alias("actor"), F.unix_micros("ts").alias("us"), i.alias("event_id"), (F.lit(-60) + (i * 37) % 120).cast("double").alias("lat"), (F.lit(-180) + (i * 91) % 360).cast("double").alias("lon"),
        F.concat(F.lit("203.0."), (user % 11).cast("string"), F.lit("."), (i % 23).cast("string")).alias("source_ip"),
    )
    return replay(rows, live.travel_stream)[0].withColumn("velocity_kmh", F.round("velocity_kmh", 3))


# A tenth of the rows comes after the rest: those older than the clock by then are late, the others chain as if they had been in time.
LATE_SPLIT = "event_id % 10 = 0 AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events WHERE event_id % 10 <> 0) - 600000"


def arriving(src) -> tuple[DataFrame, DataFrame]:
    rows = src.given("events").select("event_id", F.concat(F.lit("host-"), (F.col("user_id") % 20).cast("string")).alias("host"), "ts", F.unix_micros("ts").alias("us"))
    return replay(rows, live.arrivals, F.col("event_id") % 10 != 0, live.batch_cells)


@query("late_events", f"SELECT concat('host-', CAST(user_id % 20 AS STRING)) AS host, count(*) AS late_rows, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events WHERE {LATE_SPLIT} GROUP BY 1")
def _(src):
    return arriving(src)[1].groupBy("host").agg(F.count("*").alias("late_rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("stream_cells_in_time", f"SELECT CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS cell, concat('host-', CAST(user_id % 20 AS STRING)) AS host, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi, count(*) AS n FROM events WHERE NOT ({LATE_SPLIT}) GROUP BY 1, 2")
def _(src):
    return live.merged_cells(arriving(src)[0])
