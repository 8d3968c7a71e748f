"""Time-ordered operators: clusters, travel, bursts, chains of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.times import haversine_km
from tracewright.operators.ordered import DAY_US, HOUR_US, dense_index, first_within, islands, previous_values, slot, trailing_count
from tracewright.session import cut_lineage

# Our choice of thresholds.
TRAVEL_KMH = 1000.0
MFA_PROMPTS = 5
MFA_MINUTES = 10


def temporal_clusters(events: DataFrame, us: str = "us", host: str = "host", gap_us: int = 60_000_000, min_hosts: int = 2) -> DataFrame:
    """Chains of events no more than `gap` apart that touch several hosts.

    Events inside one gap-wide cell always chain, so a cell is one row (earliest, latest, count) whatever its
    size; chaining then runs over cells, in blocks of a week.
    """
    per_host = events.where(F.col(us).isNotNull()).groupBy(slot(us, gap_us).alias("cell"), F.col(host).alias("host")).agg(
        F.min(us).alias("lo"), F.max(us).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    # The events are read once; what follows reads this bounded table several times.
    return clusters_from_cells(cut_lineage(per_host), gap_us, min_hosts)


def cluster_events(events: DataFrame, us: str = "us", host: str = "host", gap_us: int = 60_000_000, min_hosts: int = 2) -> DataFrame:
    """Every event of a cluster, all its columns, with the cluster's first and last moment.

    An event meets its cluster by its cell: a cell lies in one chain whole, so the join is an equal one and copies no row.
    """
    dated = events.where(F.col(us).isNotNull()).withColumn("cell", slot(us, gap_us))
    per_host = cut_lineage(dated.groupBy("cell", F.col(host).alias("host")).agg(F.min(us).alias("lo"), F.max(us).alias("hi"), F.count(F.lit(1)).alias("n")))
    cells = per_host.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    chained = cut_lineage(islands(cells, "cell", "lo", "hi", gap_us, max(1, 7 * DAY_US // gap_us)).select("cell", "island_start"))
    spans = clusters_from_chains(per_host, chained, min_hosts).select("island_start", F.col("first_us").alias("cluster_first_us"), F.col("last_us").alias("cluster_last_us"))
    return dated.join(chained.join(spans, "island_start"), "cell").drop("cell", "island_start")


def clusters_from_cells(per_host: DataFrame, gap_us: int = 60_000_000, min_hosts: int = 2) -> DataFrame:
    """Clusters from (cell, host, lo, hi, n) rows, as the batch job or the stream leaves them."""
    cells = per_host.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    chained = islands(cells, "cell", "lo", "hi", gap_us, max(1, 7 * DAY_US // gap_us)).select("cell", "island_start")
    return clusters_from_chains(per_host, chained, min_hosts).drop("island_start")


def clusters_from_chains(per_host: DataFrame, chained: DataFrame, min_hosts: int) -> DataFrame:
    """Chains that touch enough hosts, one row each."""
    per_chain_host = per_host.join(chained, "cell").groupBy("island_start", "host").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")
    )
    return (
        per_chain_host.groupBy("island_start")
        .agg(F.min("lo").alias("first_us"), F.max("hi").alias("last_us"), F.count(F.lit(1)).alias("host_count"), F.sum("n").alias("events"))
        .where(F.col("host_count") >= min_hosts)
        .select("island_start", "first_us", "last_us", (F.col("last_us") - F.col("first_us")).alias("duration_us"), "host_count", "events")
    )


def impossible_travel(signins: DataFrame, kmh: float = TRAVEL_KMH, keys=("actor",), us: str = "us", tie: str = "event_id") -> DataFrame:
    """Consecutive sign-ins of one actor whose distance over time beats the threshold; equal times are skipped."""
    known = signins.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    pairs = previous_values(known, list(keys), [us, tie], [us, "lat", "lon", "source_ip"], slot(us, DAY_US))
    hours = (F.col(us) - F.col("prev_" + us)) / F.lit(float(HOUR_US))
    km = haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    return (
        pairs.where(F.col("prev_" + us).isNotNull() & (F.col(us) > F.col("prev_" + us)))
        .withColumn("distance_km", km)
        .withColumn("velocity_kmh", km / hours)
        .where(F.col("velocity_kmh") > kmh)
        .select(*keys, tie, us, F.col("prev_source_ip").alias("from_ip"), F.col("source_ip").alias("to_ip"), "distance_km", "velocity_kmh")
    )


def prompt_bursts(events: DataFrame, denied: Column, approved: Column, prompts: int = MFA_PROMPTS, minutes: int = MFA_MINUTES, keys=("actor",), us: str = "us", tie: str = "event_id") -> DataFrame:
    """Moments an actor reaches `prompts` denials within the window, and whether an approval follows in it."""
    width = minutes * 60_000_000
    counted = trailing_count(events, list(keys), us, denied, width, "prompt_count")
    bursts = counted.where(denied & (F.col("prompt_count") >= prompts)).select(*keys, us, tie, "prompt_count")
    out = first_within(bursts, events.where(approved).select(*keys, us), list(keys), us, [], width, prefix="approved_")
    return out.withColumn("accepted_after_denials", F.col("approved_" + us).isNotNull()).drop("approved_" + us)


def mfa_fatigue(events: DataFrame, denied: Column, approved: Column, prompts: int = MFA_PROMPTS, minutes: int = MFA_MINUTES, keys=("actor",), us: str = "us", tie: str = "event_id") -> DataFrame:
    """One lead per actor: largest burst and whether any burst ended in an approval."""
    bursts = prompt_bursts(events, denied, approved, prompts, minutes, keys, us, tie)
    return bursts.groupBy(*keys).agg(
        F.max("prompt_count").alias("prompt_count"),
        F.min(us).alias("first_us"),
        F.bool_or("accepted_after_denials").alias("accepted_after_denials"),
    )


def number_rows(df: DataFrame, keys, order, bucket: Column, prefix: str, name: str = "row_id") -> DataFrame:
    """Ids such as ctr-0001 in order within each key."""
    out = dense_index(df, list(keys), list(order), bucket, "__n", start=1)
    return out.withColumn(name, F.format_string(prefix + "-%04d", F.col("__n"))).drop("__n")


def pair_positions(df: DataFrame, keys, pool: str, order, bucket: Column, sides=("A", "B")) -> DataFrame:
    """Match the i-th row of one pool with the i-th row of the other; leftovers stay alone."""
    placed = dense_index(df, [*keys, pool], list(order), bucket, "pair_no", start=1)
    rest = [c for c in df.columns if c not in (*keys, pool)]
    row = F.struct(*rest)
    return placed.groupBy(*keys, "pair_no").agg(
        F.max(F.when(F.col(pool) == sides[0], row)).alias("a"), F.max(F.when(F.col(pool) == sides[1], row)).alias("b")
    )


def latest_of_kind(audit: DataFrame, kind: str, value: str, keys=("case_id",), order: str = "seq") -> DataFrame:
    return audit.where(F.col("kind") == kind).groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def key_events(events: DataFrame, cap: int = 12, keys=("case_id",), us: str = "us", tie: str = "event_id") -> DataFrame:
    """First event per identical summary, entity-bearing ones first, at most `cap` per case in time order."""
    entity = F.size(F.map_filter("entities", lambda k, v: k.isin("account", "source_ip", "service_name", "logon_type_label") & (F.coalesce(v, F.lit("")) != ""))) > 0
    shown = events.where(F.col("significance").isin("finding_support", "triage_lead") | entity)
    rank = F.when(entity, 0).when(F.col("significance") == "triage_lead", 1).otherwise(2)
    first = shown.withColumn("priority", rank).groupBy(*keys, "summary").agg(F.min_by(F.struct(us, tie, "priority"), F.col(tie)).alias("e"))
    best = Window.partitionBy(*keys).orderBy("e.priority", "e." + us, "e." + tie)
    return first.withColumn("pick", F.row_number().over(best)).where(F.col("pick") <= cap).select(*keys, "summary", "e.*", "pick")


def dense_period(clusters: DataFrame, us: str = "first_us", keys=(), share: float = 0.2) -> DataFrame:
    """Contiguous months around the busiest one, each holding at least a fifth of it."""
    stamp = F.timestamp_micros(F.col(us))
    months = clusters.groupBy(*keys, (F.year(stamp) * 12 + F.month(stamp) - 1).cast("long").alias("month_no")).agg(F.count(F.lit(1)).alias("n"))
    # One row per month and key from here on.
    whole = Window.partitionBy(*keys)
    peak = F.min_by("month_no", F.struct((-F.col("n")).alias("a"), F.col("month_no").alias("b"))).over(whole)
    busy = months.withColumn("peak_n", F.max("n").over(whole)).withColumn("peak_month", peak)
    kept = busy.where(F.col("n") >= F.greatest(F.lit(1.0), F.col("peak_n") * share))
    run = F.col("month_no") - F.row_number().over(Window.partitionBy(*keys).orderBy("month_no"))
    grouped = kept.withColumn("run", run).groupBy(*keys, "run", "peak_month").agg(
        F.min("month_no").alias("from_month"), F.max("month_no").alias("to_month"), F.sum("n").alias("clusters")
    )
    return grouped.where("peak_month BETWEEN from_month AND to_month").select(*keys, "from_month", "to_month", "peak_month", "clusters")


# Order of attack phases.
PHASES = (
    "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "credential-access",
    "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
)


def attack_chain(findings: DataFrame, keys=("case_id", "host"), us: str = "us") -> DataFrame:
    """Findings in phase order, then time, numbered per host."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    placed = findings.withColumn("phase_rank", F.when(rank > 0, rank).otherwise(99).cast("long"))
    # Phase, then day, rises with the order and keeps one busy phase from being one bucket.
    bucket = F.col("phase_rank") * 10_000_000 + slot(us, DAY_US)
    return dense_index(placed, list(keys), ["phase_rank", us, "finding_id"], bucket, "step", start=1)
