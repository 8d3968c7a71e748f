"""Writers: result tables as files, written by tasks in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column order of the timeline file.
TIMELINE_COLUMNS = (
    "event_id", "timestamp_utc", "artifact_class", "tool_call_id", "summary", "significance", "linked_finding_ids",
    "confidence", "entities", "source_record_ref",
)


def write_timeline(timeline: DataFrame, path: str) -> None:
    """Timeline as CSV parts in time order; lists and maps are written as JSON text."""
    nested = {c: F.to_json(c) for c, t in timeline.dtypes if t.startswith(("array", "map", "struct"))}
    flat = timeline.withColumns(nested) if nested else timeline
    missing = {c: F.lit(None).cast("string") for c in TIMELINE_COLUMNS if c not in flat.columns}
    flat = (flat.withColumns(missing) if missing else flat).select(*TIMELINE_COLUMNS)
    flat.orderBy("timestamp_utc", "event_id").write.mode("overwrite").option("header", True).csv(path)


def write_fleet(results: dict[str, DataFrame], path: str) -> None:
    """Fleet correlation results, one JSON folder per table."""
    for name, df in results.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def benchmark_rows(runs: DataFrame, spec: dict, keep=()) -> DataFrame:
    """One row per run; each column takes the first field that has a value, fields that do not exist are skipped."""
    out = []
    for name, fields in spec.items():
        have = [F.col(f) for f in fields if f in runs.columns]
        out.append((F.coalesce(*have) if have else F.lit(None).cast("string")).alias(name))
    return runs.select(*keep, *out)


def write_benchmark(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
