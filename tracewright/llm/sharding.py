"""Contiguous shards of equal bytes: global prefix sums of sizes from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import before_parts, ordered_parts, utf8

OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): rows in id order, cut where equal shares of the bytes end.

    A row goes to the shard that holds its middle byte, so a shard misses its target by less than one row at each
    end, and a row larger than a target leaves shards beside it empty. Only (id, size, crc) is moved: rows are
    range-partitioned once, each part's total is one row, and running sums stay inside parts. Nothing depends on how
    often a text occurs. Rows without id come first; ties of the id are ordered by crc and size, equal rows in any order.
    A null text has size `OVERHEAD` and crc 0. An empty table gives no rows.
    """
    raw = utf8(F.col(text_col))
    sized = docs.select(F.col(id_col).alias("key"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    order = [F.col("key").asc_nulls_first(), F.col("crc"), F.col("size")]
    parts = ordered_parts(sized, *order)
    before = before_parts(parts, bytes=F.sum("size"), rows=F.count("*"))
    # A handful of numbers: one row per part.
    total = parts.agg(F.sum("size")).first()[0] or 1
    inside = Window.partitionBy("_part").orderBy(*order)
    running = parts.withColumns({
        "_bytes": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
        "_row": F.row_number().over(inside) - 1,
    }).join(F.broadcast(before), "_part")
    middle = (F.col("bytes_before") + F.col("_bytes")) * 2 + F.col("size")
    placed = running.select(
        "key", "size", "crc", (F.col("rows_before") + F.col("_row")).alias("_row"),
        F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * total)).cast("int")).alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select(F.col("key").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
