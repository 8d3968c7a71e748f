"""Harmonic packing: token pieces fall into reciprocal-capacity classes and each class fills its sequences by count.

A piece of class k is at most capacity / k long, so any k of them share a sequence and no bin search is needed. As
documents may be cut, a length that would leave its class slot part empty first gives off pieces that fill a slot of
the next classes exactly. Classes are filled independently: a piece needs only its running number within its class,
which comes from one count per task and class. What is left, under k pieces of each class, is bounded by the class
count and packed by best fit in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import by_tasks
from tracewright.llm.tokens import chunk_ids
from tracewright.session import cut_lineage

CLASSES = 256


def cuts(length: int, capacity: int, classes: int, waste: int = 32) -> list[tuple[int, int, int]]:
    """(start, length, class) pieces of a document; a slot's waste stays under 1/waste of a piece, or below capacity/classes."""
    out, start = [], 0
    while length > start:
        left = length - start
        k = max(1, min(classes, capacity // left))
        slot = capacity // k
        if left >= capacity:
            take = capacity
        elif k == classes or (slot - left) * waste <= left:
            take = left
        else:
            k += 1
            take = min(left, capacity // k)
        out.append((start, take, k))
        start += take
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, classes: int = CLASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, class) of all documents; a null text has only the end id."""
    tail = end_id.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_ids(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = known.of(text.as_py() or "") + tail
                n = len(ids) // 4
                for start, length, k in cuts(n, capacity, classes):
                    out.append((key, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), n, k))
            cols = list(zip(*out)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "start", "length", "ids_crc32", "doc_tokens", "cls"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return by_tasks(slim, work, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, cls int")


def best_fit(capacity: int):
    """Task function that packs the bounded rest of all classes, longest first into the tightest open sequence."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])]
        rows.sort(key=lambda r: (-r[1], r[0]))
        room: list[tuple[int, int]] = []
        filled: list[int] = []
        out = []
        for row, length in rows:
            at = bisect_left(room, (length, -1))
            if at < len(room):
                free, seq = room.pop(at)
            else:
                free, seq = capacity, len(filled)
                filled.append(0)
            out.append((row, seq, filled[seq]))
            filled[seq] += length
            insort(room, (free - length, seq))
        cols = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["_row", "sequence_id", "offset"])

    return work


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, classes: int = CLASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    Null and empty texts hold the end id alone. Repeated rows are packed each for itself, also under one id; ties in
    a class follow the input's task and row order. Other columns are not read. An empty table gives no rows.
    """
    pieces = cut_pieces(docs, tokenizer, capacity, end_id, classes, id_col, text_col)
    # Written once: the texts are tokenized a single time, and row and task numbers stay as they are.
    pieces = cut_lineage(pieces.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = pieces.groupBy("cls", "_part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("cls").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("cls", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # At most `classes` rows: how many sequences each class fills, and where its numbers begin.
    full = counts.groupBy("cls").agg((F.sum("n") - F.sum("n") % F.col("cls")).alias("whole"))
    bins = F.expr("whole div cls")
    full = full.withColumns({
        "first": F.coalesce(F.sum(bins).over(Window.orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "above": F.sum(bins).over(Window.orderBy("cls").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    place = Window.partitionBy("_part", "cls").orderBy("_row")
    numbered = (
        pieces.withColumn("_in_part", F.row_number().over(place) - 1)
        .join(before, ["cls", "_part"])
        .join(F.broadcast(full), "cls")
        .withColumn("_index", F.col("before") + F.col("_in_part"))
    )
    kept = ["key", "start", "length", "ids_crc32", "doc_tokens", "_row"]
    inside = Window.partitionBy("sequence_id").orderBy("_index").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        numbered.filter("_index < whole")
        .withColumn("sequence_id", F.col("first") + F.expr("_index div cls"))
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
        .select(*kept, "sequence_id", "offset")
    )
    rest = numbered.filter("_index >= whole").select(*kept, "above")
    packed = by_tasks(rest.select("_row", "length").coalesce(1), best_fit(capacity), "_row long, sequence_id long, offset long")
    packed = rest.join(packed, "_row").withColumn("sequence_id", F.col("sequence_id") + F.col("above"))
    out = filled.unionByName(packed.select(*kept, "sequence_id", "offset"))
    return out.select(F.col("key").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long"), F.col("offset").cast("long"))
