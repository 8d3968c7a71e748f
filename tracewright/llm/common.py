"""Column rules, a global row order and task helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.session import cut_lineage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; a null text has none."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)).cast("int")


def by_tasks(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows that the task function makes of the batches. Workers outlive their tasks, so unused batch memory is given back."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidy, schema)


def text_column(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], pick: Callable[[pa.RecordBatch], Iterable], kind: str, missing=None) -> Callable[[Column], Column]:
    """A column function of texts out of a task function over (key, text): what `pick` finds in the row of that text."""

    def values(texts: pd.Series) -> pd.Series:
        out = [missing] * len(texts)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string(), from_pandas=True)], names=["key", "text"])
        for found in work(iter([batch])):
            for key, value in zip(found.column(0).to_pylist(), pick(found)):
                out[key] = value
        return pd.Series(out)

    values.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(values, kind)


def ordered_parts(df: DataFrame, *order: Column) -> DataFrame:
    """Rows range-partitioned by `order` and written once, with their part number as `_part`.

    The parts follow one another in the order, so a global order needs only one summary row per part. The written
    copy keeps part numbers fixed when tasks are run again. Give it slim rows.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def before_parts(parts: DataFrame, **totals: Column) -> DataFrame:
    """Per part of `ordered_parts`: for each named sum, what the parts before it hold. One row per part."""
    sums = parts.groupBy("_part").agg(*[v.alias(k) for k, v in totals.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).cast("long").alias(f"{k}_before") for k in totals])


BLANK = re.compile(r"\s")


def spans(text: str, size: int, stops: re.Pattern = BLANK) -> Iterator[tuple[int, int]]:
    """Cuts of a text into spans of about `size` characters, each behind a character that `stops` matches.

    What lies between two stops is never cut: where a span holds no stop it runs on to the next one.
    """
    start = 0
    while len(text) - start > size:
        end = start + size
        while end > start and not stops.match(text, end - 1):
            end -= 1
        if end == start:
            later = stops.search(text, start + size)
            end = later.end() if later else len(text)
        yield start, end
        start = end
    if start < len(text):
        yield start, len(text)


def pieces(texts: Iterable[str], size: int = 1 << 19, stops: re.Pattern = BLANK) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Groups of (text numbers, offsets, text pieces) of about `size` characters; longer texts are cut behind `stops` only."""
    numbers, offsets, group, held = [], [], [], 0
    for i, text in enumerate(texts):
        for start, end in spans(text, size, stops):
            numbers.append(i)
            offsets.append(start)
            group.append(text[start:end])
            held += end - start
            if held >= size:
                yield numbers, offsets, group
                numbers, offsets, group, held = [], [], [], 0
    if group:
        yield numbers, offsets, group


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, fold: tuple[int, int], per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """(key, text, y) of at most `per_class` rows of each label value, and per value (rows there are, rows taken).

    Rows of the held-out fold (folds, remainder) are never read. The choice follows a hash of the id, so it is the same
    in every run. The chosen ids are broadcast: two times `per_class` rows at most.
    """
    folds, held_out = fold
    known = labels.filter(F.col(value).isin(0, 1) & F.col(id_col).isNotNull() & (fold_of(F.col(id_col), folds) != held_out))
    known = known.groupBy(F.col(id_col).alias("key")).agg(F.max(value).cast("int").alias("y"))
    there = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    sample = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key")
    return sample, {y: (n, min(n, per_class)) for y, n in there.items()}
