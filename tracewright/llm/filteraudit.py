"""Filter interaction audit: what each filter removes in every order of application, by contracting a tensor of counts.

A document is a point of {pass, fail}^k for k filters. Per part of the table its documents are counted into a tensor of
shape 2 x ... x 2 (at most 2^k rows of a part leave Spark's aggregation). Every step of every order is then one
contraction of that tensor: along each axis a filter is held to pass, to fail, or to either.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions of a text: few words, repeated words, capitals, markup signs."""
    said = words(text)
    return {
        "A": F.size(said) < 100,
        "B": 100 * F.size(F.array_distinct(said)) < 80 * F.size(said),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def labelled(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, good, toxic) once per labelled id; an id with several label rows has what any of them says."""
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, A..E, n, good, toxic): counts of documents by part and by the filters that they fail, at most 32 rows a part.

    E holds where a smaller id of any part has the same text. The text is read once, where it lies; from there on rows hold
    its digest. Copies are counted together per (digest, part, label) before anything about them is compared, so a large
    group of copies is a few rows. Rows without id have no smaller one and no label; rows of one id do not make each other
    duplicates. A null text is empty, a null part the empty string.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("_digest"), *[rule.alias(k) for k, rule in text_rules(text).items()],
    )
    flags = list("ABCD")
    once = slim.groupBy("_id", "_digest", "part", *flags).agg(F.count("*").alias("n"))
    # Rows without id are dealt out by their digest; they meet no label.
    once = once.withColumns({"_none": F.col("_id").isNull(), "_hash": F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.col("_digest")))})
    marks = labelled(labels, id_col).withColumns({"_none": F.lit(False), "_hash": F.xxhash64(F.col("_id").cast("string"))})
    marked = once.join(marks.withColumnRenamed("_id", "_of"), ["_none", "_hash"], "left").withColumns({c: F.coalesce(F.col("_id") == F.col("_of"), F.lit(False)) & F.col(c) for c in ("good", "toxic")})
    group = ["_digest", "part", *flags, "good", "toxic"]
    first = F.struct("_id", "n")
    copies = marked.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.when(~F.col("_none"), first)).alias("first"), F.sum(F.when(F.col("_none"), F.col("n")).otherwise(0)).alias("unnamed"))
    # One row per (digest, part, label) by now: the smallest id over all of a digest's rows tells which of them hold it.
    least = F.min("first._id").over(Window.partitionBy("_digest"))
    copies = copies.withColumn("fresh", F.col("unnamed") + F.when(F.col("first._id") == least, F.col("first.n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("fresh").alias("m")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("fresh")).alias("m")))).alias("s")
    counted = copies.select("part", *flags, "good", "toxic", split).select("part", *flags, "s.E", "good", "toxic", "s.m")
    of = lambda c: F.sum(F.when(F.col(c), F.col("m")).otherwise(0)).alias(c)
    return counted.groupBy("part", *flags, "E").agg(F.sum("m").alias("n"), of("good"), of("toxic"))


def contractions(tensor: np.ndarray, names: Sequence[str]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every step of every order.

    `tensor` has one axis of two (pass, fail) per filter and a last one of (all, good, toxic) documents.
    """
    k = len(names)
    orders = list(permutations(range(k)))
    axes = ascii_letters[:k]
    formula = f"{axes}Z," + ",".join(f"Y{a}" for a in axes) + "->YZ"

    def contract(held: list[list[tuple[int, int]]]) -> np.ndarray:
        """Rows of (all, good, toxic) counts: one per list of what is held along each axis."""
        chosen = np.array(held, np.int64)
        return np.einsum(formula, tensor, *[chosen[:, a] for a in range(k)], optimize=k > 2)

    after, here, fails, alone = [], [], [], []
    for order in orders:
        for step, f in enumerate(order):
            earlier = set(order[:step])
            after.append([PASS if a in earlier or a == f else ALL for a in range(k)])
            here.append([PASS if a in earlier else FAIL if a == f else ALL for a in range(k)])
            fails.append([FAIL if a == f else ALL for a in range(k)])
            alone.append([FAIL if a == f else PASS for a in range(k)])
    kept, removed, failing, unique = (contract(x) for x in (after, here, fails, alone))
    share = np.zeros(k, np.int64)
    of = [f for order in orders for f in order]
    np.add.at(share, of, removed[:, 0])
    return [
        ("".join(names[f] for f in orders[i // k]), i % k + 1, int(kept[i, 0]), int(removed[i, 0]), int(failing[i, 0] - removed[i, 0]), int(unique[i, 0]), int(removed[i, 1]), int(removed[i, 2]), int(share[of[i]]))
        for i in range(factorial(k) * k)
    ]


def interactions(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """(part, filter_order, step, counts) of every order of the named filters, from (part, filter columns, n, good, toxic).

    A group handed to a task holds at most 2^k rows. `shapley` sums a filter's removals over all orders; divided by their
    number it is its Shapley value. A part's steps that remove nothing are there with zeros. Repeated rows add up.
    """
    columns = list(names)

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tensor = np.zeros((2,) * len(columns) + (3,), np.int64)
        for batch in batches:
            at = tuple(np.array(batch.column(c).to_pylist(), np.int64) for c in columns)
            np.add.at(tensor, at, np.stack([np.array(batch.column(c).to_pylist(), np.int64) for c in ("n", "good", "toxic")], axis=1))
        rows = list(zip(*contractions(tensor, columns)))
        part = pa.array([key[0].as_py()] * len(rows[0]), pa.string())
        yield pa.RecordBatch.from_arrays([part, pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:]]], names=["part", "filter_order", "step", *COUNTS])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return counted.groupBy("part").applyInArrow(work, schema)


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """The five text filters' interactions per part; no rows for an empty table. Further columns are not read."""
    return interactions(cells(docs, labels, part_col), "ABCDE")


CHECK_SQL = r"""
with recursive said as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
least as (select t, min(doc_id) as first from said group by t),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
flags as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(said.t, '[A-Z]')) > 10 * length(said.t),
     regexp_matches(said.t, '[#$%&*|]'), coalesce(said.doc_id > first, false)] as f
  from said join least on said.t = least.t left join marks on said.doc_id = marks.doc_id),
cells as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from flags group by part, f),
orders(o) as (select '' union all select o || c from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) as c) where not contains(o, c) and length(o) < 5),
steps as (select o, step, list_transform(range(1, step::int), lambda i: ascii(o[i::int]) - 64) as earlier, ascii(o[step::int]) - 64 as here
  from orders, (select unnest(range(1, 6)) as step) where length(o) = 5),
met as (select part, o, step, here, n, good, toxic, f[here] as fails,
    len(list_filter(earlier, lambda e: f[e])) > 0 as gone, len(list_filter(range(1, 6), lambda e: f[e])) = 1 as once
  from cells, steps),
rows as (select part, o, step, here, sum(case when not gone and not fails then n else 0 end) as kept, sum(case when not gone and fails then n else 0 end) as removed,
    sum(case when gone and fails then n else 0 end) as redundant, sum(case when fails and once then n else 0 end) as unique_fails,
    sum(case when not gone and fails then good else 0 end) as good_lost, sum(case when not gone and fails then toxic else 0 end) as toxic_lost
  from met group by part, o, step, here)
select part, o as filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, here))::bigint as shapley
from rows
"""
