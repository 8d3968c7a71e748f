"""Ordered operators that never put one whole key in one task.

A key may hold a third of all rows, so a plain window over the key would sort that share in one task.
Each function here cuts a key into buckets along its order, works inside the bucket, and passes only one
edge row per bucket across: as many rows as the key has buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def slot(us: str | Column, width: int) -> Column:
    """Bucket number of a microsecond column."""
    col = F.col(us) if isinstance(us, str) else us
    return F.floor(col / F.lit(width)).cast("long")


def _carried(edges: DataFrame, keys, bucket: str, value: str, name: str) -> DataFrame:
    """Per bucket, the value of the nearest earlier bucket that has one."""
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return edges.select(*keys, bucket, F.last(value, ignorenulls=True).over(over).alias(name)).where(F.col(name).isNotNull())


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on `keys` where two nulls are equal; the result has the left side's key columns."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def previous_values(df: DataFrame, keys, order, values, bucket: Column, prefix: str = "prev_") -> DataFrame:
    """Values of the preceding row along `order` within `keys`; `bucket` must rise with order[0]."""
    rows = df.withColumn("__b", bucket)
    packed = F.struct(*values)
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    edges = rows.groupBy(*keys, "__b").agg(F.max_by(packed, F.struct(*order)).alias("__last"))
    joined = null_safe_join(rows.withColumn("__in", F.lag(packed).over(inside)), _carried(edges, keys, "__b", "__last", "__carry"), [*keys, "__b"], "left")
    prev = F.coalesce("__in", "__carry")
    return joined.select(*df.columns, *[prev[v].alias(prefix + v) for v in values])


def dense_index(df: DataFrame, keys, order, bucket: Column, name: str, start: int = 0) -> DataFrame:
    """Gap-free position along `order` within `keys`. Null keys form a key of their own; rows without a bucket come last."""
    rows = df.withColumn("__b", bucket)
    sizes = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(F.col("__b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    numbered = null_safe_join(rows.withColumn("__rn", F.row_number().over(inside)), offsets, [*keys, "__b"])
    return numbered.select(*df.columns, (F.col("__rn") + F.col("__off") + F.lit(start - 1)).cast("long").alias(name))


def asof_before(left: DataFrame, right: DataFrame, keys, us: str, values, bucket_us: int = DAY_US, prefix: str = "r_") -> DataFrame:
    """Latest right row strictly earlier than each left row, per key; equal times do not match. A null key is a key like any other."""
    payload = F.struct(*[F.col(v) for v in values])
    left_side = left.select(*keys, us, F.lit(0).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("__r"))
    right_side = right.select(*keys, us, F.lit(1).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"), payload.alias("__r"))
    both = left_side.unionByName(right_side).withColumn("__b", slot(us, bucket_us))
    # Left rows sort ahead of right rows at the same time, so equality never matches.
    inside = Window.partitionBy(*keys, "__b").orderBy(us, "__side").rowsBetween(Window.unboundedPreceding, -1)
    edges = both.groupBy(*keys, "__b").agg(F.max_by("__r", F.when(F.col("__side") == 1, F.struct(F.col(us), F.col("__r")))).alias("__last"))
    rows = both.withColumn("__in", F.last("__r", ignorenulls=True).over(inside)).where("__side = 0")
    found = null_safe_join(rows, _carried(edges, keys, "__b", "__last", "__carry"), [*keys, "__b"], "left").withColumn("__hit", F.coalesce("__in", "__carry"))
    return found.select("__l.*", *[F.col("__hit")[v].alias(prefix + v) for v in values])


def first_within(left: DataFrame, right: DataFrame, keys, us: str, values, gap_us: int, prefix: str = "r_") -> DataFrame:
    """Earliest right row in (left, left + gap] for each left row; exact, with each right row in two buckets."""
    payload = F.struct(F.col(us).alias("__at"), *[F.col(v) for v in values])
    own = slot(us, gap_us)
    left_side = left.select(*keys, us, F.lit(1).alias("__side"), own.alias("__b"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("__r"))
    right_side = right.select(*keys, us, F.lit(0).alias("__side"), F.explode(F.array(own, own - 1)).alias("__b"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"), payload.alias("__r"))
    back = Window.partitionBy(*keys, "__b").orderBy(F.desc(us), F.desc("__side")).rowsBetween(Window.unboundedPreceding, -1)
    found = left_side.unionByName(right_side).withColumn("__hit", F.last("__r", ignorenulls=True).over(back)).where("__side = 1")
    near = F.when((F.col("__hit")["__at"] > F.col(us)) & (F.col("__hit")["__at"] <= F.col(us) + F.lit(gap_us)), F.col("__hit"))
    return found.withColumn("__hit", near).select(
        "__l.*", F.col("__hit")["__at"].alias(prefix + us), *[F.col("__hit")[v].alias(prefix + v) for v in values]
    )


def trailing_count(df: DataFrame, keys, us: str, flag: Column, width_us: int, name: str) -> DataFrame:
    """Flagged rows in [t - width, t] for each row; a flagged row enters its own bucket, and leaves the next one when it is too old.

    Both are running totals along the bucket, so the work doesn't grow with the number of rows in a window.
    """
    rows = df.withColumns({"__own": slot(us, width_us), "__flag": F.when(flag, 1).otherwise(0)})
    enters = F.struct(F.col("__own").alias("b"), F.col(us).alias("at"), F.col("__flag").alias("in"), F.lit(0).alias("out"))
    leaves = F.struct((F.col("__own") + 1).alias("b"), (F.col(us) + F.lit(width_us)).alias("at"), F.lit(0).alias("in"), F.lit(1).alias("out"))
    moved = rows.withColumn("__m", F.explode(F.when(F.col("__flag") == 1, F.array(enters, leaves)).otherwise(F.array(enters))))
    moved = moved.withColumns({"__b": F.col("__m.b"), "__at": F.col("__m.at")})
    bucket = Window.partitionBy(*keys, "__b")
    along = bucket.orderBy("__at")
    held = F.sum("__m.out").over(bucket) - F.coalesce(F.sum("__m.out").over(along.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = moved.withColumn(name, F.sum("__m.in").over(along.rangeBetween(Window.unboundedPreceding, 0)) + held)
    return counted.where("__b = __own").select(*df.columns, name)


def islands(cells: DataFrame, position: str, lo: str, hi: str, gap: int, block: int) -> DataFrame:
    """Chain rows, ordered by `position`, whose gap from the previous `hi` to `lo` is at most `gap`; adds island_start."""
    blocked = F.floor(F.col(position) / F.lit(block))
    chained = previous_values(cells, [], [position], [hi], blocked)
    fresh = chained.withColumn("__new", F.when(F.col("prev_" + hi).isNull() | (F.col(lo) - F.col("prev_" + hi) > gap), F.col(lo)))
    rows = fresh.withColumn("__b", blocked)
    inside = Window.partitionBy("__b").orderBy(position)
    edges = rows.groupBy("__b").agg(F.max("__new").alias("__last"))
    placed = rows.withColumn("__in", F.last("__new", ignorenulls=True).over(inside))
    carried = null_safe_join(placed, _carried(edges, [], "__b", "__last", "__carry"), ["__b"], "left")
    return carried.select(*cells.columns, F.coalesce("__in", "__carry").alias("island_start"))
