"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A rule or lookup table is broadcast only up to this many rows.
BROADCAST_ROW_LIMIT = 200_000


def build_session(app: str = "tracewright", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs; on a cluster the submit command supplies master and sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every job here relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Rows may be whole documents: a Python worker holds some copies of a batch at a time.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir; a temporary one only in local runs without it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="tracewright-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint a DataFrame in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast when a count proves the side small; otherwise leave the join to the optimizer."""
    small = df.select(F.lit(1)).limit(limit + 1).count() <= limit
    return F.broadcast(df) if small else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over all cores when the input has fewer splits than that; large inputs pass through unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
