"""Ordered reports and bounded listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.paths import base_name, is_webroot_script, slashed
from tracewright.operators.ordered import null_safe_join


def first_per_key(df: DataFrame, keys, order, k: int) -> DataFrame:
    """The first k rows in order of each key; without keys, of the whole table."""
    if not keys:
        return df.orderBy(*order).limit(k)
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(place)).where(F.col("__rank") <= k).drop("__rank")


def top_conversations(conv: DataFrame, k: int = 50, keys=()) -> DataFrame:
    """The k busiest conversations of each key (one capture or case)."""
    return first_per_key(conv, keys, [F.desc("packets"), "src", "dst", "dst_port", "proto"], k)


def top_requests(requests: DataFrame, k: int = 300, keys=()) -> DataFrame:
    """Per key: authenticated first, then submissions, then by frequency and key."""
    post = F.when(F.col("method") == "POST", 0).otherwise(1)
    return first_per_key(requests, keys, [F.desc("has_cookie"), post, F.desc("requests"), "host", "src", "dst", "method"], k)


def top_cookies(cookies: DataFrame, keys, k: int = 8) -> DataFrame:
    """The k longest distinct cookies per request group."""
    longest = Window.partitionBy(*keys).orderBy(F.desc(F.octet_length("value")), F.desc("name"), F.desc("value"))
    return cookies.dropDuplicates([*keys, "name", "value"]).withColumn("rank", F.row_number().over(longest)).where(F.col("rank") <= k)


def rank_counts(counts: DataFrame, count: str, name: str) -> DataFrame:
    return counts.orderBy(F.desc(count), name)


def capped(df: DataFrame, order, n: int, keys=()) -> DataFrame:
    """First n rows of each key in order, with the key's exact total and a truncation flag on each."""
    if keys:
        place = Window.partitionBy(*keys).orderBy(*order)
        cut = df.withColumn("__rank", F.row_number().over(place)).where(F.col("__rank") <= n).drop("__rank")
        totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
        return null_safe_join(cut, totals, list(keys)).withColumn("truncated", F.col("total") > n)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total", total).withColumn("truncated", F.col("total") > n)


def recent_history(history: DataFrame, n: int, us: str = "us", tie: str = "url", keys=()) -> DataFrame:
    """The n latest visits of each key; undated ones come last."""
    return first_per_key(history, keys, [F.desc_nulls_last(us), tie], n)


# Which logs, script folders and hives are read first.
CORE_LOGS = r"^(security|system)\.evtx$|sysmon|powershell"
SIGNAL_LOGS = r"^(application|forwardedevents)\.evtx$|^archive-security|taskscheduler|windows defender|winrm|wmi-activity|terminalservices|applocker"
WRITABLE_FOLDERS = r"(^|/)(uploads?|tmp|temp|cache|files|images|img|media|avatars|attachments|data)$"
DOCUMENT_ROOTS = r"(htdocs|wwwroot|public_html|www|webroot)$"
HIVE_ORDER = ("system", "software", "sam", "security", "ntuser.dat", "usrclass.dat")


def triage_rank(path: Column) -> Column:
    """Draw order inside a class: core logs, then named ones, then the provider tail; scripts where uploads land
    first, then in the document root; shortcuts with a staging tell first; hives in their fixed order."""
    low, name = slashed(path), base_name(path)
    folder = F.regexp_replace(low, "/?[^/]*$", "")
    log = F.when(name.rlike(CORE_LOGS), 0).when(name.rlike(SIGNAL_LOGS) | ~name.startswith("microsoft-windows-"), 1).otherwise(2)
    script = F.when(folder.rlike(WRITABLE_FOLDERS), 0).when(folder.rlike(DOCUMENT_ROOTS), 1).otherwise(2)
    recent = low.rlike("/(recent|nethood)/")
    link = F.when(recent & low.contains("staging"), 0).when(recent, 1).otherwise(2)
    hive = F.array_position(F.array(*[F.lit(h) for h in HIVE_ORDER]), name).cast("int")
    return (
        F.when(name.endswith(".evtx"), log)
        .when(is_webroot_script(path), script)
        .when(name.endswith(".lnk"), link)
        .when(hive > 0, hive - 1)
        .otherwise(0)
    )


def triage_order(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("rank", triage_rank(F.col(path))).orderBy("rank", path)


def round_robin(cands: DataFrame, n: int, keys=()) -> DataFrame:
    """Per tier, one candidate of each class per pass; classes of equal priority share one queue."""
    queue = Window.partitionBy(*keys, "tier", "class_priority").orderBy("sub_rank", "partition_rank", "path")
    turn = cands.withColumn("turn", F.row_number().over(queue)).where(F.col("turn") <= n)
    if not keys:
        return turn.orderBy("tier", "turn", "class_priority", "path").limit(n)
    picked = Window.partitionBy(*keys).orderBy("tier", "turn", "class_priority", "path")
    return turn.withColumn("pick", F.row_number().over(picked)).where(F.col("pick") <= n)
