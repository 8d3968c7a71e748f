"""Registry of queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tracewright.plans.evidence import evidence, table, with_evidence
from tracewright.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Source:
    """Tables of one data folder, given or derived, by attribute name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def __getattr__(self, name: str) -> DataFrame:
        return evidence(self.spark, self.folder, name)


def query(name: str, check: str | None = None, uses: tuple = ()):
    """Register a query; `check` is equivalent SQL over the evidence named in `uses`."""

    def register(build: Callable[[Source], DataFrame]):
        @wraps(build)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Source(prepare(spark), folder))

        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if check:
            CHECKS[name] = with_evidence(*uses, body=check)
        return build

    return register


def load_all() -> None:
    from tracewright.plans import custody_plans, disk_plans, fleet_plans, judging_plans, log_plans, source_plans, stream_plans, text_plans, traffic_plans  # noqa: F401
