"""Every registered query against its check SQL at the smallest scale, and contract checks."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import compare
from tracewright.plans import catalog
from tracewright.plans.evidence import TABLES
from tracewright.session import broadcast_if_small, cut_lineage

FOLDER = "/root/testdata/sf0.001"
# Thresholds of these are not reached by the smallest tables.
MAY_BE_EMPTY = {"failed_logon_bursts", "management_children", "brute_force", "prompt_bursts", "mfa_fatigue", "stream_bursts", "archive_staging", "extracted_iocs", "document_addresses", "network_filter", "service_recon", "hacking_tools", "local_accounts"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    note, fine = compare(spark, con, name, FOLDER)
    assert fine or (name in MAY_BE_EMPTY and " n=0" in note), note


def test_entry_and_names(spark):
    assert entry_module.entry(spark).columns == ["first_us", "last_us", "duration_us", "host_count", "events"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_lineage_and_broadcast_helpers(spark):
    assert cut_lineage(spark.range(3)).count() == 3
    assert "BroadcastHint" not in broadcast_if_small(spark.range(10), limit=5)._jdf.queryExecution().toString()
    assert "broadcast" in broadcast_if_small(spark.range(3), limit=5)._jdf.queryExecution().toString().lower()
