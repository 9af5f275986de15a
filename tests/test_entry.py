import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows_and_a_schema(spark):
    result = entry.entry(spark)
    assert result.columns == ["window_start_us", "dst_ip", "confidence", "is_threat", "severity"] and result.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


# The whole set runs in tools/check_oracles.py; these cover each area on the smallest tables
@pytest.mark.parametrize("name", ["packet_view", "window_fan_in", "window_vertical_scan", "flow_segments", "flow_active_chain", "domain_dga_signals",
                                  "client_hello_decode", "alert_cooldown", "topology_edges", "response_rules", "host_interval_label_join", "hybrid_merge"])
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert compare(entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()) == ""
