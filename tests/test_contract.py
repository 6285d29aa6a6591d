"""The driver contract, and a sample of the registered queries against their SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, canonical

SF = "/root/testdata/sf0.001"
SAMPLE = ["extract_vlans", "extract_trunk_operational", "wireless_client_matrix", "wireless_anomalies", "wireless_client_state", "policy_diff", "vlan_crosscheck", "graph_components",
          "graph_attack_paths", "tree_interfaces", "merge_interface_enrichment", "audit_login_window", "lab_client_matrix", "findings_analysis", "stream_run_client_state",
          "subnet_of_address", "source_intake", "tree_lab_tables"]


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 150


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    spark_rows = canonical(entry.queries()[name](spark, SF).toPandas())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert spark_rows == canonical(con.execute(entry.oracle_sql()[name]).df())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert {"file_id", "id", "status", "severity"} <= set(df.columns)
