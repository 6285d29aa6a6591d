"""Table sinks: one folder per table, a manifest, CSV export and report bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import file_manifest, read_binary


def write_tables(tables: dict[str, DataFrame], folder: str, partition: str | None = "tenant_id", fmt: str = "parquet") -> None:
    """Write each table below its own name, partitioned where the column exists."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        if partition and partition in df.columns:
            writer = writer.partitionBy(partition)
        writer.save(f"{folder}/{name}")


def write_manifest(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Hash every file below a folder and store the manifest."""
    file_manifest(read_binary(spark, folder)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def export_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    """Newest rows as CSV with a header."""
    rows = df.orderBy(F.col("id").desc())
    (rows if limit is None else rows.limit(limit)).write.mode("overwrite").option("header", True).csv(path)


# fixed values: report kind -> tables
REPORTS = {
    "executive": ["policy_risk", "findings", "quality_score"], "technical": ["policy_diff", "interfaces", "vlans", "acl_rules", "vlan_crosscheck"],
    "security": ["findings", "security_hardening", "acl_rules", "risk_atoms"], "audit": ["audit_log", "evidence_registry"], "compliance": ["compliance_matrix", "policy_controls"],
    "quality": ["quality_matrix", "diagnostics", "signoff"], "wireless": ["client_matrix", "ap_load", "anomalies", "playbooks"],
}


def report_tables(tables: dict[str, DataFrame], kind: str) -> dict[str, DataFrame]:
    """The tables of one report; unknown kinds get the technical set."""
    wanted = REPORTS.get(kind, REPORTS["technical"])
    return {n: tables[n] for n in wanted if n in tables}


def write_tagged(rows: DataFrame, folder: str, tag: str = "table", mode: str = "overwrite") -> None:
    """Rows of many tables in one pass: a folder for each value of the tag; a task writes a file for each table it meets."""
    rows.write.mode(mode).partitionBy(tag).parquet(folder)


def read_tagged(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, tag: str = "table") -> DataFrame:
    """One table of `write_tagged`: only its folder is read, without the columns that it leaves empty if they are named."""
    rows = spark.read.parquet(folder).filter(F.col(tag) == name).drop(tag)
    return rows if columns is None else rows.select(*columns)
