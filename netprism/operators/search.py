"""Filters over stacked objects and the keyword index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .graph import first_rows


def explore(rows: DataFrame, category: str | None = None, text: str | None = None, status: str | None = None, high_value: bool | None = None) -> DataFrame:
    """Object rows by category, by a substring anywhere in the row, by evidence status and by value."""
    df = rows
    if category:
        df = df.filter(F.col("category") == category)
    if text:
        df = df.filter(F.lower(F.to_json(F.struct("*"))).contains(text.lower()))
    if status:
        df = df.filter(F.col("status") == status)
    if high_value is not None:
        df = df.filter(F.col("high_value") == high_value)
    return df


def filter_events(events: DataFrame, kind: str | None = None, severity: str | None = None, text: str | None = None) -> DataFrame:
    df = events
    if kind:
        df = df.filter(F.col("type") == kind)
    if severity:
        df = df.filter(F.col("severity") == severity)
    if text:
        low = text.lower()
        df = df.filter(F.lower(F.coalesce("client", F.lit(""))).contains(low) | F.lower(F.coalesce("detail", F.lit(""))).contains(low))
    return df


def tenant_rows(df: DataFrame, tenant: str) -> DataFrame:
    """Rows of one tenant; rows without a tenant belong to the reader's own."""
    return df.filter(F.coalesce("tenant_id", F.lit(tenant)) == tenant)


def sanitize(df: DataFrame) -> DataFrame:
    """Drop rows without any value and give every row an evidence struct."""
    df = df.dropna(how="all")
    if "evidence" not in df.columns:
        return df
    kind = df.schema["evidence"].dataType.simpleString()
    empty = F.from_json(F.lit("{}"), kind)
    return df.withColumn("evidence", F.coalesce("evidence", empty))


def terms(text: Column) -> Column:
    """Lower-case terms of three or more characters, without edge punctuation."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./:-]{3,}"), F.lit(0))
    return F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[_:\-./]+|[_:\-./]+$", ""))


def keyword_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Count of every index term; stop words and numbers are left out."""
    word = F.col("term")
    return docs.select(F.explode(terms(F.col(text_col))).alias("term")).filter(
        (word != "") & ~word.rlike(r"^\d+$") & ~word.isin(*fv.STOP_WORDS)).groupBy("term").agg(F.count("*").alias("count"))


def top_keywords(docs: DataFrame, text_col: str, limit: int | None = None) -> DataFrame:
    return keyword_counts(docs, text_col).transform(first_rows, limit, F.col("count").desc(), "term")


def category_counts(docs: DataFrame, category: str, limit: int | None = None) -> DataFrame:
    return docs.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("count")).transform(first_rows, limit, F.col("count").desc(), "category")
