"""Hash chains, login windows, fingerprints and newest-first lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import carry_forward

GENESIS = "GENESIS"
CHAIN_FIELDS = ["created_at", "actor", "action", "target", "detail", "severity", "tenant_id"]


def entry_hash(previous: Column, *fields: Column) -> Column:
    return F.sha2(F.concat_ws("|", previous, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def verify_chain(log: DataFrame, key: str = "tenant_id", order: str = "id", fields: list[str] | None = None, chunk: int = 100_000) -> DataFrame:
    """Check every row of a hash chain against the last hash before it; rows without a hash are skipped.

    The last hash is carried in chunks of ids, so one long chain is no single task.
    """
    df = carry_forward(log, {"_previous": F.col("entry_hash")}, key=key, order=order, chunk=chunk, inclusive=False)
    expected = entry_hash(F.coalesce("_previous", F.lit(GENESIS)), *[F.col(f) for f in (fields or CHAIN_FIELDS)])
    linked = F.coalesce(F.col("prev_hash") == F.coalesce("_previous", F.lit(GENESIS)), F.lit(False))
    status = F.when(F.col("entry_hash").isNull(), "skipped").when((F.col("entry_hash") == expected) & linked, "valid").otherwise("broken")
    return df.select(*log.columns, expected.alias("expected_hash"), status.alias("status"))


def chain_summary(verified: DataFrame, key: str = "tenant_id") -> DataFrame:
    return verified.groupBy(key).agg(
        F.count("*").alias("checked"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") == "broken").alias("broken"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.min(F.when(F.col("status") == "broken", F.col("id"))).alias("first_broken"))


def failures_before(attempts: DataFrame, key: str, seconds: int = 900, only_failed: Column | None = None) -> DataFrame:
    """Per attempt: failures of the same key in the window that ends at it.

    Attempts are first counted per key and second. Time is cut into windows of
    `seconds`; each second goes to its own window and the next one, so that a
    hot key is spread over time and every window holds all it needs.
    """
    failed = only_failed if only_failed is not None else ~F.col("ok")
    at = F.col("created_at").cast("timestamp").cast("long")
    per_second = attempts.groupBy(F.col(key).alias("_k"), at.alias("_t")).agg(F.count_if(failed).alias("_f"))
    bucket = F.floor(F.col("_t") / seconds)
    spread = per_second.select("_k", "_t", "_f", F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    window = Window.partitionBy("_k", "_b").orderBy("_t").rangeBetween(-seconds, 0)
    counted = spread.withColumn("failures", F.sum("_f").over(window)).filter(F.floor(F.col("_t") / seconds) == F.col("_b"))
    return attempts.withColumn("_t", at).join(counted.select(F.col("_k").alias(key), "_t", "failures"), [key, "_t"]).drop("_t")


def login_allowed(attempts: DataFrame, limit: int = 5, seconds: int = 900) -> DataFrame:
    """Failures by user or by address in the last window: user + address - both."""
    # as the login form does: names in lower case, what is missing is "unknown"
    user = F.coalesce(F.nullif(F.lower(F.trim("username")), F.lit("")), F.lit("unknown"))
    address = F.coalesce(F.nullif(F.trim("ip_address"), F.lit("")), F.lit("unknown"))
    marked = attempts.withColumns({"_user": user, "_address": address}).withColumn("_pair", F.struct("_user", "_address"))
    a = failures_before(marked, "_user", seconds).withColumnRenamed("failures", "by_user")
    b = failures_before(a, "_address", seconds).withColumnRenamed("failures", "by_ip")
    c = failures_before(b, "_pair", seconds).withColumnRenamed("failures", "by_pair")
    recent = F.col("by_user") + F.col("by_ip") - F.col("by_pair")
    return c.select(*attempts.columns, "by_user", "by_ip", "by_pair", recent.alias("recent_failures"), (recent < limit).alias("allowed"))


def audit_search(log: DataFrame, text: str = "", action: str = "", actor: str = "", severity: str = "", limit: int | None = None) -> DataFrame:
    """Rows matching all given filters, newest first."""
    df = log
    if text:
        p = f"%{text}%"
        df = df.filter(F.col("actor").like(p) | F.col("action").like(p) | F.col("target").like(p) | F.col("detail").like(p))
    if action:
        df = df.filter(F.col("action").like(f"%{action}%"))
    if actor:
        df = df.filter(F.col("actor").like(f"%{actor}%"))
    if severity:
        df = df.filter(F.col("severity") == severity)
    df = df.orderBy(F.col("id").desc())
    return df if limit is None else df.limit(limit)


def fingerprint_counters(events: DataFrame, fingerprint: Column) -> DataFrame:
    return events.groupBy(fingerprint.alias("fingerprint")).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("seen"))


def poll(events: DataFrame, since_id: int, limit: int = 500) -> DataFrame:
    """Events after an id, oldest first: one page of an incremental reader."""
    return events.filter(F.col("id") > since_id).orderBy("id").limit(limit)


def newest(df: DataFrame, order: str, limit: int) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(limit)
