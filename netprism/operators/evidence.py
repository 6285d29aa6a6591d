"""Evidence registry, coverage and quality of stacked object rows.

Object rows are `scope columns, category, name, source_line, source_path,
confidence, source`. `scope` names the grouping columns of one import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv

STATUSES = ["verified", "recovered", "inferred", "unmapped"]


def C(name: str) -> Column:
    return F.col(name)


def _located() -> Column:
    return F.coalesce(C("source_line") > 0, F.lit(False)) | (F.coalesce("source_path", F.lit("")) != "")


def evidence_status() -> Column:
    """How well a row is backed: a line or path with confidence, a recovery, a derivation, or nothing."""
    conf = F.coalesce("confidence", F.lit(0.0))
    source = F.lower(F.coalesce("source", F.lit("")))
    return (
        F.when(_located(), F.when(conf >= 0.78, "verified").otherwise("recovered"))
        .when(C("category").isin(*fv.RECOVERED_TABLES) | source.contains("native") | source.contains("reconstructed"), "recovered")
        .when(C("category").isin(*fv.INFERRED_TABLES), "inferred").otherwise("unmapped"))


def source_type() -> Column:
    return (F.when(C("source_line") > 0, "line").when(F.coalesce("source_path", F.lit("")) != "", "path")
            .when(F.coalesce("source", F.lit("")) != "", "derived").otherwise("unmapped"))


def build_registry(objects: DataFrame, high_value: list[str] | None = None) -> DataFrame:
    """One row per object with status, source type and value class."""
    values = fv.HIGH_VALUE_TABLES if high_value is None else high_value
    return objects.withColumns({
        "status": evidence_status(), "source_type": source_type(), "confidence": F.round(F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5)), 3),
        "high_value": C("category").isin(*values)})


def registry_summary(registry: DataFrame, scope: list[str], weight: str | None = None) -> DataFrame:
    """Totals per status with verified ratios. With `weight`, a row stands for as many objects as that column says."""
    verified = C("status") == "verified"
    one = F.lit(1) if weight is None else C(weight)
    n = lambda test: F.coalesce(F.sum(F.when(test, one).otherwise(0)), F.lit(0)).cast("long")
    ratio = lambda a, b: F.round(F.coalesce(C(a) / F.nullif(C(b), F.lit(0)), F.lit(0.0)), 3)
    return registry.groupBy(*scope).agg(
        n(F.lit(True)).alias("total"), *[n(C("status") == s).alias(s) for s in STATUSES],
        n(C("high_value")).alias("high_value_total"), n(C("high_value") & verified).alias("high_value_verified"),
    ).withColumns({"verified_ratio": ratio("verified", "total"), "high_value_verified_ratio": ratio("high_value_verified", "high_value_total")})


def status_by_category(registry: DataFrame, scope: list[str], weight: str | None = None) -> DataFrame:
    """Objects per status. With `weight`, a row stands for as many objects as that column says."""
    return registry.groupBy(*scope, "category").pivot("status", STATUSES).agg(F.count(F.lit(1)) if weight is None else F.sum(weight)).na.fill(0).withColumn(
        "total", C("verified") + C("recovered") + C("inferred") + C("unmapped"))


def object_counts(objects: DataFrame, scope: list[str]) -> DataFrame:
    """Rows per table, with the rows that carry a line or path."""
    return objects.groupBy(*scope, "category").agg(F.count("*").alias("objects"), F.count_if(_located()).alias("line_mapped"))


def count_breakdown(counts: DataFrame, scope: list[str]) -> DataFrame:
    """Real network objects apart from support evidence."""
    real = C("category").isin(*fv.REAL_TABLES)
    return counts.groupBy(*scope).agg(
        F.coalesce(F.sum(F.when(real, C("objects"))), F.lit(0)).alias("real_objects"), F.coalesce(F.sum(F.when(~real, C("objects"))), F.lit(0)).alias("evidence_entries"),
        F.sum("objects").alias("total_entries"))


def evidence_profile(counts: DataFrame, scope: list[str]) -> DataFrame:
    """Mapping ratio and the import confidence formula."""
    of = lambda k: F.coalesce(F.sum(F.when(C("category") == k, C("objects"))), F.lit(0))
    one = counts.groupBy(*scope).agg(F.sum("objects").alias("total"), F.sum("line_mapped").alias("mapped"), of("raw_evidence").alias("raw"),
                                     of("deep_evidence_index").alias("deep"), of("command_blocks").alias("commands"))
    ratio = F.round(C("mapped") / C("total"), 3)
    native = C("mapped") / (C("mapped") + 2)
    mixed = ratio * 0.62 + F.least("raw", F.lit(80)) / 80 * 0.18 + F.least("deep", F.lit(120)) / 120 * 0.12 + F.least("commands", F.lit(8)) / 8 * 0.08
    return one.select(*scope, "total", "mapped", "raw", "deep", "commands", ratio.alias("line_mapping_ratio"),
                      F.least(F.lit(0.99), F.round(F.greatest(native, mixed), 3)).alias("confidence"))


def _membership(groups: list[tuple[str, list[str]]]) -> Column:
    """The groups a table belongs to, as one constant lookup."""
    tables = sorted({t for _, ts in groups for t in ts})
    pairs = [x for t in tables for x in (F.lit(t), F.array(*[F.lit(g) for g, ts in groups if t in ts]))]
    return F.try_element_at(F.create_map(*pairs), C("category"))


def _per_group(counts: DataFrame, scope: list[str], scopes: DataFrame, groups: list[tuple[str, list[str]]], name: str) -> DataFrame:
    found = counts.select(*scope, "objects", "line_mapped", F.explode(_membership(groups)).alias(name)).groupBy(*scope, name).agg(
        F.sum("objects").alias("objects"), F.sum("line_mapped").alias("line_mapped"))
    every = scopes.select(*scope, F.explode(F.array(*[F.lit(g) for g, _ in groups])).alias(name))
    return every.join(found, [*scope, name], "left").na.fill(0, ["objects", "line_mapped"])


def coverage_domains(counts: DataFrame, scopes: DataFrame, scope: list[str]) -> DataFrame:
    n = C("objects")
    return _per_group(counts, scope, scopes, fv.COVERAGE_DOMAINS, "domain").select(
        *scope, "domain", "objects", F.when(n >= 8, "excellent").when(n >= 3, "good").when(n > 0, "needs_more_evidence").otherwise("missing").alias("status"))


def extraction_completeness(counts: DataFrame, scopes: DataFrame, scope: list[str]) -> DataFrame:
    n = C("objects")
    score = F.when(n == 0, 0).otherwise(F.least(F.lit(100), F.lit(45) + F.least(n, F.lit(25)) * 2 + F.least(C("line_mapped"), F.lit(20))))
    return _per_group(counts, scope, scopes, fv.COMPLETENESS_FAMILIES, "family").select(
        *scope, "family", "objects", "line_mapped", score.cast("int").alias("score"),
        F.when(score >= 80, "strong").when(score >= 50, "partial").otherwise("missing").alias("status"))


def quality_matrix(counts: DataFrame, by_category: DataFrame, scopes: DataFrame, scope: list[str]) -> DataFrame:
    """Eleven categories per scope with status and the claim they allow."""
    spec = F.array(*[F.struct(F.lit(t).alias("category"), F.lit(label).alias("label"), F.lit(crit).alias("critical")) for t, label, crit in fv.QUALITY_CATEGORIES])
    every = scopes.select(*scope, F.explode(spec).alias("s")).select(*scope, "s.*")
    df = every.join(counts.select(*scope, "category", "objects"), [*scope, "category"], "left").join(by_category, [*scope, "category"], "left").na.fill(
        0, ["objects", "total", *STATUSES])
    ratio = F.round(F.coalesce(C("verified") / F.nullif(C("total"), F.lit(0)), F.lit(0.0)), 3)
    df = df.withColumn("verified_ratio", ratio)
    claim = (F.when(C("objects") <= 0, "not_available").when((C("verified") > 0) & (C("verified_ratio") >= 0.70), "verified")
             .when(C("verified") > 0, "partially_verified").when(C("recovered") > 0, "recovered_native").otherwise("unmapped"))
    return df.withColumn("claim_level", claim).withColumn(
        "status", F.when(C("claim_level") == "not_available", "missing").when(C("claim_level") == "verified", "pass").otherwise("review"))


def quality_score(matrix: DataFrame, scope: list[str]) -> DataFrame:
    missing, review = C("status") == "missing", C("status") == "review"
    one = matrix.groupBy(*scope).agg(
        F.count_if(C("status") == "pass").alias("passed"), F.count_if(review).alias("review"), F.count_if(missing).alias("missing"),
        F.count_if(missing & C("critical")).alias("critical_missing"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - C("critical_missing") * 18 - (C("missing") - C("critical_missing")) * 8 - C("review") * 5))
    return one.withColumn("score", score).withColumn("grade", F.when(C("score") >= 90, "Evidence-ready").when(C("score") >= 70, "Reportable with caveats")
                                                     .when(C("score") >= 45, "Needs companion exports").otherwise("Insufficient evidence"))


def _wide(counts: DataFrame, scopes: DataFrame, scope: list[str], tables: list[str]) -> DataFrame:
    """One row per scope with a count column per named table."""
    wide = counts.filter(C("category").isin(*tables)).groupBy(*scope).pivot("category", tables).agg(F.sum("objects"))
    return scopes.select(*scope).join(wide, scope, "left").na.fill(0)


def diagnostics(counts: DataFrame, summary: DataFrame, scopes: DataFrame, scope: list[str]) -> DataFrame:
    """Blockers per scope with severity."""
    wide = _wide(counts, scopes, scope, ["interfaces", "vlans", "cdp_links", "lldp_links"]).join(summary, scope, "left")
    b = lambda test, id_, sev: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(id_).alias("id"), F.lit(sev).alias("severity")))
    rows = F.array(
        b((C("total") > 0) & (C("high_value_verified_ratio") < 0.75), "EVIDENCE-HIGH-VALUE-LOW", "Medium"), b(C("interfaces") == 0, "NO-INTERFACES", "High"),
        b(C("vlans") == 0, "NO-VLANS", "Medium"), b(C("cdp_links") + C("lldp_links") == 0, "NO-L2-NEIGHBORS", "Low"))
    return wide.select(*scope, F.inline(F.filter(rows, lambda x: x.isNotNull())))


def readiness(counts: DataFrame, summary: DataFrame, scopes: DataFrame, scope: list[str]) -> DataFrame:
    wide = _wide(counts, scopes, scope, ["interfaces", "vlans"]).join(summary.select(*scope, "verified_ratio"), scope, "left")
    raw = F.lit(25) + C("interfaces") * 4 + C("vlans") * 6 + F.coalesce("verified_ratio", F.lit(0.0)) * 45
    return wide.select(*scope, F.least(F.lit(100), F.floor(raw)).cast("int").alias("readiness_score"))


def signoff(scores: DataFrame, blockers: DataFrame, scope: list[str]) -> DataFrame:
    high = blockers.filter("severity = 'High'").groupBy(*scope).agg(F.count("*").alias("high_blockers"))
    df = scores.join(high, scope, "left").na.fill(0, ["high_blockers"])
    return df.select(*scope, C("score").alias("evidence_score"), "high_blockers", "critical_missing",
                     ((C("critical_missing") == 0) & (C("score") >= 55)).alias("can_publish_technical"),
                     ((C("high_blockers") == 0) & (C("score") >= 70)).alias("can_publish_executive"))


def command_checklist(counts: DataFrame, scopes: DataFrame, scope: list[str]) -> DataFrame:
    """Which show commands the evidence covers already."""
    tables = sorted({t for _, ts in fv.COMMAND_CHECKLIST for t in ts} | {"interfaces", "vlans"})
    wide = _wide(counts, scopes, scope, tables)

    def row(command, ok):
        severe = command in ("show running-config", "show access-lists")
        return F.struct(F.lit(command).alias("command"), F.when(ok, "covered").otherwise("missing").alias("status"),
                        F.when(ok, "Info").otherwise("High" if severe else "Medium").alias("severity"))

    some = lambda ts: F.greatest(*[C(t) for t in ts], F.lit(0)) > 0
    rows = [row("show running-config", (C("interfaces") > 0) & (C("vlans") > 0))] + [row(c, some(ts)) for c, ts in fv.COMMAND_CHECKLIST]
    return wide.select(*scope, F.inline(F.array(*rows)))


# fixed values: gate name, tables, full score at this many rows, status without rows, rows needed to pass
QUALITY_GATES = [
    ("Device identity", ["devices"], 1, "fail", 1), ("Interface coverage", ["interfaces"], 8, "review", 3), ("VLAN coverage", ["vlans"], 5, "fail", 1),
    ("Security policy coverage", ["acl_rules"], 10, "review", 1), ("Topology evidence", ["cdp_links", "lldp_links"], 4, "review", 1),
    ("Operational state coverage", ["interface_status", "trunk_operational"], 8, "review", 1), ("Security hardening extraction", ["security_hardening"], 8, "review", 1),
    ("Policy control mapping", ["policy_controls"], 5, "review", 1), ("Runtime validation evidence", ["acl_hit_counts", "interface_counters"], 8, "review", 1),
]


def quality_gates(counts: DataFrame, profile: DataFrame, scopes: DataFrame, scope: list[str]) -> DataFrame:
    """Gates from table counts, and line traceability from the profile."""
    tables = sorted({t for _, ts, *_ in QUALITY_GATES for t in ts})
    wide = _wide(counts, scopes, scope, tables).join(profile.select(*scope, "line_mapping_ratio"), scope, "left")
    rows = []
    for name, ts, full, bad, need in QUALITY_GATES:
        n = sum((C(t) for t in ts), F.lit(0))
        rows.append(F.struct(F.lit(name).alias("gate"), F.when(n >= need, "pass").otherwise(bad).alias("status"), F.least(F.lit(1.0), n / F.lit(float(full))).alias("score")))
    ratio = F.coalesce("line_mapping_ratio", F.lit(0.0))
    rows.append(F.struct(F.lit("Line-level traceability").alias("gate"), F.when(ratio >= 0.70, "pass").otherwise("review").alias("status"), ratio.alias("score")))
    return wide.select(*scope, F.inline(F.array(*rows)))


def gate_readiness(gates: DataFrame, scope: list[str]) -> DataFrame:
    return gates.groupBy(*scope).agg(F.round(F.avg(F.col("score").cast("decimal(18,6)")).cast("double"), 3).alias("readiness"), F.count_if(C("status") == "pass").alias("passed"))


def extraction_contract(summary: DataFrame, source_mode: Column) -> DataFrame:
    """Tier of an import and whether a full-fidelity claim is allowed."""
    direct = source_mode.isin("json_structured", "xml_structured", "text_config", "zip_text", "external_xml_converter")
    ratio = C("high_value_verified_ratio")
    df = summary.withColumn("source_mode", source_mode)
    tier = F.when(direct, "verified_export_parse").when(C("source_mode").startswith("pkt_"), F.when(ratio >= 0.45, "strong_native_recovery").otherwise("partial_native_recovery")).otherwise(
        "partial_visible_recovery")
    # exact decimals, so that halves round the same way everywhere
    exact = F.expr("cast(verified_ratio as decimal(6,3)) * 0.35 + 0.08") + F.when(direct, F.expr("0.90 * 0.55")).otherwise(F.expr("0.45 * 0.55"))
    return df.withColumns({"tier": tier, "can_claim_full_fidelity": direct & (ratio >= 0.70),
                           "import_confidence": F.least(F.lit(0.99), F.round(exact, 3).cast("double"))})


def attach_registry(objects: DataFrame, registry: DataFrame, scope: list[str]) -> DataFrame:
    """Objects with the best registry row of the same category and name."""
    key = [*scope, "category", "name"]
    best = registry.groupBy(*key).agg(F.max_by(F.struct("status", "source_type", "high_value"), "confidence").alias("r"))
    return objects.join(best, key, "left").select(*objects.columns, "r.*")
