"""The line filters ahead of the patterns lose no line, and word lists give what substring tests give."""

import pytest
from pyspark.sql import functions as F

from netprism import fixed_values as fv
from netprism.functions.text import _wide, contains_any, may_match, words_found
from netprism.operators import extract as X
from netprism.queries.bindings import config_lines
from netprism.queries.evidence_queries import OBJECT_LINES, _test

ODD = ["", " ", "\x0bhostname\x0bR1", "HOSTNAME r1", "vlan 10\n", "vlan 10\r", " switchport mode trunk ", "password=\x0babcd1", "password = ab", None,
       "interface Gi0/1 ", "Gi0/1 10,20\x0b\n", "Port Security : Enabled\n", "matches) (3 matches)", "iNTERNET portal", "İnternet VLAN", "x# show ip"]


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"


def odd_lines(spark):
    rows = [(1, i + 1, t) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "file_id bigint, line_no bigint, text string")


def test_filter_keeps_every_line_that_java_matches(spark, sf):
    patterns = [p for kind in X.BLOCK_ATTRIBUTES for p in X._reads(kind)] + [fv.SECRET_PATTERN, fv.TRUNK_VLAN_ROW, fv.PORT_SECURITY_STATE, fv.INVENTORY_PID]
    lines = odd_lines(spark).unionByName(config_lines(spark, sf).limit(3000))
    for p in dict.fromkeys(patterns):
        lost = lines.filter(F.col("text").rlike("(?i)" + p.removeprefix("(?i)"))).select("text", F.explode(F.array(may_match(F.col("text"), [p]))).alias("hit")).filter("not hit")
        assert lost.count() == 0, p


def test_negated_class_is_left_alone():
    assert _wide(r"^\s*[^\s,]+[,\s]\b$") == r"^[\s\v]*[^\s,]+[,\s\v]"


def test_words_found_equals_substring_tests(spark, sf):
    lines = odd_lines(spark).unionByName(config_lines(spark, sf).limit(3000))
    tags = F.concat_ws(",", *[F.when(contains_any(F.lower("text"), words), F.lit(n)) for n, words in fv.EVIDENCE_TAXONOMY])
    got = lines.select(tags.alias("a"), words_found(F.col("text"), fv.EVIDENCE_TAXONOMY).alias("b"))
    assert got.filter("a <> b or b is null").count() == 0


def test_object_tests_equal_their_patterns(spark, sf):
    lines = odd_lines(spark).unionByName(config_lines(spark, sf).limit(3000))
    for _, p, _ in OBJECT_LINES:
        assert lines.filter(~F.col("text").rlike(p).eqNullSafe(_test(p))).count() == 0, p


def test_credentials_equal_those_of_all_entities(spark, sf):
    lines = odd_lines(spark).unionByName(config_lines(spark, sf).limit(3000))
    cols = ["file_id", "name", "line_no", "source_text"]
    few, every = X.text_credentials(lines).select(cols), X.text_entities(lines).filter("type = 'credential'").select(cols)
    assert few.count() > 0 and few.exceptAll(every).count() == 0 and every.exceptAll(few).count() == 0


def test_lines_are_put_together_from_small_expressions(spark, sf):
    """One expression of all templates is too long to be compiled: no case of them is left in the plan."""
    plan = config_lines(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN ((l_linenumber" not in plan


def test_single_values_are_exploded_by_generated_code(spark):
    lines = odd_lines(spark)
    plan = X.deep_evidence_index(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(" in plan and "lambda" not in plan
    a, b = F.when(F.col("text").contains("Gi0/1"), F.lit("a")), F.when(F.col("line_no") == 11, F.lit("b"))
    rows = lambda *values: sorted((r["line_no"], r["v"]) for r in X._held(lines, ["line_no"], list(values), "v").collect())
    assert rows(a) == [(11, "a"), (12, "a")] and rows(a, F.lit(None).cast("string"), b) == [(11, "a"), (11, "b"), (12, "a")]
