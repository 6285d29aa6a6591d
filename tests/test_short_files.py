"""Lines of short files: one window for each file, lines kept together by file, and tables that read only their own lines."""

import random

from pyspark.sql import functions as F

from netprism.operators import extract as X
from netprism.operators.carry import MOST, carry_forward, short_files
from netprism.queries.bindings import config_lines

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(repr(r) for r in df.collect())


def test_one_window_gives_what_chunks_give(spark):
    rng = random.Random(3)
    rows = [(f, i, rng.choice(["a", "b", None, "x", ""])) for f in (1, 2, None) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "file_id long, line_no long, text string")
    # a wrong bound must not change a result either
    said = df.withColumn("line_no", F.col("line_no").alias("line_no", metadata={MOST: 5})).filter("true")
    assert short_files(said) and not short_files(df)
    marks = {"a": F.when(F.col("text") == "a", F.col("line_no")), "b": F.when(F.col("text") == "b", F.struct("line_no", "text"))}
    uses = F.col("text") == "x"
    for kept in (None, uses):
        for inclusive in (True, False):
            one = carry_forward(said.filter("file_id is not null"), marks, uses=kept, inclusive=inclusive)
            assert rows_of(one) == rows_of(carry_forward(df.filter("file_id is not null"), marks, chunk=7, uses=kept, inclusive=inclusive))
    plan = carry_forward(said, marks)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "_chunk" not in plan


def test_tables_of_written_lines_need_no_shuffle(spark):
    few = X.needed_lines(config_lines(spark, SF), "interface", "dhcp", "static_routes")
    plan = X.interfaces(X.block_lines(few, "interface"), few)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_every_table_reads_its_own_lines(spark, lines_of):
    names = ("interface", "vlan", "dhcp", "acl", "cdp", "lldp", "blk_vty", "hardening", "trunk_section", "trunk_seen", "counter", "devices", "static_routes")
    plain = config_lines(spark, SF).filter("file_id % 4 = 0")
    odd = plain.limit(0).unionByName(spark.createDataFrame([(1, 1, None), (1, 2, ""), (1, 3, "hostname R1"), (1, 4, " vlan 7"), (1, 5, "exit")], "file_id long, line_no long, text string"))
    for lines in (plain, odd):
        few = X.needed_lines(lines, *names)
        assert X.TAGS in few.columns and X.only(few, "cdp").count() <= few.count()
        assert X.only(few, "secure_port").count() == few.count()  # not asked for: nothing is left out
        for table in (
            lambda df: X.interfaces(X.block_lines(df, "interface"), df), lambda df: X.vlans(X.block_lines(df, "vlan"), df), lambda df: X.dhcp_scopes(X.block_lines(df, "dhcp")),
            lambda df: X.acl_rules(X.block_lines(df, "acl"), df), lambda df: X.cdp_links(X.state_lines(df, "cdp"), df), lambda df: X.lldp_links(X.state_lines(df, "lldp"), df),
            lambda df: X.security_hardening(X.state_lines(df, "blk_vty"), df), lambda df: X.trunk_operational(X.state_lines(df, "trunk_section", "trunk_seen")),
            lambda df: X.interface_counters(X.state_lines(df, "counter")), X.devices, X.static_routes,
        ):
            assert rows_of(table(few)) == rows_of(table(lines))


def test_common_start_is_tried_once(spark):
    assert X._any_of([r"^\s*a", "^(b|c)"]) == r"(?i)^(?:\s*a|(b|c))"
    assert X._any_of(["^a|b", "^c", "d"]) == "(?i)(?:^(?:c)|^a|b|d)"
    assert X._open_choice("^a|b") and not X._open_choice(r"^(a|b)\|[|]")
