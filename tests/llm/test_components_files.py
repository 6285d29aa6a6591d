"""Components of a few edges are found in few tasks, so their rounds leave few files, and come out as by union-find."""

import random

from netprism.llm.common import components


def test_rounds_of_few_edges_take_few_tasks(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(30)] + [(500, i) for i in range(501, 520)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    out = components(spark.createDataFrame(pairs, "a long, b long").repartition(40))
    assert {(r["node"], r["root"]) for r in out.collect()} == {(x, find(x)) for x in up}
    # the last round is one part: it was the session's number of parts before
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().apply(0).rdd().getNumPartitions() == 1
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
