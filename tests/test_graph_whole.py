"""Attack paths of the registered queries reach from every entry to every kind of target."""

import random
from collections import Counter

import __spark_entry__ as entry
from netprism.operators import graph as G


def tables(spark, at):
    rows = {
        "region": ([(0,)], "r_regionkey long"),
        "nation": ([(0, 0), (1, 0)], "n_nationkey long, n_regionkey long"),
        "customer": ([(i, i % 2) for i in range(12)], "c_custkey long, c_nationkey long"),
        "supplier": ([(i, i % 2) for i in range(12)], "s_suppkey long, s_nationkey long"),
        "orders": ([(i, i % 12) for i in range(15)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(i, (i * 5) % 12) for i in range(15)], "l_orderkey long, l_suppkey long"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    pairs = [("N:0", "R:0"), ("N:1", "R:0")] + [(f"{k}:{i}", f"N:{i % 2}") for k in "CS" for i in range(12)] + [(f"C:{i % 12}", f"S:{(i * 5) % 12}") for i in range(15)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def cheapest_ways(pairs, targets):
    """Least (cost, hops, target, parent) of every node, by repeated relaxation over all edges until nothing changes."""
    best = {t: (0, 0, t, "") for t in targets}
    while True:
        new = dict(best)
        for (a, b), (cost, _) in pairs.items():
            for x, y in ((a, b), (b, a)):
                if x in best:
                    c = (best[x][0] + cost, best[x][1] + 1, best[x][2], x)
                    if y not in new or c < new[y]:
                        new[y] = c
        if new == best:
            return best
        best = new


def expected(pairs, kinds):
    rows, inner = {}, Counter()
    for kind in {k for k in kinds.values() if k != "client"}:
        best = cheapest_ways(pairs, [n for n, k in kinds.items() if k == kind])
        for n in best:
            if kinds[n] == "client":
                path, conf = [n], 0
                while best[path[-1]][3]:
                    step = tuple(sorted((path[-1], best[path[-1]][3])))
                    conf += pairs[step][1]
                    path.append(best[path[-1]][3])
                rows[n, kind] = (best[n][2], best[n][1], max(10, min(100, 92 - best[n][0])), round(conf / best[n][1] * 100), path)
                inner.update(path[1:-1])
    return rows, inner


def test_all_entries_and_kinds(spark, tmp_path):
    near = tables(spark, tmp_path)
    kinds = {n: {"C": "client", "S": "server", "N": "switch", "R": "network"}[n[0]] for n in near}
    sure = {("C", "N"): (7, 0.85), ("N", "R"): (7, 0.9), ("N", "S"): (18, 0.6), ("C", "S"): (18, 0.5)}
    pairs = {(a, b): sure[a[0], b[0]] for a in near for b in near[a] if a < b}
    rows, inner = expected(pairs, kinds)
    got = {(r["entry"], r["target_type"]): (r["target"], r["hops"], r["risk"], r["confidence"], r["path"].split(" > ")) for r in entry.queries()["graph_attack_paths"](spark, str(tmp_path)).collect()}
    assert len(rows) == 36 and got == rows
    assert {r["id"]: r["paths"] for r in entry.queries()["graph_choke_points"](spark, str(tmp_path)).collect()} == inner


def test_long_ways_with_detours(spark):
    rng = random.Random(11)
    ids = [f"n{i:02d}" for i in range(40)]
    kinds = {n: rng.choice(["client", "client", "endpoint", "router", "server", "other", "other"]) for n in ids}
    found = {tuple(sorted((ids[i], ids[i + 1]))) for i in range(39)} | {tuple(sorted(rng.sample(ids, 2))) for _ in range(8)}
    rows = [(a, b, rng.choice(["confirmed", "review", None]), rng.choice([0.5, 0.9, None])) for a, b in sorted(found)]
    rows += [("x", "y", "pass", 1.0), (None, "n00", "pass", 1.0), ("n00", "n00", "pass", 1.0), ("n01", "n00", "review", 0.1)]
    best = {}
    for a, b, status, conf in rows:
        if a and b and a != b:
            k, e = tuple(sorted((a, b))), (0.35 if conf is None else conf, status or "review")
            best[k] = max(best.get(k, e), e)
    pairs = {k: (7 if s in ("confirmed", "pass") else 18, c) for k, (c, s) in best.items()}
    kinds |= {"x": "client", "y": "other"}
    alike = {n: "client" if k in ("client", "endpoint") else k for n, k in kinds.items()}
    want, inner = expected(pairs, alike)
    want = {k: v for k, v in want.items() if k[1] != "other"}
    inner = Counter(x for v in want.values() for x in v[4][1:-1])
    nodes = spark.createDataFrame(list(kinds.items()), "id string, type string")
    edges = spark.createDataFrame(rows, "src string, dst string, status string, confidence double")
    got = {(r["entry"], r["target_type"]): (r["target"], r["hops"], r["risk"], r["confidence"], r["path"]) for r in G.attack_paths(nodes, edges).collect()}
    assert got == want and max(v[1] for v in want.values()) > 3
    assert {r["id"]: r["paths"] for r in G.choke_points(nodes, edges).collect()} == inner


def test_nothing_to_reach(spark):
    nodes, edges = spark.createDataFrame([("a", "client")], "id string, type string"), spark.createDataFrame([], "src string, dst string, status string, confidence double")
    assert G.attack_paths(nodes, edges).count() == 0 and G.choke_points(nodes, edges).count() == 0
