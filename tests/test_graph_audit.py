import hashlib
import random

from netprism.operators import audit as A
from netprism.operators import graph as G


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def test_components_match_union_find(spark):
    random.seed(7)
    nodes = [f"n{i:03d}" for i in range(120)]
    edges = [(nodes[i], nodes[i + 1]) for i in range(0, 60)] + [tuple(random.sample(nodes[65:], 2)) for _ in range(25)] + [("n000", f"n{i:03d}") for i in range(61, 64)]
    got = G.connected_components(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string"))
    assert {r["id"]: r["component"] for r in got.collect()} == union_find(nodes, edges)


def test_paths_are_short_and_bounded(spark):
    edges = [(f"a{i}", f"a{i + 1}") for i in range(9)] + [("a0", "b"), ("b", "a2")]
    e = spark.createDataFrame(edges, "src string, dst string")
    start, goal = spark.createDataFrame([("a0",)], "id string"), spark.createDataFrame([("a2",), ("a7",), ("a8",)], "id string")
    got = {r["target"]: (r["hops"], r["path"]) for r in G.shortest_paths(e, start, goal).collect()}
    assert got["a2"] == (2, ["a0", "a1", "a2"]) and got["a7"][0] == 7 and got["a8"][0] == 8
    assert "a8" not in {r["target"] for r in G.shortest_paths(e, start, goal, max_hops=7).collect()}


def chain(n):
    prev, rows = "GENESIS", []
    for i in range(1, n + 1):
        f = [f"2024-01-01 00:00:{i:02d}", "bob", "login", "x", "d", "Info", "t"]
        h = hashlib.sha256("|".join([prev, *f]).encode()).hexdigest()
        rows.append([i, *f, prev, h])
        prev = h
    return rows


SCHEMA = "id long, created_at string, actor string, action string, target string, detail string, severity string, tenant_id string, prev_hash string, entry_hash string"


def test_audit_chain(spark):
    rows = chain(12)
    good = A.chain_summary(A.verify_chain(spark.createDataFrame(rows, SCHEMA), chunk=4)).first()
    assert (good["checked"], good["valid"], good["broken"], good["skipped"]) == (12, 12, 0, 0)
    rows[5][5] = "edited"
    rows[8][9] = None
    rows[9][8] = rows[7][9]
    bad = {r["id"]: r["status"] for r in A.verify_chain(spark.createDataFrame(rows, SCHEMA), chunk=4).collect()}
    assert bad[6] == "broken" and bad[7] == "valid" and bad[9] == "skipped"
    assert bad[10] == "broken"  # its hash was built on the missing one


def test_login_window_matches_brute_force(spark):
    random.seed(3)
    rows = [(i, random.choice("ab"), random.choice("xyz"), random.random() < 0.3, float(random.randrange(0, 5000))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, username string, ip_address string, ok boolean, created_at double")
    got = {r["id"]: r["recent_failures"] for r in A.login_allowed(df).collect()}
    for i, user, ip, _, t in rows:
        want = sum(1 for _, u, a, ok, s in rows if (u == user or a == ip) and not ok and t - 900 <= s <= t)
        assert got[i] == want
