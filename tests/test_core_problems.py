"""Heavy keys and hierarchies: SQL-free checks against brute force and on awkward input."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cartolith.operators import hierarchy as H
from cartolith.operators.hierarchy import hierarchy, with_ancestors
from cartolith.operators.skew import balanced_aggregate, end_totals, heavy_ends

EDGE = "from_id bigint, to_id bigint, weight bigint, side string, node_id string, w string, is_to int"


def _edges(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], EDGE)


def test_totals_match_brute_force_with_a_heavy_key_nulls_and_clashing_columns(spark):
    rnd = random.Random(3)
    rows = [(7 if rnd.random() < 0.4 else rnd.randrange(50), rnd.choice([None, 0, 1, 2, 3]), rnd.choice([None, 1, 5])) for _ in range(3000)]
    rows += rows[:200]
    expected = defaultdict(lambda: [0, 0])
    for f, t, w in rows:
        for side, n in (("from", f), ("to", t)):
            expected[side, n][0] += 1
            expected[side, n][1] += w or 0
    got = {(r.side, r.node_id): [r.row_count, r.total_weight] for r in end_totals(_edges(spark, rows)).collect()}
    assert got == dict(expected)
    heavy = {(r.side, r.node_id) for r in heavy_ends(_edges(spark, rows), 0.1).collect()}
    assert heavy == {k for k, (n, _) in expected.items() if k[1] and n >= 0.1 * len(rows)}


def test_a_key_of_equal_rows_is_split_over_partitions(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"), F.lit(2).alias("v"))
    assert [tuple(r) for r in balanced_aggregate(df, ["k"], [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")]).collect()] == [(1, 20000, 40000)]


def test_empty_edges(spark):
    empty = _edges(spark, [])
    assert end_totals(empty).count() == 0 and heavy_ends(empty).count() == 0


def _tree(spark, rows):
    return spark.createDataFrame([(*r, 1, "q") for r in rows], "project_id string, identity_key string, parent_identity_key string, id int, scope string")


def _brute(rows):
    parent = {}
    for p, k, q in rows:
        if k is not None:
            parent[p, k] = max(filter(None, [parent.get((p, k)), q]), default=None)
    out = {}
    for v in parent:
        path, u = [v], v
        while True:
            q = parent[u]
            nxt = (u[0], q)
            if q is None or nxt not in parent:
                out[v] = (path[-1][1], len(path) - 1)
                break
            if nxt in path:
                out[v] = ("", -1)
                break
            path.append(nxt)
            u = nxt
    return out, parent


def test_hierarchy_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for p in ("a", "b", None):
        for k in range(60):
            q = None if rnd.random() < 0.08 else str(rnd.randrange(max(1, k - 3), k + 2) if rnd.random() < 0.9 else rnd.randrange(80))
            rows.append((p, str(k), q))
    rows += [("c", "s", "s"), ("c", "t", "s"), ("c", "x", "y"), ("c", "y", "z"), ("c", "z", "x"), ("c", "u", "x"), ("c", "v", ""), ("c", "v", None), ("c", None, "v"), ("c", "w", "missing")]
    rows += [("d", str(k), str(k - 1) if k else None) for k in range(150)] + [("e", f"c{k}", "hub") for k in range(300)] + [("e", "hub", None)]
    rows += rows[:40]
    expected, parent = _brute(rows)
    result = {(r.project_id, r.identity_key): r for r in hierarchy(_tree(spark, rows)).collect()}
    assert {k: (r.root_key, r.depth) for k, r in result.items()} == expected
    below = defaultdict(int)
    for v in parent:
        u = v
        while expected[v][1] > 0 and parent[u] is not None and (u[0], parent[u]) in parent:
            u = (u[0], parent[u])
            below[u] += 1
    for v, r in result.items():
        if r.depth < 0:
            assert r.entry is None and r.descendants is None
        else:
            assert r.descendants == below[v]
            q = (v[0], parent[v]) if parent[v] is not None else None
            if q in result and r.depth > 0:
                assert result[q].entry < r.entry and r.exit < result[q].exit


def test_hierarchy_in_rounds_equals_one_task(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [("a", str(k), str(k - 1) if k else None) for k in range(250)] + [("b", str(k), str(rnd.randrange(k)) if k else None) for k in range(100)] + [("c", str(k), str((k + 1) % 7)) for k in range(9)]
    fields = ["project_id", "identity_key", "root_key", "depth", "descendants"]
    want = sorted(tuple(map(str, r)) for r in hierarchy(_tree(spark, rows)).select(*fields).collect())
    monkeypatch.setattr(H, "ONE_TASK", 200)
    monkeypatch.setattr(H, "STOP_EVERY", 5)
    assert sorted(tuple(map(str, r)) for r in hierarchy(_tree(spark, rows)).select(*fields).collect()) == want


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_ancestors_across_parts(spark, coalesce, monkeypatch):
    monkeypatch.setattr(H, "WALK_NAMES", 500)
    rnd = random.Random(9)
    rows = [("a", f"n{k}", f"n{k - 1}" if k else None) for k in range(120)] + [("b", f"n{k}", f"n{rnd.randrange(max(0, k - 4), k)}" if k else None) for k in range(200)] + [("c", f"n{k}", None) for k in range(30)]
    parent = {(p, k): q for p, k, q in rows}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {(r.project_id, r.identity_key): r.ancestors for r in with_ancestors(hierarchy(_tree(spark, rows)).persist()).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for (p, k), q in parent.items():
        up = []
        while q is not None:
            up.append(q)
            q = parent[p, q]
        assert got[p, k] == up[::-1]


def test_ancestors_of_nothing(spark):
    assert with_ancestors(hierarchy(_tree(spark, []))).count() == 0


def test_hierarchy_of_nothing(spark):
    assert hierarchy(_tree(spark, [])).count() == 0
