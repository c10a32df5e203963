import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cartolith.llm import mixing, topn

SCHEMA = "g bigint, i bigint, s bigint, b string, c string, cut string, place string"


def _rows(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def _brute(rows, n):
    best = {}
    for g, i, s in rows:
        if None not in (g, i, s):
            best[g, i] = max(s, best.get((g, i), s))
    by = defaultdict(list)
    for (g, i), s in best.items():
        by[g].append((-s, i))
    return {(g, i) for g, v in by.items() for _, i in sorted(v)[:n]}


def test_top_n_with_a_hot_group_ties_nulls_and_repeats(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(1 if rnd.random() < 0.5 else rnd.randrange(2, 40), rnd.randrange(900), rnd.choice([None, -5, 0, 3, 3, 3, rnd.randrange(-100, 1000)])) for _ in range(6000)]
    rows += [(2, i, 7) for i in range(600)] + [(None, 1, 1), (3, None, 1), (4, 1, None)] + rows[:300]
    want = _brute(rows, 4)
    got = {(r.g, r.i) for r in topn.top_n(_rows(spark, rows), "g", "i", "s", 4).collect()}
    assert got == want
    monkeypatch.setattr(topn, "BROADCAST_ROWS", -1)  # thresholds too many for a broadcast
    assert {(r.g, r.i) for r in topn.top_n(_rows(spark, rows), "g", "i", "s", 4).collect()} == want


def test_top_n_of_nothing(spark):
    assert topn.top_n(_rows(spark, []), "g", "i", "s", 3).count() == 0


def test_buckets_follow_scores(spark):
    r = spark.range(-3000, 3000).select("id", topn.score_bucket(F.col("id")).alias("b")).orderBy("id").collect()
    assert all(a.b <= c.b for a, c in zip(r, r[1:]))


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 5, "t") for r in rows], "doc_id bigint, text string, source string, tokens int, key string")


TARGETS = "source string, target_share double, max_repeats int"


def test_mix_reaches_shares_within_a_document(spark):
    rnd = random.Random(2)
    rows = [(i, "word " * rnd.randrange(1, 30), rnd.choice(["Big source", "big-source", " BIG_SOURCE ", "small"] if i % 9 == 0 else ["big source"])) for i in range(900)] + [(None, "a", "small"), (901, None, "small"), (902, "a b", None), (903, "x", "unlisted")]
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 2), ("never", 0.0, 1)], TARGETS)
    chosen, report = mixing.mix(_docs(spark, rows), targets)
    rep = {r.source: r for r in report.collect()}
    out = chosen.collect()
    assert set(rep) == {"big_source", "small", "absent"} and rep["absent"].used == 0
    assert all(r.copies <= rep[r.source].max_repeats for r in out) and len({r.doc_id for r in out}) == len(out)
    for s in ("big_source", "small"):
        longest = max(r.tokens for r in out if r.source == s)
        assert rep[s].budget - longest < rep[s].used <= rep[s].budget
        assert sum(r.tokens * r.copies for r in out if r.source == s) == rep[s].used
    assert rep["big_source"].share == pytest.approx(0.625)
    again = {(r.doc_id, r.copies) for r in mixing.mix(_docs(spark, rows).repartition(7), targets)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in out}


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    chosen, report = mixing.mix(_docs(spark, []), targets)
    assert chosen.count() == 0 and report.first().used == 0
    assert mixing.mix(_docs(spark, [(1, "x", "a")]), spark.createDataFrame([], TARGETS))[0].count() == 0


def test_prefix_sums_match_a_running_sum(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), rnd.random(), i, rnd.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "s string, k double, id int, v bigint")
    total, want = defaultdict(int), {}
    for s, k, i, v in sorted(rows):
        want[i] = total[s]
        total[s] += v
    assert {r.id: r.before for r in mixing.prefix_sums(df, "s", ["k", "id"], "v").collect()} == want
