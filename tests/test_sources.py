"""Configurations, compile databases, numbering and staging on small fixtures."""

import os

from pyspark.sql import functions as F

from cartolith.operators.skew import numbered
from cartolith.runtime import Staged, staging
from cartolith.sources import tables

FILES = "project_id string, path string, content string"
CONFIG = '{"version": 1, "analysis": {"ignoreDirectories": ["Build/", 3, "build"], "moduleMerges": [{"match": "src\\\\ui", "module": "ui"}, {"module": "x"}, 7], "roleOverrides": {"a": 1}, "entryOverrides": [{"match": "app"}], "dependencyFoldRules": [{"match": "vendor", "collapse": false}]}}'


def test_first_configuration_and_its_rules(spark):
    rows = [("p", "architecture.json", '{"ignoreDirectories": ["late"]}'), ("p", "./config/architecture.json", CONFIG), ("q", "architecture.json", "[1"), (None, "config/project.json", '{"ignoreDirectories": ["own"]}'), ("r", "x.json", "{}"), ("s", "architecture.json", None), ("t", "architecture.json", "[]")]
    rules, notes = tables.config_rules(spark.createDataFrame(rows, FILES))
    assert {tuple(r) for r in rules.collect()} == {("p", "ignore", "build", ""), ("p", "merge", "src/ui", "ui"), ("p", "entry", "app", "true"), ("p", "fold", "vendor", "false"), (None, "ignore", "own", "")}
    assert sorted((r.project_id, r.message) for r in notes.collect()) == [("p", "ignoreDirectories has an item without a match or value"), ("p", "moduleMerges has an item without a match or value"), ("p", "moduleMerges has an item without a match or value"), ("p", "roleOverrides is no list"), ("q", "no JSON object"), ("s", "no JSON object"), ("t", "no JSON object")]
    empty, none = tables.config_rules(spark.createDataFrame([], FILES))
    assert empty.count() == 0 and none.count() == 0


def test_compile_database_discovery(spark):
    rows = [("a", "build/compile_commands.json", "2"), ("a", "compile_commands.json", "1"), ("b", "build/zz/compile_commands.json", "z"), ("b", "build/debug/.qtc_clangd/compile_commands.json", "d"), ("c", "other/compile_commands.json", "x"), (None, "build/compile_commands.json", "n")]
    assert {(r.project_id, r.content) for r in tables.compile_database(spark.createDataFrame(rows, FILES)).collect()} == {("a", "1"), ("b", "d"), (None, "n")}


def test_rows_are_numbered_across_partitions(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).when(F.col("id") % 10 == 8, F.lit("cold")).alias("g"), (F.col("id") * 7919 % 5000).alias("v"), F.lit(1).alias("extra"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(df, "g", ["v"], "place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g in ("hot", "cold", None):
        rows = sorted((r.place, r.v) for r in got if r.g == g)
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1)) and [v for _, v in rows] == sorted(v for _, v in rows)
    assert len(got) == 5000 and numbered(df.limit(0), "g", ["v"], "place").count() == 0


def test_staged_tables_are_dropped_with_their_scope(spark):
    with staging():
        inside = Staged(spark.range(3).toDF("id"), "inside")
        assert inside.count() == 3
    outside = Staged(spark.range(3).toDF("id"), "outside")
    local = lambda s: s.path.removeprefix("file:")
    assert not os.path.exists(local(inside)) and os.path.exists(local(outside))
    outside.drop()
