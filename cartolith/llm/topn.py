"""The N best items of every group, with per-group score histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.runtime import Staged, BROADCAST_ROWS

#: Groups of fewer distinct items are ranked without a threshold; it would cost more than it saves.
LARGE_GROUP = 256
#: Copies of a threshold when the thresholds are too many for a broadcast; rows of a group spread over as many tasks.
SALTS = 32


def score_bucket(score: Column) -> Column:
    """A bucket that never decreases with the score: 16 to each doubling of its size, so at most a few thousand."""
    x = score.cast("double")
    return (F.signum(x) * F.floor(16 * F.log2(1 + F.abs(x)))).cast("int")


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score, place): of each group the n items with the highest score, ties to the smaller item.

    An item of several rows counts once, with its highest score. Rows with a null group, item or score (or a NaN
    score) are left out; groups of fewer than n items are returned whole; other columns are ignored.

    1. Rows are reduced to one per (group, item); the shuffle is by both, so no group is one task's.
    2. A histogram per large group gives the highest bucket at and above which at least n items lie. Buckets are
       monotone in the score, so nothing below it can be among the n best.
    3. Rows below their group's bucket are dropped, the rest is ranked exactly. Row numbers up to n are found with a
       limit per task and group before the shuffle, so even a group of equal scores sends few rows to one task.
    """
    s = F.col(score)
    valid = df.where(F.col(group).isNotNull() & F.col(item).isNotNull() & s.isNotNull() & ~F.isnan(s.cast("double")))
    pairs = valid.groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(F.max(score).alias("s")).withColumn("b", score_bucket(F.col("s")))
    counts = pairs.groupBy("g", "b").agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("g").orderBy(F.desc("b"))
    above = counts.withColumn("cum", F.sum("c").over(down)).withColumn("size", F.sum("c").over(Window.partitionBy("g")))
    cut = above.where((F.col("cum") >= n) & (F.col("size") >= LARGE_GROUP)).groupBy("g").agg(F.max("b").alias("cut"))
    cuts = Staged(cut, "cuts")
    if cuts.count() <= BROADCAST_ROWS:
        kept = pairs.join(F.broadcast(cuts.df), "g", "left")
    else:
        salted = cuts.df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        kept = pairs.withColumn("salt", F.pmod(F.hash("i"), F.lit(SALTS))).join(salted, ["g", "salt"], "left")
    kept = kept.where(F.col("cut").isNull() | (F.col("b") >= F.col("cut")))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), F.asc("i")))
    return kept.withColumn("place", place).where(F.col("place") <= n).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "place")


def strongest_targets(edges: DataFrame, n: int = 3) -> DataFrame:
    """(from_id, to_id, weight, place): the n heaviest targets of each from_id; null, zero and equal ends do not count."""
    proper = edges.where("from_id <> 0 AND to_id <> 0 AND from_id <> to_id")
    return top_n(proper, "from_id", "to_id", "weight", n)


def best_candidates(nodes: DataFrame, n: int = 5) -> DataFrame:
    """(module_id, id, candidate_score, place): the n best members of each module."""
    return top_n(nodes, "module_id", "id", "candidate_score", n)
