"""Per-key results when a few keys own most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.runtime import Staged

_POS = "__position"


def balanced_aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], order: Sequence[str] = ()) -> DataFrame:
    """One row per key with the given aggregates, without a task per heavy key.

    Rows are range-partitioned on (keys, order, row position) at quantiles that Spark samples from the input, so a
    heavy key is cut into as many partitions as its share of the rows demands, even if all its rows are equal.
    Each partition reduces its rows to one state per key (the partial aggregate before the second exchange). A key
    inside one partition has one state, a key on a boundary one for each partition that it spans; the final
    aggregate stitches these. The second exchange moves at most (keys + partitions) rows.

    Nulls form a key of their own; an empty table gives an empty result; equal rows all count. Columns of the input
    that are neither keys nor used in aggs are pruned, whatever their names.
    """
    ranged = df.withColumn(_POS, F.monotonically_increasing_id()).repartitionByRange(*keys, *order, _POS)
    return ranged.groupBy(*keys).agg(*aggs)


def end_totals(edges: DataFrame) -> DataFrame:
    """side ('from' or 'to'), node_id, row_count, total_weight of every end of edges.

    Null ids stay as a key (they belong to the number of rows); null weights add nothing, and a key that has only
    null weights has total 0.
    """
    both = edges.select(
        F.inline(
            F.array(
                F.struct(F.lit(False).alias("is_to"), F.col("from_id").alias("node_id"), F.col("weight").alias("w")),
                F.struct(F.lit(True).alias("is_to"), F.col("to_id").alias("node_id"), F.col("weight").alias("w")),
            )
        )
    )
    totals = balanced_aggregate(
        both, ["is_to", "node_id"],
        [F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("total_weight")],
    )
    side = F.when(F.col("is_to"), F.lit("to")).otherwise(F.lit("from"))
    return totals.select(side.alias("side"), "node_id", "row_count", "total_weight")


def heavy_ends(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """Ends that stand in at least `share` of all rows of edges; null and zero ids are no ends."""
    rows = edges.agg(F.count(F.lit(1)).alias("n"))
    totals = end_totals(edges)
    known = totals.where(F.col("node_id").isNotNull() & (F.col("node_id") != 0))
    return known.where(F.col("row_count") >= rows.scalar() * F.lit(share)).select("side", "node_id", "row_count", "total_weight")


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with `name`, the place (from 1) of each row in its group by `order` (nulls first), however large the group.

    Rows are range-partitioned by group and order, numbered in their partition, and moved on by the rows of the group in
    the partitions before; these are one row a group and partition."""
    keys = ["__group", *order]
    parts = Staged(df.withColumn("__group", F.col(group)).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "numbered").df
    local = F.row_number().over(Window.partitionBy("__part", "__group").orderBy(*order))
    counts = parts.groupBy(F.col("__part").alias("__p"), F.col("__group").alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    placed = parts.withColumn("__local", local).join(before, (F.col("__part") == F.col("__p")) & F.col("__group").eqNullSafe(F.col("__g")))
    return placed.withColumn(name, F.col("__local") + F.col("__before")).drop("__group", "__part", "__local", "__p", "__g", "__before")
