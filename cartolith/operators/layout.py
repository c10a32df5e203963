"""Geometry: interval islands, rectangles met by segments, capped and ordered edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of the cells through which segments and rectangles find each other.
CELL = 256.0


def islands(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], gap: float) -> DataFrame:
    """df with `island`: intervals of a key that overlap or lie within `gap` of an earlier one share a number."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(far.isNull() | (F.col(start) > far + gap), 1).otherwise(0)
    return df.withColumn("__o", opens).withColumn("island", F.sum("__o").over(w)).drop("__o")


def _cell(x: Column) -> Column:
    return F.floor(x / CELL)


def _half(x: Column, k: Column) -> Column:
    """x halved k times, rounded down."""
    return F.call_function("shiftright", x, k)


def _blocks(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """df for each of the few blocks that make up its cells first to last, at levels up to its top: (k, c) stands for the
    cells c * 2**k to (c + 1) * 2**k - 1. No cell is in two."""
    levels = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("top"))))
    lo, hi = -_half(-first, F.col("k")), _half(last + 1, F.col("k"))
    block = lambda c, alone: F.when((lo < hi) & (F.pmod(alone, F.lit(2)) == 1), c)
    return levels.withColumn("c", F.explode(F.array_compact(F.array(block(lo, lo), block(hi - 1, hi)))))


def _holding(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """df for every block (k, c) up to its top that holds one of its cells first to last."""
    levels = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("top"))))
    return levels.withColumn("c", F.explode(F.sequence(_half(first, F.col("k")), _half(last, F.col("k")))))


def segment_hits(segments: DataFrame, rects: DataFrame, margin: float) -> DataFrame:
    """(seg, rect, length) of axis-parallel segments (seg, x1, y1, x2, y2) that run through rectangles (rect, left, top,
    right, bottom) grown by margin, with the other columns of segments.

    Rectangles of equal extent across a segment's direction are one lane. Which lanes a segment meets is settled on the
    distinct coordinates, exactly; along its direction it is cut into blocks of cells, about twice the logarithm of its
    length, and a rectangle is sought in the blocks that hold it. So what is compared follows the hits and not the lengths."""
    upright = F.abs(F.col("y2") - F.col("y1")) > F.abs(F.col("x2") - F.col("x1"))
    side = lambda f, a, b: F.when(upright, f("x1", "x2") if a == "across" else f("y1", "y2")).otherwise(f("y1", "y2") if a == "across" else f("x1", "x2")).alias(b)
    s = segments.select("*", upright.alias("up"), side(F.least, "across", "a1"), side(F.greatest, "across", "a2"), side(F.least, "along", "m1"), side(F.greatest, "along", "m2"))
    box = rects.select("rect", (F.col("left") - margin).alias("l"), (F.col("top") - margin).alias("t"), (F.col("right") + margin).alias("r"), (F.col("bottom") + margin).alias("b"))
    turned = lambda up, *c: F.struct(F.lit(up).alias("up"), *[F.col(x).alias(n) for x, n in zip(c, ("l1", "l2", "n1", "n2"))])
    r = box.select("rect", F.inline(F.array(turned(True, "l", "r", "t", "b"), turned(False, "t", "b", "l", "r"))))
    cells = lambda df, x, y: df.withColumn("cell", F.explode(F.sequence(_cell(F.col(x)), _cell(F.col(y)))))
    met = cells(s.select("up", "a1", "a2").distinct(), "a1", "a2").join(cells(r.select("up", "l1", "l2").distinct(), "l1", "l2"), ["up", "cell"])
    met = met.where((F.col("a1") <= F.col("l2")) & (F.col("a2") >= F.col("l1")) & (F.col("cell") == F.greatest(_cell(F.col("a1")), _cell(F.col("l1"))))).drop("cell")
    laned = s.join(met, ["up", "a1", "a2"])
    cells_along = F.greatest(*[_cell(F.greatest(f"{c}1", f"{c}2")) - _cell(F.least(f"{c}1", f"{c}2")) + 1 for c in "xy"])
    top = F.broadcast(segments.agg(F.coalesce(F.floor(F.log2(F.max(cells_along))), F.lit(0)).cast("int").alias("top")))  # one row
    cut = _blocks(laned.crossJoin(top), _cell(F.col("m1")), _cell(F.col("m2")))
    held = r.join(met.select("up", "l1", "l2").distinct(), ["up", "l1", "l2"], "left_semi").crossJoin(top)
    held = _holding(held, _cell(F.col("n1")), _cell(F.col("n2"))).drop("top")
    near = cut.join(held, ["up", "l1", "l2", "k", "c"])
    # the first cell of both lies in one block only
    once = _half(F.greatest(_cell(F.col("m1")), _cell(F.col("n1"))), F.col("k")) == F.col("c")
    across = F.least("a2", "l2") - F.greatest("a1", "l1")
    along = F.least("m2", "n2") - F.greatest("m1", "n1")
    return near.where(once & (along >= 0)).select(*segments.columns, "rect", F.greatest(across, along).alias("length"))


def capped_edges(edges: DataFrame, group: str, total: int = 18, per_node: int = 4) -> DataFrame:
    """Edges taken greedily by falling weight (w; ties by f, t): at most `total` of a group and `per_node` out of and
    into a node. The choice depends on all choices before it, so it is a fold over a group's sorted edges; a group is
    one project's module graph."""
    # an edge beyond the first `per_node` times the nodes' number can still be taken, so none is left out beforehand
    lists = edges.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), "f", "t"))).alias("e"))
    none = F.array().cast("array<struct<o: bigint, f: bigint, t: bigint>>")
    free = lambda acc, x: (F.size(acc) < total) & (F.size(F.filter(acc, lambda y: y["f"] == x["f"])) < per_node) & (F.size(F.filter(acc, lambda y: y["t"] == x["t"])) < per_node)
    taken = F.aggregate("e", none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(F.struct(x["o"].cast("bigint").alias("o"), x["f"].cast("bigint").alias("f"), x["t"].cast("bigint").alias("t"))))).otherwise(acc))
    return lists.select(group, F.posexplode(taken).alias("lane", "x")).select(group, "lane", F.col("x.f").alias("f"), F.col("x.t").alias("t"))
