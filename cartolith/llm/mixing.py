"""A training mix with target shares of tokens, from sources of very different sizes."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.runtime import Staged, balanced

#: Rank file of the byte-level BPE whose tokens are the unit of size, and its splitting pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counter(path: str, pattern: str = SPLIT):
    """Batches of (.., text) to (.., tokens); the ranks are read once in each Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            pdf["tokens"] = [len(x) for x in enc.encode_ordinary_batch(pdf["text"].tolist(), num_threads=1)]
            yield pdf.drop(columns="text")

    return run


def source_name(col: Column) -> Column:
    """One spelling of a source: lower case, words joined by _; null if nothing is left."""
    name = F.regexp_replace(F.trim(F.lower(F.regexp_replace(col, r"[\s\-_.]+", " "))), " +", "_")
    return F.when(name != "", name)


def counted(documents: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, tokens) of documents with a source; null texts have 0 tokens."""
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), source_name(F.col(source)).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("source IS NOT NULL AND doc_id IS NOT NULL")
    return balanced(docs, "doc_id").mapInPandas(token_counter(tokenizer), "doc_id bigint, source string, tokens bigint")


def _budgets(sized: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """One row per target source: available tokens, budget, full epochs and what remains for a part of one.

    Shares of sources without tokens fall to the others in proportion. Without a given total the mix is the largest
    that every source can serve its share of within max_repeats; a given total that a source cannot serve leaves that
    source at its most."""
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    want = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
    want = want.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").cast("bigint").alias("max_repeats"))
    every = Window.partitionBy(F.lit(1))  # a row per source
    plan = want.join(have, "source", "left").fillna(0, ["available", "documents"])
    live = F.when(F.col("available") > 0, F.col("target_share"))
    plan = plan.withColumn("share", live / F.sum(live).over(every)).withColumn("most", F.col("available") * F.col("max_repeats"))
    size = F.lit(total).cast("double") if total is not None else F.min(F.when(F.col("share") > 0, F.col("most") / F.col("share"))).over(every)
    plan = plan.withColumn("budget", F.coalesce(F.least(F.floor(size * F.col("share") + F.lit(1e-6)), F.col("most")), F.lit(0)).cast("bigint"))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0)
    return plan.withColumn("epochs", epochs.cast("bigint")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))


def prefix_sums(df: DataFrame, by: str, order: list[str], value: str, label: str = "prefix") -> DataFrame:
    """df with `before`, the sum of value over the rows of the same `by` that come before in order.

    Rows are range-partitioned by (by, order), so a large group is cut into many partitions; each partition sums its
    part of each group, and the offsets are running sums over that table of (partition, group). order must be unique."""
    ranged = df.repartitionByRange(by, *order).withColumn("part", F.spark_partition_id())
    held = Staged(ranged, label)
    sums = held.df.groupBy(by, "part").agg(F.sum(value).alias("sum"))
    start = sums.withColumn("start", F.coalesce(F.sum("sum").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(by, "part", "start")
    inside = Window.partitionBy("part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = held.df.withColumn("within", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(start, [by, "part"]).withColumn("before", F.col("start") + F.col("within")).drop("part", "start", "within")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: doc_id, source, tokens, copies of the documents used at least once. report: a row for each
    target source with the share of all tokens that it reached.

    Every document of a source is used in each full epoch; a last part of an epoch takes documents in the order of a
    hash of their id until the next would exceed the budget, so the result is the same on every run. A source misses
    its budget by less than its longest document. Documents without a (listed) source, null ids, and targets with a
    null or non-positive share or repeat do not take part; repeated target rows add up, with the lowest repeat."""
    sized = Staged(counted(documents, tokenizer), "tokens").df
    plan = Staged(_budgets(sized, targets, total), "budgets").df  # a row per source
    keyed = sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    summed = prefix_sums(keyed, "source", ["key", "doc_id", "tokens"], "tokens")
    placed = summed.join(F.broadcast(plan.select("source", "epochs", "rest", "max_repeats")), "source")
    once = F.when(F.col("before") + F.col("tokens") <= F.col("rest"), 1).otherwise(0)
    chosen = placed.withColumn("copies", F.least(F.col("epochs") + once, F.col("max_repeats"))).where("copies > 0").select("doc_id", "source", "tokens", "copies")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.sum("copies").alias("records"))
    report = plan.join(used, "source", "left").fillna(0, ["used", "records"])
    reached = F.coalesce(F.try_divide(F.col("used"), F.sum("used").over(Window.partitionBy(F.lit(1)))), F.lit(0.0))
    return chosen, report.select("source", "target_share", "share", "max_repeats", "documents", "available", "budget", "used", "records", reached.alias("reached_share"))
