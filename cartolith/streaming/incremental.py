"""Re-extraction of what changed, as a batch over snapshots and as a stream over a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["project_id", "path"]
STATE = [*KEY, "length", "modification_time"]


def changed(current: DataFrame, known: DataFrame) -> DataFrame:
    """Files of the current snapshot whose (length, modification_time) is not known; nulls are values."""
    same = known.select(*STATE).distinct()
    on = [current[c].eqNullSafe(same[c]) for c in STATE]
    return current.join(same, on, "left_anti")


def removed(current: DataFrame, known: DataFrame) -> DataFrame:
    return known.select(*KEY).distinct().join(current.select(*KEY).distinct(), [known[c].eqNullSafe(current[c]) for c in KEY], "left_anti")


def refreshed(facts: DataFrame, current: DataFrame, known: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The facts (with KEY) of the current snapshot: those of unchanged files stay, the rest are extracted anew."""
    anew = changed(current, known)
    gone = anew.select(*KEY).unionByName(removed(current, known)).distinct()
    return facts.join(gone, KEY, "left_anti").unionByName(extract(anew))


def run_key(*parts: str) -> F.Column:
    """The key of a layer: a hash over its inputs' keys, so a change upstream changes every key below."""
    return F.sha2(F.concat_ws("\n", *[F.lit(p) for p in parts]), 256)


def watch(spark: SparkSession, root: str, project_id: str) -> DataFrame:
    """A stream of files that appear under root, in the schema of the files table."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    path = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    return raw.select(F.lit(project_id).alias("project_id"), F.substr(path, F.length(base) + 2).alias("path"), "length", F.col("modificationTime").alias("modification_time"), F.decode("content", "UTF-8").alias("content"))


def sink_facts(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], table: str, checkpoint: str):
    """Writes the facts of each micro-batch to a folder of its own; a repeated batch overwrites what it wrote before."""

    def write(batch: DataFrame, n: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{table}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
