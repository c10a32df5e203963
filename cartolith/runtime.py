"""Session helpers: table access, lineage cuts in shared storage, checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows up to which a side whose size was counted may be broadcast (about 10 MB of narrow rows).
BROADCAST_ROWS = 200_000
#: Rows of some 50 bytes that one task may settle by itself, where a loop of joins would take many rounds.
ONE_TASK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir, else (local mode only) a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cartolith-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


#: Session setting that removes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES: list[list[Staged]] = []


@contextlib.contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside leave no shuffle files, which otherwise stay until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


@contextlib.contextmanager
def staging() -> Iterator[None]:
    """Drops what is staged inside when it ends, for sessions that live long; results must be read or written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for staged in _SCOPES.pop():
            staged.drop()


class Staged:
    """A DataFrame written once to shared storage; reading it needs no lineage, so lost executors cost nothing."""

    def __init__(self, df: DataFrame, label: str = "t"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/cartolith-{label}-{uuid.uuid4().hex}"
        with _freed(self.spark):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self.drop)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def count(self) -> int:
        """Row count from the footers."""
        return self.df.count()

    def drop(self) -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            atexit.unregister(self.drop)
        except Exception:  # the session may be gone at exit
            pass


def stage(df: DataFrame, label: str = "t") -> DataFrame:
    """Cuts the lineage of df: writes it to shared storage and reads it back."""
    return Staged(df, label).df


def in_one_task(tables: dict[str, DataFrame], settle, schema: str) -> DataFrame:
    """The rows that `settle` makes of the tables, each a list of tuples of integers, in a single task. The caller has
    counted the rows and found no more than ONE_TASK. The result is staged."""
    widths = {name: len(t.columns) for name, t in tables.items()}
    rows = None
    for name, t in tables.items():
        values = [*(F.col(c) for c in t.columns), *[F.lit(None)] * (max(widths.values()) - widths[name])]
        part = t.select(F.lit(name).alias("name"), *[v.cast("bigint").alias(f"c{k}") for k, v in enumerate(values)])
        rows = part if rows is None else rows.unionByName(part)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {name: [] for name in widths}
        for batch in batches:
            for name, *values in zip(*[c.to_pylist() for c in batch.columns]):
                held[name].append(tuple(values[: widths[name]]))
        columns = zip(*settle(**held))
        yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)] or [pa.array([], f.type) for f in arrow], schema=arrow).to_batches()

    return stage(rows.repartition(1).mapInArrow(run, schema), "settled")


def small_side(staged: Staged, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The staged rows, hinted for broadcast only if their counted number is within the limit."""
    return F.broadcast(staged.df) if staged.count() <= limit else staged.df


def balanced(df: DataFrame, *keys: str, factor: int = 2) -> DataFrame:
    """df for work that is heavy per row: spread by the keys if it has fewer partitions than `factor` a core. df should
    be a scan without a shuffle, as the stages before one would run to tell the number."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * factor * 2, *keys) if df.rdd.getNumPartitions() < cores * factor else df
