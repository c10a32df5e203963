"""Rules by path prefix: a prefix meets itself and what lies below it. Rules are (ord, match, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions.paths import segments


def ancestors(path: Column) -> Column:
    """A path and all folders above it: the prefixes that it can meet, so rules join by equality."""
    s = segments(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda i: F.array_join(F.slice(s, 1, i), "/"))


def normal_prefix(p: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(p), r"\\", "/"), r"^(?:\./)+|/+$", "")


def matches(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Each path with each rule that it meets. Rules are a small table written by people and are broadcast."""
    keyed = F.broadcast(rules.withColumn("__prefix", normal_prefix(F.col("match"))))
    return paths.withColumn("__prefix", F.explode(ancestors(F.col(path)))).join(keyed, "__prefix").drop("__prefix")


def last_wins(paths: DataFrame, rules: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return matches(paths, rules).groupBy(*keys).agg(F.max_by(value, "ord").alias(value))


def first_wins(paths: DataFrame, rules: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return matches(paths, rules).groupBy(*keys).agg(F.min_by(value, "ord").alias(value))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths that meet no rule."""
    hit = matches(paths, rules).select("project_id", "path").distinct()
    return paths.join(hit, ["project_id", "path"], "left_anti")


def fold_merges(modules: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Every rule in order renames a module whose path or present name it meets; later rules see the new name."""
    name = F.col("module")
    for match, target in rules:
        meets = lambda c, m=match: (c == m) | F.startswith(c, F.lit(m + "/"))
        name = F.when(meets(F.col("path")) | meets(name), F.lit(target)).otherwise(name)
    return modules.withColumn("module", name)
