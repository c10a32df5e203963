"""References to nodes and files: ranked join ladders, and the merging of edges and nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions.paths import normalize, parent, segments


def unique_lookup(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value) of the keys that stand for exactly one distinct value; null keys stand for none."""
    known = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)) if keys else df
    return known.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__last")).where(F.col(value) == F.col("__last")).drop("__last")


def path_suffixes(paths: DataFrame) -> DataFrame:
    """(project_id, path, suffix): every suffix of a path that begins at a segment. It turns the search for a file
    that ends with a given path into an equi-join."""
    seg = segments(F.col("path"))
    return paths.select("project_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(seg), F.lit(1))), lambda i: F.array_join(F.slice(seg, i, F.size(seg)), "/"))).alias("suffix"))


def resolve_includes(includes: DataFrame, paths: DataFrame) -> DataFrame:
    """(…, resolved, rung): (1) beside the including file unless in angle brackets, (2) from the root, (3) the only
    path that ends so, (4) the only file of that name; null where none holds."""
    files = paths.select("project_id", F.col("path").alias("hit"))
    suffix = unique_lookup(path_suffixes(paths), ["project_id", "suffix"], "path")
    base = unique_lookup(paths.withColumn("base", F.substring_index("path", "/", -1)), ["project_id", "base"], "path")
    inc = includes.withColumn("root", normalize(F.col("target")))
    inc = inc.withColumn("near", F.when(~F.col("is_system"), normalize(F.when(parent(F.col("path")) == "", F.col("target")).otherwise(F.concat_ws("/", parent(F.col("path")), "target")))))
    inc = inc.withColumn("base", F.substring_index("root", "/", -1))
    out = inc
    for name, right, key in (
        ("r1", files.select("project_id", F.col("hit").alias("near"), F.col("hit").alias("r1")), "near"),
        ("r2", files.select("project_id", F.col("hit").alias("root"), F.col("hit").alias("r2")), "root"),
        ("r3", suffix.select("project_id", F.col("suffix").alias("root"), F.col("path").alias("r3")), "root"),
        ("r4", base.select("project_id", "base", F.col("path").alias("r4")), "base"),
    ):
        out = out.join(right, ["project_id", key], "left")
    rung = F.when(F.col("r1").isNotNull(), 1).when(F.col("r2").isNotNull(), 2).when(F.col("r3").isNotNull(), 3).when(F.col("r4").isNotNull(), 4)
    return out.select("project_id", "path", "line_no", "target", "is_system", F.coalesce("r1", "r2", "r3", "r4").alias("resolved"), rung.alias("rung"))


def resolve_java_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(project_id, path, specifier, resolved): files that end with the class's path; all files of the package for a
    wildcard; without a match those of the name with its last part dropped. One import may have several files."""
    java = imports.where("language = 'java'").select("project_id", "path", "specifier").distinct().withColumn("wild", F.endswith("specifier", F.lit(".*")))
    java = java.withColumn("slashed", F.replace(F.regexp_replace("specifier", r"\.\*$", ""), F.lit("."), F.lit("/")))
    ends = path_suffixes(paths).where("suffix <> path").select("project_id", F.col("path").alias("resolved"), "suffix")
    exact = java.where("NOT wild").withColumn("suffix", F.concat("slashed", F.lit(".java")))
    first = exact.join(ends, ["project_id", "suffix"])
    rest = exact.join(first.select("project_id", "path", "specifier").distinct(), ["project_id", "path", "specifier"], "left_anti")
    rest = rest.where(F.instr("slashed", "/") > 0).withColumn("suffix", F.concat(F.regexp_replace("slashed", "/[^/]*$", ""), F.lit(".java")))
    second = rest.join(ends, ["project_id", "suffix"])
    folders = paths.select("project_id", parent(F.col("path")).alias("path"), F.col("path").alias("resolved"))
    tails = path_suffixes(folders.select("project_id", "path").distinct()).where("suffix <> path OR suffix = path")
    inside = tails.join(folders, ["project_id", "path"]).select("project_id", "suffix", "resolved")
    wild = java.where("wild").withColumn("suffix", F.col("slashed")).join(inside, ["project_id", "suffix"])
    pick = ["project_id", "path", "specifier", "resolved"]
    return first.select(*pick).unionByName(second.select(*pick)).unionByName(wild.select(*pick)).distinct()


# What is tried behind a relative specifier, in this order.
SCRIPT_TRIES = ["", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", "/index.js", "/index.mjs", "/index.cjs", "/index.ts", "/index.tsx", "/index.mts", "/index.cts"]


def resolve_script_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(project_id, path, specifier, resolved): relative specifiers as given, with seven extensions, then seven index
    files; the first that exists, null if none does."""
    rel = imports.where("language IN ('javascript', 'typescript') AND (startswith(specifier, './') OR startswith(specifier, '../'))").select("project_id", "path", "specifier").distinct()
    base = normalize(F.when(parent(F.col("path")) == "", F.col("specifier")).otherwise(F.concat_ws("/", parent(F.col("path")), "specifier")))
    tries = F.posexplode(F.transform(F.array(*[F.lit(t) for t in SCRIPT_TRIES]), lambda t: F.concat(base, t))).alias("rank", "hit")
    found = rel.select("*", tries).join(paths.select("project_id", F.col("path").alias("hit")), ["project_id", "hit"])
    best = found.groupBy("project_id", "path", "specifier").agg(F.min_by("hit", "rank").alias("resolved"))
    return rel.join(best, ["project_id", "path", "specifier"], "left")


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls (call_id, project_id, callee, type_prefix, namespace_prefix) with `target` and `rung`: (1) the qualified
    name as written, (2) in the type, (3) in the namespace, (4) the only node of the simple name in the namespace,
    (5) the only one at all. A qualified name of several nodes resolves to none."""
    named = nodes.where("qualified_name IS NOT NULL AND qualified_name <> ''")
    exact = unique_lookup(named, ["project_id", "qualified_name"], "id")
    shown = nodes.where("display_name IS NOT NULL AND display_name <> ''").select("project_id", F.col("display_name").alias("simple"), "id", "qualified_name")
    only = unique_lookup(shown, ["project_id", "simple"], "id")
    c = calls.withColumn("callee", F.regexp_replace("callee", "^::", ""))
    c = c.withColumn("k1", F.col("callee")).withColumn("k2", F.when(F.col("type_prefix") != "", F.concat_ws("::", "type_prefix", "callee"))).withColumn("k3", F.when(F.col("namespace_prefix") != "", F.concat_ws("::", "namespace_prefix", "callee")))
    c = c.withColumn("simple", F.substring_index("callee", "::", -1))
    for n in (1, 2, 3):
        c = c.join(exact.select("project_id", F.col("qualified_name").alias(f"k{n}"), F.col("id").alias(f"r{n}")), ["project_id", f"k{n}"], "left")
    # every namespace around a node, so that the search in a namespace is an equi-join whatever the simple name
    around = F.split("qualified_name", "::")
    inner = shown.where(F.contains("qualified_name", F.lit("::"))).select(
        "project_id", "simple", "id", F.explode(F.transform(F.sequence(F.lit(1), F.size(around) - 1), lambda i: F.array_join(F.slice(around, F.lit(1), i), "::"))).alias("namespace_prefix"))
    scoped = unique_lookup(inner, ["project_id", "simple", "namespace_prefix"], "id").withColumnRenamed("id", "r4")
    c = c.join(scoped.where("namespace_prefix <> ''"), ["project_id", "simple", "namespace_prefix"], "left").join(only.select("project_id", "simple", F.col("id").alias("r5")), ["project_id", "simple"], "left")
    rungs = [F.col(f"r{n}") for n in range(1, 6)]
    rung = F.coalesce(*[F.when(r.isNotNull(), n) for n, r in enumerate(rungs, 1)])
    return c.select("call_id", "project_id", "callee", F.coalesce(*rungs).alias("target"), rung.alias("rung"))


def merge_edges(edges: DataFrame, accumulate: bool, order: Sequence[str] = ("observed_at",)) -> DataFrame:
    """One edge per (from_id, to_id, kind); self-loops and ends 0 or null go. Accumulating sums weight and support;
    else the first weight by `order` stays (ties: the smaller weight) with the largest support. 'semantic' wins."""
    proper = edges.where("from_id <> 0 AND to_id <> 0 AND from_id <> to_id")
    source = F.max("fact_source").alias("fact_source")
    if accumulate:
        aggs = [F.sum("weight").alias("weight"), F.sum("support_count").alias("support_count"), source]
    else:
        aggs = [F.min_by("weight", F.struct(*order, "weight")).alias("weight"), F.max("support_count").alias("support_count"), source]
    return proper.groupBy("from_id", "to_id", "kind").agg(*aggs)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes by identity key; without one by (kind, qualified name). Empty fields are filled from the row with the
    smallest id that has them; distinct identities stay apart."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    key = F.coalesce(F.concat(F.lit("id:"), filled("identity_key")), F.concat(F.lit("name:"), "kind", F.lit(":"), filled("qualified_name")), F.concat(F.lit("row:"), F.col("id").cast("string")))
    first = lambda c: F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col("id")))
    keyed = nodes.withColumn("merge_key", key)
    return keyed.groupBy("project_id", "merge_key").agg(
        F.min("id").alias("id"), F.min_by("kind", "id").alias("kind"), first("display_name").alias("display_name"), first("qualified_name").alias("qualified_name"), first("file_path").alias("file_path"),
        F.min_by("line", F.when(F.col("line") > 0, F.col("id"))).alias("line"), F.max("fact_source").alias("fact_source"), F.count_distinct("id").alias("merged"),
    )
