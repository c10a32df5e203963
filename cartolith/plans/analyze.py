"""From files to the typed graph: file, module and symbol nodes with contains, includes, calls and depends_on edges.

All projects of the input are analysed at once; every step is a join or an aggregate over (project_id, …)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import paths as P
from cartolith.operators import cpp_facts, extract, resolve, rollup, rules
from cartolith.operators.skew import numbered
from cartolith.runtime import Staged
from cartolith.sources.tables import file_lines, newest_files


@dataclass
class Analysis:
    """nodes (project_id, id, kind, display_name, qualified_name, identity_key, file_path, line, module_id) and edges
    (project_id, from_id, to_id, kind, weight, support_count)."""

    nodes: DataFrame
    edges: DataFrame


def scanned(files: DataFrame, third_party: bool = False) -> DataFrame:
    """Files that belong to the architecture: relevant by extension or name, not generated, in no pruned folder."""
    p = F.col("path")
    return files.where(P.is_relevant(p) & ~P.is_generated_name(p) & P.pruned_at(p, third_party).isNull())


def _symbols(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """(project_id, path, line_no, kind, name, qualified_name) of all languages."""
    plain = extract.symbols(lines).select("project_id", "path", (F.col("line_no") - 1).alias("line_no"), "kind", "name", F.col("name").alias("qualified_name"))
    return plain.unionByName(cpp_facts.symbols_of(facts).select("project_id", "path", (F.col("line_no") - 1).alias("line_no"), "kind", "name", "qualified_name"))


def _numbered(parts: DataFrame) -> DataFrame:
    """Dense ids per project: files by path, then modules, then symbols by path and line."""
    placed = numbered(parts.withColumn("at", F.coalesce("file_path", F.lit(""))), "project_id", ["phase", "at", "line", "qualified_name", "kind"], "id")
    return placed.drop("at").withColumn("id", F.col("id").cast("bigint"))


def analyze(files: DataFrame, merge_rules: list[tuple[str, str]] | None = None, third_party: bool = False) -> Analysis:
    """files: project_id, path, content. An import that no ladder resolves goes to every node of its name, modules and
    symbols included, as the display name is all that it says. Repeated nodes of a kind and qualified name are one."""
    kept = Staged(scanned(files, third_party).select("project_id", "path", "content"), "scan").df
    paths = kept.select("project_id", "path")
    modules = rollup.infer_modules(paths)
    modules = Staged(rules.fold_merges(modules, merge_rules) if merge_rules else modules, "modules").df
    lines = file_lines(kept)
    facts = Staged(cpp_facts.cpp_facts(kept), "cpp").df
    symbols = Staged(_symbols(facts, lines), "symbols").df
    none = F.lit(None).cast("string")
    file_nodes = paths.select("project_id", F.lit(1).alias("phase"), F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("display_name"), F.col("path").alias("qualified_name"), F.concat(F.lit("file:"), "path").alias("identity_key"), F.col("path").alias("file_path"), F.lit(0).alias("line"))
    module_nodes = modules.select("project_id", "module").distinct().select("project_id", F.lit(2).alias("phase"), F.lit("module").alias("kind"), F.col("module").alias("display_name"), F.col("module").alias("qualified_name"), F.concat(F.lit("module:"), "module").alias("identity_key"), none.alias("file_path"), F.lit(0).alias("line"))
    first = F.min(F.struct("path", "line_no"))
    symbol_nodes = symbols.groupBy("project_id", "kind", "qualified_name").agg(first.alias("at"), F.min("name").alias("display_name")).select("project_id", F.lit(3).alias("phase"), "kind", "display_name", "qualified_name", none.alias("identity_key"), F.col("at.path").alias("file_path"), F.col("at.line_no").alias("line"))
    nodes_no = Staged(_numbered(file_nodes.unionByName(module_nodes).unionByName(symbol_nodes)), "nodes").df
    ids = lambda kind, key, name: nodes_no.where(F.col("kind") == kind).select("project_id", F.col("qualified_name").alias(key), F.col("id").alias(name))
    file_id, module_id = ids("file", "path", "file_id"), ids("module", "module", "module_id")
    member = Staged(modules.join(file_id, ["project_id", "path"]).join(module_id, ["project_id", "module"]).select("project_id", "path", "file_id", "module_id"), "member").df
    edge = lambda df, a, b, kind: df.select("project_id", F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(kind).alias("kind")).distinct()
    symbol_id = nodes_no.where("phase = 3").select("project_id", "kind", "qualified_name", F.col("id").alias("symbol_id"), "file_path")
    contains = edge(member, "module_id", "file_id", "contains").unionByName(edge(symbols.join(symbol_id.drop("file_path"), ["project_id", "kind", "qualified_name"]).join(file_id, ["project_id", "path"]), "file_id", "symbol_id", "contains"))
    imports = Staged(extract.imports(lines), "imports").df
    known = Staged(resolve.resolve_java_imports(imports, paths).unionByName(resolve.resolve_script_imports(imports, paths).where("resolved IS NOT NULL").select("project_id", "path", "specifier", "resolved")), "known").df
    target = file_id.select("project_id", F.col("path").alias("resolved"), F.col("file_id").alias("target_id"))
    exact = (
        resolve.resolve_includes(extract.cpp_includes(lines), paths).where("resolved IS NOT NULL").select("project_id", "path", "resolved")
        .unionByName(known.select("project_id", "path", "resolved"))
    )
    loose = imports.join(known.select("project_id", "path", "specifier").distinct(), ["project_id", "path", "specifier"], "left_anti").select("project_id", "path", F.col("name").alias("display_name")).distinct()
    named = nodes_no.select("project_id", "display_name", F.col("id").alias("target_id"))
    includes = exact.join(target, ["project_id", "resolved"]).select("project_id", "path", "target_id").unionByName(loose.join(named, ["project_id", "display_name"]).select("project_id", "path", "target_id"))
    includes = edge(includes.join(file_id, ["project_id", "path"]), "file_id", "target_id", "includes")
    called = cpp_facts.resolved(facts).where("target IS NOT NULL").select("project_id", F.element_at(F.split("call_id", r"\|"), 4).alias("caller"), F.col("target"))
    callable_id = symbol_id.where("kind IN ('function', 'method')").groupBy("project_id", "qualified_name").agg(F.min("symbol_id").alias("sid"))
    calls = called.join(callable_id.select("project_id", F.col("qualified_name").alias("caller"), F.col("sid").alias("a")), ["project_id", "caller"]).join(callable_id.select("project_id", F.col("qualified_name").alias("target"), F.col("sid").alias("b")), ["project_id", "target"])
    proven = Staged(contains.unionByName(includes).unionByName(edge(calls, "a", "b", "calls")).where("from_id <> to_id").distinct().withColumn("weight", F.lit(1).cast("bigint")).withColumn("support_count", F.lit(1).cast("bigint")), "facts").df
    bound = nodes_no.where("file_path IS NOT NULL").select("project_id", "id", F.col("file_path").alias("path")).join(member, ["project_id", "path"]).select("project_id", "id", "module_id")
    a, b = bound.select("project_id", F.col("id").alias("from_id"), F.col("module_id").alias("ma")), bound.select("project_id", F.col("id").alias("to_id"), F.col("module_id").alias("mb"))
    between = proven.where(F.col("kind").isin(*rollup.DEPENDENCY_KINDS)).join(a, ["project_id", "from_id"]).join(b, ["project_id", "to_id"]).where("ma <> mb")
    depends = between.groupBy("project_id", F.col("ma").alias("from_id"), F.col("mb").alias("to_id")).agg(F.sum("weight").alias("weight"), F.sum("support_count").alias("support_count")).withColumn("kind", F.lit("depends_on"))
    nodes = nodes_no.drop("phase").join(bound, ["project_id", "id"], "left")
    return Analysis(nodes, proven.unionByName(depends))


def analyzed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(newest_files(spark, sf_dir)).nodes


def analyzed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(newest_files(spark, sf_dir)).edges


QUERIES = {"analyzed_nodes": analyzed_nodes, "analyzed_edges": analyzed_edges}
SQL: dict[str, str] = {}
