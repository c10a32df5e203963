"""The domain tables as the operators want them, and readers for raw repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.runtime import table

FILES = "project_id string, path string, length bigint, modification_time timestamp, content string"
CONFIG = (
    "version int, ignoreDirectories array<string>, moduleMerges array<struct<match: string, module: string>>, roleOverrides array<struct<match: string, role: string>>, "
    "entryOverrides array<struct<match: string, entry: boolean>>, dependencyFoldRules array<struct<match: string, collapse: boolean, hideByDefault: boolean>>"
)


def scan_repository(spark: SparkSession, root: str, project_id: str, with_content: bool = True) -> DataFrame:
    """Files under root in the schema of the files table; paths are relative to root. Without content the bytes are
    never read. binaryFile prunes the column, so one definition serves both scans."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    path = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    columns = [F.lit(project_id).alias("project_id"), F.substr(path, F.length(base) + 2).alias("path"), "length", F.col("modificationTime").alias("modification_time")]
    return raw.select(*columns, F.decode("content", "UTF-8").alias("content")) if with_content else raw.select(*columns)


def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, path, length, modification_time, content): the newest state of each file."""
    f = table(spark, sf_dir, "files").where("path IS NOT NULL")
    last = F.max(F.struct("modification_time", "scanned_at", "content", "length"))
    return f.groupBy("project_id", "path").agg(last.alias("s")).select("project_id", "path", "s.length", "s.modification_time", "s.content")


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where("path IS NOT NULL").select("project_id", "path").distinct()


def file_lines(files: DataFrame) -> DataFrame:
    """(project_id, path, line_no from 1, line) of files with content; carriage returns and a byte-order mark go."""
    text = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r", "")
    lines = files.where(F.col("content").isNotNull()).select("project_id", "path", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.select("project_id", "path", (F.col("pos") + 1).alias("line_no"), "line")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes without repeated rows."""
    return table(spark, sf_dir, "nodes").distinct()


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edges")


def commerce_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f, t, w): nations as modules, a line item from the supplier's to the customer's nation as an edge of weight 1."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("f"), F.col("c_nationkey").alias("t")).agg(F.count(F.lit(1)).alias("w"))


def project_config(spark: SparkSession, path: str) -> DataFrame:
    """One row of a project's configuration, whose fields may stand under `analysis`; malformed items become null."""
    raw = spark.read.option("multiLine", True).schema(f"{CONFIG}, analysis struct<{CONFIG.replace(' int', ': int', 1).replace(' array', ': array')}>").json(path)
    names = ["ignoreDirectories", "moduleMerges", "roleOverrides", "entryOverrides", "dependencyFoldRules"]
    return raw.select(F.coalesce("version", "analysis.version", F.lit(1)).alias("version"), *[F.coalesce(n, f"analysis.{n}").alias(n) for n in names])


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(path, arguments) of a compile database: C and C++ units, one per path."""
    raw = spark.read.option("multiLine", True).schema("directory string, file string, arguments array<string>, command string").json(path)
    whole = F.when(F.startswith("file", F.lit("/")), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    rows = raw.select(whole.alias("path"), F.coalesce("arguments", F.split("command", r"\s+")).alias("arguments"))
    return rows.where(F.lower("path").rlike(r"\.(c|cc|cpp|cxx|cp|c\+\+|cu|mm|ixx|cppm)$")).dropDuplicates(["path"])


def sanitized_arguments(arguments: Column) -> Column:
    """Compile arguments for a parse: without -c, -o and its value, dependency-file flags, and objects or libraries."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))
    valued, single = ["-o", "-MF", "-MT", "-MQ", "/Fo", "/Fd"], ["-c", "/c", "-MD", "-MMD", "-MP", "-M", "-MM", "-S", "-E"]
    artifact = lambda a: F.lower(a).rlike(r"\.(o|obj|a|lib|so|dll|dylib)$") | a.rlike("^-l|^-L|^-Wl,")

    def step(acc, a):
        drop = acc["skip"] | a.isin(*single, *valued) | artifact(a)
        return F.struct(F.when(drop, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(a))).alias("kept"), (~acc["skip"] & a.isin(*valued)).alias("skip"))

    return F.aggregate(arguments, start, step, lambda acc: acc["kept"])


#: Where a project's configuration and compile database may stand, in the order in which they are sought.
CONFIG_CANDIDATES = ["config/architecture.json", "architecture.json", ".architecture/config.json", "config/project.json"]
COMPILE_DATABASES = ["compile_commands.json", ".qtc_clangd/compile_commands.json", "build/compile_commands.json", "build/.qtc_clangd/compile_commands.json"]
_RULES = {"moduleMerges": ("merge", "module"), "roleOverrides": ("role", "role"), "entryOverrides": ("entry", "entry"), "dependencyFoldRules": ("fold", "collapse")}


def first_existing(files: DataFrame, candidates: list[str]) -> DataFrame:
    """(project_id, path, content) of each project's first candidate that there is; other columns are ignored."""
    order = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.regexp_replace("path", r"^(?:\./)+", ""))
    found = files.withColumn("rank", order).where("rank > 0")
    return found.groupBy("project_id").agg(F.min_by(F.struct("path", "content"), F.struct("rank", "path")).alias("s")).select("project_id", "s.path", "s.content")


def compile_database(files: DataFrame) -> DataFrame:
    """(project_id, path, content) of each project's compile database: at one of COMPILE_DATABASES, else in a folder below
    build, the first by name."""
    fixed = first_existing(files, COMPILE_DATABASES)
    below = files.where(F.col("path").rlike(r"^build/[^/]+/(?:\.qtc_clangd/)?compile_commands\.json$")).groupBy("project_id").agg(F.min(F.struct("path", "content")).alias("s")).select("project_id", "s.path", "s.content")
    known = fixed.select(F.col("project_id").alias("p"))
    return fixed.unionByName(below.join(known, F.col("project_id").eqNullSafe(F.col("p")), "left_anti"))


def config_rules(files: DataFrame, candidates: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, diagnostics) of the projects' configurations: rules (project_id, rule, match, value), distinct, and
    diagnostics (project_id, path, message) for what is malformed.

    A text that is no JSON object, a list that is none, and items without a match are reported and left out; the rest is
    kept. Fields may stand under `analysis`. ignoreDirectories gives rules `ignore` without a value."""
    found = first_existing(files, candidates or CONFIG_CANDIDATES)
    v = found.select("project_id", "path", F.try_parse_json("content").alias("v"))
    good = v.where(F.schema_of_variant("v").startswith("OBJECT"))
    bad = v.where(F.coalesce(~F.schema_of_variant("v").startswith("OBJECT"), F.lit(True))).select("project_id", "path", F.lit("no JSON object").alias("message"))
    body = F.coalesce(F.try_variant_get("v", "$.analysis", "variant"), F.col("v"))
    fields = good.select("project_id", "path", body.alias("b")).select("project_id", "path", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.try_variant_get("b", f"$.{k}", "variant").alias("x")) for k in ["ignoreDirectories", *_RULES]])).alias("f")).select("project_id", "path", "f.key", "f.x").where("x IS NOT NULL")
    lists = F.try_variant_get("x", "$", "array<variant>")
    no_list = fields.where(lists.isNull()).select("project_id", "path", F.concat("key", F.lit(" is no list")).alias("message"))
    items = fields.where(lists.isNotNull()).select("project_id", "path", "key", F.explode(lists).alias("i"))
    plain = F.when(F.schema_of_variant("i") == "STRING", F.try_variant_get("i", "$", "string"))
    match = F.when(F.col("key") == "ignoreDirectories", plain).otherwise(F.try_variant_get("i", "$.match", "string"))
    rule, value = F.when(F.col("key") == "ignoreDirectories", "ignore"), F.when(F.col("key") == "ignoreDirectories", "")
    for key, (name, field) in _RULES.items():
        rule, value = rule.when(F.col("key") == key, name), value.when(F.col("key") == key, F.coalesce(F.try_variant_get("i", f"$.{field}", "string"), F.lit("true" if name in ("entry", "fold") else "")))
    token = F.regexp_replace(F.lower(F.trim(F.regexp_replace(match, r"\\", "/"))), r"^(?:\./)+|/+$", "")
    parsed = items.select("project_id", "path", "key", rule.alias("rule"), token.alias("match"), value.alias("value"))
    ok = (F.col("match") != "") & ((F.col("value") != "") | (F.col("rule") == "ignore"))
    rejected = parsed.where(~F.coalesce(ok, F.lit(False))).select("project_id", "path", F.concat("key", F.lit(" has an item without a match or value")).alias("message"))
    return parsed.where(ok).select("project_id", "rule", "match", "value").distinct(), bad.unionByName(no_list).unionByName(rejected)
