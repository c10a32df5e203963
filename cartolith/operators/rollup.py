"""Files to modules: inference of module names from paths, and the roll-up of dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions.paths import BRIDGE_DIRS, GROUPED_ROOTS, directory_like, file_name, is_bootstrap, is_dependency_segment, is_manifest, segments, stem

DEPENDENCY_KINDS = ("includes", "calls", "inherits", "uses_type", "overrides")


def _seg(n: int) -> Column:
    return F.coalesce(F.get(F.col("seg"), n - 1), F.lit(""))


def _java(seg: Column) -> Column:
    return (F.size(seg) >= 4) & (F.get(seg, 0) == "src") & F.get(seg, 1).isin("main", "test") & F.get(seg, 2).isin("java", "kotlin")


def _grouped_root() -> Column:
    second = F.when(directory_like(_seg(2)), _seg(2)).otherwise(stem(_seg(2)))
    return F.when(F.size("seg") == 1, _seg(1)).when(second == "", _seg(1)).otherwise(F.concat_ws("/", _seg(1), second))


def _java_module(common: Column | None) -> Column:
    prefix, name = F.concat_ws("/", _seg(1), _seg(2)), F.lower(stem(F.element_at("seg", -1)))
    package = F.slice("seg", 4, F.greatest(F.size("seg") - 4, F.lit(0)))
    last = F.lower(F.try_element_at(package, F.lit(-1)))
    out = F.when(F.endswith(name, F.lit("application")) | name.isin("main", "bootstrap", "startup"), F.concat_ws("/", prefix, F.lit("bootstrap")))
    out = out.when(last.isNotNull() & ~last.isin("com", "org", "net", "io", "cn", "dev", "app"), F.concat_ws("/", prefix, last))
    if common is not None:
        out = out.when((F.coalesce(common, F.lit(0)) > 0) & (F.size(package) > common), F.concat_ws("/", prefix, F.lower(F.get(package, common))))
    return F.when(_java(F.col("seg")), out.otherwise(F.when(name == "", prefix).otherwise(F.concat_ws("/", prefix, name))))


def common_prefix_length(df: DataFrame, keys: list[str], array: str) -> DataFrame:
    """(keys, common): the number of leading elements that all arrays of a group share: those of the smallest and the
    largest, so one aggregate suffices."""
    ends = df.groupBy(*keys).agg(F.min(array).alias("lo"), F.max(array).alias("hi"))
    same = F.aggregate(F.arrays_zip("lo", "hi"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & x["lo"].eqNullSafe(x["hi"])).cast("int")).alias("n"), (a["on"] & x["lo"].eqNullSafe(x["hi"])).alias("on")))
    return ends.select(*keys, same["n"].alias("common"))


def infer_modules(paths: DataFrame) -> DataFrame:
    """(project_id, path, module) by the statistics of the project's paths; the first rung that gives a name:
    dependency root, flat top folder split by stem, Java source sets, grouped roots, three segments, two segments,
    generic bridge folder, top folder."""
    p = paths.select("project_id", "path", segments(F.col("path")).alias("seg"))
    name = file_name(F.col("path"))
    boot = is_bootstrap(name)
    component = F.when(~boot & (name != ""), F.lower(stem(F.element_at("seg", -1))))
    deep = (F.size("seg") >= 3) & directory_like(_seg(2))
    direct = F.size("seg") == 2
    rows = p.where(F.size("seg") > 0).withColumn("top", _seg(1)).withColumn("second", F.when(deep, _seg(2)))
    top = rows.groupBy("project_id", "top").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(direct).alias("direct"), F.count_distinct(F.when(direct, component)).alias("stems"), F.bool_or(direct & (boot | is_manifest(name))).alias("has_boot"), F.count_distinct("second").alias("seconds"))
    third = F.when((F.size("seg") >= 4) & directory_like(_seg(3)), _seg(3))
    pre = rows.where("second IS NOT NULL").groupBy("project_id", "top", "second").agg(F.count(F.lit(1)).alias("pre_files"), F.count_distinct(third).alias("thirds"))
    java = rows.where(_java(F.col("seg"))).select("project_id", _seg(2).alias("set"), F.slice("seg", 4, F.size("seg") - 4).alias("package"))
    common = common_prefix_length(java, ["project_id", "set"], "package").withColumnRenamed("set", "second_seg")
    j = rows.withColumn("second_seg", _seg(2)).join(top, ["project_id", "top"], "left").join(pre, ["project_id", "top", "second"], "left").join(common, ["project_id", "second_seg"], "left")
    dep = is_dependency_segment(F.col("top"))
    flat = ~dep & ~F.col("top").rlike("^[0-9]+$") & direct & (F.col("direct") >= 8) & (F.col("stems") >= 5) & F.col("has_boot")
    module = F.coalesce(
        F.when(F.size("seg") == 1, F.when(directory_like(_seg(1)), _seg(1)).otherwise(F.lit("(root)"))),
        F.when(dep, F.col("top")),
        F.when(flat, F.when(boot, F.col("top")).when(component != "", F.concat_ws("/", "top", component))),
        _java_module(F.col("common")),
        F.when(F.col("top").isin(*GROUPED_ROOTS), _grouped_root()),
        F.when((F.size("seg") >= 4) & F.col("second").isNotNull() & (F.col("pre_files") >= 6) & (F.col("thirds") >= 2) & directory_like(_seg(3)), F.concat_ws("/", _seg(1), _seg(2), _seg(3))),
        F.when(F.col("second").isNotNull() & (F.col("files") >= 4) & (F.col("seconds") >= 2), F.concat_ws("/", _seg(1), _seg(2))),
        F.when((F.size("seg") >= 4) & F.lower(_seg(2)).isin(*BRIDGE_DIRS) & directory_like(_seg(3)), F.concat_ws("/", _seg(1), _seg(3))),
        F.col("top"),
    )
    empty = p.where(F.size("seg") == 0).select("project_id", "path", F.lit("(root)").alias("module"))
    return j.select("project_id", "path", module.alias("module")).unionByName(empty)


def single_path_module(paths: DataFrame) -> DataFrame:
    """(project_id, path, module) by each path alone."""
    p = paths.select("project_id", "path", segments(F.col("path")).alias("seg"))
    module = F.coalesce(
        F.when(F.size("seg") == 0, F.lit("(root)")),
        F.when(F.size("seg") == 1, F.when(directory_like(_seg(1)), _seg(1)).otherwise(F.lit("(root)"))),
        F.when(is_dependency_segment(_seg(1)) | _seg(1).rlike("^[0-9]+$"), _seg(1)),
        _java_module(None), F.when(_seg(1).isin(*GROUPED_ROOTS), _grouped_root()), _seg(1))
    return p.select("project_id", "path", module.alias("module"))


def node_modules_of(nodes: DataFrame) -> DataFrame:
    """(id, module): a module is its own; other nodes have theirs from their row."""
    return nodes.select("id", F.when(F.col("kind") == "module", F.col("id")).otherwise(F.col("module_id")).alias("module")).where("module IS NOT NULL").distinct()


def module_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_module, to_module, edge_count, weight, support_count) over edges of code between modules.

    Edges are first reduced per pair of ends, so the two joins move one row per pair and a heavy end's rows are
    combined before any shuffle. Null weights add nothing."""
    pairs = edges.where(F.col("kind").isin(*DEPENDENCY_KINDS) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum("support_count").alias("s"))
    member = node_modules_of(nodes)
    a, b = member.select(F.col("id").alias("from_id"), F.col("module").alias("from_module")), member.select(F.col("id").alias("to_id"), F.col("module").alias("to_module"))
    joined = pairs.join(a, "from_id").join(b, "to_id").where("from_module <> to_module")
    return joined.groupBy("from_module", "to_module").agg(F.sum("n").alias("edge_count"), F.coalesce(F.sum("w"), F.lit(0)).alias("weight"), F.coalesce(F.sum("s"), F.lit(0)).alias("support_count"))
