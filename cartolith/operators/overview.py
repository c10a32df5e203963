"""Modules of a project as an overview: counters, leading symbols, entries, roles, and capabilities built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions.paths import extension_class, folder_key
from cartolith.functions.text import any_token, humanize

# Words that tell a module's role, in the order in which they are asked.
ENTRY_PATHS = "/main.cpp /main.cc /main.cxx /main.cp /main.cppm /main.ixx /main.mm /main.c".split()
ENTRY_FILES = "/main.js /main.mjs /main.cjs /main.ts /main.tsx /main.mts /main.cts /index.js /index.mjs /index.cjs /index.ts /index.tsx /index.mts /index.cts /app.js /app.mjs /app.cjs /app.ts /app.tsx /app.mts /app.cts /server.js /server.mjs /server.cjs /server.ts /server.tsx /server.mts /server.cts /bin/www application.java /main.java application.kt /main.kt".split()
ENTRY_WORDS = "/bootstrap /startup application logindlg mainwindow".split()
DEPENDENCY_WORDS = "qxlsx third_party thirdparty 3rdparty vendor external dependency dependencies".split()
LIBRARY_WORDS = "library package xlsx".split()
SAMPLE_WORDS = "sample samples example examples demo demos helloworld helloandroid issuetest testexcel showconsole readcolor webserver pump whattype".split()
SCRIPT_ROLES = [
    ("storage", "repository repo model schema database db mongoose sequelize typeorm prisma redis cache".split()),
    ("interaction", "express koa nestjs fastify hapi router route controller middleware endpoint server http api".split()),
    ("analysis", "service domain logic validator handler facade backend processor analysis".split()),
    ("web", "react vue next nuxt component page layout hooks frontend client".split()),
    ("tooling", "test spec mock fixture script build cli migration seed".split()),
]
WORD_ROLES = [
    ("presentation", "ui view widget window qml page screen desktop dialog mainwindow logindlg".split()),
    ("interaction", "controller handler route endpoint command facade backend management".split()),
    ("analysis", "service analyzer analysis parser indexer engine compiler algorithm graph prediction flowanalysis passengerflow".split()),
    ("visualization", "layout render canvas scene map web chart trend dynamic dashboard".split()),
    ("storage", "storage sqlite database repository cache persist resource data config csv xlsx".split()),
    ("tooling", "tool script build generate".split()),
    ("core_model", "core model entity domain schema types".split()),
]
COUNTED = ("class", "struct", "enum", "field", "function", "method")
BUCKETS = {"presentation": "experience", "interaction": "experience", "analysis": "analysis", "visualization": "visualization", "web": "web", "storage": "storage", "data": "data", "tooling": "tooling", "dependency": "dependency", "core_model": "foundation", "type_centric": "foundation", "procedure_centric": "workflow"}
# Folders of examples, tests and generated code.
EXAMPLE_DIRS = "example examples sample samples demo demos playground sandbox prototype prototypes bench benchmarks".split()
TEST_DIRS = "test tests testdata fixture fixtures mock mocks stub stubs __tests__".split()
GENERATED_DIRS = "generated generatedfiles autogen autogenerated .generated gen".split()
SUPPORT_ROLES = ("dependency", "storage", "data", "tooling", "core_model", "type_centric")


def top_symbols(nodes: DataFrame, k: int = 5) -> DataFrame:
    """(module_id, top_symbols): the first k distinct names of a module's types, functions and methods by (kind, path,
    line, name)."""
    prio = F.when(F.col("kind").isin("class", "struct", "enum"), 0).when(F.col("kind") == "function", 1).when(F.col("kind") == "method", 2)
    c = nodes.where(prio.isNotNull() & F.col("module_id").isNotNull() & (F.col("display_name") != "") & (F.col("file_path") != ""))
    named = c.groupBy("module_id", "display_name").agg(F.min(F.struct(prio.alias("p"), "file_path", "line", "display_name")).alias("o"))
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("module_id").orderBy("o"))).where(F.col("r") <= k)
    return ranked.groupBy("module_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "display_name"))), lambda x: x["display_name"]).alias("top_symbols"))


def is_dependency_like(evidence: Column) -> Column:
    return any_token(evidence, DEPENDENCY_WORDS) | (any_token(evidence, LIBRARY_WORDS) & any_token(evidence, SAMPLE_WORDS))


def role(evidence: Column, numeric: Column) -> Column:
    """The first rung that holds; words match anywhere in the text."""
    n = lambda c: F.col(f"{c}_files")
    out = F.when(is_dependency_like(evidence), "dependency").when(numeric, "tooling")
    out = out.when((n("qml") > 0) & (n("web") >= n("cpp")), "presentation").when((n("web") > 0) & (n("cpp") == 0) & (n("script") == 0), "web")
    script_only = (n("script") > 0) & (n("cpp") == 0) & (n("qml") == 0) & (n("web") == 0)
    for name, words in SCRIPT_ROLES:
        out = out.when(script_only & any_token(evidence, words), name)
    out = out.when((n("data") > 0) & (n("cpp") == 0) & (n("qml") == 0) & (n("web") == 0), "data")
    for name, words in WORD_ROLES:
        out = out.when(any_token(evidence, words), name)
    out = out.when(n("qml") > 0, "presentation").when(n("web") > 0, "web").when(n("script") > 0, "tooling").when(n("data") > 0, "data")
    types, procs = F.col("class_count") + F.col("struct_count") + F.col("enum_count"), F.col("function_count") + F.col("method_count")
    return out.when(types >= procs, "type_centric").when(procs > 0, "procedure_centric").otherwise("mixed")


def modules(nodes: DataFrame) -> DataFrame:
    """One row per module: counters of files by kind and of symbols, top symbols, role, entry flag and shown name.
    nodes must be free of repeated rows."""
    mods = nodes.where("kind = 'module'").select("id", "project_id", F.coalesce("display_name", F.lit("")).alias("name"))
    member = nodes.where("module_id IS NOT NULL")
    kind_of = extension_class(F.col("qualified_name"))
    files = member.where("kind = 'file'").groupBy("module_id").agg(F.count(F.lit(1)).alias("file_count"), *[F.count_if(kind_of == k).alias(f"{k}_files") for k in ("cpp", "qml", "web", "script", "data")], F.array_sort(F.collect_list("qualified_name")).alias("paths"))
    placed = member.where("kind NOT IN ('module', 'file') AND file_path <> ''")
    main = F.col("kind").isin("function", "method") & F.lower("display_name").isin("main", "wwinmain", "winmain", "qmlmain")
    symbols = placed.groupBy("module_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in COUNTED], F.bool_or(F.coalesce(main, F.lit(False)) | any_token(F.col("file_path"), ENTRY_PATHS)).alias("entry_symbol"))
    m = mods.join(files.withColumnRenamed("module_id", "id"), "id", "left").join(symbols.withColumnRenamed("module_id", "id"), "id", "left").join(top_symbols(member).withColumnRenamed("module_id", "id"), "id", "left")
    counters = ["file_count", *[f"{k}_files" for k in ("cpp", "qml", "web", "script", "data")], *[f"{k}_count" for k in COUNTED]]
    none = F.array().cast("array<string>")
    m = m.fillna(0, counters).withColumn("paths", F.coalesce("paths", none)).withColumn("top_symbols", F.coalesce("top_symbols", none)).withColumn("folder", folder_key(F.col("name")))
    last = F.lower(F.substring_index("name", "/", -1))
    match = F.try_element_at(F.filter("top_symbols", lambda s: F.lower(s) == last), F.lit(1))
    shown = F.when(F.contains("name", F.lit("/")) & match.isNotNull(), F.concat(F.regexp_replace("name", "[^/]*$", ""), match)).otherwise(F.col("name"))
    m = m.withColumn("name", shown).withColumn("evidence", F.concat_ws(" ", "name", "folder", F.array_join("paths", " "), F.array_join("top_symbols", " ")))
    numeric = F.col("folder").rlike("^[0-9]+$")
    m = m.withColumn("role", role(F.col("evidence"), numeric))
    barred = is_dependency_like(F.col("evidence")) | numeric
    likely = F.exists("paths", lambda p: any_token(p, [*ENTRY_PATHS, *ENTRY_FILES])) | any_token(F.col("evidence"), ENTRY_WORDS)
    return m.withColumn("is_entry", ~barred & (F.coalesce("entry_symbol", F.lit(False)) | likely)).drop("entry_symbol")


def capability_kind(is_entry: Column, role_: Column, is_leaf: Column, out_degree: Column) -> Column:
    return F.when(is_entry, "entry").when(role_.isin(*SUPPORT_ROLES) | (is_leaf & (out_degree == 0)), "infrastructure").otherwise("capability")


def bucket(kind: Column, role_: Column) -> Column:
    out = F.when(kind == "entry", "entry")
    for r, b in BUCKETS.items():
        out = out.when(role_ == r, b)
    return out.otherwise(F.when(kind == "infrastructure", "support").otherwise("capability"))


def capabilities(overview: DataFrame) -> DataFrame:
    """Modules with kind, bucket, cluster key and name. overview: modules() with in_degree, out_degree, stage, reachable.

    How a project aggregates depends on its number of modules: each module apart up to 16 (24 in a project of mixed
    artifacts), by folder and bucket up to 48, by bucket beyond."""
    project = Window.partitionBy("project_id")
    mixed = (F.col("qml_files") > 0) | (F.col("web_files") > 0) | (F.col("script_files") > 0) | (F.col("data_files") > 0)
    n, cross = F.count(F.lit(1)).over(project), F.count_if(mixed).over(project)
    mode = F.when((n <= 16) | ((cross >= 3) & (n <= 24)), "module_scoped").when(n <= 48, "folder_role_scoped").otherwise("role_scoped")
    o = overview.withColumn("mode", mode).withColumn("max_stage", F.max("stage").over(project)).withColumn("in_folder", F.count(F.lit(1)).over(Window.partitionBy("project_id", "folder")))
    leaf = (F.col("stage") == F.col("max_stage")) & (F.col("max_stage") > 0)
    o = o.withColumn("kind", capability_kind(F.col("is_entry"), F.col("role"), leaf, F.col("out_degree"))).withColumn("bucket", bucket(F.col("kind"), F.col("role")))
    scoped = (F.col("mode") == "folder_role_scoped") & (F.col("kind") != "entry") & (F.col("folder") != "") & (F.col("in_folder") > 1) & (F.col("folder") != F.col("name"))
    prefix = F.when(F.col("kind") == "infrastructure", "infra:").otherwise("cap:")
    ident = F.col("id").cast("string")
    key = F.when(F.col("kind") == "entry", F.concat(F.lit("entry:"), ident)).when(F.col("mode") == "module_scoped", F.concat(prefix, F.lit("module:"), ident)).when(scoped, F.concat(prefix, "folder", F.lit(":"), "bucket")).otherwise(F.concat(prefix, "bucket"))
    suffix = F.when(F.col("kind") == "infrastructure", " Infrastructure").otherwise(" Capability")
    title = F.when((F.col("kind") == "entry") | (F.col("mode") == "module_scoped"), humanize(F.col("name"))).when(scoped, F.concat(humanize(F.col("folder")), F.lit(" "), humanize(F.col("bucket")), suffix)).otherwise(F.concat(humanize(F.col("bucket")), suffix))
    return o.withColumn("cluster", key).withColumn("cluster_name", title)


def clusters(caps: DataFrame) -> DataFrame:
    """Capability nodes: sums, spans, the most frequent role (ties: the first by name), symbols and example files."""
    # a list per cluster: at most the modules of one project
    roles = caps.groupBy("project_id", "cluster", "role").agg(F.count(F.lit(1)).alias("c")).groupBy("project_id", "cluster").agg(F.min_by("role", F.struct((-F.col("c")).alias("n"), "role")).alias("dominant_role"))
    lists = lambda c: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("is_entry"), 0).otherwise(1).alias("e"), "name", "id", F.col(c).alias("v")))), lambda x: x["v"]))), 1, 6)
    out = caps.groupBy("project_id", "cluster").agg(
        F.min("kind").alias("kind"), F.min("cluster_name").alias("name"), F.count(F.lit(1)).alias("module_count"), F.sum("file_count").alias("file_count"), F.min("stage").alias("stage_start"), F.max("stage").alias("stage_end"),
        F.bool_or("reachable").alias("reachable"), F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"), F.min("mode").alias("mode"), lists("top_symbols").alias("symbols"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))), 1, 6).alias("example_files"))
    return out.join(roles, ["project_id", "cluster"])


def node_confidence(c: DataFrame) -> DataFrame:
    """c (with collaborators) and confidence, a score to 100 with its label."""
    s = F.least(F.col("file_count") * 8, F.lit(32)) + F.least(F.size("symbols") * 12, F.lit(24)) + F.least(F.col("collaborators") * 4, F.lit(16)) + F.when(F.col("reachable"), 10).otherwise(0) + F.when(F.col("kind") == "entry", 18).otherwise(0)
    s = s + F.when(F.col("mode") == "module_scoped", 18).when(F.col("mode") == "folder_role_scoped", 8).otherwise(0)
    s = F.when(F.col("module_count") > 3, F.greatest(s - 14, F.lit(0))).when(F.col("module_count") == 1, s + 10).otherwise(s)
    s = F.least(F.when(F.size("example_files") == 0, F.greatest(s - 10, F.lit(0))).otherwise(s), F.lit(100))
    return c.withColumn("confidence", s.cast("int")).withColumn("confidence_label", confidence_label(F.col("confidence"), 75, 45))


def confidence_label(score: Column, high: int, medium: int) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def visual_priority(c: DataFrame) -> Column:
    base = F.when(F.col("kind") == "entry", 1000).when(F.col("kind") == "capability", 500).otherwise(250)
    return (base + F.least((F.col("in_degree") + F.col("out_degree")) * 4, F.lit(400)) + F.least(F.col("module_count") * 20, F.lit(120)) + F.least(F.col("file_count") * 8, F.lit(80)) + F.when(F.col("reachable"), 60).otherwise(0)).cast("int")


def noise_class(path: Column) -> Column:
    """'generated', 'example', 'test' or null for a path."""
    s = F.filter(F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/"), lambda x: x != "")
    first = F.try_element_at(s, F.lit(1))
    generated = F.exists(s, lambda x: x.isin(*GENERATED_DIRS))
    return F.when(generated, "generated").when(first.isin(*EXAMPLE_DIRS), "example").when(first.isin(*TEST_DIRS), "test")


def findings(nodes: DataFrame) -> DataFrame:
    """(id, finding, severity, reasons) of hubs and isolated nodes. nodes: project_id, id, is_entry, in_degree,
    out_degree, reachable, visible."""
    total = F.col("in_degree") + F.col("out_degree")
    visible = F.count_if("visible").over(Window.partitionBy("project_id"))
    n = nodes.withColumn("floor", F.when(visible >= 12, 5).when(visible >= 7, 4).otherwise(3))
    hi, ho = F.col("in_degree") >= F.col("floor"), F.col("out_degree") >= F.col("floor")
    hub = hi | ho | ((total >= F.col("floor")) & (F.col("in_degree") >= 2) & (F.col("out_degree") >= 2))
    reasons = lambda *pairs: F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in pairs]))), ",")
    hubs = n.where(hub).select("project_id", "id", F.lit("hub").alias("finding"), F.when((total >= F.col("floor") + 3) | (hi & ho), "critical").otherwise("warning").alias("severity"), reasons(("high_total_degree", F.lit(True)), ("high_in_degree", hi), ("high_out_degree", ho), ("reachable_from_entry", F.col("reachable"))).alias("reasons"))
    alone, weak = total == 0, (total == 1) & ~F.col("reachable")
    isolated = n.where(~F.col("is_entry") & (alone | weak)).select("project_id", "id", F.lit("isolated").alias("finding"), F.when(alone, "warning").otherwise("info").alias("severity"), reasons(("no_relationships", alone), ("single_relationship", ~alone), ("not_reachable_from_entry", ~F.col("reachable")), ("hidden_in_default_view", ~F.col("visible"))).alias("reasons"))
    return hubs.unionByName(isolated)


def cycle_findings(component: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, size, severity, members) of components of two nodes or more; critical with an entry or from three on."""
    j = component.join(nodes.select("id", "is_entry"), "id")
    # a list per component, as the result has it
    g = j.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.bool_or("is_entry").alias("entry"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("members"))
    return g.where("size > 1").select("component", "size", F.when(F.col("entry") | (F.col("size") >= 3), "critical").otherwise("warning").alias("severity"), "members")
