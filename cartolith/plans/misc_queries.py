"""Queries over symbols, requests, reports, events and the geometry of layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.functions import paths as P
from cartolith.functions import replies
from cartolith.functions import text as T
from cartolith.operators import graph as G
from cartolith.operators import layout as L
from cartolith.operators import overview as O
from cartolith.operators import rollup
from cartolith.operators.skew import numbered
from cartolith.plans import graph_queries as Q
from cartolith.plans.sqlparts import MODULE_EDGES, NEWEST, NODES, PATHS, base, ext, in_list
from cartolith.runtime import Staged, table
from cartolith.sources.tables import file_paths, graph_edges, graph_nodes, newest_files
from cartolith.streaming import incremental

_LOC = r"^(.*):(\d+)$"


def _symbol_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "semantic_symbols").where("identity_key IS NOT NULL").distinct()


def symbol_registry(spark, d):
    """One row per symbol with its set of declarations, the first of which is its place, numbered in order of place."""
    place = F.transform("declaration_locations", lambda x: F.struct(F.regexp_extract(x, _LOC, 1).alias("p"), F.regexp_extract(x, _LOC, 2).cast("int").alias("l")))
    s = _symbol_rows(spark, d).withColumn("places", F.coalesce(place, F.array().cast("array<struct<p: string, l: int>>")))
    # lists of one symbol's declarations
    g = s.groupBy("project_id", "identity_key").agg(F.min("kind").alias("kind"), F.min("qualified_name").alias("qualified_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    first = F.try_element_at("places", F.lit(1))
    g = g.select("project_id", "identity_key", "kind", "qualified_name", first["p"].alias("path"), first["l"].alias("line"), F.size("places").alias("declarations"))
    keyed = g.withColumn("o1", F.coalesce("path", F.lit(""))).withColumn("o2", F.coalesce("line", F.lit(0))).withColumn("o3", F.coalesce("qualified_name", F.lit("")))
    return numbered(keyed, "project_id", ["o1", "o2", "o3", "kind", "identity_key"], "ord").drop("o1", "o2", "o3").withColumn("ord", F.col("ord").cast("int"))


def preferred_locations(spark, d):
    return symbol_registry(spark, d).where("path IS NOT NULL").select("project_id", "identity_key", "path", "line")


def semantic_edge_support(spark, d):
    e = graph_edges(spark, d).where("fact_source = 'semantic' AND kind IN ('inherits', 'overrides', 'uses_type') AND from_id <> 0 AND to_id <> 0")
    return e.groupBy("kind", "from_id", "to_id").agg(F.count(F.lit(1)).alias("support"))


def type_use_closure(spark, d):
    """What the types of all projects use, directly or not; the types themselves with 0 steps."""
    e = graph_edges(spark, d).where("kind = 'uses_type' AND from_id <> 0 AND to_id <> 0").select(F.col("from_id").alias("f"), F.col("to_id").alias("t")).distinct()
    return G.reach(e, graph_nodes(spark, d).where("kind IN ('class', 'struct', 'enum')").select("id"))


def external_usage(spark, d):
    """Uses of symbols outside all projects; a fixed table, broadcast."""
    x = F.broadcast(table(spark, d, "external_symbols").select(F.col("id").alias("to_id"), "display_name", F.col("kind").alias("symbol_kind")))
    return graph_edges(spark, d).groupBy("to_id", "project_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("weight").alias("weight")).join(x, "to_id")


def adjacency_index(spark, d):
    _, e = Q.module_graph(spark, d)
    both = e.select(F.col("f").alias("id"), F.col("t").alias("n")).unionByName(e.select(F.col("t").alias("id"), F.col("f").alias("n")))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("incident"), F.array_join(F.transform(F.array_sort(F.collect_set("n")), lambda x: x.cast("string")), ",").alias("neighbours"))


def edge_endpoints(spark, d):
    _, e = Q.module_graph(spark, d)
    m = graph_nodes(spark, d).where("kind = 'module'")
    return e.join(m.select(F.col("id").alias("f"), F.col("display_name").alias("from_name")), "f").join(m.select(F.col("id").alias("t"), F.col("display_name").alias("to_name")), "t")


def root_modules(spark, d):
    """The module of a project from which the view starts: many outgoing, few incoming edges, reachable, core."""
    o = Q.overview_table(spark, d)
    score = F.col("out_degree") * 4 - F.col("in_degree") + F.when(F.col("reachable") | F.col("is_entry"), 64).otherwise(0) + F.when(F.contains("role", F.lit("core")), 3).otherwise(0)
    return o.groupBy("project_id").agg(F.max_by("id", F.struct(score.alias("s"), (-F.col("id")).alias("i"))).alias("root_id"), F.max(score).cast("bigint").alias("score"))


def stage_groups(spark, d):
    o = Q.overview_table(spark, d)
    return o.groupBy("project_id", "stage").agg(F.count(F.lit(1)).alias("modules"), F.sum("file_count").alias("files"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def lane_groups(spark, d):
    return O.capabilities(Q.overview_table(spark, d)).groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("reachable")).alias("unreachable"))


def role_groups(spark, d):
    return O.capabilities(Q.overview_table(spark, d)).where("kind <> 'entry'").groupBy("project_id", "role").agg(F.count(F.lit(1)).alias("members"), F.sum("file_count").alias("files"))


def confidence_histogram(spark, d):
    s = Q.capability_scores(spark, d)
    return s.groupBy("project_id").agg(F.count(F.lit(1)).alias("capabilities"), *[F.count_if(F.col("confidence_label") == x).alias(x) for x in ("high", "medium", "low")])


def component_nodes(spark, d):
    """Files of a module clustered by name without extension, with symbols, kind, stage and priority."""
    n = graph_nodes(spark, d).where("module_id IS NOT NULL AND file_path <> ''").withColumn("component", F.regexp_replace("file_path", r"\.[^.]*$", ""))
    main = F.col("kind").isin("function", "method") & F.lower("display_name").isin("main", "winmain", "wwinmain", "qmlmain")
    g = n.groupBy("module_id", "component").agg(F.count_distinct("file_path").alias("files"), F.count_if(F.col("kind") != "file").alias("symbols"), F.bool_or(F.coalesce(main, F.lit(False))).alias("entry"), F.bool_and(P.extension_class(F.col("file_path")) == "data").alias("support"))
    kind = F.when(F.col("entry"), "entry").when(F.col("support"), "support").otherwise("component")
    g = g.withColumn("kind", kind)
    return g.select("module_id", "component", "files", "symbols", "kind", F.when(F.col("kind") == "entry", 0).when(F.col("kind") == "support", 2).otherwise(1).alias("stage"), (F.col("files") * 3 + F.when(F.col("kind") == "entry", 65).when(F.col("kind") == "support", 5).otherwise(15)).cast("int").alias("priority"))


def component_edges(spark, d):
    """Edges between file clusters of one module, by weight of at least 1 each."""
    n = graph_nodes(spark, d).where("module_id IS NOT NULL AND file_path <> ''").select("id", "module_id", F.regexp_replace("file_path", r"\.[^.]*$", "").alias("c")).distinct()
    e = graph_edges(spark, d).where("kind <> 'contains'").groupBy("from_id", "to_id").agg(F.sum(F.greatest(F.lit(1), F.coalesce("weight", F.lit(1)))).alias("w"))
    a, b = n.select(F.col("id").alias("from_id"), F.col("module_id"), F.col("c").alias("from_component")), n.select(F.col("id").alias("to_id"), F.col("module_id").alias("m2"), F.col("c").alias("to_component"))
    return e.join(a, "from_id").join(b, "to_id").where("module_id = m2 AND from_component <> to_component").groupBy("module_id", "from_component", "to_component").agg(F.sum("w").alias("weight"))


def component_names(spark, d):
    """A name for each class and struct that no other in its module has: the shown name, then with the file's stem, then
    with a number."""
    n = graph_nodes(spark, d).where("kind IN ('class', 'struct') AND module_id IS NOT NULL AND display_name <> ''").select("id", "module_id", "display_name", "file_path").dropDuplicates(["id"])
    stem = P.stem(F.coalesce(F.substring_index("file_path", "/", -1), F.lit("")))
    c = n.select("*", F.posexplode(F.array(F.col("display_name"), F.concat("display_name", F.lit(" ("), stem, F.lit(")")))).alias("o", "cand"))
    only = c.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("module_id", F.lower("cand")))).where("n = 1")
    best = only.groupBy("id").agg(F.min_by("cand", "o").alias("best"))
    number = F.row_number().over(Window.partitionBy("module_id", F.lower("display_name")).orderBy("id"))
    return n.withColumn("k", number).join(best, "id", "left").select("id", "module_id", F.coalesce("best", F.concat("display_name", F.lit(" #"), F.col("k").cast("string"))).alias("name"))


def readiness(spark, d):
    """How far each project's last report can be trusted."""
    r = table(spark, d, "analysis_report").distinct()
    last = r.groupBy("project_id").agg(F.max(F.struct("exported_at", "entry_id", "precision_level", "semantic_status_code", "primary_engine")).alias("r")).select("project_id", "r.*")
    level, code = F.coalesce("precision_level", F.lit("")), F.coalesce("semantic_status_code", F.lit(""))
    mode = F.when(level.startswith("semantic"), "semantic-ready").when(code.isin("", "not_requested", "syntax_only"), "syntax-only").otherwise("semantic-preferred")
    return last.select("project_id", mode.alias("mode"), ((mode == "semantic-preferred")).alias("needs_attention"), code.alias("status_code"))


def run_metrics(spark, d):
    p = table(spark, d, "parse_results").distinct()
    a = p.groupBy("project_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("file_path").alias("files"), F.count_if("succeeded").alias("succeeded"), F.count_if(F.coalesce("error_message", F.lit("")) != "").alias("with_message"))
    return a.withColumn("success", T.ratio(F.col("succeeded"), F.col("attempts")))


def header_failures(spark, d):
    low = F.lower(F.coalesce("error_message", F.lit("")))
    hit = low.rlike("file not found|no such file or directory|cannot open include file")
    return table(spark, d, "parse_results").distinct().select("result_id", hit.alias("missing_file"), F.regexp_extract(F.coalesce("error_message", F.lit("")), "['\"]([^'\"]+)['\"]", 1).alias("quoted"))


def precision_words(spark, d):
    x = F.lower(F.coalesce("text", F.lit("")))
    strong = ["semantic-required", "语义优先", "精确推演回退", "精确推演阻断", "精确推演未就绪"]
    weak = ["semantic", "语义分析", "精确推演"]
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w))
    return table(spark, d, "documents").select("doc_id", F.when(has(strong), "semantic_preferred").when(has(weak), "semantic_available").otherwise("syntax_fallback").alias("precision"))


def build_system(spark, d):
    name = P.file_name(F.col("path"))
    has = lambda c: F.bool_or(c)
    a = file_paths(spark, d).groupBy("project_id").agg(has(name == "cmakelists.txt").alias("cmake"), has(F.endswith(name, F.lit(".qmlproject"))).alias("qml"), has(name.isin("package.json", "package-lock.json")).alias("node"), has(name.isin("pom.xml", "build.gradle", "build.gradle.kts")).alias("jvm"))
    return a.select("project_id", F.when(F.col("cmake") & F.col("qml"), "CMake + QML").when(F.col("qml"), "QML Project").when(F.col("cmake"), "CMake / C++").when(F.col("node"), "Node / Web").when(F.col("jvm"), "JVM").otherwise("general").alias("build"))


def root_directories(spark, d):
    low = F.lower("folder")
    kind = F.when(low.isin("build", "dist", "out", "target", "node_modules") | low.rlike("^(cmake-build-|\\.)"), "ignore").when(low.isin("generated", "gen", "autogen", "__generated__"), "generated").when(low.isin("docs", "examples", "samples", "tests", "test"), "optional").when(low.isin(*P.DEPENDENCY_DIRS), "dependency").otherwise("source")
    return file_paths(spark, d).where(F.instr("path", "/") > 0).groupBy("project_id", P.folder_key(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files")).withColumn("kind", kind)


def scope_statistics(spark, d):
    """File kinds of each folder of depth one and two."""
    dirs = F.slice(P.segments(P.parent(F.col("path"))), 1, 2)
    scopes = F.explode(F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda i: F.array_join(F.slice(dirs, 1, i), "/"))).alias("scope")
    e = P.extension(F.col("path"))
    s = file_paths(spark, d).where(F.size(dirs) > 0).select("project_id", e.alias("e"), scopes)
    return s.groupBy("project_id", "scope").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("e").isin(*P.CPP)).alias("cpp"), F.count_if(F.col("e").isin(".js", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts")).alias("scripts"), F.count_if(F.col("e") == ".json").alias("json"))


def entry_prefixes(spark, d):
    s = P.segments(F.col("path"))
    dirs = F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
    tail = F.lower(F.try_element_at(dirs, F.lit(-1)))
    cut = F.when((F.size(dirs) > 1) & tail.isin("src", "source", "sources", "app", "apps", "bin", "java", "kotlin"), F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0)))).otherwise(dirs)
    return file_paths(spark, d).where(F.size(dirs) > 0).select("project_id", "path", F.array_join(cut, "/").alias("prefix"))


def config_recommendation(spark, d):
    """Rules proposed for a project: folders to ignore, dependencies to fold, tests to give a role."""
    r = root_directories(spark, d)
    pick = lambda kind, rule, value: r.where(F.col("kind") == kind).select("project_id", F.lit(rule).alias("rule"), F.col("folder").alias("match"), F.lit(value).alias("value"))
    tests = r.where("lower(folder) IN ('test', 'tests')").select("project_id", F.lit("role").alias("rule"), F.col("folder").alias("match"), F.lit("tooling").alias("value"))
    return pick("ignore", "ignore", "").unionByName(pick("dependency", "fold", "collapse")).unionByName(tests)


def request_contexts(spark, d):
    """The prompt context of the last request for each node."""
    r = table(spark, d, "ai_requests").distinct()
    last = r.groupBy("project_id", "node_name").agg(F.max(F.struct("requested_at", "request_id", "ui_scope", "node_kind", "file_path", "file_language")).alias("r"))
    return last.select("project_id", "node_name", "r.request_id", F.concat_ws(" | ", F.col("node_name"), F.col("r.node_kind"), F.col("r.file_path"), F.coalesce("r.ui_scope", F.lit("overview"))).alias("context"))


def evidence_json(spark, d):
    r = table(spark, d, "ai_requests").distinct().where("code_excerpt IS NOT NULL")
    lines = F.split("code_excerpt", "\n")
    return r.select("request_id", F.to_json(F.struct(F.col("request_id").alias("id"), F.col("file_language").alias("language"), F.size(lines).alias("lines"))).alias("evidence"))


def excerpt_objects(spark, d):
    r = table(spark, d, "ai_requests").distinct().where("code_excerpt LIKE '%{%'")
    return r.select("request_id", F.length(replies.first_json_object(F.col("code_excerpt"))).alias("chars"))


def annotated_modules(spark, d):
    """Modules under the scope that the last request about them gave."""
    r = table(spark, d, "ai_requests").where("node_kind = 'module'").groupBy("project_id", F.col("node_name").alias("display_name")).agg(F.max_by(F.coalesce("ui_scope", F.lit("")), F.struct("requested_at", "request_id")).alias("scope"))
    m = graph_nodes(spark, d).where("kind = 'module'").select("id", "project_id", "display_name", F.lit("none").alias("scope"))
    notes = m.drop("scope").join(r, ["project_id", "display_name"]).select("id", "scope")
    return replies.annotate(m, notes, "id", ["scope"])


def event_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), F.from_json("props", "k bigint")["k"].alias("k_typed"))


def session_islands(spark, d):
    """A user's events within ten minutes of each other, as intervals of one minute."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("a")).withColumn("b", F.col("a") + 60_000_000)
    return L.islands(e, ["user_id"], "a", "b", ["event_id"], 600_000_000).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("events"), F.min("a").alias("start"), F.max("b").alias("end"))


def event_bounds(spark, d):
    e = table(spark, d, "events").withColumn("h", F.hour("ts"))
    return e.groupBy("event_type").agg((F.min("h") - 1).alias("left"), F.round(F.min("value") - 1, 6).alias("top"), (F.max("h") + 1).alias("right"), F.round(F.max("value") + 1, 6).alias("bottom"))


def click_paths(spark, d):
    """Paths of a user's day with equal neighbours as one, and how often each is walked."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    steps = e.withColumn("prev", F.lag("event_type").over(w)).where("prev IS NULL OR prev <> event_type").withColumn("n", F.row_number().over(w))
    # the steps of one user and day
    p = steps.groupBy("user_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_type"))), lambda x: x["event_type"]), ">").alias("path"))
    return p.groupBy("path").agg(F.count(F.lit(1)).alias("walks"))


def flow_participation(spark, d):
    p = click_paths(spark, d)
    return p.select("walks", F.explode(F.array_distinct(F.split("path", ">"))).alias("event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("paths"), F.sum("walks").alias("walks"))


def mode_tie_break(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct((-F.col("n")).alias("n"), "c_mktsegment")).alias("segment"), F.max("n").alias("n"))


def route_hits(spark, d):
    """Parts of routes that run through modules that are not their ends."""
    pos, routes = Q.placed_routes(spark, d)
    r = Staged(routes, "routes").df
    piece = lambda n, x1, y1, x2, y2: F.struct(F.concat_ws(":", F.col("f").cast("string"), F.col("t").cast("string"), F.lit(n)).alias("seg"), F.col(x1).alias("x1"), F.col(y1).alias("y1"), F.col(x2).alias("x2"), F.col(y2).alias("y2"))
    seg = r.select("f", "t", F.inline(F.array(piece("a", "x1", "y1", "rail", "y1"), piece("b", "rail", "y1", "rail", "y2"), piece("c", "rail", "y2", "x2", "y2"))))
    rects = pos.select(F.col("id").alias("rect"), F.col("x").alias("left"), F.col("y").alias("top"), (F.col("x") + 220).alias("right"), (F.col("y") + 92).alias("bottom"))
    return L.segment_hits(seg, rects, 6.0).where("rect <> f AND rect <> t").select("seg", "rect", "length")


def capped_edges(spark, d):
    _, e = Q.module_graph(spark, d)
    m = graph_nodes(spark, d).where("kind = 'module'").select(F.col("id").alias("f"), "project_id")
    return L.capped_edges(e.join(m, "f"), "project_id")


def focus_rail(spark, d):
    """Edges at each module by side, their place and number there."""
    _, e = Q.module_graph(spark, d)
    sides = e.select(F.inline(F.array(F.struct(F.col("f").alias("id"), F.lit("out").alias("side"), F.col("t").alias("other"), F.col("w").alias("w")), F.struct(F.col("t").alias("id"), F.lit("in").alias("side"), F.col("f").alias("other"), F.col("w").alias("w")))))
    w = Window.partitionBy("id", "side")
    return sides.withColumn("place", F.row_number().over(w.orderBy(F.desc("w"), "other"))).withColumn("n", F.count(F.lit(1)).over(w))


def barycentre_order(spark, d):
    """Mean place of the predecessors of each module of the second layer and beyond."""
    p = Staged(Q.layout_positions(spark, d), "positions").df
    _, e = Q.module_graph(spark, d)
    a = e.join(p.select(F.col("id").alias("f"), F.col("layer").alias("fl"), F.col("ord").alias("fo")), "f").join(p.select(F.col("id").alias("t"), F.col("layer").alias("tl")), "t").where("fl < tl")
    return a.groupBy("t", "tl").agg(F.round(F.avg("fo"), 6).alias("centre"), F.count(F.lit(1)).alias("predecessors")).select(F.col("t").alias("id"), F.col("tl").alias("layer"), "centre", "predecessors")


def relationship_items(spark, d):
    """The three heaviest edges of each module with a sentence."""
    x = edge_endpoints(spark, d)
    r = x.withColumn("place", F.row_number().over(Window.partitionBy("f").orderBy(F.desc("w"), "to_name", "t"))).where("place <= 3")
    return r.select(F.col("f").alias("id"), "place", F.concat("from_name", F.lit(" uses "), "to_name", F.lit(" ("), F.col("w").cast("string"), F.lit(")")).alias("summary"))


def unchanged_files(spark, d):
    """Files that a re-extraction skips: their newest state is the one that the first snapshot knew."""
    f = table(spark, d, "files").where("path IS NOT NULL")
    oldest = f.groupBy("project_id", "path").agg(F.min(F.struct("modification_time", "scanned_at", "content", "length")).alias("s")).select("project_id", "path", "s.length", "s.modification_time")
    now = newest_files(spark, d).select(*incremental.STATE)
    same = now.join(incremental.changed(now, oldest).select(F.col("project_id").alias("p"), F.col("path").alias("q")), F.col("project_id").eqNullSafe(F.col("p")) & (F.col("path") == F.col("q")), "left_anti")
    return same.groupBy("project_id").agg(F.count(F.lit(1)).alias("skipped"))


def language_labels(spark, d):
    e = P.extension(F.col("path"))
    label = F.when(e.isin(".cpp", ".cc", ".cxx", ".c", ".c++", ".cp"), "C++").when(e.isin(".h", ".hh", ".hpp", ".hxx", ".h++", ".ipp", ".inl", ".tpp"), "C/C++ Header").when(e == ".qml", "QML").when(e.isin(".js", ".mjs", ".cjs"), "JavaScript").when(e.isin(".ts", ".tsx", ".mts", ".cts"), "TypeScript").when(e == ".py", "Python").when(e == ".java", "Java").when(e == ".json", "JSON").when(e == "", "Unknown").otherwise(F.upper(F.substring(e, 2, 20)))
    return file_paths(spark, d).groupBy("project_id", label.alias("label")).agg(F.count(F.lit(1)).alias("files"))


def text_report(spark, d):
    """Counts of nodes by kind as report lines, with the most frequent first."""
    c = graph_nodes(spark, d).groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), "kind")))
    return r.select("project_id", "place", F.format_string("%s: %d", "kind", "n").alias("line"))


QUERIES = {f.__name__: f for f in (
    symbol_registry, preferred_locations, semantic_edge_support, type_use_closure, external_usage, adjacency_index, edge_endpoints, root_modules, stage_groups, lane_groups, role_groups, confidence_histogram, component_nodes,
    component_edges, component_names, readiness, run_metrics, header_failures, precision_words, build_system, root_directories, scope_statistics, entry_prefixes, config_recommendation, request_contexts, evidence_json,
    excerpt_objects, annotated_modules, event_properties, session_islands, event_bounds, click_paths, flow_participation, mode_tie_break, route_hits, capped_edges, focus_rail, barycentre_order, relationship_items,
    unchanged_files, language_labels, text_report)}

_E, _B = ext(), base()
_REG = """sy AS (SELECT DISTINCT * FROM semantic_symbols WHERE identity_key IS NOT NULL), reg AS (SELECT project_id, identity_key, min(kind) AS kind, min(qualified_name) AS qualified_name,
  list_sort(list_distinct(flatten(list(list_transform(coalesce(declaration_locations, []), lambda x: {'p': regexp_extract(x, '^(.*):(\\d+)$', 1), 'l': TRY_CAST(regexp_extract(x, '^(.*):(\\d+)$', 2) AS INTEGER)}))))) AS places FROM sy GROUP BY 1, 2),
registry AS (SELECT project_id, identity_key, kind, qualified_name, places[1].p AS path, places[1].l AS line, CAST(len(places) AS INTEGER) AS declarations FROM reg)"""
_PARENT = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
_ROOTS = f"""roots AS (SELECT *, CASE WHEN lower(folder) IN ('build', 'dist', 'out', 'target', 'node_modules') OR regexp_matches(lower(folder), '^(cmake-build-|\\.)') THEN 'ignore' WHEN lower(folder) IN ('generated', 'gen', 'autogen', '__generated__') THEN 'generated'
  WHEN lower(folder) IN ('docs', 'examples', 'samples', 'tests', 'test') THEN 'optional' WHEN lower(folder) IN ({in_list(P.DEPENDENCY_DIRS)}) THEN 'dependency' ELSE 'source' END AS kind FROM (SELECT project_id, string_split(path, '/')[1] AS folder, count(*) AS files FROM paths WHERE contains(path, '/') GROUP BY 1, 2))"""
_MN = "mn AS (SELECT DISTINCT id, project_id, display_name FROM nodes WHERE kind = 'module')"
_MAIN = "coalesce(kind IN ('function', 'method') AND lower(display_name) IN ('main', 'winmain', 'wwinmain', 'qmlmain'), false)"
_FEXT = ext("file_path")
_CLICK = """st AS (SELECT *, CAST(ts AS DATE) AS day, lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS prev FROM events), cp AS (SELECT path, count(*) AS walks FROM (SELECT user_id, day, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM st WHERE prev IS NULL OR prev <> event_type GROUP BY 1, 2) GROUP BY 1)"""
_PREC = lambda words: " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words)

SQL = {
    "symbol_registry": f"WITH {_REG} SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY coalesce(path, ''), coalesce(line, 0), coalesce(qualified_name, ''), kind, identity_key) AS INTEGER) AS ord FROM registry",
    "preferred_locations": f"WITH {_REG} SELECT project_id, identity_key, path, line FROM registry WHERE path IS NOT NULL",
    "semantic_edge_support": "SELECT kind, from_id, to_id, count(*) AS support FROM edges WHERE fact_source = 'semantic' AND kind IN ('inherits', 'overrides', 'uses_type') AND from_id <> 0 AND to_id <> 0 GROUP BY 1, 2, 3",
    "unchanged_files": f"""WITH {NEWEST}, o AS (SELECT project_id, path, length, modification_time FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY modification_time NULLS FIRST, scanned_at NULLS FIRST, content NULLS FIRST, length NULLS FIRST) AS rn FROM files WHERE path IS NOT NULL) WHERE rn = 1)
        SELECT a.project_id, count(*) AS skipped FROM newest a JOIN o b ON a.project_id IS NOT DISTINCT FROM b.project_id AND a.path = b.path AND a.length IS NOT DISTINCT FROM b.length AND a.modification_time IS NOT DISTINCT FROM b.modification_time GROUP BY 1""",
    "capped_edges": f"""WITH RECURSIVE {MODULE_EDGES}, c AS (SELECT m.project_id, f, t, row_number() OVER (PARTITION BY m.project_id ORDER BY w DESC, f, t) AS k FROM dep JOIN (SELECT DISTINCT id, project_id FROM nodes WHERE kind = 'module') m ON m.id = dep.f),
        g(project_id, k, taken) AS (SELECT DISTINCT project_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(f BIGINT, t BIGINT)[]) FROM c UNION ALL SELECT g.project_id, c.k, CASE WHEN len(taken) < 18 AND len(list_filter(taken, lambda y: y.f = c.f)) < 4 AND len(list_filter(taken, lambda y: y.t = c.t)) < 4 THEN list_append(taken, {{'f': c.f, 't': c.t}}) ELSE taken END FROM g JOIN c ON c.project_id = g.project_id AND c.k = g.k + 1),
        z AS (SELECT project_id, arg_max(taken, k) AS a FROM g GROUP BY 1), u AS (SELECT project_id, CAST(unnest(range(0, len(a))) AS INTEGER) AS lane, unnest(a) AS x FROM z) SELECT project_id, lane, x.f AS f, x.t AS t FROM u""",
    "type_use_closure": "WITH RECURSIVE e AS (SELECT DISTINCT from_id AS f, to_id AS t FROM edges WHERE kind = 'uses_type' AND from_id <> 0 AND to_id <> 0), r(id, s) AS (SELECT DISTINCT id, 0 FROM nodes WHERE kind IN ('class', 'struct', 'enum') UNION SELECT e.t, r.s + 1 FROM r JOIN e ON e.f = r.id WHERE r.s < 40) SELECT id, CAST(min(s) AS INTEGER) AS hops FROM r GROUP BY 1",
    "external_usage": "SELECT e.to_id, e.project_id, count(*) AS uses, CAST(sum(weight) AS BIGINT) AS weight, x.display_name, x.kind AS symbol_kind FROM edges e JOIN external_symbols x ON x.id = e.to_id GROUP BY e.to_id, e.project_id, x.display_name, x.kind",
    "adjacency_index": f"WITH {MODULE_EDGES}, b AS (SELECT f AS id, t AS n FROM dep UNION ALL SELECT t, f FROM dep) SELECT id, count(*) AS incident, string_agg(DISTINCT CAST(n AS VARCHAR), ',' ORDER BY CAST(n AS VARCHAR)) AS neighbours FROM b GROUP BY 1",
    "edge_endpoints": f"WITH {MODULE_EDGES}, {_MN} SELECT dep.f, dep.t, dep.w, a.display_name AS from_name, b.display_name AS to_name FROM dep JOIN mn a ON a.id = dep.f JOIN mn b ON b.id = dep.t",
    "root_modules": Q._FULL + ", s AS (SELECT project_id, id, out_degree * 4 - in_degree + CASE WHEN reachable OR is_entry THEN 64 ELSE 0 END + CASE WHEN contains(role, 'core') THEN 3 ELSE 0 END AS score FROM ov) SELECT project_id, id AS root_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, id) AS r FROM s) WHERE r = 1",
    "stage_groups": Q._FULL + " SELECT project_id, CAST(stage AS INTEGER) AS stage, count(*) AS modules, CAST(sum(file_count) AS BIGINT) AS files, string_agg(name, ',' ORDER BY name) AS names FROM ov GROUP BY project_id, stage",
    "lane_groups": Q._CAPS + " SELECT project_id, kind, count(*) AS members, count(*) FILTER (NOT reachable) AS unreachable FROM caps GROUP BY 1, 2",
    "role_groups": Q._CAPS + " SELECT project_id, role, count(*) AS members, CAST(sum(file_count) AS BIGINT) AS files FROM caps WHERE kind <> 'entry' GROUP BY 1, 2",
    "confidence_histogram": Q._SCORES + f", l AS (SELECT project_id, {Q._LABEL} AS label FROM scores) SELECT project_id, count(*) AS capabilities, count(*) FILTER (label = 'high') AS high, count(*) FILTER (label = 'medium') AS medium, count(*) FILTER (label = 'low') AS low FROM l GROUP BY 1",
    "component_nodes": f"""WITH {NODES}, g AS (SELECT module_id, regexp_replace(file_path, '\\.[^.]*$', '') AS component, count(DISTINCT file_path) AS files, count(*) FILTER (kind <> 'file') AS symbols, bool_or({_MAIN}) AS entry, bool_and({_FEXT} = '.json') AS support FROM n WHERE module_id IS NOT NULL AND file_path <> '' GROUP BY 1, 2),
        k AS (SELECT *, CASE WHEN entry THEN 'entry' WHEN support THEN 'support' ELSE 'component' END AS kind FROM g) SELECT module_id, component, files, symbols, kind, CAST(CASE kind WHEN 'entry' THEN 0 WHEN 'support' THEN 2 ELSE 1 END AS INTEGER) AS stage, CAST(files * 3 + CASE kind WHEN 'entry' THEN 65 WHEN 'support' THEN 5 ELSE 15 END AS INTEGER) AS priority FROM k""",
    "component_edges": f"""WITH {NODES}, c AS (SELECT DISTINCT id, module_id, regexp_replace(file_path, '\\.[^.]*$', '') AS c FROM n WHERE module_id IS NOT NULL AND file_path <> '')
        SELECT a.module_id, a.c AS from_component, b.c AS to_component, CAST(sum(greatest(1, coalesce(e.weight, 1))) AS BIGINT) AS weight FROM edges e JOIN c a ON a.id = e.from_id JOIN c b ON b.id = e.to_id WHERE e.kind <> 'contains' AND a.module_id = b.module_id AND a.c <> b.c GROUP BY 1, 2, 3""",
    "component_names": f"""WITH {NODES}, s AS (SELECT DISTINCT id, module_id, display_name, file_path FROM n WHERE kind IN ('class', 'struct') AND module_id IS NOT NULL AND display_name <> ''), c AS (SELECT id, module_id, 0 AS o, display_name AS cand FROM s UNION ALL SELECT id, module_id, 1, display_name || ' (' || regexp_replace(coalesce(list_extract(string_split(file_path, '/'), -1), ''), '(.)\\.[^.]*$', '\\1') || ')' FROM s),
        u AS (SELECT *, count(*) OVER (PARTITION BY module_id, lower(cand)) AS k FROM c), b AS (SELECT id, arg_min(cand, o) AS best FROM u WHERE k = 1 GROUP BY 1) SELECT s.id, s.module_id, coalesce(best, display_name || ' #' || row_number() OVER (PARTITION BY module_id, lower(display_name) ORDER BY s.id)) AS name FROM s LEFT JOIN b ON b.id = s.id""",
    "readiness": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY exported_at DESC NULLS LAST, entry_id DESC NULLS LAST, precision_level DESC NULLS LAST, semantic_status_code DESC NULLS LAST, primary_engine DESC NULLS LAST) AS k FROM (SELECT DISTINCT * FROM analysis_report)),
        m AS (SELECT project_id, coalesce(semantic_status_code, '') AS status_code, CASE WHEN starts_with(coalesce(precision_level, ''), 'semantic') THEN 'semantic-ready' WHEN coalesce(semantic_status_code, '') IN ('', 'not_requested', 'syntax_only') THEN 'syntax-only' ELSE 'semantic-preferred' END AS mode FROM r WHERE k = 1) SELECT project_id, mode, mode = 'semantic-preferred' AS needs_attention, status_code FROM m""",
    "run_metrics": "SELECT project_id, count(*) AS attempts, count(DISTINCT file_path) AS files, count(*) FILTER (succeeded) AS succeeded, count(*) FILTER (coalesce(error_message, '') <> '') AS with_message, printf('%.1f%%', count(*) FILTER (succeeded) * 100.0::DOUBLE / count(*)) AS success FROM (SELECT DISTINCT * FROM parse_results) GROUP BY 1",
    "header_failures": "SELECT result_id, regexp_matches(lower(coalesce(error_message, '')), 'file not found|no such file or directory|cannot open include file') AS missing_file, regexp_extract(coalesce(error_message, ''), '[''\"]([^''\"]+)[''\"]', 1) AS quoted FROM (SELECT DISTINCT * FROM parse_results)",
    "precision_words": f"SELECT doc_id, CASE WHEN {_PREC(['semantic-required', '语义优先', '精确推演回退', '精确推演阻断', '精确推演未就绪'])} THEN 'semantic_preferred' WHEN {_PREC(['semantic', '语义分析', '精确推演'])} THEN 'semantic_available' ELSE 'syntax_fallback' END AS precision FROM documents",
    "build_system": f"WITH {PATHS}, a AS (SELECT project_id, bool_or({_B} = 'cmakelists.txt') AS cmake, bool_or(ends_with({_B}, '.qmlproject')) AS qml, bool_or({_B} IN ('package.json', 'package-lock.json')) AS node, bool_or({_B} IN ('pom.xml', 'build.gradle', 'build.gradle.kts')) AS jvm FROM paths GROUP BY 1) SELECT project_id, CASE WHEN cmake AND qml THEN 'CMake + QML' WHEN qml THEN 'QML Project' WHEN cmake THEN 'CMake / C++' WHEN node THEN 'Node / Web' WHEN jvm THEN 'JVM' ELSE 'general' END AS build FROM a",
    "root_directories": f"WITH {PATHS}, {_ROOTS} SELECT * FROM roots",
    "scope_statistics": f"""WITH {PATHS}, p AS (SELECT project_id, {_E} AS e, list_filter(string_split({_PARENT}, '/'), lambda s: s <> '')[1:2] AS d FROM paths), s AS (SELECT project_id, e, unnest(list_transform(range(1, len(d) + 1), lambda i: array_to_string(d[1:i], '/'))) AS scope FROM p)
        SELECT project_id, scope, count(*) AS files, count(*) FILTER (e IN ({in_list(P.CPP)})) AS cpp, count(*) FILTER (e IN ('.js', '.mjs', '.cjs', '.ts', '.tsx', '.mts', '.cts')) AS scripts, count(*) FILTER (e = '.json') AS json FROM s GROUP BY 1, 2""",
    "entry_prefixes": f"WITH {PATHS}, p AS (SELECT *, list_filter(string_split({_PARENT}, '/'), lambda s: s <> '') AS d FROM paths) SELECT project_id, path, array_to_string(CASE WHEN len(d) > 1 AND lower(d[len(d)]) IN ('src', 'source', 'sources', 'app', 'apps', 'bin', 'java', 'kotlin') THEN d[1:len(d) - 1] ELSE d END, '/') AS prefix FROM p WHERE len(d) > 0",
    "config_recommendation": f"WITH {PATHS}, {_ROOTS} SELECT project_id, 'ignore' AS rule, folder AS match, '' AS value FROM roots WHERE kind = 'ignore' UNION ALL SELECT project_id, 'fold', folder, 'collapse' FROM roots WHERE kind = 'dependency' UNION ALL SELECT project_id, 'role', folder, 'tooling' FROM roots WHERE lower(folder) IN ('test', 'tests')",
    "request_contexts": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY project_id, node_name ORDER BY requested_at DESC NULLS LAST, request_id DESC NULLS LAST, ui_scope DESC NULLS LAST, node_kind DESC NULLS LAST, file_path DESC NULLS LAST, file_language DESC NULLS LAST) AS k FROM (SELECT DISTINCT * FROM ai_requests)) SELECT project_id, node_name, request_id, concat_ws(' | ', node_name, node_kind, file_path, coalesce(ui_scope, 'overview')) AS context FROM r WHERE k = 1",
    "evidence_json": "SELECT request_id, '{\"id\":' || request_id || CASE WHEN file_language IS NULL THEN '' ELSE ',\"language\":' || to_json(file_language) END || ',\"lines\":' || len(string_split(code_excerpt, chr(10))) || '}' AS evidence FROM (SELECT DISTINCT * FROM ai_requests) WHERE code_excerpt IS NOT NULL",
    "annotated_modules": f"WITH {_MN}, r AS (SELECT project_id, node_name, scope FROM (SELECT project_id, node_name, coalesce(ui_scope, '') AS scope, row_number() OVER (PARTITION BY project_id, node_name ORDER BY requested_at DESC NULLS LAST, request_id DESC) AS k FROM ai_requests WHERE node_kind = 'module') WHERE k = 1) SELECT mn.id, mn.project_id, mn.display_name, coalesce(nullif(r.scope, ''), 'none') AS scope FROM mn LEFT JOIN r ON r.project_id = mn.project_id AND r.node_name = mn.display_name",
    "event_properties": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_typed FROM events",
    "session_islands": "WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + 60000000 AS b FROM events), f AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM e), i AS (SELECT *, sum(CASE WHEN far IS NULL OR a > far + 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, event_id) AS island FROM f) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS events, min(a) AS start, max(b) AS \"end\" FROM i GROUP BY 1, 2",
    "event_bounds": "SELECT event_type, CAST(min(hour(ts)) - 1 AS INTEGER) AS \"left\", round(min(value) - 1, 6) AS top, CAST(max(hour(ts)) + 1 AS INTEGER) AS \"right\", round(max(value) + 1, 6) AS bottom FROM events GROUP BY 1",
    "click_paths": f"WITH {_CLICK} SELECT * FROM cp",
    "flow_participation": f"WITH {_CLICK}, x AS (SELECT walks, unnest(list_distinct(string_split(path, '>'))) AS event_type FROM cp) SELECT event_type, count(*) AS paths, CAST(sum(walks) AS BIGINT) AS walks FROM x GROUP BY 1",
    "mode_tie_break": "SELECT c_nationkey, c_mktsegment AS segment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1",
    "route_hits": Q.SQL["edge_routes"].replace("SELECT *, abs(rail", "SELECT *, abs(rail").replace(" FROM r", " FROM r", 1).rsplit("SELECT *, abs", 1)[0] + """, sg AS (SELECT f, t, f || ':' || t || ':a' AS seg, x1 AS sx, y1 AS sy, rail AS ex, y1 AS ey FROM r UNION ALL SELECT f, t, f || ':' || t || ':b', rail, y1, rail, y2 FROM r UNION ALL SELECT f, t, f || ':' || t || ':c', rail, y2, x2, y2 FROM r),
        h AS (SELECT seg, xy.id AS rect, f, t, least(greatest(sx, ex), x + 226) - greatest(least(sx, ex), x - 6) AS dx, least(greatest(sy, ey), y + 98) - greatest(least(sy, ey), y - 6) AS dy FROM sg, xy) SELECT seg, rect, greatest(dx, dy) AS length FROM h WHERE dx >= 0 AND dy >= 0 AND rect <> f AND rect <> t""",
    "focus_rail": f"WITH {MODULE_EDGES}, s AS (SELECT f AS id, 'out' AS side, t AS other, w FROM dep UNION ALL SELECT t, 'in', f, w FROM dep) SELECT id, side, other, w, CAST(row_number() OVER (PARTITION BY id, side ORDER BY w DESC, other) AS INTEGER) AS place, count(*) OVER (PARTITION BY id, side) AS n FROM s",
    "barycentre_order": Q._POS + " SELECT b.id, b.layer, round(avg(a.ord), 6) AS centre, count(*) AS predecessors FROM dep JOIN xy a ON a.id = dep.f JOIN xy b ON b.id = dep.t WHERE a.layer < b.layer GROUP BY 1, 2",
    "relationship_items": f"WITH {MODULE_EDGES}, {_MN}, x AS (SELECT dep.f AS id, CAST(row_number() OVER (PARTITION BY dep.f ORDER BY dep.w DESC, b.display_name, dep.t) AS INTEGER) AS place, a.display_name || ' uses ' || b.display_name || ' (' || dep.w || ')' AS summary FROM dep JOIN mn a ON a.id = dep.f JOIN mn b ON b.id = dep.t) SELECT * FROM x WHERE place <= 3",
    "language_labels": f"WITH {PATHS} SELECT project_id, CASE WHEN {_E} IN ('.cpp', '.cc', '.cxx', '.c', '.c++', '.cp') THEN 'C++' WHEN {_E} IN ('.h', '.hh', '.hpp', '.hxx', '.h++', '.ipp', '.inl', '.tpp') THEN 'C/C++ Header' WHEN {_E} = '.qml' THEN 'QML' WHEN {_E} IN ('.js', '.mjs', '.cjs') THEN 'JavaScript' WHEN {_E} IN ('.ts', '.tsx', '.mts', '.cts') THEN 'TypeScript' WHEN {_E} = '.py' THEN 'Python' WHEN {_E} = '.java' THEN 'Java' WHEN {_E} = '.json' THEN 'JSON' WHEN {_E} = '' THEN 'Unknown' ELSE upper({_E}[2:21]) END AS label, count(*) AS files FROM paths GROUP BY 1, 2",
    "text_report": f"WITH {NODES}, c AS (SELECT project_id, kind, count(*) AS n FROM n GROUP BY 1, 2) SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY n DESC, kind) AS INTEGER) AS place, kind || ': ' || n AS line FROM c",
}
