"""Queries over nodes, edges and the module graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.functions import text as T
from cartolith.functions.paths import CPP, SCRIPT, WEB
from cartolith.operators import graph as G
from cartolith.operators import overview as O
from cartolith.operators import resolve, rollup
from cartolith.plans.sqlparts import COMMERCE, DAG, MEMBER, MODULE_EDGES, NODES, ext, in_list
from cartolith.runtime import Staged, table
from cartolith.sources.tables import commerce_edges, graph_edges, graph_nodes


def module_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, edges: f, t, w) of the module dependencies, staged."""
    nodes = graph_nodes(spark, d)
    dep = rollup.module_dependencies(graph_edges(spark, d), nodes)
    edges = Staged(dep.select(F.col("from_module").alias("f"), F.col("to_module").alias("t"), F.col("weight").alias("w")), "dep").df
    return nodes.where("kind = 'module'").select("id").distinct(), edges


def overview_table(spark: SparkSession, d: str) -> DataFrame:
    """modules() with degrees, stage, reachability from the project's entries and component, staged."""
    nodes, edges = module_graph(spark, d)
    mods = Staged(O.modules(graph_nodes(spark, d)), "modules").df
    placed = G.placed(nodes, edges, entries(mods, edges))
    o = mods.join(G.degrees(edges), "id", "left").fillna(0, ["in_degree", "out_degree"]).join(placed, "id")
    return Staged(o, "overview").df


def entries(mods: DataFrame, edges: DataFrame) -> DataFrame:
    """Entry modules; in a project without any, the modules without an incoming dependency."""
    explicit = mods.where("is_entry").select("id", "project_id")
    none = mods.join(explicit.select("project_id").distinct(), "project_id", "left_anti")
    return explicit.select("id").unionByName(none.join(edges.select(F.col("t").alias("id")).distinct(), "id", "left_anti").select("id"))


def module_dependency_rollup(spark, d):
    return rollup.module_dependencies(graph_edges(spark, d), graph_nodes(spark, d))


def edge_merge_accumulate(spark, d):
    return resolve.merge_edges(graph_edges(spark, d), True)


def edge_merge_keep(spark, d):
    return resolve.merge_edges(graph_edges(spark, d), False)


def node_merge(spark, d):
    return resolve.merge_nodes(graph_nodes(spark, d)).drop("merge_key")


def kind_histogram(spark, d):
    n = graph_nodes(spark, d).groupBy(F.lit("node").alias("what"), "kind").agg(F.count(F.lit(1)).alias("n"))
    e = graph_edges(spark, d).groupBy(F.lit("edge").alias("what"), "kind").agg(F.count(F.lit(1)).alias("n"))
    s = graph_edges(spark, d).groupBy(F.lit("source").alias("what"), F.col("fact_source").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(e).unionByName(s)


def precision_summary(spark, d):
    e = graph_edges(spark, d)
    kinds = ["contains", "calls", "includes", "inherits", "uses_type", "overrides", "depends_on"]
    a = e.groupBy("project_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("support_count").alias("support"), F.count_if(F.col("fact_source") == "semantic").alias("semantic"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return a.withColumn("semantic_share", T.ratio(F.col("semantic"), F.col("edges")))


def degree_in_out(spark, d):
    e = graph_edges(spark, d).where("from_id <> 0 AND to_id <> 0").select(F.col("from_id").alias("f"), F.col("to_id").alias("t")).distinct()
    return G.degrees(e)


def symbols_by_qualified_name(spark, d):
    n = graph_nodes(spark, d).where("qualified_name <> ''")
    return resolve.unique_lookup(n, ["project_id", "qualified_name"], "id")


def symbols_by_display_name(spark, d):
    n = graph_nodes(spark, d).where("display_name <> ''")
    return n.groupBy("project_id", "display_name").agg(F.count_distinct("id").alias("matches"), F.min("id").alias("first_id"), F.count_distinct("kind").alias("kinds"))


def call_ladder_resolve(spark, d):
    """Calls by name: the callee of each call edge is known only by its display name, the caller by its namespace."""
    n = graph_nodes(spark, d)
    e = graph_edges(spark, d).where("kind = 'calls'").select("from_id", "to_id").distinct()
    a = n.select(F.col("id").alias("from_id"), "project_id", F.regexp_replace(F.coalesce("qualified_name", F.lit("")), "(^|::)[^:]*$", "").alias("namespace_prefix"))
    b = n.where("display_name <> ''").select(F.col("id").alias("to_id"), F.col("display_name").alias("callee"))
    c = e.join(a, "from_id").join(b, "to_id").select(F.concat_ws(">", F.col("from_id").cast("string"), F.col("to_id").cast("string")).alias("call_id"), "project_id", "callee", F.lit("").alias("type_prefix"), "namespace_prefix")
    return resolve.resolve_calls(c.dropDuplicates(["call_id"]), n)


def unresolved_calls(spark, d):
    return call_ladder_resolve(spark, d).where("target IS NULL").select("call_id", "project_id", "callee")


def collaborators(spark, d):
    _, e = module_graph(spark, d)
    both = e.select(F.col("f").alias("id"), F.col("t").alias("o")).unionByName(e.select(F.col("t").alias("id"), F.col("f").alias("o"))).distinct()
    names = graph_nodes(spark, d).where("kind = 'module'").select(F.col("id").alias("o"), F.col("display_name").alias("name"))
    return both.join(names, "o").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("collaborators"))


def ego_network(spark, d):
    """The neighbourhood of the module with the largest weight."""
    _, e = module_graph(spark, d)
    both = e.select(F.col("f").alias("id"), F.col("t").alias("neighbour"), F.col("w").alias("w_out"), F.lit(0).cast("bigint").alias("w_in")).unionByName(e.select(F.col("t").alias("id"), F.col("f").alias("neighbour"), F.lit(0).cast("bigint").alias("w_out"), F.col("w").alias("w_in")))
    weight = both.groupBy("id").agg(F.sum(F.col("w_out") + F.col("w_in")).alias("total"))
    centre = weight.agg(F.max_by("id", F.struct("total", "id")).alias("c"))
    return both.where(F.col("id") == centre.scalar()).groupBy("id", "neighbour").agg(F.sum("w_out").alias("w_out"), F.sum("w_in").alias("w_in"))


def bidirectional_merge(spark, d):
    return G.merged_directions(module_graph(spark, d)[1])


def commerce_bidirectional(spark, d):
    return G.merged_directions(commerce_edges(spark, d))


def commerce_degrees(spark, d):
    return G.degrees(commerce_edges(spark, d))


def commerce_dag(spark, d) -> DataFrame:
    e = commerce_edges(spark, d).where("f < t").withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy(F.desc("w"), "t"))).where("r <= 3")
    return Staged(e.select(F.col("f").cast("bigint").alias("f"), F.col("t").cast("bigint").alias("t"), "w"), "dag").df


def _ends(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("f", "t")).alias("id")).distinct()


def dag_hops(spark, d):
    e = commerce_dag(spark, d)
    return G.reach(e, _ends(e).join(e.select(F.col("t").alias("id")).distinct(), "id", "left_anti"))


def dag_layers(spark, d):
    e = commerce_dag(spark, d)
    return G.peel_layers(_ends(e), e)


def dag_stages(spark, d):
    e = commerce_dag(spark, d)
    return G.stages(_ends(e), e)


def dag_heaviest_path(spark, d):
    e = commerce_dag(spark, d)
    roots = _ends(e).join(e.select(F.col("t").alias("id")).distinct().withColumn("has", F.lit(1)), "id", "left").select("id", F.when(F.col("has").isNull(), 1).otherwise(0).alias("base"))
    return G.best_scores(roots, e)


def module_flows(spark, d) -> DataFrame:
    """(project_id, id, score, path): the heaviest way over the condensed module graph that ends in each component."""
    n, e = module_graph(spark, d)
    comp = Staged(G.components(n, e), "component").df
    best = G.best_scores(comp.select(F.col("component").alias("id")).distinct().withColumn("base", F.lit(0)), Staged(G.condense(e, comp), "condensed").df, keep_path=True)
    return best.join(graph_nodes(spark, d).where("kind = 'module'").select("id", "project_id"), "id").withColumn("path", F.transform("path", lambda x: x.cast("string")))


def heaviest_flows(spark, d):
    """The five heaviest ways of each project, of two components or more."""
    best = module_flows(spark, d).where("size(path) > 1")
    r = best.withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), "id"))).where("r <= 5")
    return r.select("project_id", "r", "score", F.array_join("path", ">").alias("signature"))


def include_reach(spark, d):
    """What the files without an incoming include edge reach over include edges."""
    e = graph_edges(spark, d).where("kind = 'includes' AND from_id <> 0 AND to_id <> 0").select(F.col("from_id").alias("f"), F.col("to_id").alias("t")).distinct()
    seeds = e.select(F.col("f").alias("id")).distinct().join(e.where("f <> t").select(F.col("t").alias("id")).distinct(), "id", "left_anti")
    return G.reach(e, seeds)


def scc_members(spark, d):
    return G.components(*module_graph(spark, d))


def condensation_edges(spark, d):
    n, e = module_graph(spark, d)
    return G.condense(e, Staged(G.components(n, e), "component").df)


def module_stages(spark, d):
    n, e = module_graph(spark, d)
    comp = Staged(G.components(n, e), "component").df
    return G.stages(comp.select(F.col("component").alias("id")).distinct(), Staged(G.condense(e, comp), "condensed").df)


def module_layers(spark, d):
    return G.peel_layers(*module_graph(spark, d))


def inferred_entries(spark, d):
    n, e = module_graph(spark, d)
    return n.join(e.select(F.col("t").alias("id")).distinct(), "id", "left_anti")


def module_symbol_counts(spark, d):
    m = O.modules(graph_nodes(spark, d))
    return m.select("id", "project_id", "name", "folder", "file_count", *[f"{k}_files" for k in ("cpp", "qml", "web", "script", "data")], *[f"{k}_count" for k in O.COUNTED])


def top_symbols_per_module(spark, d):
    return O.top_symbols(graph_nodes(spark, d)).select("module_id", F.array_join("top_symbols", ",").alias("symbols"), T.first_k(F.col("top_symbols"), 2).alias("short"))


def module_roles(spark, d):
    return O.modules(graph_nodes(spark, d)).select("id", "name", "role", "is_entry")


def folder_role_clusters(spark, d):
    m = O.modules(graph_nodes(spark, d))
    g = m.groupingSets([["project_id", "folder"], ["project_id", "role"]], "project_id", "folder", "role").agg(F.grouping("folder").alias("no_folder"), F.count(F.lit(1)).alias("modules"), F.bool_or("is_entry").alias("has_entry"))
    return g.select("project_id", F.when(F.col("no_folder") == 0, "folder").otherwise("role").alias("by"), F.when(F.col("no_folder") == 0, F.col("folder")).otherwise(F.col("role")).alias("name"), "modules", ((F.col("no_folder") == 0) & (F.col("has_entry") | (F.col("modules") <= 3))).alias("expanded"))


def project_kinds(spark, d):
    m = O.modules(graph_nodes(spark, d))
    s = lambda c: F.sum(f"{c}_files")
    has = lambda *r: F.bool_or(F.col("role").isin(*r))
    a = m.groupBy("project_id").agg(s("cpp").alias("cpp"), s("qml").alias("qml"), s("web").alias("web"), s("script").alias("script"), has("presentation", "web").alias("ui"), has("interaction", "analysis").alias("backend"), has("storage", "data").alias("storage"))
    kind = (F.when((F.col("qml") > 0) & (F.col("cpp") > 0) & ((F.col("web") > 0) | F.col("ui")), "qml application").when((F.col("qml") > 0) & (F.col("cpp") > 0), "desktop").when((F.col("web") > 0) & (F.col("cpp") > 0), "mixed web")
            .when((F.col("cpp") > 0) & F.col("backend") & F.col("storage"), "local application").when((F.col("cpp") > 0) & (F.col("script") > 0), "cpp with scripts").when(F.col("cpp") > 0, "cpp").when(F.col("script") > 0, "scripts").otherwise("unclear"))
    return a.select("project_id", "cpp", "script", kind.alias("kind"))


def reachable_from_entry(spark, d):
    return overview_table(spark, d).select("id", "reachable")


def overview_nodes(spark, d):
    o = overview_table(spark, d)
    top = F.max("stage").over(Window.partitionBy("project_id"))
    name = F.when(F.col("stage") == 0, "entry").when(F.col("stage") == top, "leaf").when(F.col("stage") == 1, "core").otherwise(F.concat(F.lit("downstream_"), F.col("stage").cast("string")))
    return o.select("id", "project_id", "name", "role", "is_entry", "in_degree", "out_degree", "stage", name.alias("stage_name"), "reachable", "component")


def capability_nodes(spark, d):
    c = O.capabilities(overview_table(spark, d))
    return c.select("id", "mode", "kind", "bucket", "cluster", "cluster_name")


def capability_rollup(spark, d):
    c = O.clusters(O.capabilities(overview_table(spark, d)))
    return c.select("project_id", "cluster", "kind", "name", "module_count", "file_count", "stage_start", "stage_end", "reachable", "in_degree", "out_degree", "dominant_role", F.array_join("symbols", ",").alias("symbols"), F.array_join("example_files", ",").alias("example_files"))


def capability_edges(spark, d, overview: DataFrame | None = None):
    _, e = module_graph(spark, d)
    o = overview if overview is not None else overview_table(spark, d)
    c = Staged(O.capabilities(o).select("id", "project_id", "cluster", "kind"), "caps").df
    a, b = c.select(F.col("id").alias("f"), "project_id", F.col("cluster").alias("from_cluster"), F.col("kind").alias("fk")), c.select(F.col("id").alias("t"), F.col("cluster").alias("to_cluster"), F.col("kind").alias("tk"))
    j = e.join(a, "f").join(b, "t").where("from_cluster <> to_cluster")
    kind = F.when(F.col("fk") == "entry", "activates").when(F.col("tk") == "infrastructure", "uses_infrastructure").otherwise("enables")
    g = j.groupBy("project_id", "from_cluster", "to_cluster", kind.alias("kind")).agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("supporting"))
    score = F.least(F.lit(22) + F.least(F.col("weight") * 12, F.lit(36)) + F.least(F.col("supporting") * 10, F.lit(20)), F.lit(100))
    return g.withColumn("confidence", score.cast("int")).withColumn("label", O.confidence_label(F.col("confidence"), 75, 45))


def capability_scores(spark, d, overview: DataFrame | None = None):
    _, e = module_graph(spark, d)
    caps = Staged(O.capabilities(overview if overview is not None else overview_table(spark, d)), "caps").df
    k = caps.select("id", F.struct("project_id", "cluster").alias("k"))
    pair = e.join(k.select(F.col("id").alias("f"), F.col("k").alias("a")), "f").join(k.select(F.col("id").alias("t"), F.col("k").alias("b")), "t").where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    n = pair.groupBy(F.col("p.a.project_id").alias("project_id"), F.col("p.a.cluster").alias("cluster")).agg(F.count_distinct("p.b").alias("collaborators"))
    c = O.clusters(caps).join(n, ["project_id", "cluster"], "left").fillna(0, ["collaborators"])
    return O.node_confidence(c).select("project_id", "cluster", "collaborators", "confidence", "confidence_label", O.visual_priority(c).alias("priority"))


def pruned_capabilities(spark, d):
    """At most 40 visible capabilities of a project, by weight; entries always."""
    o = overview_table(spark, d)
    s = capability_scores(spark, d, o).join(O.clusters(O.capabilities(o)).select("project_id", "cluster", "kind", "name", "file_count"), ["project_id", "cluster"])
    weight = F.col("priority") * 100 + F.col("collaborators") * 10 + F.col("file_count") + F.when(F.col("kind") == "entry", 1000000).otherwise(0)
    r = s.withColumn("weight", weight).withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("weight"), "name", "cluster")))
    return r.select("project_id", "cluster", "weight", ((F.col("place") <= 40) | (F.col("kind") == "entry")).alias("visible"))


def noise_classes(spark, d):
    p = graph_nodes(spark, d).where("kind = 'file'").select("module_id", O.noise_class(F.col("qualified_name")).alias("c"))
    return p.groupBy("module_id").agg(F.when(F.count_if(F.col("c").isNull()) == 0, F.when(F.min("c") == F.max("c"), F.min("c"))).alias("noise"), F.count(F.lit(1)).alias("files"))


def hub_and_isolated_findings(spark, d):
    return O.findings(overview_table(spark, d).withColumn("visible", F.lit(True)))


def cycle_findings(spark, d):
    o = overview_table(spark, d)
    return O.cycle_findings(o.select("id", "component"), o)


def hotspots(spark, d):
    o = overview_table(spark, d).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("component")))
    score = F.least(F.lit(12), F.col("in_degree") + F.col("out_degree")) + F.least(F.lit(8), F.floor(F.col("file_count") / 4)) + F.when(F.col("size") > 1, 10).otherwise(0)
    s = o.where("NOT is_entry AND role <> 'dependency'").withColumn("score", score.cast("int")).where("score >= 10")
    r = s.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), F.desc("file_count"), "name", "id"))).where("place <= 3")
    return r.select("project_id", "place", "id", "score", F.when(F.col("score") >= 24, "high").when(F.col("score") >= 14, "medium").otherwise("low").alias("severity"))


def layout_positions(spark, d, graph: tuple[DataFrame, DataFrame] | None = None):
    """Layers left to right, in a layer by falling out-degree and name."""
    n, e = graph or module_graph(spark, d)
    names = graph_nodes(spark, d).where("kind = 'module'").select("id", "display_name")
    p = G.peel_layers(n, e).join(G.degrees(e).select("id", "out_degree"), "id", "left").fillna(0, ["out_degree"]).join(names, "id")
    order = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("out_degree"), "display_name", "id")) - 1
    return p.select("id", "layer", order.alias("ord"), (F.col("layer") * 320.0).alias("x"), (order * 140.0).alias("y"))


def column_wrap(spark, d):
    """Rows of a layer wrapped into columns of three, round robin."""
    p = layout_positions(spark, d)
    columns = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("layer")) / 3)
    return p.select("id", "layer", "ord", F.pmod(F.col("ord"), columns).cast("int").alias("sub_column"), F.floor(F.col("ord") / columns).cast("int").alias("sub_row"))


def layer_bounds(spark, d):
    p = layout_positions(spark, d)
    return p.groupBy("layer").agg((F.min("x") - 24).alias("left"), (F.min("y") - 24).alias("top"), (F.max("x") + 220 + 24).alias("right"), (F.max("y") + 92 + 24).alias("bottom"), F.count(F.lit(1)).alias("members"))


def placed_routes(spark, d) -> tuple[DataFrame, DataFrame]:
    """(layout_positions, staged, and edge_routes) of one module graph."""
    n, e = module_graph(spark, d)
    p = Staged(layout_positions(spark, d, (n, e)), "placed").df
    a, b = p.select(F.col("id").alias("f"), F.col("layer").alias("fl"), F.col("ord").alias("fo"), F.col("x").alias("fx"), F.col("y").alias("fy")), p.select(F.col("id").alias("t"), F.col("layer").alias("tl"), F.col("ord").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    j = e.join(a, "f").join(b, "t")
    back, ahead, left = F.col("tl") < F.col("fl"), F.col("tl") > F.col("fl"), F.col("to") < F.col("fo")
    start = F.when(back | (~ahead & left), F.col("fx")).otherwise(F.col("fx") + 220)
    end = F.when(ahead | (~back & left), F.col("tx")).otherwise(F.col("tx") + 220)
    rail = F.when(back, F.col("fx") - 28).when(ahead, F.col("fx") + 220 + 28).when(left, F.least("fx", "tx") - 44).otherwise(F.greatest(F.col("fx"), F.col("tx")) + 220 + 44)
    y1, y2 = F.col("fy") + 46, F.col("ty") + 46
    return p, j.select("f", "t", start.alias("x1"), y1.alias("y1"), rail.alias("rail"), end.alias("x2"), y2.alias("y2"), (F.abs(rail - start) + F.abs(y2 - y1) + F.abs(end - rail)).alias("length"))


def edge_routes(spark, d):
    """Orthogonal routes between placed modules: out of one side, along a rail, into the other."""
    return placed_routes(spark, d)[1]


def endpoint_slots(spark, d):
    """The place of each edge at either of its ends, by weight."""
    _, e = module_graph(spark, d)
    slot = lambda k: (F.row_number().over(Window.partitionBy(k).orderBy(F.desc("w"), "f", "t")) - (F.count(F.lit(1)).over(Window.partitionBy(k)) + 1) / 2) * 14.0
    return e.select("f", "t", slot("f").alias("offset_out"), slot("t").alias("offset_in"))


def dot_export(spark, d):
    """The lines of a graph drawing for each project; a writer sorts them by (part, line)."""
    n, e = module_graph(spark, d)
    names = graph_nodes(spark, d).where("kind = 'module'")
    a = names.select(F.col("project_id"), F.lit(1).alias("part"), F.concat(F.lit("  n"), F.col("id").cast("string"), F.lit(' [label="'), T.escape_dot(F.col("display_name")), F.lit('"];')).alias("line"))
    b = e.join(names.select(F.col("id").alias("f"), "project_id"), "f").select("project_id", F.lit(2).alias("part"), F.concat(F.lit("  n"), F.col("f").cast("string"), F.lit(" -> n"), F.col("t").cast("string"), F.lit(' [label="'), F.col("w").cast("string"), F.lit('"];')).alias("line"))
    own = names.select("project_id").distinct()
    frame = own.select("project_id", F.lit(0).alias("part"), F.lit("digraph architecture {").alias("line")).unionByName(own.select("project_id", F.lit(3).alias("part"), F.lit("}").alias("line")))
    return frame.unionByName(a).unionByName(b)


def overview_json(spark, d):
    o = O.modules(graph_nodes(spark, d))
    return o.select("id", F.to_json(F.struct("name", "role", F.col("is_entry").alias("entry"), "file_count")).alias("json"))


def evidence_packages(spark, d):
    o = overview_table(spark, d)
    facts = F.array_compact(F.array(F.concat(F.col("file_count").cast("string"), F.lit(" files")), F.when(F.col("in_degree") > 0, F.concat(F.lit("used by "), F.col("in_degree").cast("string"))), F.when(F.col("out_degree") > 0, F.concat(F.lit("uses "), F.col("out_degree").cast("string"))), F.when(F.col("is_entry"), F.lit("entry"))))
    return o.select("id", F.array_join(facts, "; ").alias("facts"), F.size(facts).alias("n"), T.first_k(F.slice("paths", 1, 6), 2).alias("files"))


def markdown_report(spark, d):
    o = overview_table(spark, d)
    r = o.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("is_entry"), F.desc(F.col("in_degree") + F.col("out_degree")), "name", "id"))).where("place <= 3")
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("** ("), F.col("role"), F.lit("): "), F.col("file_count").cast("string"), F.lit(" files"))
    g = r.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return g.select("project_id", F.concat(F.lit("# "), "project_id", F.lit("\n\n## Reading order\n"), "body").alias("markdown"))


QUERIES = {f.__name__: f for f in (
    module_dependency_rollup, edge_merge_accumulate, edge_merge_keep, node_merge, kind_histogram, precision_summary, degree_in_out, symbols_by_qualified_name, symbols_by_display_name, call_ladder_resolve, unresolved_calls,
    collaborators, ego_network, bidirectional_merge, commerce_bidirectional, commerce_degrees, dag_hops, dag_layers, dag_stages, dag_heaviest_path, heaviest_flows, include_reach, scc_members, condensation_edges, module_stages,
    module_layers, inferred_entries, module_symbol_counts, top_symbols_per_module, module_roles, folder_role_clusters, project_kinds, reachable_from_entry, overview_nodes, capability_nodes, capability_rollup, capability_edges,
    capability_scores, pruned_capabilities, noise_classes, hub_and_isolated_findings, cycle_findings, hotspots, layout_positions, column_wrap, layer_bounds, edge_routes, endpoint_slots, dot_export, overview_json,
    evidence_packages, markdown_report)}

_ANY = lambda e, words: "regexp_matches(lower(" + e + "), '" + "|".join(w.replace(".", "\\.") for w in words) + "')"
_DEPLIKE = f"({_ANY('evidence', O.DEPENDENCY_WORDS)} OR ({_ANY('evidence', O.LIBRARY_WORDS)} AND {_ANY('evidence', O.SAMPLE_WORDS)}))"
_SO = "(script_files > 0 AND cpp_files = 0 AND qml_files = 0 AND web_files = 0)"
_ROLE = f"""CASE WHEN {_DEPLIKE} THEN 'dependency' WHEN regexp_matches(folder, '^[0-9]+$') THEN 'tooling' WHEN qml_files > 0 AND web_files >= cpp_files THEN 'presentation' WHEN web_files > 0 AND cpp_files = 0 AND script_files = 0 THEN 'web'
  {' '.join(f"WHEN {_SO} AND {_ANY('evidence', w)} THEN '{r}'" for r, w in O.SCRIPT_ROLES)} WHEN data_files > 0 AND cpp_files = 0 AND qml_files = 0 AND web_files = 0 THEN 'data'
  {' '.join(f"WHEN {_ANY('evidence', w)} THEN '{r}'" for r, w in O.WORD_ROLES)} WHEN qml_files > 0 THEN 'presentation' WHEN web_files > 0 THEN 'web' WHEN script_files > 0 THEN 'tooling' WHEN data_files > 0 THEN 'data'
  WHEN class_count + struct_count + enum_count >= function_count + method_count THEN 'type_centric' WHEN function_count + method_count > 0 THEN 'procedure_centric' ELSE 'mixed' END"""
_FEXT = ext("qualified_name")
_TOP = """tops AS (SELECT module_id, list(display_name ORDER BY o) AS top_symbols FROM (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY o) AS r FROM (
  SELECT module_id, display_name, min({'p': CASE WHEN kind IN ('class', 'struct', 'enum') THEN 0 WHEN kind = 'function' THEN 1 ELSE 2 END, 'f': file_path, 'l': line, 'd': display_name}) AS o
  FROM n WHERE kind IN ('class', 'struct', 'enum', 'function', 'method') AND module_id IS NOT NULL AND display_name <> '' AND file_path <> '' GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1)"""
_OV = f"""{NODES}, {_TOP},
fc AS (SELECT module_id, count(*) AS file_count, count(*) FILTER ({_FEXT} IN ({in_list(CPP)})) AS cpp_files, count(*) FILTER ({_FEXT} = '.qml') AS qml_files, count(*) FILTER ({_FEXT} IN ({in_list(WEB)})) AS web_files, count(*) FILTER ({_FEXT} IN ({in_list(SCRIPT)})) AS script_files,
  count(*) FILTER ({_FEXT} = '.json') AS data_files, list(qualified_name ORDER BY qualified_name) AS paths FROM n WHERE kind = 'file' AND module_id IS NOT NULL GROUP BY 1),
sc AS (SELECT module_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}_count" for k in O.COUNTED)}, bool_or(coalesce(kind IN ('function', 'method') AND lower(display_name) IN ('main', 'wwinmain', 'winmain', 'qmlmain'), false) OR {_ANY('file_path', O.ENTRY_PATHS)}) AS entry_symbol
  FROM n WHERE kind NOT IN ('module', 'file') AND file_path <> '' AND module_id IS NOT NULL GROUP BY 1),
m0 AS (SELECT n.id, n.project_id, coalesce(n.display_name, '') AS name, string_split(coalesce(n.display_name, ''), '/')[1] AS folder, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ['file_count', 'cpp_files', 'qml_files', 'web_files', 'script_files', 'data_files', *[k + '_count' for k in O.COUNTED]])},
  coalesce(paths, []) AS paths, coalesce(top_symbols, []) AS top_symbols, coalesce(entry_symbol, false) AS entry_symbol FROM n LEFT JOIN fc ON fc.module_id = n.id LEFT JOIN sc ON sc.module_id = n.id LEFT JOIN tops ON tops.module_id = n.id WHERE n.kind = 'module'),
m1 AS (SELECT * REPLACE (CASE WHEN contains(name, '/') AND hit IS NOT NULL THEN regexp_replace(name, '[^/]*$', '') || hit ELSE name END AS name) FROM (SELECT *, list_filter(top_symbols, lambda s: lower(s) = lower(list_extract(string_split(name, '/'), -1)))[1] AS hit FROM m0)),
m2 AS (SELECT *, concat_ws(' ', name, folder, array_to_string(paths, ' '), array_to_string(top_symbols, ' ')) AS evidence FROM m1),
mods AS (SELECT *, {_ROLE} AS role, NOT ({_DEPLIKE} OR regexp_matches(folder, '^[0-9]+$')) AND (entry_symbol OR len(list_filter(paths, lambda p: {_ANY('p', [*O.ENTRY_PATHS, *O.ENTRY_FILES])})) > 0 OR {_ANY('evidence', O.ENTRY_WORDS)}) AS is_entry FROM m2)"""
_SCC = "closure(a, b) AS (SELECT f, t FROM dep UNION SELECT closure.a, dep.t FROM closure JOIN dep ON closure.b = dep.f), comp AS (SELECT m.id, least(m.id, coalesce(min(c.b), m.id)) AS component FROM (SELECT DISTINCT id FROM nodes WHERE kind = 'module') m LEFT JOIN (SELECT x.a, x.b FROM closure x JOIN closure y ON x.a = y.b AND x.b = y.a) c ON c.a = m.id GROUP BY m.id)"
_COND = "cond AS (SELECT a.component AS f, b.component AS t, max(w) AS w FROM dep JOIN comp a ON a.id = dep.f JOIN comp b ON b.id = dep.t WHERE a.component <> b.component GROUP BY 1, 2), chain(id, s) AS (SELECT component, 0 FROM comp UNION SELECT cond.t, chain.s + 1 FROM chain JOIN cond ON cond.f = chain.id), stage AS (SELECT id, max(s) AS stage FROM chain GROUP BY 1)"
_DEG = "deg AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT f AS id, 1 AS o, 0 AS i FROM dep UNION ALL SELECT t, 0, 1 FROM dep) GROUP BY 1)"
_REACH = "entry AS (SELECT id FROM mods WHERE is_entry UNION SELECT id FROM mods WHERE project_id NOT IN (SELECT project_id FROM mods WHERE is_entry) AND id NOT IN (SELECT t FROM dep)), seen(id) AS (SELECT id FROM entry UNION SELECT dep.t FROM seen JOIN dep ON dep.f = seen.id)"
_FULL = f"WITH RECURSIVE {MODULE_EDGES}, {_OV}, {_SCC}, {_COND}, {_DEG}, {_REACH}, ov AS (SELECT mods.*, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, comp.component, stage.stage, mods.id IN (SELECT id FROM seen) AS reachable FROM mods JOIN comp ON comp.id = mods.id LEFT JOIN stage ON stage.id = comp.component LEFT JOIN deg ON deg.id = mods.id)"
_HUMAN = lambda e: f"array_to_string(list_transform(string_split(translate({e}, '_/-.', '    '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"
_BUCKET = "CASE WHEN kind = 'entry' THEN 'entry' " + " ".join(f"WHEN role = '{r}' THEN '{b}'" for r, b in O.BUCKETS.items()) + " WHEN kind = 'infrastructure' THEN 'support' ELSE 'capability' END"
_CAPS = _FULL + f""", c0 AS (SELECT *, CASE WHEN cnt <= 16 OR (cross_n >= 3 AND cnt <= 24) THEN 'module_scoped' WHEN cnt <= 48 THEN 'folder_role_scoped' ELSE 'role_scoped' END AS mode,
    CASE WHEN is_entry THEN 'entry' WHEN role IN ({in_list(O.SUPPORT_ROLES)}) OR (stage = max_stage AND max_stage > 0 AND out_degree = 0) THEN 'infrastructure' ELSE 'capability' END AS kind
  FROM (SELECT *, count(*) OVER p AS cnt, count(*) FILTER (qml_files + web_files + script_files + data_files > 0) OVER p AS cross_n, max(stage) OVER p AS max_stage, count(*) OVER (PARTITION BY project_id, folder) AS in_folder FROM ov WINDOW p AS (PARTITION BY project_id))),
c1 AS (SELECT *, {_BUCKET} AS bucket, mode = 'folder_role_scoped' AND kind <> 'entry' AND folder <> '' AND in_folder > 1 AND folder <> name AS scoped, CASE WHEN kind = 'infrastructure' THEN 'infra:' ELSE 'cap:' END AS px, CASE WHEN kind = 'infrastructure' THEN ' Infrastructure' ELSE ' Capability' END AS sx FROM c0),
caps AS (SELECT *, CASE WHEN kind = 'entry' THEN 'entry:' || id WHEN mode = 'module_scoped' THEN px || 'module:' || id WHEN scoped THEN px || folder || ':' || bucket ELSE px || bucket END AS cluster,
    CASE WHEN kind = 'entry' OR mode = 'module_scoped' THEN {_HUMAN('name')} WHEN scoped THEN {_HUMAN('folder')} || ' ' || {_HUMAN('bucket')} || sx ELSE {_HUMAN('bucket')} || sx END AS cluster_name FROM c1)"""
_LISTED = lambda c: f"(flatten(list({c} ORDER BY CASE WHEN is_entry THEN 0 ELSE 1 END, name, id)))"
_CLUST = _CAPS + f""", cl AS (SELECT project_id, cluster, min(kind) AS kind, min(cluster_name) AS name, min(mode) AS mode, count(*) AS module_count, CAST(sum(file_count) AS BIGINT) AS file_count, min(stage) AS stage_start, max(stage) AS stage_end, bool_or(reachable) AS reachable,
  CAST(sum(in_degree) AS BIGINT) AS in_degree, CAST(sum(out_degree) AS BIGINT) AS out_degree, {_LISTED('top_symbols')} AS allsym, list_sort(list_distinct(flatten(list(paths))))[1:6] AS files6 FROM caps GROUP BY 1, 2),
clu AS (SELECT cl.*, list_filter(allsym, lambda x, i: list_position(allsym, x) = i)[1:6] AS symbols, dom.role AS dominant_role FROM cl JOIN (SELECT project_id, cluster, role FROM (SELECT project_id, cluster, role, row_number() OVER (PARTITION BY project_id, cluster ORDER BY count(*) DESC, role) AS r FROM caps GROUP BY 1, 2, 3) WHERE r = 1) dom USING (project_id, cluster))"""
_SCORES = _CLUST + """, pr AS (SELECT DISTINCT a.project_id, a.cluster, b.cluster AS other FROM dep JOIN caps a ON a.id IN (dep.f, dep.t) JOIN caps b ON b.id IN (dep.f, dep.t) AND a.id <> b.id WHERE a.cluster <> b.cluster),
sc1 AS (SELECT clu.*, (SELECT count(*) FROM pr WHERE pr.project_id = clu.project_id AND pr.cluster = clu.cluster) AS collaborators FROM clu),
sc2 AS (SELECT *, least(file_count * 8, 32) + least(len(symbols) * 12, 24) + least(collaborators * 4, 16) + CASE WHEN reachable THEN 10 ELSE 0 END + CASE WHEN kind = 'entry' THEN 18 ELSE 0 END + CASE mode WHEN 'module_scoped' THEN 18 WHEN 'folder_role_scoped' THEN 8 ELSE 0 END AS s FROM sc1),
sc3 AS (SELECT *, CASE WHEN module_count > 3 THEN greatest(s - 14, 0) WHEN module_count = 1 THEN s + 10 ELSE s END AS s1 FROM sc2),
scores AS (SELECT *, least(CASE WHEN len(files6) = 0 THEN greatest(s1 - 10, 0) ELSE s1 END, 100) AS confidence, CASE kind WHEN 'entry' THEN 1000 WHEN 'capability' THEN 500 ELSE 250 END + least((in_degree + out_degree) * 4, 400) + least(module_count * 20, 120) + least(file_count * 8, 80) + CASE WHEN reachable THEN 60 ELSE 0 END AS priority FROM sc3)"""
_LABEL = "CASE WHEN confidence >= 75 THEN 'high' WHEN confidence >= 45 THEN 'medium' ELSE 'low' END"
_PEEL = lambda src, nodes: f"lp(id, s) AS (SELECT id, 0 FROM {nodes} UNION SELECT e.t, lp.s + 1 FROM lp JOIN {src} e ON e.f = lp.id WHERE lp.s <= (SELECT count(*) FROM {nodes})), deep AS (SELECT id, max(s) AS s FROM lp GROUP BY 1)"
_CYC = f"cyc(id) AS (SELECT a FROM closure WHERE a = b UNION SELECT dep.t FROM cyc JOIN dep ON dep.f = cyc.id), mid AS (SELECT DISTINCT id FROM nodes WHERE kind = 'module'), lp(id, s) AS (SELECT id, 0 FROM mid WHERE id NOT IN (SELECT id FROM cyc) UNION SELECT dep.t, lp.s + 1 FROM lp JOIN dep ON dep.f = lp.id WHERE dep.t NOT IN (SELECT id FROM cyc)), lay0 AS (SELECT id, max(s) AS layer FROM lp GROUP BY 1), lay AS (SELECT * FROM lay0 UNION ALL SELECT DISTINCT id, coalesce((SELECT max(layer) + 1 FROM lay0), 0) FROM cyc)"
_LAYERS = f"WITH RECURSIVE {MODULE_EDGES}, closure(a, b) AS (SELECT f, t FROM dep UNION SELECT closure.a, dep.t FROM closure JOIN dep ON closure.b = dep.f), {_CYC}"
_POS = _LAYERS + f", {_DEG}, pos AS (SELECT lay.id, CAST(layer AS INTEGER) AS layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY coalesce(out_degree, 0) DESC, display_name, lay.id) - 1 AS INTEGER) AS ord FROM lay JOIN (SELECT DISTINCT id, display_name FROM nodes WHERE kind = 'module') m ON m.id = lay.id LEFT JOIN deg ON deg.id = lay.id), xy AS (SELECT *, layer * 320.0::DOUBLE AS x, ord * 140.0::DOUBLE AS y FROM pos)"
_KINDS = ["contains", "calls", "includes", "inherits", "uses_type", "overrides", "depends_on"]
_NS = "regexp_replace(coalesce(a.qualified_name, ''), '(^|::)[^:]*$', '')"
_CALLS = f"""WITH {NODES}, c AS (SELECT DISTINCT a.id || '>' || b.id AS call_id, a.project_id, b.display_name AS callee, {_NS} AS ns FROM (SELECT DISTINCT from_id, to_id FROM edges WHERE kind = 'calls') e JOIN n a ON a.id = e.from_id JOIN n b ON b.id = e.to_id WHERE b.display_name <> ''),
  uq AS (SELECT project_id, qualified_name, min(id) AS id FROM n WHERE qualified_name <> '' GROUP BY 1, 2 HAVING count(DISTINCT id) = 1), ud AS (SELECT project_id, display_name, min(id) AS id FROM n WHERE display_name <> '' GROUP BY 1, 2 HAVING count(DISTINCT id) = 1),
  s AS (SELECT c.call_id, min(n.id) AS id FROM c JOIN n ON n.project_id = c.project_id AND n.display_name = list_extract(string_split(c.callee, '::'), -1) AND c.ns <> '' AND starts_with(n.qualified_name, c.ns || '::') GROUP BY 1 HAVING count(DISTINCT n.id) = 1),
  r AS (SELECT c.call_id, c.project_id, c.callee, q1.id AS r1, q3.id AS r3, s.id AS r4, ud.id AS r5 FROM c LEFT JOIN uq q1 ON q1.project_id = c.project_id AND q1.qualified_name = c.callee LEFT JOIN uq q3 ON q3.project_id = c.project_id AND c.ns <> '' AND q3.qualified_name = c.ns || '::' || c.callee
    LEFT JOIN s ON s.call_id = c.call_id LEFT JOIN ud ON ud.project_id = c.project_id AND ud.display_name = list_extract(string_split(c.callee, '::'), -1)),
  res AS (SELECT call_id, project_id, callee, coalesce(r1, r3, r4, r5) AS target, CAST(CASE WHEN r1 IS NOT NULL THEN 1 WHEN r3 IS NOT NULL THEN 3 WHEN r4 IS NOT NULL THEN 4 WHEN r5 IS NOT NULL THEN 5 END AS INTEGER) AS rung FROM r)"""
_PAIR = lambda src: f"SELECT least(f, t) AS a, greatest(f, t) AS b, CAST(sum(w) AS BIGINT) AS weight, bool_or(f < t) AS forward, bool_or(f > t) AS backward FROM {src} WHERE f <> t GROUP BY 1, 2"
_DEGREE = lambda src: f"SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT f AS id, 0 AS i, 1 AS o FROM {src} UNION ALL SELECT t, 1, 0 FROM {src}) GROUP BY 1"
_DAGN = f"WITH RECURSIVE {DAG}, ends AS (SELECT CAST(f AS BIGINT) AS id FROM dag UNION SELECT CAST(t AS BIGINT) FROM dag)"
_NOISE = "CASE WHEN len(list_filter(sg, lambda x: x IN ('generated', 'generatedfiles', 'autogen', 'autogenerated', '.generated', 'gen'))) > 0 THEN 'generated' WHEN sg[1] IN ('example', 'examples', 'sample', 'samples', 'demo', 'demos', 'playground', 'sandbox', 'prototype', 'prototypes', 'bench', 'benchmarks') THEN 'example' WHEN sg[1] IN ('test', 'tests', 'testdata', 'fixture', 'fixtures', 'mock', 'mocks', 'stub', 'stubs', '__tests__') THEN 'test' END"
_FLOWS = f"""WITH RECURSIVE {MODULE_EDGES}, {_SCC}, {_COND}, hv(id, s) AS (SELECT component, CAST(0 AS BIGINT) FROM comp UNION SELECT cond.t, hv.s + cond.w FROM hv JOIN cond ON cond.f = hv.id), best AS (SELECT id, max(s) AS s FROM hv GROUP BY 1),
pred AS (SELECT c.t AS id, min(c.f) AS f FROM cond c JOIN best a ON a.id = c.f JOIN best b ON b.id = c.t WHERE a.s + c.w = b.s AND b.s > 0 GROUP BY 1),
way(id, sig, n) AS (SELECT id, CAST(id AS VARCHAR), 1 FROM best WHERE id NOT IN (SELECT id FROM pred) UNION ALL SELECT p.id, way.sig || '>' || p.id, n + 1 FROM way JOIN pred p ON p.f = way.id),
flow AS (SELECT m.project_id, way.id, best.s, way.sig, way.n FROM way JOIN best ON best.id = way.id JOIN (SELECT DISTINCT id, project_id FROM nodes WHERE kind = 'module') m ON m.id = way.id)"""
_MERGEKEY = "coalesce('id:' || nullif(identity_key, ''), 'name:' || kind || ':' || nullif(qualified_name, ''), 'row:' || id)"

SQL = {
    "module_dependency_rollup": f"WITH {MODULE_EDGES} SELECT f AS from_module, t AS to_module, edge_count, w AS weight, support_count FROM dep",
    "edge_merge_accumulate": "SELECT from_id, to_id, kind, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(support_count) AS BIGINT) AS support_count, max(fact_source) AS fact_source FROM edges WHERE from_id <> 0 AND to_id <> 0 AND from_id <> to_id GROUP BY 1, 2, 3",
    "edge_merge_keep": """SELECT from_id, to_id, kind, max(weight) FILTER (r = 1) AS weight, max(support_count) AS support_count, max(fact_source) AS fact_source FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, kind ORDER BY observed_at NULLS FIRST, weight NULLS FIRST) AS r
        FROM edges WHERE from_id <> 0 AND to_id <> 0 AND from_id <> to_id) GROUP BY 1, 2, 3""",
    "node_merge": f"""WITH {NODES} SELECT project_id, min(id) AS id, arg_min(kind, id) AS kind, arg_min(nullif(display_name, ''), id) FILTER (display_name <> '') AS display_name, arg_min(qualified_name, id) FILTER (qualified_name <> '') AS qualified_name, arg_min(file_path, id) FILTER (file_path <> '') AS file_path,
        arg_min(line, id) FILTER (line > 0) AS line, max(fact_source) AS fact_source, count(DISTINCT id) AS merged FROM n GROUP BY project_id, {_MERGEKEY}""",
    "kind_histogram": f"WITH {NODES} SELECT 'node' AS what, kind, count(*) AS n FROM n GROUP BY 1, 2 UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY 1, 2 UNION ALL SELECT 'source', fact_source, count(*) FROM edges GROUP BY 1, 2",
    "precision_summary": f"SELECT project_id, count(*) AS edges, CAST(sum(support_count) AS BIGINT) AS support, count(*) FILTER (fact_source = 'semantic') AS semantic, {', '.join(f'count(*) FILTER (kind = {k!r}) AS {k}' for k in _KINDS)}, printf('%.1f%%', count(*) FILTER (fact_source = 'semantic') * 100.0::DOUBLE / count(*)) AS semantic_share FROM edges GROUP BY 1",
    "degree_in_out": "WITH e AS (SELECT DISTINCT from_id AS f, to_id AS t FROM edges WHERE from_id <> 0 AND to_id <> 0) " + _DEGREE("e"),
    "symbols_by_qualified_name": f"WITH {NODES} SELECT project_id, qualified_name, min(id) AS id FROM n WHERE qualified_name <> '' GROUP BY 1, 2 HAVING count(DISTINCT id) = 1",
    "symbols_by_display_name": f"WITH {NODES} SELECT project_id, display_name, count(DISTINCT id) AS matches, min(id) AS first_id, count(DISTINCT kind) AS kinds FROM n WHERE display_name <> '' GROUP BY 1, 2",
    "call_ladder_resolve": _CALLS + " SELECT * FROM res",
    "unresolved_calls": _CALLS + " SELECT call_id, project_id, callee FROM res WHERE target IS NULL",
    "collaborators": f"WITH {MODULE_EDGES}, b AS (SELECT f AS id, t AS o FROM dep UNION SELECT t, f FROM dep) SELECT b.id, count(*) AS n, string_agg(DISTINCT display_name, ', ' ORDER BY display_name) AS collaborators FROM b JOIN (SELECT DISTINCT id, display_name FROM nodes WHERE kind = 'module') m ON m.id = b.o GROUP BY 1",
    "ego_network": f"""WITH {MODULE_EDGES}, b AS (SELECT f AS id, t AS neighbour, w AS w_out, 0 AS w_in FROM dep UNION ALL SELECT t, f, 0, w FROM dep), c AS (SELECT id FROM b GROUP BY id ORDER BY sum(w_out + w_in) DESC, id DESC LIMIT 1)
        SELECT id, neighbour, CAST(sum(w_out) AS BIGINT) AS w_out, CAST(sum(w_in) AS BIGINT) AS w_in FROM b WHERE id = (SELECT id FROM c) GROUP BY 1, 2""",
    "bidirectional_merge": f"WITH {MODULE_EDGES} " + _PAIR("dep"),
    "commerce_bidirectional": f"WITH {COMMERCE} " + _PAIR("commerce"),
    "commerce_degrees": f"WITH {COMMERCE} " + _DEGREE("commerce"),
    "dag_hops": _DAGN + ", h(id, s) AS (SELECT id, 0 FROM ends WHERE id NOT IN (SELECT t FROM dag) UNION SELECT dag.t, h.s + 1 FROM h JOIN dag ON dag.f = h.id) SELECT CAST(id AS BIGINT) AS id, CAST(min(s) AS INTEGER) AS hops FROM h GROUP BY 1",
    "dag_layers": _DAGN + ", h(id, s) AS (SELECT id, 0 FROM ends UNION SELECT dag.t, h.s + 1 FROM h JOIN dag ON dag.f = h.id) SELECT CAST(id AS BIGINT) AS id, CAST(max(s) AS INTEGER) AS layer FROM h GROUP BY 1",
    "dag_stages": _DAGN + ", h(id, s) AS (SELECT id, 0 FROM ends UNION SELECT dag.t, h.s + 1 FROM h JOIN dag ON dag.f = h.id) SELECT CAST(id AS BIGINT) AS id, CAST(max(s) AS INTEGER) AS stage FROM h GROUP BY 1",
    "dag_heaviest_path": _DAGN + ", h(id, s) AS (SELECT id, CASE WHEN id IN (SELECT t FROM dag) THEN 0 ELSE 1 END FROM ends UNION SELECT dag.t, h.s + dag.w FROM h JOIN dag ON dag.f = h.id) SELECT CAST(id AS BIGINT) AS id, CAST(max(s) AS BIGINT) AS score FROM h GROUP BY 1",
    "heaviest_flows": _FLOWS + ", r AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY s DESC, id) AS r, s, sig FROM flow WHERE n > 1) SELECT project_id, CAST(r AS INTEGER) AS r, CAST(s AS BIGINT) AS score, sig AS signature FROM r WHERE r <= 5",
    "include_reach": "WITH RECURSIVE e AS (SELECT DISTINCT from_id AS f, to_id AS t FROM edges WHERE kind = 'includes' AND from_id <> 0 AND to_id <> 0), lv(id, s) AS (SELECT DISTINCT f, 0 FROM e WHERE f NOT IN (SELECT t FROM e WHERE f <> t) UNION SELECT e.t, lv.s + 1 FROM lv JOIN e ON e.f = lv.id WHERE lv.s < 40) SELECT id, CAST(min(s) AS INTEGER) AS hops FROM lv GROUP BY 1",
    "scc_members": f"WITH RECURSIVE {MODULE_EDGES}, {_SCC} SELECT id, component FROM comp",
    "condensation_edges": f"WITH RECURSIVE {MODULE_EDGES}, {_SCC}, {_COND} SELECT f, t, w FROM cond",
    "module_stages": f"WITH RECURSIVE {MODULE_EDGES}, {_SCC}, {_COND} SELECT id, CAST(stage AS INTEGER) AS stage FROM stage",
    "module_layers": _LAYERS + " SELECT id, CAST(layer AS INTEGER) AS layer FROM lay",
    "inferred_entries": f"WITH {MODULE_EDGES} SELECT DISTINCT id FROM nodes WHERE kind = 'module' AND id NOT IN (SELECT t FROM dep)",
    "module_symbol_counts": f"WITH {_OV} SELECT id, project_id, name, folder, file_count, cpp_files, qml_files, web_files, script_files, data_files, {', '.join(k + '_count' for k in O.COUNTED)} FROM mods",
    "top_symbols_per_module": f"WITH {NODES}, {_TOP} SELECT module_id, array_to_string(top_symbols, ',') AS symbols, CASE WHEN len(top_symbols) > 2 THEN array_to_string(top_symbols[1:2], ', ') || ', +' || (len(top_symbols) - 2) || ' more' ELSE array_to_string(top_symbols, ', ') END AS short FROM tops",
    "module_roles": f"WITH {_OV} SELECT id, name, role, is_entry FROM mods",
    "folder_role_clusters": f"WITH {_OV} SELECT project_id, 'folder' AS by, folder AS name, count(*) AS modules, bool_or(is_entry) OR count(*) <= 3 AS expanded FROM mods GROUP BY project_id, folder UNION ALL SELECT project_id, 'role', role, count(*), false FROM mods GROUP BY project_id, role",
    "project_kinds": f"""WITH {_OV}, a AS (SELECT project_id, CAST(sum(cpp_files) AS BIGINT) AS cpp, CAST(sum(qml_files) AS BIGINT) AS qml, CAST(sum(web_files) AS BIGINT) AS web, CAST(sum(script_files) AS BIGINT) AS script, bool_or(role IN ('presentation', 'web')) AS ui, bool_or(role IN ('interaction', 'analysis')) AS backend, bool_or(role IN ('storage', 'data')) AS storage FROM mods GROUP BY 1)
        SELECT project_id, cpp, script, CASE WHEN qml > 0 AND cpp > 0 AND (web > 0 OR ui) THEN 'qml application' WHEN qml > 0 AND cpp > 0 THEN 'desktop' WHEN web > 0 AND cpp > 0 THEN 'mixed web' WHEN cpp > 0 AND backend AND storage THEN 'local application' WHEN cpp > 0 AND script > 0 THEN 'cpp with scripts' WHEN cpp > 0 THEN 'cpp' WHEN script > 0 THEN 'scripts' ELSE 'unclear' END AS kind FROM a""",
    "reachable_from_entry": _FULL + " SELECT id, reachable FROM ov",
    "overview_nodes": _FULL + " SELECT id, project_id, name, role, is_entry, in_degree, out_degree, CAST(stage AS INTEGER) AS stage, CASE WHEN stage = 0 THEN 'entry' WHEN stage = max(stage) OVER (PARTITION BY project_id) THEN 'leaf' WHEN stage = 1 THEN 'core' ELSE 'downstream_' || stage END AS stage_name, reachable, component FROM ov",
    "capability_nodes": _CAPS + " SELECT id, mode, kind, bucket, cluster, cluster_name FROM caps",
    "capability_rollup": _CLUST + " SELECT project_id, cluster, kind, name, module_count, file_count, CAST(stage_start AS INTEGER) AS stage_start, CAST(stage_end AS INTEGER) AS stage_end, reachable, in_degree, out_degree, dominant_role, coalesce(array_to_string(symbols, ','), '') AS symbols, coalesce(array_to_string(files6, ','), '') AS example_files FROM clu",
    "capability_edges": _CAPS + f""", g AS (SELECT a.project_id, a.cluster AS from_cluster, b.cluster AS to_cluster, CASE WHEN a.kind = 'entry' THEN 'activates' WHEN b.kind = 'infrastructure' THEN 'uses_infrastructure' ELSE 'enables' END AS kind, CAST(sum(w) AS BIGINT) AS weight, count(*) AS supporting
        FROM dep JOIN caps a ON a.id = dep.f JOIN caps b ON b.id = dep.t WHERE a.cluster <> b.cluster GROUP BY 1, 2, 3, 4), h AS (SELECT *, CAST(least(22 + least(weight * 12, 36) + least(supporting * 10, 20), 100) AS INTEGER) AS confidence FROM g) SELECT *, {_LABEL} AS label FROM h""",
    "capability_scores": _SCORES + f" SELECT project_id, cluster, collaborators, CAST(confidence AS INTEGER) AS confidence, {_LABEL} AS confidence_label, CAST(priority AS INTEGER) AS priority FROM scores",
    "pruned_capabilities": _SCORES + ", w AS (SELECT *, CAST(priority * 100 + collaborators * 10 + file_count + CASE WHEN kind = 'entry' THEN 1000000 ELSE 0 END AS BIGINT) AS weight FROM scores) SELECT project_id, cluster, weight, row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, name, cluster) <= 40 OR kind = 'entry' AS visible FROM w",
    "noise_classes": f"WITH {NODES}, p AS (SELECT module_id, {_NOISE} AS c FROM (SELECT module_id, list_filter(string_split(lower(replace(qualified_name, '\\', '/')), '/'), lambda x: x <> '') AS sg FROM n WHERE kind = 'file')) SELECT module_id, CASE WHEN count(*) = count(c) AND min(c) = max(c) THEN min(c) END AS noise, count(*) AS files FROM p GROUP BY 1",
    "hub_and_isolated_findings": _FULL + """, f AS (SELECT *, CASE WHEN count(*) OVER p >= 12 THEN 5 WHEN count(*) OVER p >= 7 THEN 4 ELSE 3 END AS fl, in_degree + out_degree AS tot FROM ov WINDOW p AS (PARTITION BY project_id))
        SELECT project_id, id, 'hub' AS finding, CASE WHEN tot >= fl + 3 OR (in_degree >= fl AND out_degree >= fl) THEN 'critical' ELSE 'warning' END AS severity, array_to_string(list_sort(list_filter(['high_total_degree', CASE WHEN in_degree >= fl THEN 'high_in_degree' END, CASE WHEN out_degree >= fl THEN 'high_out_degree' END, CASE WHEN reachable THEN 'reachable_from_entry' END], lambda x: x IS NOT NULL)), ',') AS reasons
        FROM f WHERE in_degree >= fl OR out_degree >= fl OR (tot >= fl AND in_degree >= 2 AND out_degree >= 2)
        UNION ALL SELECT project_id, id, 'isolated', CASE WHEN tot = 0 THEN 'warning' ELSE 'info' END, array_to_string(list_sort(list_filter([CASE WHEN tot = 0 THEN 'no_relationships' ELSE 'single_relationship' END, CASE WHEN NOT reachable THEN 'not_reachable_from_entry' END], lambda x: x IS NOT NULL)), ',') FROM f WHERE NOT is_entry AND (tot = 0 OR (tot = 1 AND NOT reachable))""",
    "cycle_findings": _FULL + " SELECT component, count(*) AS size, CASE WHEN bool_or(is_entry) OR count(*) >= 3 THEN 'critical' ELSE 'warning' END AS severity, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM ov GROUP BY component HAVING count(*) > 1",
    "hotspots": _FULL + """, s AS (SELECT *, CAST(least(12, in_degree + out_degree) + least(8, file_count // 4) + CASE WHEN count(*) OVER (PARTITION BY component) > 1 THEN 10 ELSE 0 END AS INTEGER) AS score FROM ov), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY score DESC, file_count DESC, name, id) AS INTEGER) AS place FROM s WHERE NOT is_entry AND role <> 'dependency' AND score >= 10)
        SELECT project_id, place, id, score, CASE WHEN score >= 24 THEN 'high' WHEN score >= 14 THEN 'medium' ELSE 'low' END AS severity FROM r WHERE place <= 3""",
    "layout_positions": _POS + " SELECT * FROM xy",
    "column_wrap": _POS + ", k AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY layer) / 3) AS INTEGER) AS c FROM xy) SELECT id, layer, ord, CAST(ord % c AS INTEGER) AS sub_column, CAST(ord // c AS INTEGER) AS sub_row FROM k",
    "layer_bounds": _POS + " SELECT layer, min(x) - 24 AS \"left\", min(y) - 24 AS top, max(x) + 244 AS \"right\", max(y) + 116 AS bottom, count(*) AS members FROM xy GROUP BY layer",
    "edge_routes": _POS + """, j AS (SELECT dep.f, dep.t, a.x AS fx, a.y AS fy, b.x AS tx, b.y AS ty, b.layer < a.layer AS back, b.layer > a.layer AS ahead, b.ord < a.ord AS l FROM dep JOIN xy a ON a.id = dep.f JOIN xy b ON b.id = dep.t),
        r AS (SELECT f, t, CASE WHEN back OR (NOT ahead AND l) THEN fx ELSE fx + 220 END AS x1, fy + 46 AS y1, CASE WHEN back THEN fx - 28 WHEN ahead THEN fx + 248 WHEN l THEN least(fx, tx) - 44 ELSE greatest(fx, tx) + 264 END AS rail, CASE WHEN ahead OR (NOT back AND l) THEN tx ELSE tx + 220 END AS x2, ty + 46 AS y2 FROM j)
        SELECT *, abs(rail - x1) + abs(y2 - y1) + abs(x2 - rail) AS length FROM r""",
    "endpoint_slots": f"WITH {MODULE_EDGES} SELECT f, t, (row_number() OVER (PARTITION BY f ORDER BY w DESC, f, t) - (count(*) OVER (PARTITION BY f) + 1) / 2) * 14.0::DOUBLE AS offset_out, (row_number() OVER (PARTITION BY t ORDER BY w DESC, f, t) - (count(*) OVER (PARTITION BY t) + 1) / 2) * 14.0::DOUBLE AS offset_in FROM dep",
    "dot_export": f"""WITH {MODULE_EDGES}, m AS (SELECT DISTINCT id, project_id, display_name FROM nodes WHERE kind = 'module'), l AS (SELECT project_id, 1 AS part, '  n' || id || ' [label="' || replace(replace(display_name, '\\', '\\\\'), '"', '\\"') || '"];' AS line FROM m UNION ALL SELECT project_id, 2, '  n' || f || ' -> n' || t || ' [label="' || w || '"];' FROM dep JOIN m ON m.id = dep.f)
        SELECT project_id, CAST(part AS INTEGER) AS part, line FROM (SELECT * FROM l UNION ALL SELECT DISTINCT project_id, 0, 'digraph architecture {{' FROM m UNION ALL SELECT DISTINCT project_id, 3, '}}' FROM m)""",
    "overview_json": f"WITH {_OV} SELECT id, '{{\"name\":' || to_json(name) || ',\"role\":' || to_json(role) || ',\"entry\":' || to_json(is_entry) || ',\"file_count\":' || file_count || '}}' AS json FROM mods",
    "evidence_packages": _FULL + """, e AS (SELECT id, list_filter([file_count || ' files', CASE WHEN in_degree > 0 THEN 'used by ' || in_degree END, CASE WHEN out_degree > 0 THEN 'uses ' || out_degree END, CASE WHEN is_entry THEN 'entry' END], lambda x: x IS NOT NULL) AS facts, paths[1:6] AS p FROM ov)
        SELECT id, array_to_string(facts, '; ') AS facts, CAST(len(facts) AS INTEGER) AS n, CASE WHEN len(p) = 0 THEN 'none' WHEN len(p) > 2 THEN array_to_string(p[1:2], ', ') || ', +' || (len(p) - 2) || ' more' ELSE array_to_string(p, ', ') END AS files FROM e""",
    "markdown_report": _FULL + """, r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY is_entry DESC, in_degree + out_degree DESC, name, id) AS place FROM ov)
        SELECT project_id, '# ' || project_id || chr(10) || chr(10) || '## Reading order' || chr(10) || string_agg('- **' || name || '** (' || role || '): ' || file_count || ' files', chr(10) ORDER BY place) AS markdown FROM r WHERE place <= 3 GROUP BY project_id""",
}
