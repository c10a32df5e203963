"""Exports: reports as numbered lines and documents as JSON rows, one per fact, so that no project's text has to fit a
row. A writer that wants one text sorts a project's lines by (part, place)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import text as T
from cartolith.operators import overview as O
from cartolith.operators import resolve
from cartolith.plans import graph_queries as Q
from cartolith.plans import view_queries as V
from cartolith.plans.sqlparts import MODULE_EDGES, NODES
from cartolith.runtime import Staged, table
from cartolith.sources.tables import graph_edges, graph_nodes

#: Lines that a report shows of nodes, edges, dependencies and diagnostics.
SHOWN_NODES, SHOWN_EDGES, SHOWN_DEPENDENCIES, SHOWN_DIAGNOSTICS, SHOWN_PLACES = 80, 120, 20, 40, 40
# Kinds of nodes and edges in the order in which reports count them.
NODE_KINDS = ["module", "file", "namespace", "class", "struct", "enum", "enumerator", "field", "function", "method"]
EDGE_KINDS = ["contains", "calls", "includes", "inherits", "uses_type", "overrides", "depends_on"]
# Words that give a capability its label, in the order in which they are asked, and what the label adds to
# its priority; utilities are hidden.
LABEL_WORDS = [
    ("graph", ["graph", "node", "edge"], 240), ("algorithm", ["algorithm", "astar", "a*"], 220), ("interface", ["view", "window", "ui", "qml", "widget"], 200), ("storage", ["db", "sql", "repo", "storage", "database"], 0),
    ("network", ["net", "http", "api", "client", "socket"], 0), ("engine", ["parser", "ast", "analyzer", "core"], 0), ("utilities", ["util", "helper", "const", "common"], 0),
]
WEB_ASSETS = [".css", ".html", ".htm"]


def _s(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _line(part: int, place: Column, *pieces: str | Column) -> list[Column]:
    return ["project_id", F.lit(part).alias("part"), place.cast("int").alias("place"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces]).alias("line")]


def _head(df: DataFrame, part: int, *lines: Column) -> DataFrame:
    return df.select("project_id", F.lit(part).alias("part"), F.posexplode(F.array(*lines)).alias("place", "line"))


def _ranked(df: DataFrame, *order, limit: int) -> DataFrame:
    """df with place (from 1) in its project up to the limit; the limit is the report's."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(*order))).where(F.col("place") <= limit)


def _more(df: DataFrame, part: int, shown: int, what: str) -> DataFrame:
    n = df.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shown)
    return n.select(*_line(part, F.lit(0), "... ", (F.col("n") - shown).cast("string"), f" more {what}"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _report_edges(spark, d) -> DataFrame:
    n = graph_nodes(spark, d)
    a = n.select("project_id", F.col("id").alias("from_id"), F.col("qualified_name").alias("from_name"), F.col("display_name").alias("from_shown"))
    b = n.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("to_name"), F.col("display_name").alias("to_shown"))
    return Staged(resolve.merge_edges(graph_edges(spark, d), True).join(a, "from_id").join(b, "to_id"), "named").df


def _diagnostics(spark, d) -> DataFrame:
    return table(spark, d, "parse_results").where("error_message <> ''").select("project_id", F.coalesce("file_path", F.lit("")).alias("path"), F.coalesce("attempt", F.lit(0)).alias("attempt"), "error_message").distinct()


def analysis_text(spark, d):
    """The report of a run: counts by kind and source, and samples of nodes, edges, dependencies and diagnostics."""
    n, e, x = graph_nodes(spark, d), _report_edges(spark, d), _diagnostics(spark, d)
    source = lambda s: F.count_if(F.col("fact_source") == s).alias(s)
    nc = n.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in NODE_KINDS], source("inferred"), source("semantic"))
    ec = e.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in EDGE_KINDS], source("inferred"), source("semantic"))
    counted = lambda what, kinds: [F.concat(F.lit(f"{what}: "), F.col("n").cast("string")), *[F.concat(F.lit(f"  {k}: "), F.col(k).cast("string")) for k in [*kinds, "inferred", "semantic"]]]
    weight = F.concat(F.when(F.col("weight") > 1, F.concat(F.lit(" (weight="), F.col("weight").cast("string"), F.lit(")"))).otherwise(""), F.when(F.col("support_count") > 1, F.concat(F.lit(" (support="), F.col("support_count").cast("string"), F.lit(")"))).otherwise(""))
    nodes = _ranked(n, "id", limit=SHOWN_NODES).select(*_line(2, F.col("place"), "- [", _s("fact_source"), "] [", _s("kind"), "] ", _s("qualified_name"), " @ ", _s("file_path"), ":", F.coalesce("line", F.lit(0)).cast("string")))
    edges = _ranked(e, "from_id", "to_id", "kind", limit=SHOWN_EDGES).select(*_line(4, F.col("place"), "- [", _s("fact_source"), "] ", F.col("kind"), ": ", _s("from_name"), " -> ", _s("to_name"), weight))
    depends = e.where("kind = 'depends_on'")
    deps = _ranked(depends, "from_id", "to_id", limit=SHOWN_DEPENDENCIES).select(*_line(6, F.col("place"), "- ", _s("from_shown"), " -> ", _s("to_shown"), weight))
    none = nc.select("project_id").join(depends.select("project_id").distinct(), "project_id", "left_anti").select(*_line(6, F.lit(0), "- none"))
    notes = _ranked(x, "path", "attempt", "error_message", limit=SHOWN_DIAGNOSTICS).select(*_line(7, F.col("place"), "- ", F.col("path"), ": ", F.col("error_message")))
    return _all(_head(nc, 0, *counted("nodes", NODE_KINDS)), _head(ec, 1, *counted("edges", EDGE_KINDS)), nodes, _more(n, 3, SHOWN_NODES, "nodes"), edges, _more(e, 5, SHOWN_EDGES, "edges"), deps, none, notes, _more(x, 8, SHOWN_DIAGNOSTICS, "diagnostics"))


def run_json(spark, d):
    """A run's summary, nodes, edges and diagnostics, a JSON object each."""
    n, e, x = graph_nodes(spark, d), _report_edges(spark, d), _diagnostics(spark, d)
    json = lambda *fields: F.to_json(F.struct(*fields)).alias("json")
    node = n.select("project_id", F.lit("nodes").alias("section"), json("id", _s("kind").alias("kind"), _s("display_name").alias("displayName"), _s("qualified_name").alias("qualifiedName"), _s("identity_key").alias("identityKey"), _s("file_path").alias("filePath"), F.coalesce("line", F.lit(0)).alias("line"), _s("fact_source").alias("factSource")))
    edge = e.select("project_id", F.lit("edges").alias("section"), json(F.col("from_id").alias("fromId"), F.col("to_id").alias("toId"), "kind", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("support_count", F.lit(0)).alias("supportCount"), _s("fact_source").alias("factSource")))
    note = x.select("project_id", F.lit("diagnostics").alias("section"), json(F.col("path").alias("filePath"), "attempt", F.col("error_message").alias("message")))
    nc = n.groupBy("project_id").agg(F.count_if(F.col("kind") == "file").alias("fileCount"), F.count(F.lit(1)).alias("nodeCount"), F.count_if(F.col("fact_source") == "semantic").alias("semanticNodeCount"))
    ec = e.groupBy("project_id").agg(F.count(F.lit(1)).alias("edgeCount"), F.count_if(F.col("fact_source") == "semantic").alias("semanticEdgeCount"))
    both = nc.join(ec, "project_id", "left").fillna(0, ["edgeCount", "semanticEdgeCount"])
    return _all(both.select("project_id", F.lit("summary").alias("section"), json("fileCount", "nodeCount", "semanticNodeCount", "edgeCount", "semanticEdgeCount")), node, edge, note)


def overview_text(spark, d):
    """Modules in reading order with role, stage and links, then their dependencies."""
    o = Q.overview_table(spark, d)
    _, e = Q.module_graph(spark, d)
    names = o.select(F.col("id").alias("f"), "project_id", F.col("name").alias("from_name"))
    dep = e.join(names, "f").join(o.select(F.col("id").alias("t"), F.col("name").alias("to_name")), "t")
    c = o.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_entry").alias("entries"), F.count_if("reachable").alias("reached"), F.max("stage").alias("last"), F.sum("file_count").alias("files"))
    head = _head(c, 0, *[F.concat(F.lit(f"{t}: "), F.col(k).cast("string")) for t, k in (("modules", "n"), ("entry modules", "entries"), ("reachable modules", "reached"), ("last stage", "last"), ("files", "files"))])
    r = _ranked(o, F.desc("is_entry"), "stage", "name", "id", limit=SHOWN_NODES)
    body = r.select(*_line(1, F.col("place"), "- [", F.col("stage").cast("string"), "] ", F.col("name"), " (", F.col("role"), F.when(F.col("is_entry"), ", entry").otherwise(""), ") files=", F.col("file_count").cast("string"), " in=", F.col("in_degree").cast("string"), " out=", F.col("out_degree").cast("string"), " symbols=", T.first_k(F.col("top_symbols"), 3)))
    lines = _ranked(dep, F.desc("w"), "f", "t", limit=SHOWN_EDGES).select(*_line(3, F.col("place"), "- ", F.col("from_name"), " -> ", F.col("to_name"), " (weight=", F.col("w").cast("string"), ")"))
    return _all(head, body, _more(o, 2, SHOWN_NODES, "modules"), lines, _more(dep, 4, SHOWN_EDGES, "dependencies"))


def _clusters(spark, d, o: DataFrame) -> DataFrame:
    """Capabilities with scores, visibility, buckets, modules and the names of their collaborators, staged."""
    caps = O.capabilities(o)
    # lists of one capability's modules and neighbours
    of = caps.groupBy("project_id", "cluster").agg(F.min("bucket").alias("bucket"), F.slice(F.array_sort(F.collect_set("name")), 1, 8).alias("modules"))
    c = O.clusters(caps).join(Q.capability_scores(spark, d, o), ["project_id", "cluster"]).join(of, ["project_id", "cluster"]).join(V.budgeted_visibility(spark, d, o).select("project_id", "cluster", "visible"), ["project_id", "cluster"])
    c = Staged(c, "clusters").df
    e = Q.capability_edges(spark, d, o).select("project_id", F.explode(F.array(F.struct(F.col("from_cluster").alias("cluster"), F.col("to_cluster").alias("other")), F.struct(F.col("to_cluster").alias("cluster"), F.col("from_cluster").alias("other")))).alias("p")).select("project_id", "p.*").distinct()
    near = e.join(c.select("project_id", F.col("cluster").alias("other"), F.col("name").alias("near")), ["project_id", "other"]).groupBy("project_id", "cluster").agg(F.slice(F.array_sort(F.collect_set("near")), 1, 8).alias("near"))
    return Staged(c.join(near, ["project_id", "cluster"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<string>"))), "near").df


def _label(c: DataFrame) -> DataFrame:
    """c with label, and priority and visible as the label changes them."""
    evidence = F.lower(F.concat_ws(" ", "name", F.array_join("symbols", " "), F.array_join("modules", " "), F.array_join("example_files", " ")))
    holds = lambda words: reduce(lambda a, b: a | b, [F.contains(evidence, F.lit(w)) for w in words])
    assets = (F.size("example_files") > 0) & F.forall("example_files", lambda f: reduce(lambda a, b: a | b, [F.contains(F.lower(f), F.lit(w)) for w in WEB_ASSETS]))
    label, more = F.when(assets, "web_assets"), F.when(assets, 0)
    for name, words, add in LABEL_WORDS:
        label, more = label.when(holds(words), name), more.when(holds(words), add)
    labelled = c.withColumn("label", label).withColumn("priority", F.when(F.col("label") == "utilities", 0).otherwise(F.col("priority") + more.otherwise(0)))
    return labelled.withColumn("visible", F.col("visible") & F.coalesce(F.col("label") != "utilities", F.lit(True)))


def capability_labels(spark, d):
    """The label that a capability's names, symbols and files give it; null if none of its words occurs."""
    return _label(_clusters(spark, d, Q.overview_table(spark, d))).select("project_id", "cluster", "label", "priority", "visible")


def capability_text(spark, d):
    """Capabilities by priority, then their edges by weight."""
    o = Q.overview_table(spark, d)
    c, e = _clusters(spark, d, o), Q.capability_edges(spark, d, o)
    head = _head(c.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("visible").alias("seen"), F.min("mode").alias("mode")), 0, F.concat(F.lit("capabilities: "), F.col("n").cast("string")), F.concat(F.lit("visible: "), F.col("seen").cast("string")), F.concat(F.lit("aggregation: "), F.col("mode")))
    span = F.concat(F.col("stage_start").cast("string"), F.when(F.col("stage_end") != F.col("stage_start"), F.concat(F.lit("-"), F.col("stage_end").cast("string"))).otherwise(""))
    body = _ranked(c, F.desc("priority"), "name", "cluster", limit=SHOWN_NODES).select(*_line(1, F.col("place"), "- [", F.col("kind"), "] ", F.col("name"), " (", F.col("dominant_role"), ") modules=", F.col("module_count").cast("string"), " files=", F.col("file_count").cast("string"), " stages=", span, " confidence=", F.col("confidence_label"), " with=", T.first_k(F.col("near"), 3)))
    named = e.join(c.select("project_id", F.col("cluster").alias("from_cluster"), F.col("name").alias("a")), ["project_id", "from_cluster"]).join(c.select("project_id", F.col("cluster").alias("to_cluster"), F.col("name").alias("b")), ["project_id", "to_cluster"]).drop("kind").join(e.select("project_id", "from_cluster", "to_cluster", "kind"), ["project_id", "from_cluster", "to_cluster"])
    lines = _ranked(named, F.desc("weight"), "from_cluster", "to_cluster", limit=SHOWN_EDGES).select(*_line(2, F.col("place"), "- ", F.col("a"), " -> ", F.col("b"), " (", F.col("kind"), ", weight=", F.col("weight").cast("string"), ")"))
    return _all(head, body, lines)


def layout_text(spark, d):
    """Each project's modules with layer and place, in order of layer."""
    p = Q.layout_positions(spark, d).join(graph_nodes(spark, d).where("kind = 'module'").select("id", "project_id", "display_name"), "id")
    head = _head(p.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("layer").alias("layers")), 0, F.concat(F.lit("placed modules: "), F.col("n").cast("string")), F.concat(F.lit("layers: "), F.col("layers").cast("string")))
    body = _ranked(p, "layer", "ord", "id", limit=SHOWN_PLACES).select(*_line(1, F.col("place"), "- layer ", F.col("layer").cast("string"), ": ", _s("display_name"), " at (", F.col("x").cast("int").cast("string"), ", ", F.col("y").cast("int").cast("string"), ")"))
    return _all(head, body, _more(p, 2, SHOWN_PLACES, "modules"))


def context_markdown(spark, d):
    """The system context: a section for each kind of capability with what belongs to it."""
    c = _clusters(spark, d, Q.overview_table(spark, d))
    part = F.when(F.col("kind") == "entry", 1).when(F.col("kind") == "capability", 2).otherwise(3)
    title = c.select("project_id").distinct().select(*_line(0, F.lit(0), "# System context of ", _s("project_id")))
    sections = c.groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("n")).select("project_id", part.alias("part"), F.lit(0).alias("place"), F.concat(F.lit("## "), T.humanize(F.col("kind")), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    place = F.row_number().over(Window.partitionBy("project_id", "kind").orderBy(F.desc("priority"), "name", "cluster"))
    rows = c.select("project_id", part.alias("part"), place.alias("place"), F.concat(F.lit("- **"), "name", F.lit("** ("), "dominant_role", F.lit("): "), F.col("module_count").cast("string"), F.lit(" modules, "), F.col("file_count").cast("string"), F.lit(" files; works with "), T.first_k(F.col("near"), 4)).alias("line"))
    return _all(title, sections, rows)


def scene_payload(spark, d):
    """What a view of the capabilities needs, a JSON object for each node, edge and group."""
    o = Q.overview_table(spark, d)
    c, e = _clusters(spark, d, o), Q.capability_edges(spark, d, o)
    json = lambda *fields: F.to_json(F.struct(*fields)).alias("json")
    lane = (F.row_number().over(Window.partitionBy("project_id", "stage_start").orderBy(F.desc("priority"), "name", "cluster")) - 1).alias("row")
    node = c.select("project_id", "cluster", "name", "kind", "dominant_role", "stage_start", lane, "priority", "confidence_label", "visible", "symbols", "example_files")
    node = node.select("project_id", F.lit("nodes").alias("section"), json(F.col("cluster").alias("id"), "name", "kind", F.col("dominant_role").alias("role"), F.col("stage_start").alias("column"), "row", "priority", F.col("confidence_label").alias("confidence"), "visible", "symbols", F.col("example_files").alias("files")))
    seen = c.where("visible").select("project_id", "cluster")
    shown = e.join(seen.withColumnRenamed("cluster", "from_cluster"), ["project_id", "from_cluster"], "left_semi").join(seen.withColumnRenamed("cluster", "to_cluster"), ["project_id", "to_cluster"], "left_semi")
    edge = shown.select("project_id", F.lit("edges").alias("section"), json(F.col("from_cluster").alias("from"), F.col("to_cluster").alias("to"), "kind", "weight", "confidence"))
    group = c.groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("visible")).alias("hidden"), F.min("stage_start").alias("first"), F.max("stage_end").alias("last"))
    return _all(node, edge, group.select("project_id", F.lit("groups").alias("section"), json(F.col("kind").alias("lane"), "members", "hidden", F.col("first").alias("firstColumn"), F.col("last").alias("lastColumn"))))


def capability_evidence(spark, d):
    """What is known of each capability, by which rules it was made, what follows, and how sure that is."""
    c = _label(_clusters(spark, d, Q.overview_table(spark, d)))
    text = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    n = lambda k: F.col(k).cast("string")
    listed = lambda *items: F.array_join(F.array_compact(F.array(*items)), "; ")
    facts = listed(text("kind ", F.col("kind"), ", main role ", F.col("dominant_role")), text(n("module_count"), " modules, ", n("file_count"), " files"), text("stages ", n("stage_start"), " to ", n("stage_end")), F.when(F.col("reachable"), "reached from an entry"), F.when(F.col("collaborators") > 0, text("works with ", n("collaborators"), " others")))
    rules = listed(text("aggregation ", F.col("mode")), text("bucket ", F.col("bucket")), F.when(F.col("kind") == "entry", "entry modules stand alone").when(F.col("kind") == "infrastructure", "support role or last stage").otherwise("no entry and no support role"), F.when(F.col("visible"), "shown at first").otherwise("folded at first"), F.when(F.col("label").isNotNull(), text("label ", F.col("label"))))
    conclusions = listed(F.when(F.col("in_degree") > F.col("out_degree"), "is used more than it uses").when(F.col("in_degree") < F.col("out_degree"), "uses more than it is used").otherwise("uses as much as it is used"), F.when(~F.col("reachable"), "no entry leads to it"), F.when(F.size("symbols") == 0, "has no leading symbols"))
    reason = F.when(F.col("confidence_label") == "high", "focused files and symbols").when(F.col("confidence_label") == "medium", "some files or symbols, partly aggregated").otherwise("broad aggregation or few symbols")
    return c.select("project_id", "cluster", facts.alias("facts"), rules.alias("rules"), conclusions.alias("conclusions"), F.array_join("example_files", ",").alias("files"), F.array_join("symbols", ",").alias("symbols"), F.array_join("modules", ",").alias("modules"), F.array_join("near", ",").alias("relationships"), "confidence", "confidence_label", reason.alias("reason"))


def project_guide(spark, d):
    """A first tour: what the project holds, where it starts, its leading modules and hotspots, and the steps to read."""
    o = Q.overview_table(spark, d)
    c = o.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum("file_count").alias("files"), F.min_by("name", F.struct((~F.col("is_entry")).alias("e"), (-F.col("in_degree") - F.col("out_degree")).alias("g"), "name", "id")).alias("start"))
    head = _head(c, 0, F.concat(n_("n"), F.lit(" modules with "), n_("files"), F.lit(" files")), F.concat(F.lit("start at "), F.col("start")))
    top = _ranked(o, F.desc(F.col("in_degree") + F.col("out_degree")), F.desc("file_count"), "name", "id", limit=3).select(*_line(1, F.col("place"), "leading module ", F.col("name"), " (", F.col("role"), "): ", T.first_k(F.col("top_symbols"), 2)))
    size = o.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("component")))
    score = F.least(F.lit(12), F.col("in_degree") + F.col("out_degree")) + F.least(F.lit(8), F.floor(F.col("file_count") / 4)) + F.when(F.col("size") > 1, 10).otherwise(0)
    hot = _ranked(size.withColumn("score", score).where("NOT is_entry AND role <> 'dependency' AND score >= 10"), F.desc("score"), F.desc("file_count"), "name", "id", limit=2).select(*_line(2, F.col("place"), "hotspot ", F.col("name"), ": ", n_("score")))
    stages = o.groupBy("project_id", "stage").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))
    steps = stages.select(*_line(3, F.col("stage"), "stage ", n_("stage"), ": ", n_("n"), " modules from ", F.col("first")))
    return _all(head, top, hot, steps)


def n_(name: str) -> Column:
    return F.col(name).cast("string")


QUERIES = {f.__name__: f for f in (analysis_text, run_json, overview_text, capability_labels, capability_text, layout_text, context_markdown, scene_payload, capability_evidence, project_guide)}

_MERGED = """m AS (SELECT from_id, to_id, kind, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(support_count) AS BIGINT) AS support_count, max(fact_source) AS fact_source FROM edges WHERE from_id <> 0 AND to_id <> 0 AND from_id <> to_id GROUP BY 1, 2, 3),
e AS (SELECT a.project_id, m.*, a.qualified_name AS from_name, b.qualified_name AS to_name, a.display_name AS from_shown, b.display_name AS to_shown FROM m JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id),
x AS (SELECT DISTINCT project_id, coalesce(file_path, '') AS path, coalesce(attempt, 0) AS attempt, error_message FROM parse_results WHERE error_message <> '')"""
_HEAD = lambda part, what, kinds, src: f"SELECT project_id, {part} AS part, unnest(range(0, {len(kinds) + 3})) AS place, unnest(['{what}: ' || count(*), {', '.join(f'''{chr(39)}  {k}: {chr(39)} || count(*) FILTER (kind = {k!r})''' for k in kinds)}, '  inferred: ' || count(*) FILTER (fact_source = 'inferred'), '  semantic: ' || count(*) FILTER (fact_source = 'semantic')]) AS line FROM {src} GROUP BY project_id"
_MORE = lambda part, shown, what, src: f"SELECT project_id, {part}, 0, '... ' || (count(*) - {shown}) || ' more {what}' FROM {src} GROUP BY project_id HAVING count(*) > {shown}"
_TOP = lambda src, order, limit: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {order}) AS place FROM {src}) WHERE place <= {limit})"
_WEIGHT = "CASE WHEN weight > 1 THEN ' (weight=' || weight || ')' ELSE '' END || CASE WHEN support_count > 1 THEN ' (support=' || support_count || ')' ELSE '' END"
_FIRST = lambda e, k: f"CASE WHEN len({e}) = 0 THEN 'none' WHEN len({e}) > {k} THEN array_to_string({e}[1:{k}], ', ') || ', +' || (len({e}) - {k}) || ' more' ELSE array_to_string({e}, ', ') END"
_TYPED = lambda sql: f"SELECT project_id, CAST(part AS INTEGER) AS part, CAST(place AS INTEGER) AS place, line FROM ({sql})"
_LISTCOMPACT = lambda *items: "array_to_string(list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL), '; ')"
#: Capabilities with everything that the reports say of them.
_CLUS = Q._SCORES + """, bv_a AS (SELECT project_id, cluster, kind, name, mode, priority, count(*) OVER (PARTITION BY project_id) AS n, row_number() OVER (PARTITION BY project_id, kind ORDER BY priority DESC, name, cluster) AS pl FROM scores),
bv_b AS (SELECT *, n <= 18 OR (mode = 'module_scoped' AND n <= 24) OR kind = 'entry' OR (kind = 'capability' AND pl <= 10) AS shown FROM bv_a),
ce AS (SELECT x.project_id, x.cluster AS fc, y.cluster AS tc, CASE WHEN x.kind = 'entry' THEN 'activates' WHEN y.kind = 'infrastructure' THEN 'uses_infrastructure' ELSE 'enables' END AS kind, CAST(sum(w) AS BIGINT) AS weight, count(*) AS supporting FROM dep JOIN caps x ON x.id = dep.f JOIN caps y ON y.id = dep.t WHERE x.cluster <> y.cluster GROUP BY 1, 2, 3, 4),
ends AS (SELECT project_id, fc AS cluster, tc AS other, weight FROM ce UNION ALL SELECT project_id, tc, fc, weight FROM ce),
bv_n AS (SELECT ends.project_id, ends.cluster, sum(weight) AS near FROM ends JOIN bv_b b ON b.project_id = ends.project_id AND b.cluster = ends.other AND b.shown GROUP BY 1, 2),
bv_r AS (SELECT bv_b.*, coalesce(near, 0) AS near, row_number() OVER (PARTITION BY bv_b.project_id, bv_b.kind ORDER BY coalesce(near, 0) + priority DESC, name, bv_b.cluster) AS rk FROM bv_b LEFT JOIN bv_n USING (project_id, cluster)),
bv AS (SELECT project_id, cluster, shown OR (kind = 'infrastructure' AND rk <= 6 AND (near > 0 OR rk = 1)) AS visible FROM bv_r),
ofc AS (SELECT project_id, cluster, min(bucket) AS bucket, list_sort(list(DISTINCT name))[1:8] AS modules FROM caps GROUP BY 1, 2),
nb AS (SELECT ends.project_id, ends.cluster, list_sort(list(DISTINCT s.name))[1:8] AS near FROM ends JOIN scores s ON s.project_id = ends.project_id AND s.cluster = ends.other GROUP BY 1, 2),
c0_ AS (SELECT scores.* EXCLUDE (s, s1), bv.visible, ofc.bucket, ofc.modules, coalesce(nb.near, []) AS near, CASE WHEN confidence >= 75 THEN 'high' WHEN confidence >= 45 THEN 'medium' ELSE 'low' END AS confidence_label FROM scores JOIN bv USING (project_id, cluster) JOIN ofc USING (project_id, cluster) LEFT JOIN nb USING (project_id, cluster))"""
_EV = "lower(concat_ws(' ', name, array_to_string(symbols, ' '), array_to_string(modules, ' '), array_to_string(files6, ' ')))"
_HAS = lambda e, words: "(" + " OR ".join(f"contains({e}, '{w}')" for w in words) + ")"
_LABELLED = _CLUS + f""", lb AS (SELECT *, CASE WHEN len(files6) > 0 AND len(list_filter(files6, lambda f: NOT {_HAS('lower(f)', WEB_ASSETS)})) = 0 THEN 'web_assets' {' '.join(f"WHEN {_HAS(_EV, w)} THEN '{n}'" for n, w, _ in LABEL_WORDS)} END AS label FROM c0_),
lc AS (SELECT * REPLACE (CASE WHEN label = 'utilities' THEN 0 ELSE priority + CASE label {' '.join(f"WHEN '{n}' THEN {a}" for n, _, a in LABEL_WORDS)} ELSE 0 END END AS priority, visible AND coalesce(label <> 'utilities', true) AS visible) FROM lb)"""
_HUMAN = Q._HUMAN

SQL = {
    "analysis_text": f"WITH {NODES}, {_MERGED}, dd AS (SELECT * FROM e WHERE kind = 'depends_on') " + _TYPED(" UNION ALL ".join([
        _HEAD(0, "nodes", NODE_KINDS, "n"), _HEAD(1, "edges", EDGE_KINDS, "e"),
        f"SELECT project_id, 2, place, '- [' || coalesce(fact_source, '') || '] [' || coalesce(kind, '') || '] ' || coalesce(qualified_name, '') || ' @ ' || coalesce(file_path, '') || ':' || coalesce(line, 0) FROM {_TOP('n', 'id', SHOWN_NODES)}", _MORE(3, SHOWN_NODES, "nodes", "n"),
        f"SELECT project_id, 4, place, '- [' || coalesce(fact_source, '') || '] ' || kind || ': ' || coalesce(from_name, '') || ' -> ' || coalesce(to_name, '') || {_WEIGHT} FROM {_TOP('e', 'from_id, to_id, kind', SHOWN_EDGES)}", _MORE(5, SHOWN_EDGES, "edges", "e"),
        f"SELECT project_id, 6, place, '- ' || coalesce(from_shown, '') || ' -> ' || coalesce(to_shown, '') || {_WEIGHT} FROM {_TOP('dd', 'from_id, to_id', SHOWN_DEPENDENCIES)}", "SELECT DISTINCT project_id, 6, 0, '- none' FROM n WHERE project_id NOT IN (SELECT project_id FROM dd)",
        f"SELECT project_id, 7, place, '- ' || path || ': ' || error_message FROM {_TOP('x', 'path, attempt, error_message', SHOWN_DIAGNOSTICS)}", _MORE(8, SHOWN_DIAGNOSTICS, "diagnostics", "x")])),
    "run_json": f"""WITH {NODES}, {_MERGED}, nc AS (SELECT project_id, count(*) FILTER (kind = 'file') AS fc, count(*) AS c, count(*) FILTER (fact_source = 'semantic') AS s FROM n GROUP BY 1), ec AS (SELECT project_id, count(*) AS c, count(*) FILTER (fact_source = 'semantic') AS s FROM e GROUP BY 1)
        SELECT nc.project_id, 'summary' AS section, CAST(to_json({{'fileCount': fc, 'nodeCount': nc.c, 'semanticNodeCount': nc.s, 'edgeCount': coalesce(ec.c, 0), 'semanticEdgeCount': coalesce(ec.s, 0)}}) AS VARCHAR) AS json FROM nc LEFT JOIN ec USING (project_id)
        UNION ALL SELECT project_id, 'nodes', CAST(to_json({{'id': id, 'kind': coalesce(kind, ''), 'displayName': coalesce(display_name, ''), 'qualifiedName': coalesce(qualified_name, ''), 'identityKey': coalesce(identity_key, ''), 'filePath': coalesce(file_path, ''), 'line': coalesce(line, 0), 'factSource': coalesce(fact_source, '')}}) AS VARCHAR) FROM n
        UNION ALL SELECT project_id, 'edges', CAST(to_json({{'fromId': from_id, 'toId': to_id, 'kind': kind, 'weight': coalesce(weight, 0), 'supportCount': coalesce(support_count, 0), 'factSource': coalesce(fact_source, '')}}) AS VARCHAR) FROM e
        UNION ALL SELECT project_id, 'diagnostics', CAST(to_json({{'filePath': path, 'attempt': attempt, 'message': error_message}}) AS VARCHAR) FROM x""",
    "overview_text": Q._FULL + ", dn AS (SELECT a.project_id, a.name AS from_name, b.name AS to_name, f, t, w FROM dep JOIN ov a ON a.id = f JOIN ov b ON b.id = t) " + _TYPED(" UNION ALL ".join([
        "SELECT project_id, 0 AS part, unnest(range(0, 5)) AS place, unnest(['modules: ' || count(*), 'entry modules: ' || count(*) FILTER (is_entry), 'reachable modules: ' || count(*) FILTER (reachable), 'last stage: ' || max(stage), 'files: ' || CAST(sum(file_count) AS BIGINT)]) AS line FROM ov GROUP BY project_id",
        f"SELECT project_id, 1, place, '- [' || stage || '] ' || name || ' (' || role || CASE WHEN is_entry THEN ', entry' ELSE '' END || ') files=' || file_count || ' in=' || in_degree || ' out=' || out_degree || ' symbols=' || {_FIRST('top_symbols', 3)} FROM {_TOP('ov', 'is_entry DESC, stage, name, id', SHOWN_NODES)}", _MORE(2, SHOWN_NODES, "modules", "ov"),
        f"SELECT project_id, 3, place, '- ' || from_name || ' -> ' || to_name || ' (weight=' || w || ')' FROM {_TOP('dn', 'w DESC, f, t', SHOWN_EDGES)}", _MORE(4, SHOWN_EDGES, "dependencies", "dn")])),
    "capability_labels": _LABELLED + " SELECT project_id, cluster, label, CAST(priority AS INTEGER) AS priority, visible FROM lc",
    "capability_text": _CLUS + ", cn AS (SELECT ce.*, a.name AS an, b.name AS bn FROM ce JOIN c0_ a ON a.project_id = ce.project_id AND a.cluster = fc JOIN c0_ b ON b.project_id = ce.project_id AND b.cluster = tc) " + _TYPED(" UNION ALL ".join([
        "SELECT project_id, 0 AS part, unnest(range(0, 3)) AS place, unnest(['capabilities: ' || count(*), 'visible: ' || count(*) FILTER (visible), 'aggregation: ' || min(mode)]) AS line FROM c0_ GROUP BY project_id",
        f"SELECT project_id, 1, place, '- [' || kind || '] ' || name || ' (' || dominant_role || ') modules=' || module_count || ' files=' || file_count || ' stages=' || stage_start || CASE WHEN stage_end <> stage_start THEN '-' || stage_end ELSE '' END || ' confidence=' || confidence_label || ' with=' || {_FIRST('near', 3)} FROM {_TOP('c0_', 'priority DESC, name, cluster', SHOWN_NODES)}",
        f"SELECT project_id, 2, place, '- ' || an || ' -> ' || bn || ' (' || kind || ', weight=' || weight || ')' FROM {_TOP('cn', 'weight DESC, fc, tc', SHOWN_EDGES)}"])),
    "layout_text": Q._POS + ", pl AS (SELECT xy.*, m.project_id, m.display_name FROM xy JOIN (SELECT DISTINCT id, project_id, display_name FROM nodes WHERE kind = 'module') m ON m.id = xy.id) " + _TYPED(" UNION ALL ".join([
        "SELECT project_id, 0 AS part, unnest(range(0, 2)) AS place, unnest(['placed modules: ' || count(*), 'layers: ' || count(DISTINCT layer)]) AS line FROM pl GROUP BY project_id",
        f"SELECT project_id, 1, place, '- layer ' || layer || ': ' || coalesce(display_name, '') || ' at (' || CAST(x AS INTEGER) || ', ' || CAST(y AS INTEGER) || ')' FROM {_TOP('pl', 'layer, ord, id', SHOWN_PLACES)}", _MORE(2, SHOWN_PLACES, "modules", "pl")])),
    "context_markdown": _CLUS + f", pk AS (SELECT *, CASE kind WHEN 'entry' THEN 1 WHEN 'capability' THEN 2 ELSE 3 END AS part, row_number() OVER (PARTITION BY project_id, kind ORDER BY priority DESC, name, cluster) AS place FROM c0_) " + _TYPED(
        f"SELECT DISTINCT project_id, 0 AS part, 0 AS place, '# System context of ' || coalesce(project_id, '') AS line FROM pk UNION ALL SELECT project_id, part, 0, '## ' || {_HUMAN('kind')} || ' (' || count(*) || ')' FROM pk GROUP BY project_id, part, kind UNION ALL SELECT project_id, part, place, '- **' || name || '** (' || dominant_role || '): ' || module_count || ' modules, ' || file_count || ' files; works with ' || {_FIRST('near', 4)} FROM pk"),
    "scene_payload": _CLUS + """ SELECT project_id, 'nodes' AS section, CAST(to_json({'id': cluster, 'name': name, 'kind': kind, 'role': dominant_role, 'column': stage_start, 'row': row_number() OVER (PARTITION BY project_id, stage_start ORDER BY priority DESC, name, cluster) - 1, 'priority': priority, 'confidence': confidence_label, 'visible': visible, 'symbols': symbols, 'files': files6}) AS VARCHAR) AS json FROM c0_
        UNION ALL SELECT ce.project_id, 'edges', CAST(to_json({'from': fc, 'to': tc, 'kind': ce.kind, 'weight': weight, 'confidence': least(22 + least(weight * 12, 36) + least(supporting * 10, 20), 100)}) AS VARCHAR) FROM ce JOIN bv a ON a.project_id = ce.project_id AND a.cluster = fc AND a.visible JOIN bv b ON b.project_id = ce.project_id AND b.cluster = tc AND b.visible
        UNION ALL SELECT project_id, 'groups', CAST(to_json({'lane': kind, 'members': count(*), 'hidden': count(*) FILTER (NOT visible), 'firstColumn': min(stage_start), 'lastColumn': max(stage_end)}) AS VARCHAR) FROM c0_ GROUP BY project_id, kind""",
    "capability_evidence": _LABELLED + " SELECT project_id, cluster, " + _LISTCOMPACT("'kind ' || kind || ', main role ' || dominant_role", "module_count || ' modules, ' || file_count || ' files'", "'stages ' || stage_start || ' to ' || stage_end", "CASE WHEN reachable THEN 'reached from an entry' END", "CASE WHEN collaborators > 0 THEN 'works with ' || collaborators || ' others' END") + " AS facts, "
        + _LISTCOMPACT("'aggregation ' || mode", "'bucket ' || bucket", "CASE kind WHEN 'entry' THEN 'entry modules stand alone' WHEN 'infrastructure' THEN 'support role or last stage' ELSE 'no entry and no support role' END", "CASE WHEN visible THEN 'shown at first' ELSE 'folded at first' END", "'label ' || label") + " AS rules, "
        + _LISTCOMPACT("CASE WHEN in_degree > out_degree THEN 'is used more than it uses' WHEN in_degree < out_degree THEN 'uses more than it is used' ELSE 'uses as much as it is used' END", "CASE WHEN NOT reachable THEN 'no entry leads to it' END", "CASE WHEN len(symbols) = 0 THEN 'has no leading symbols' END") + """ AS conclusions,
        coalesce(array_to_string(files6, ','), '') AS files, coalesce(array_to_string(symbols, ','), '') AS symbols, coalesce(array_to_string(modules, ','), '') AS modules, coalesce(array_to_string(near, ','), '') AS relationships, CAST(confidence AS INTEGER) AS confidence, confidence_label, CASE confidence_label WHEN 'high' THEN 'focused files and symbols' WHEN 'medium' THEN 'some files or symbols, partly aggregated' ELSE 'broad aggregation or few symbols' END AS reason FROM lc""",
    "project_guide": Q._FULL + ", sz AS (SELECT *, CAST(least(12, in_degree + out_degree) + least(8, file_count // 4) + CASE WHEN count(*) OVER (PARTITION BY component) > 1 THEN 10 ELSE 0 END AS BIGINT) AS score FROM ov), ht AS (SELECT * FROM sz WHERE NOT is_entry AND role <> 'dependency' AND score >= 10), st AS (SELECT project_id, first(name ORDER BY NOT is_entry, -in_degree - out_degree, name, id) AS start, count(*) AS n, CAST(sum(file_count) AS BIGINT) AS files FROM ov GROUP BY 1) " + _TYPED(" UNION ALL ".join([
        "SELECT project_id, 0 AS part, unnest([0, 1]) AS place, unnest([n || ' modules with ' || files || ' files', 'start at ' || start]) AS line FROM st",
        f"SELECT project_id, 1, place, 'leading module ' || name || ' (' || role || '): ' || {_FIRST('top_symbols', 2)} FROM {_TOP('ov', 'in_degree + out_degree DESC, file_count DESC, name, id', 3)}",
        f"SELECT project_id, 2, place, 'hotspot ' || name || ': ' || score FROM {_TOP('ht', 'score DESC, file_count DESC, name, id', 2)}",
        "SELECT project_id, 3, stage, 'stage ' || stage || ': ' || count(*) || ' modules from ' || min(name) FROM ov GROUP BY project_id, stage"])),
}
