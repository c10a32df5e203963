"""Queries that choose what a first view of a project shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import text as T
from cartolith.operators import graph as G
from cartolith.operators import overview as O
from cartolith.plans import graph_queries as Q
from cartolith.plans.sqlparts import MODULE_EDGES, NODES
from cartolith.runtime import Staged
from cartolith.sources.tables import graph_edges, graph_nodes


def budgeted_visibility(spark, d, overview: DataFrame | None = None):
    """Capabilities shown at first: all of a small project; else entries, the ten of highest priority, and six of
    infrastructure by priority and the weight of their edges with shown ones (the first of them in any case)."""
    o = overview if overview is not None else Q.overview_table(spark, d)
    s = Q.capability_scores(spark, d, o).select("project_id", "cluster", "priority")
    c = O.clusters(O.capabilities(o)).select("project_id", "cluster", "kind", "name", "mode").join(s, ["project_id", "cluster"])
    c = Staged(c.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("project_id"))), "shown").df
    every = (F.col("n") <= 18) | ((F.col("mode") == "module_scoped") & (F.col("n") <= 24))
    place = F.row_number().over(Window.partitionBy("project_id", "kind").orderBy(F.desc("priority"), "name", "cluster"))
    seen = c.withColumn("shown", every | (F.col("kind") == "entry") | ((F.col("kind") == "capability") & (place <= 10)))
    e = Q.capability_edges(spark, d, o).groupBy("project_id", "from_cluster", "to_cluster").agg(F.sum("weight").alias("w"))
    both = e.select("project_id", F.col("from_cluster").alias("cluster"), F.col("to_cluster").alias("other"), "w").unionByName(e.select("project_id", F.col("to_cluster").alias("cluster"), F.col("from_cluster").alias("other"), "w"))
    near = both.join(seen.where("shown").select("project_id", F.col("cluster").alias("other")), ["project_id", "other"]).groupBy("project_id", "cluster").agg(F.sum("w").alias("near"))
    j = seen.join(near, ["project_id", "cluster"], "left").fillna(0, ["near"])
    rank = F.row_number().over(Window.partitionBy("project_id", "kind").orderBy(F.desc(F.col("near") + F.col("priority")), "name", "cluster"))
    infra = (F.col("kind") == "infrastructure") & (rank <= 6) & ((F.col("near") > 0) | (rank == 1))
    return j.select("project_id", "cluster", "kind", (F.col("shown") | infra).alias("visible"))


def noise_folding(spark, d):
    """Modules of examples, tests or generated code, folded if two others of their project remain."""
    p = graph_nodes(spark, d).where("kind = 'file' AND module_id IS NOT NULL").select("module_id", O.noise_class(F.col("qualified_name")).alias("c"))
    noise = p.groupBy(F.col("module_id").alias("id")).agg(F.when(F.count_if(F.col("c").isNull()) == 0, F.when(F.min("c") == F.max("c"), F.min("c"))).alias("noise"))
    m = O.modules(graph_nodes(spark, d)).join(noise, "id", "left").withColumn("noise", F.when(~F.col("is_entry") & (F.col("role") != "dependency"), F.col("noise")))
    focus = F.count_if(F.col("noise").isNull()).over(Window.partitionBy("project_id"))
    return m.select("id", "noise", (F.col("noise").isNotNull() & (focus >= 2)).alias("folded"))


def dependency_folding(spark, d):
    m = O.modules(graph_nodes(spark, d)).where("role = 'dependency'")
    return m.select("id", "file_count", (F.col("file_count") > 20).alias("folded"))


def card_remarks(spark, d):
    o = Q.overview_table(spark, d).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("component")))
    return o.select("id", F.concat_ws("; ", F.when(F.col("size") > 1, F.lit("part of a cycle")), F.when(F.col("in_degree") + F.col("out_degree") >= 8, F.lit("many links")), F.when(F.col("role").isin("storage", "core_model"), F.lit("shared infrastructure"))).alias("remarks"))


def project_totals(spark, d):
    m = O.modules(graph_nodes(spark, d))
    return m.groupBy("project_id").agg(F.count(F.lit(1)).alias("modules"), F.sum("file_count").alias("files"), F.sum("cpp_files").alias("cpp"), F.sum("script_files").alias("script"), F.sum("data_files").alias("data"), F.count_if("is_entry").alias("entries"))


def leading_modules(spark, d):
    """The three modules of a project with the most links and files."""
    o = Q.overview_table(spark, d)
    r = o.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), F.desc("file_count"), "name", "id"))).where("place <= 3")
    return r.select("project_id", "place", "id", "role", T.first_k(F.col("top_symbols"), 2).alias("symbols"))


def reading_order(spark, d):
    """Where to begin: the entry or most used module, what it leans on most, and what is left in the last stage."""
    o = Q.overview_table(spark, d)
    first = F.min_by("id", F.struct((~F.col("is_entry")).alias("e"), (-F.col("in_degree") - F.col("out_degree")).alias("g"), "name", "id"))
    last = F.max_by("id", F.struct("stage", (-F.col("id")).alias("i")))
    return o.groupBy("project_id").agg(first.alias("start_id"), F.max_by("id", F.struct("in_degree", (-F.col("id")).alias("i"))).alias("hub_id"), last.alias("end_id"))


def view_edges(spark, d):
    """The 220 heaviest edges of a project's view."""
    _, e = Q.module_graph(spark, d)
    m = graph_nodes(spark, d).where("kind = 'module'").select(F.col("id").alias("f"), "project_id")
    r = e.join(m, "f").withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("w"), "f", "t")))
    return r.where("place <= 220").select("project_id", "place", "f", "t", "w")


def evidence_totals(spark, d):
    """Distinct files, symbols and modules that the edges of a project rest on."""
    n = graph_nodes(spark, d).select("id", "file_path", "module_id", "kind")
    ends = graph_edges(spark, d).select("project_id", F.explode(F.array("from_id", "to_id")).alias("id")).where("id IS NOT NULL AND id <> 0").distinct()
    return ends.join(n, "id").groupBy("project_id").agg(F.count_distinct("file_path").alias("files"), F.count_distinct(F.when(~F.col("kind").isin("file", "module"), F.col("id"))).alias("symbols"), F.count_distinct("module_id").alias("modules"))


def main_flows(spark, d):
    """The heaviest path of module components of each project."""
    top = Q.module_flows(spark, d).groupBy("project_id").agg(F.max_by(F.struct("score", "path"), F.struct("score", (-F.col("id")).alias("i"))).alias("b"))
    return top.select("project_id", F.col("b.score").alias("score"), F.array_join("b.path", ">").alias("path"))


def project_comparison(spark, d):
    """Each project's figures beside those of the largest project, one row a figure."""
    t = project_totals(spark, d)
    rows = t.select("project_id", F.inline(F.array(*[F.struct(F.lit(c).alias("title"), F.col(c).alias("value")) for c in ("modules", "files", "cpp", "script", "data", "entries")])))
    rows = Staged(rows, "figures").df
    largest = rows.where("title = 'files'").agg(F.max_by("project_id", F.struct("value", "project_id")).alias("p"))
    other = rows.where(F.col("project_id") == largest.scalar()).select("title", F.col("value").alias("largest"))
    return rows.join(F.broadcast(other), "title")  # a row for each of six titles


QUERIES = {f.__name__: f for f in (budgeted_visibility, noise_folding, dependency_folding, card_remarks, project_totals, leading_modules, reading_order, view_edges, evidence_totals, main_flows, project_comparison)}

_TOTALS = "tot AS MATERIALIZED (SELECT project_id, count(*) AS modules, CAST(sum(file_count) AS BIGINT) AS files, CAST(sum(cpp_files) AS BIGINT) AS cpp, CAST(sum(script_files) AS BIGINT) AS script, CAST(sum(data_files) AS BIGINT) AS data, count(*) FILTER (is_entry) AS entries FROM mods GROUP BY 1)"
_FIG = "fig AS MATERIALIZED (SELECT project_id, unnest(['modules', 'files', 'cpp', 'script', 'data', 'entries']) AS title, unnest([modules, files, cpp, script, data, entries]) AS value FROM tot)"
_KV = Q._NOISE
SQL = {
    "budgeted_visibility": Q._SCORES + """, a AS (SELECT project_id, cluster, kind, name, mode, priority, count(*) OVER (PARTITION BY project_id) AS n, row_number() OVER (PARTITION BY project_id, kind ORDER BY priority DESC, name, cluster) AS pl FROM scores),
        b AS (SELECT *, n <= 18 OR (mode = 'module_scoped' AND n <= 24) OR kind = 'entry' OR (kind = 'capability' AND pl <= 10) AS shown FROM a),
        ce AS (SELECT x.project_id, x.cluster AS fc, y.cluster AS tc, sum(w) AS w FROM dep JOIN caps x ON x.id = dep.f JOIN caps y ON y.id = dep.t WHERE x.cluster <> y.cluster GROUP BY 1, 2, 3),
        nr AS (SELECT ce2.project_id, ce2.cluster, sum(ce2.w) AS near FROM (SELECT project_id, fc AS cluster, tc AS other, w FROM ce UNION ALL SELECT project_id, tc, fc, w FROM ce) ce2 JOIN b ON b.project_id = ce2.project_id AND b.cluster = ce2.other AND b.shown GROUP BY 1, 2),
        r AS (SELECT b.*, coalesce(near, 0) AS near, row_number() OVER (PARTITION BY b.project_id, b.kind ORDER BY coalesce(near, 0) + priority DESC, name, b.cluster) AS rk FROM b LEFT JOIN nr ON nr.project_id = b.project_id AND nr.cluster = b.cluster)
        SELECT project_id, cluster, kind, shown OR (kind = 'infrastructure' AND rk <= 6 AND (near > 0 OR rk = 1)) AS visible FROM r""",
    "noise_folding": f"WITH {Q._OV}, p AS (SELECT module_id, {_KV} AS c FROM (SELECT module_id, list_filter(string_split(lower(replace(qualified_name, '\\', '/')), '/'), lambda x: x <> '') AS sg FROM n WHERE kind = 'file' AND module_id IS NOT NULL)), z AS (SELECT module_id, CASE WHEN count(*) = count(c) AND min(c) = max(c) THEN min(c) END AS noise FROM p GROUP BY 1), y AS (SELECT mods.id, project_id, CASE WHEN NOT is_entry AND role <> 'dependency' THEN noise END AS noise FROM mods LEFT JOIN z ON z.module_id = mods.id) SELECT id, noise, noise IS NOT NULL AND count(*) FILTER (noise IS NULL) OVER (PARTITION BY project_id) >= 2 AS folded FROM y",
    "dependency_folding": f"WITH {Q._OV} SELECT id, file_count, file_count > 20 AS folded FROM mods WHERE role = 'dependency'",
    "card_remarks": Q._FULL + " SELECT id, concat_ws('; ', CASE WHEN count(*) OVER (PARTITION BY component) > 1 THEN 'part of a cycle' END, CASE WHEN in_degree + out_degree >= 8 THEN 'many links' END, CASE WHEN role IN ('storage', 'core_model') THEN 'shared infrastructure' END) AS remarks FROM ov",
    "project_totals": f"WITH {Q._OV}, {_TOTALS} SELECT * FROM tot",
    "leading_modules": Q._FULL + ", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY in_degree + out_degree DESC, file_count DESC, name, id) AS INTEGER) AS place FROM ov) SELECT project_id, place, id, role, CASE WHEN len(top_symbols) = 0 THEN 'none' WHEN len(top_symbols) > 2 THEN array_to_string(top_symbols[1:2], ', ') || ', +' || (len(top_symbols) - 2) || ' more' ELSE array_to_string(top_symbols, ', ') END AS symbols FROM r WHERE place <= 3",
    "reading_order": Q._FULL + ", s AS (SELECT project_id, id AS start_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY NOT is_entry, in_degree + out_degree DESC, name, id) AS r FROM ov) WHERE r = 1), h AS (SELECT project_id, id AS hub_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY in_degree DESC, id) AS r FROM ov) WHERE r = 1), l AS (SELECT project_id, id AS end_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY stage DESC, id) AS r FROM ov) WHERE r = 1) SELECT * FROM s JOIN h USING (project_id) JOIN l USING (project_id)",
    "view_edges": f"WITH {MODULE_EDGES}, m AS (SELECT DISTINCT id, project_id FROM nodes WHERE kind = 'module'), r AS (SELECT m.project_id, CAST(row_number() OVER (PARTITION BY m.project_id ORDER BY w DESC, f, t) AS INTEGER) AS place, f, t, w FROM dep JOIN m ON m.id = dep.f) SELECT * FROM r WHERE place <= 220",
    "evidence_totals": f"WITH {NODES}, x AS (SELECT DISTINCT project_id, from_id AS id FROM edges WHERE from_id <> 0 UNION SELECT DISTINCT project_id, to_id FROM edges WHERE to_id <> 0) SELECT x.project_id, count(DISTINCT file_path) AS files, count(DISTINCT CASE WHEN kind NOT IN ('file', 'module') THEN n.id END) AS symbols, count(DISTINCT module_id) AS modules FROM x JOIN n ON n.id = x.id GROUP BY 1",
    "main_flows": Q._FLOWS + " SELECT project_id, CAST(s AS BIGINT) AS score, sig AS path FROM flow QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY s DESC, id) = 1",
    "project_comparison": f"WITH {Q._OV}, {_TOTALS}, {_FIG} SELECT a.title, a.project_id, a.value, b.value AS largest FROM fig a JOIN fig b ON b.title = a.title AND b.project_id = (SELECT project_id FROM tot ORDER BY files DESC, project_id DESC LIMIT 1)",
}
