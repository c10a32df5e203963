"""Queries over single files and folders, proposals of rules, layer keys and layouts around a focus."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import paths as P
from cartolith.functions import text as T
from cartolith.operators import extract, insight
from cartolith.operators import graph as G
from cartolith.plans import graph_queries as Q
from cartolith.plans import misc_queries as M
from cartolith.plans import source_queries as S
from cartolith.plans.sqlparts import LINES, MODULE_EDGES, NODES, PATHS, base, ext, in_list
from cartolith.runtime import Staged, table
from cartolith.sources.tables import file_lines, file_paths, graph_nodes, newest_files

#: Distance between rings, and the version of the layers' keys.
RING, LAYER_VERSION = 220.0, "1"


def file_labels(spark, d):
    p = F.col("path")
    return file_paths(spark, d).select("project_id", "path", insight.language_label(p).alias("language"), insight.category(p).alias("category"))


def retrieved_files(spark, d):
    return insight.retrieved(file_paths(spark, d))


def _scored(spark, d) -> tuple[DataFrame, DataFrame]:
    lines = file_lines(newest_files(spark, d))
    return lines, extract.line_scores(lines)


def preview_lines(spark, d):
    """The three lines of each file that are worth most."""
    lines, scored = _scored(spark, d)
    both = lines.join(scored.select("project_id", "path", "line_no", "block"), ["project_id", "path", "line_no"])
    r = insight.preview_scores(both).withColumn("place", F.row_number().over(Window.partitionBy("project_id", "path").orderBy(F.desc("worth"), "line_no")))
    return r.where("place <= 3").select("project_id", "path", "place", "line_no", "worth")


def single_file_modules(spark, d):
    """Modules that are one file: they have one, and bear its name or the name without its extension."""
    n = graph_nodes(spark, d)
    f = n.where("kind = 'file' AND module_id IS NOT NULL").groupBy(F.col("module_id").alias("id")).agg(F.count(F.lit(1)).alias("files"), F.min("qualified_name").alias("path"))
    m = n.where("kind = 'module'").select("id", "project_id", F.lower(F.coalesce("display_name", F.lit(""))).alias("name")).join(f, "id", "left")
    file = P.file_name(F.col("path"))
    last = F.substring_index("name", "/", -1)
    single = F.coalesce((F.col("files") == 1) & ((last == file) | (last == P.stem(file))), F.lit(False))
    return m.select("id", "project_id", single.alias("single"))


def merge_pairs(spark, d):
    return insight.merge_pairs(file_paths(spark, d))


def _choices(spark, d) -> DataFrame:
    main = file_paths(spark, d).where(P.file_name(F.col("path")).rlike(r"^(main|app|index|server)\.[a-z+]+$")).select("project_id", "path")
    entries = M.entry_prefixes(spark, d).join(main, ["project_id", "path"], "left_semi").select("project_id", "prefix")
    scopes = M.scope_statistics(spark, d)
    roles = scopes.where(F.lower("scope").rlike(r"(^|/)(ui|views?|widgets?|pages?|screens?)$")).select("project_id", "scope", F.lit("presentation").alias("role")).unionByName(scopes.where("scripts > cpp AND instr(scope, '/') = 0").select("project_id", "scope", F.lit("web").alias("role")))
    return insight.choices(M.root_directories(spark, d), entries, roles)


def config_choices(spark, d):
    return _choices(spark, d)


def config_draft(spark, d):
    """The rules of a project after its entry choices were declined: base rules, merges and the effects of what is chosen,
    a JSON object for each."""
    base = M.config_recommendation(spark, d).unionByName(insight.merge_pairs(file_paths(spark, d)).select("project_id", F.lit("merge").alias("rule"), "match", F.col("target").alias("value")))
    offered = _choices(spark, d)
    declined = offered.where("rule = 'entry'").select("project_id", "choice", F.lit("keep").alias("option"))
    rules = insight.draft_rules(base, insight.select_options(offered, declined))
    return rules.select("project_id", "rule", F.to_json(F.struct("match", "value")).alias("json"))


def syntax_tree_sizes(spark, d):
    return insight.tree_sizes(insight.syntax_tree(newest_files(spark, d)))


def syntax_tree_dump(spark, d):
    return insight.tree_dump(Staged(insight.syntax_tree(newest_files(spark, d)), "tree").df)


def syntax_previews(spark, d):
    return insight.tree_previews(insight.syntax_tree(newest_files(spark, d)), _scored(spark, d)[1])


def layer_keys(spark, d):
    """The keys of a project's four cached layers: each is a hash over the one above and what it adds."""
    files = newest_files(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.date_format(F.max("modification_time"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("newest"))
    parsed = table(spark, d, "parse_results").groupBy("project_id").agg(F.count_distinct("file_path", "attempt").alias("attempts"))
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = lambda *parts: F.sha2(F.concat_ws("|", *parts), 256)
    k = files.join(parsed, "project_id", "left").withColumn("scan_key", key(F.lit(LAYER_VERSION), s("project_id"), s("n"), s("bytes"), s("newest")))
    k = k.withColumn("parse_key", key("scan_key", s("attempts"))).withColumn("aggregate_key", key("parse_key", F.lit("aggregate"))).withColumn("layout_key", key("aggregate_key", F.lit("layout")))
    return k.select("project_id", "scan_key", "parse_key", "aggregate_key", "layout_key")


def cached_replies(spark, d):
    """Requests with the reply key of their project's service, and whether an earlier request has the same key."""
    c = table(spark, d, "ai_config").where("enabled").groupBy("project_id").agg(F.max_by(F.concat(F.coalesce("base_url", F.lit("")), F.coalesce("endpoint_path", F.lit(""))), F.struct("loaded_at", "config_id")).alias("url"))
    r = table(spark, d, "ai_requests").select("request_id", "project_id", F.col("code_excerpt").alias("payload")).distinct().join(c, "project_id", "left")
    keyed = Staged(insight.reply_lookup(r, spark.createDataFrame([], "key string, reply string")).drop("reply"), "keyed").df
    first = keyed.groupBy("key").agg(F.min("request_id").alias("reply"))
    return insight.reply_lookup(keyed.drop("key"), first).select("request_id", "key", (F.col("reply") < F.col("request_id")).alias("cached"))


def _focus(spark, d) -> tuple[DataFrame, DataFrame]:
    """(the module of each project with the most links, the module edges)"""
    n, e = Q.module_graph(spark, d)
    own = graph_nodes(spark, d).where("kind = 'module'").select("id", "project_id")
    g = own.join(G.degrees(e), "id", "left").fillna(0, ["in_degree", "out_degree"])
    return g.groupBy("project_id").agg(F.min_by("id", F.struct((-F.col("in_degree") - F.col("out_degree")).alias("g"), "id")).alias("id")), e


def component_labels(spark, d):
    """A label for each component (the files of a module that differ in extension alone): what it is around, its first
    type, else function, else its name, and its files."""
    n = graph_nodes(spark, d).where("module_id IS NOT NULL AND file_path <> ''").withColumn("component", F.regexp_replace("file_path", r"\.[^.]*$", ""))
    prio = F.when(F.col("kind").isin("class", "struct", "enum"), 0).when(F.col("kind").isin("function", "method"), 1)
    order = F.struct(prio.alias("p"), F.coalesce("line", F.lit(0)).alias("l"), "display_name")
    # the files of one component are its extensions
    g = n.groupBy("module_id", "component").agg(F.min(F.when(prio.isNotNull() & (F.col("display_name") != ""), order))["display_name"].alias("lead"), F.array_sort(F.collect_set(F.substring_index("file_path", "/", -1))).alias("files"))
    return g.select("module_id", "component", F.concat(F.lit("around "), F.coalesce("lead", F.substring_index("component", "/", -1)), F.lit(": "), T.first_k(F.col("files"), 2)).alias("label"))


def signed_lanes(spark, d):
    """Steps from the project's focus to what it uses (positive) or is used by (negative); the shorter way counts, the
    positive one of equal ways."""
    focus, e = _focus(spark, d)
    ahead, back = G.reach(e, focus.select("id")), G.reach(e.select(F.col("t").alias("f"), F.col("f").alias("t")), focus.select("id"))
    both = ahead.select("id", "hops", F.lit(0).alias("o")).unionByName(back.select("id", "hops", F.lit(1).alias("o")))
    return both.groupBy("id").agg(F.min(F.struct("hops", "o")).alias("b")).select("id", F.when(F.col("b.o") == 1, -F.col("b.hops")).otherwise(F.col("b.hops")).alias("lane"))


def ring_layout(spark, d):
    """Modules on rings around their project's focus, by steps in either direction, spread evenly in order of name; those
    without a way stand on a ring of their own."""
    focus, e = _focus(spark, d)
    hops = G.reach(e.select("f", "t").unionByName(e.select(F.col("t").alias("f"), F.col("f").alias("t"))), focus.select("id"))
    m = graph_nodes(spark, d).where("kind = 'module'").select("id", "project_id", F.coalesce("display_name", F.lit("")).alias("name")).join(hops, "id", "left")
    m = m.withColumn("ring", F.coalesce("hops", F.max("hops").over(Window.partitionBy("project_id")) + 1))
    w = Window.partitionBy("project_id", "ring")
    turn = 2 * math.pi * (F.row_number().over(w.orderBy("name", "id")) - 1) / F.count(F.lit(1)).over(w)
    # a ring is wide enough for its modules to stand apart
    radius = F.when(F.col("ring") == 0, 0.0).otherwise(F.greatest(F.col("ring") * RING, F.count(F.lit(1)).over(w) * 2 * RING / (2 * math.pi)))
    placed = m.select("id", "project_id", "ring", turn.alias("turn"), radius.alias("radius"))
    return placed.select("id", "project_id", "ring", F.round(F.col("radius") * F.cos("turn"), 3).alias("x"), F.round(F.col("radius") * F.sin("turn"), 3).alias("y"))


QUERIES = {f.__name__: f for f in (file_labels, retrieved_files, preview_lines, single_file_modules, merge_pairs, config_choices, config_draft, syntax_tree_sizes, syntax_tree_dump, syntax_previews, layer_keys, cached_replies, component_labels, signed_lanes, ring_layout)}

_E, _B = ext(), base()
_LANGUAGE = f"CASE WHEN {_B} = 'cmakelists.txt' THEN 'CMake' WHEN {_B} = 'qmldir' THEN 'QML Module' " + " ".join(f"WHEN {_E} IN ({in_list(s)}) THEN '{n}'" for n, s in insight.LANGUAGES) + f" WHEN {_E} = '' THEN 'Unknown' ELSE upper({_E}[2:]) END"
_ANY = lambda e, words: "(" + " OR ".join(f"contains({e}, '{w}')" for w in words) + ")"
_CATEGORY = f"CASE WHEN {_ANY('lower(path)', insight.TEST_PARTS)} THEN 'test' WHEN {_B} IN ('cmakelists.txt', 'qmldir') OR {_E} IN ({in_list(insight.PROJECT_SUFFIXES)}) THEN 'project' WHEN {_E} IN ({in_list(insight.CONFIG_SUFFIXES)}) THEN 'data' WHEN {_E} IN ({in_list(insight.STYLE_SUFFIXES)}) THEN 'style' WHEN {_E} = '.md' THEN 'document' WHEN {_ANY('lower(path)', insight.TOOL_PARTS)} THEN 'tool' ELSE 'source' END"
_LOW = "lower(replace(path, '\\', '/'))"
_WORTH = f"CASE WHEN {_B} IN ({in_list(insight.MAIN_FILES)}) THEN 240 WHEN {_B} IN ({in_list(insight.APP_FILES)}) THEN 210 ELSE 0 END + " + " + ".join(f"CASE WHEN {_ANY(_LOW, p)} THEN {w} ELSE 0 END" for p, w in insight.PATH_WORTH) + " + CASE " + " ".join(f"WHEN {_E} IN ({in_list(s)}) THEN {w}" for s, w in insight.SUFFIX_WORTH) + " ELSE 0 END"
_SNIPPET = [*P.CPP, ".py", ".java", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".qml", ".json"]
_DECLARES = r"^(?:export |public |private |protected |static |async |abstract |final )*(?:class|struct|enum|interface|namespace|def|function|type) +[A-Za-z_]|^[A-Za-z_][\w:<>,&* ]* [A-Za-z_~][\w:]*\([^;]*\)[^;]*\{$"
_CHOICES = f"""{M._ROOTS}, pr AS (SELECT *, list_filter(string_split({M._PARENT}, '/'), lambda s: s <> '') AS d FROM paths),
ep AS (SELECT DISTINCT project_id, array_to_string(CASE WHEN len(d) > 1 AND lower(d[len(d)]) IN ('src', 'source', 'sources', 'app', 'apps', 'bin', 'java', 'kotlin') THEN d[1:len(d) - 1] ELSE d END, '/') AS pfx FROM pr WHERE len(d) > 0 AND regexp_matches({_B}, '^(main|app|index|server)\\.[a-z+]+$')),
sc AS (SELECT project_id, scope, count(*) FILTER (e IN ({in_list(P.CPP)})) AS cpp, count(*) FILTER (e IN ('.js', '.mjs', '.cjs', '.ts', '.tsx', '.mts', '.cts')) AS scripts FROM (SELECT project_id, {_E} AS e, unnest(CASE WHEN len(d) > 1 THEN [d[1], d[1] || '/' || d[2]] ELSE [d[1]] END) AS scope FROM pr WHERE len(d) > 0) GROUP BY 1, 2),
pick AS (SELECT project_id, 'generated:' || folder AS choice, folder AS pat, 'ignore' AS option, 'ignore' AS rule, '' AS value FROM roots WHERE kind = 'generated' UNION ALL SELECT project_id, 'optional-ignore', folder, 'ignore', 'ignore', '' FROM roots WHERE kind = 'optional'
  UNION ALL SELECT project_id, 'presentation:' || scope, scope, 'presentation', 'role', 'presentation' FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY scope) AS r FROM sc WHERE regexp_matches(lower(scope), '(^|/)(ui|views?|widgets?|pages?|screens?)$')) WHERE r <= 3
  UNION ALL SELECT project_id, 'web:' || scope, scope, 'web', 'role', 'web' FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY scope) AS r FROM sc WHERE scripts > cpp AND NOT contains(scope, '/')) WHERE r <= 2
  UNION ALL SELECT project_id, 'entry:' || pfx, pfx, 'entry', 'entry', 'true' FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pfx) AS r FROM ep WHERE pfx <> '') WHERE r <= 4),
offered AS (SELECT project_id, choice, option, rule, pat AS match, value, true AS chosen FROM pick UNION ALL SELECT project_id, choice, 'keep', NULL, pat, '', false FROM pick)"""
_PAIRS = """dirs AS (SELECT DISTINCT project_id, unnest(list_transform(range(2, least(len(d), 3) + 1), lambda i: array_to_string(d[1:i], '/'))) AS match FROM pr WHERE len(d) >= 2),
inc AS (SELECT *, regexp_replace(match, '/[^/]*$', '') AS target FROM dirs WHERE regexp_matches(match, '/(include|src)$')), merges AS (SELECT project_id, match, target FROM inc QUALIFY count(*) OVER (PARTITION BY project_id, target) = 2)"""
_FOCUS = """WITH RECURSIVE """ + MODULE_EDGES + """, own AS (SELECT DISTINCT id, project_id, coalesce(display_name, '') AS name FROM nodes WHERE kind = 'module'), dg AS (SELECT id, count(*) AS g FROM (SELECT f AS id FROM dep UNION ALL SELECT t FROM dep) GROUP BY 1),
fo AS (SELECT id FROM (SELECT own.id, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(g, 0) DESC, own.id) AS r FROM own LEFT JOIN dg ON dg.id = own.id) WHERE r = 1)"""

SQL = {
    "file_labels": f"WITH {PATHS} SELECT project_id, path, {_LANGUAGE} AS language, {_CATEGORY} AS category FROM paths",
    "retrieved_files": f"""WITH {PATHS}, k AS (SELECT *, CASE WHEN NOT contains(path, '/') AND starts_with({_B}, 'readme') THEN 'readme' WHEN starts_with(lower(path), 'docs/') AND {_E} IN ('.md', '.rst', '.txt') THEN 'document' WHEN NOT contains(path, '/') AND ({_B} IN ({in_list(P.MANIFESTS)}) OR regexp_matches({_B}, '\\.(pro|pri)$')) THEN 'manifest' WHEN {_E} IN ({in_list(_SNIPPET)}) THEN 'snippet' END AS kind FROM paths),
        s AS (SELECT *, CASE WHEN kind = 'snippet' THEN {_WORTH} ELSE 0 END AS priority FROM k WHERE kind IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY project_id, kind ORDER BY priority DESC, path) AS place FROM s)
        SELECT project_id, kind, CAST(place AS INTEGER) AS place, path, CAST(priority AS INTEGER) AS priority FROM r WHERE place <= CASE WHEN kind IN ('readme', 'document') THEN 1 ELSE 2 END""",
    "preview_lines": f"""WITH {LINES}, s AS (SELECT *, CAST(sum({S._SCORE}) OVER (PARTITION BY project_id, path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 16 FOLLOWING) AS BIGINT) AS block, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM lines),
        v AS (SELECT *, lower(t) AS l, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')) AS st FROM s WHERE t <> '' AND NOT regexp_matches(t, '^(?:[{{}}()\\[\\];,]+|//.*|/\\*.*|\\*.*)$') AND NOT (t[1:1] = '#' AND NOT starts_with(t, '#include') AND NOT starts_with(t, '#define'))),
        w AS (SELECT project_id, path, line_no, block + CASE WHEN regexp_matches(t, '{_DECLARES}') THEN 69 ELSE 0 END + CASE WHEN len(st) >= 3 AND contains(l, st) THEN 55 ELSE 0 END + CASE WHEN starts_with(l, 'return ') OR contains(l, ' return ') THEN 10 ELSE 0 END + CASE WHEN contains(t, '{{') THEN 5 ELSE 0 END + CASE WHEN contains(t, '::') THEN 12 ELSE 0 END + CASE WHEN starts_with(l, 'export ') THEN 42 ELSE 0 END - CASE WHEN line_no <= 12 THEN 6 ELSE 0 END AS worth FROM v),
        r AS (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY worth DESC, line_no) AS place FROM w) SELECT project_id, path, CAST(place AS INTEGER) AS place, CAST(line_no AS INTEGER) AS line_no, CAST(worth AS BIGINT) AS worth FROM r WHERE place <= 3""",
    "single_file_modules": f"""WITH {NODES}, f AS (SELECT module_id, count(*) AS files, min(qualified_name) AS path FROM n WHERE kind = 'file' AND module_id IS NOT NULL GROUP BY 1), m AS (SELECT id, project_id, regexp_extract(lower(coalesce(display_name, '')), '([^/]*)$', 1) AS l, files, {_B} AS b FROM n LEFT JOIN f ON f.module_id = n.id WHERE kind = 'module')
        SELECT id, project_id, coalesce(files = 1 AND (l = b OR l = regexp_replace(b, '(.)\\.[^.]*$', '\\1')), false) AS single FROM m""",
    "merge_pairs": f"WITH {PATHS}, pr AS (SELECT *, list_filter(string_split({M._PARENT}, '/'), lambda s: s <> '') AS d FROM paths), {_PAIRS} SELECT * FROM merges",
    "config_choices": f"WITH {PATHS}, {_CHOICES} SELECT * FROM offered",
    "config_draft": f"""WITH {PATHS}, {_CHOICES}, {_PAIRS}, rules AS (SELECT project_id, 'ignore' AS rule, folder AS match, '' AS value FROM roots WHERE kind = 'ignore' UNION SELECT project_id, 'fold', folder, 'collapse' FROM roots WHERE kind = 'dependency' UNION SELECT project_id, 'role', folder, 'tooling' FROM roots WHERE lower(folder) IN ('test', 'tests')
        UNION SELECT project_id, 'merge', match, target FROM merges UNION SELECT project_id, rule, match, value FROM offered WHERE chosen AND rule <> 'entry') SELECT project_id, rule, CAST(to_json({{'match': match, 'value': value}}) AS VARCHAR) AS json FROM rules""",
    "layer_keys": """WITH nf AS (SELECT project_id, path, length, modification_time FROM (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY modification_time DESC NULLS LAST, scanned_at DESC NULLS LAST, content DESC NULLS LAST, length DESC NULLS LAST) AS rn FROM files WHERE path IS NOT NULL) WHERE rn = 1),
        f AS (SELECT project_id, count(*) AS n, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes, strftime(max(modification_time), '%Y-%m-%d %H:%M:%S.%f') AS newest FROM nf GROUP BY 1), p AS (SELECT project_id, count(DISTINCT (file_path, attempt)) FILTER (file_path IS NOT NULL AND attempt IS NOT NULL) AS attempts FROM parse_results GROUP BY 1),
        k1 AS (SELECT f.project_id, attempts, sha256('1|' || coalesce(f.project_id, '') || '|' || n || '|' || bytes || '|' || coalesce(newest, '')) AS scan_key FROM f LEFT JOIN p ON p.project_id = f.project_id), k2 AS (SELECT *, sha256(scan_key || '|' || coalesce(CAST(attempts AS VARCHAR), '')) AS parse_key FROM k1), k3 AS (SELECT *, sha256(parse_key || '|aggregate') AS aggregate_key FROM k2)
        SELECT project_id, scan_key, parse_key, aggregate_key, sha256(aggregate_key || '|layout') AS layout_key FROM k3""",
    "cached_replies": """WITH c AS (SELECT project_id, url FROM (SELECT project_id, coalesce(base_url, '') || coalesce(endpoint_path, '') AS url, row_number() OVER (PARTITION BY project_id ORDER BY loaded_at DESC NULLS LAST, config_id DESC) AS r FROM ai_config WHERE enabled) WHERE r = 1),
        q AS (SELECT DISTINCT request_id, r.project_id, code_excerpt, url FROM ai_requests r LEFT JOIN c ON c.project_id = r.project_id), k AS (SELECT request_id, sha256(coalesce(url, '') || chr(10) || coalesce(code_excerpt, '')) AS key FROM q) SELECT request_id, key, min(request_id) OVER (PARTITION BY key) < request_id AS cached FROM k""",
    "component_labels": f"""WITH {NODES}, c AS (SELECT *, regexp_replace(file_path, '\\.[^.]*$', '') AS component, CASE WHEN kind IN ('class', 'struct', 'enum') THEN 0 WHEN kind IN ('function', 'method') THEN 1 END AS p FROM n WHERE module_id IS NOT NULL AND file_path <> ''),
        g AS (SELECT module_id, component, first(display_name ORDER BY p, coalesce(line, 0), display_name) FILTER (p IS NOT NULL AND display_name <> '') AS lead, list_sort(list(DISTINCT regexp_extract(file_path, '([^/]*)$', 1))) AS files FROM c GROUP BY 1, 2)
        SELECT module_id, component, 'around ' || coalesce(lead, regexp_extract(component, '([^/]*)$', 1)) || ': ' || CASE WHEN len(files) > 2 THEN array_to_string(files[1:2], ', ') || ', +' || (len(files) - 2) || ' more' ELSE array_to_string(files, ', ') END AS label FROM g""",
    "signed_lanes": _FOCUS + """, up(id, s) AS (SELECT id, 0 FROM fo UNION SELECT dep.t, up.s + 1 FROM up JOIN dep ON dep.f = up.id WHERE up.s < 60), down(id, s) AS (SELECT id, 0 FROM fo UNION SELECT dep.f, down.s + 1 FROM down JOIN dep ON dep.t = down.id WHERE down.s < 60),
        b AS (SELECT id, min(s) AS s, 0 AS o FROM up GROUP BY 1 UNION ALL SELECT id, min(s), 1 FROM down GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, o) AS r FROM b) SELECT id, CAST(CASE WHEN o = 1 THEN -s ELSE s END AS INTEGER) AS lane FROM r WHERE r = 1""",
    "ring_layout": _FOCUS + f""", both_ AS (SELECT f, t FROM dep UNION SELECT t, f FROM dep), h(id, s) AS (SELECT id, 0 FROM fo UNION SELECT both_.t, h.s + 1 FROM h JOIN both_ ON both_.f = h.id WHERE h.s < 60), hop AS (SELECT id, min(s) AS s FROM h GROUP BY 1),
        m AS (SELECT own.*, coalesce(s, max(s) OVER (PARTITION BY project_id) + 1) AS ring FROM own LEFT JOIN hop ON hop.id = own.id), p AS (SELECT *, row_number() OVER (PARTITION BY project_id, ring ORDER BY name, id) - 1 AS k, count(*) OVER (PARTITION BY project_id, ring) AS c FROM m),
        q AS (SELECT *, 2 * {math.pi!r}::DOUBLE * k / c AS turn, CASE WHEN ring = 0 THEN 0.0::DOUBLE ELSE greatest(ring * {RING}::DOUBLE, c * 2 * {RING}::DOUBLE / (2 * {math.pi!r}::DOUBLE)) END AS radius FROM p) SELECT id, project_id, CAST(ring AS INTEGER) AS ring, round(radius * cos(turn), 3) AS x, round(radius * sin(turn), 3) AS y FROM q""",
}
