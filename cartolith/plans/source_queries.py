"""Queries over paths and source lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.functions import paths as P
from cartolith.functions import text as T
from cartolith.operators import cpp_facts, extract, resolve, rollup, rules
from cartolith.plans.sqlparts import LINES, NEWEST, PATHS, base, ext, in_list
from cartolith.runtime import Staged, table
from cartolith.sources.tables import file_lines, file_paths, newest_files

#: Rules of the example configuration that the rule queries apply.
ROLE_RULES = [(1, "src", "library"), (2, "app", "application"), (3, "src/index", "storage"), (4, "tests", "tooling"), (5, "lib/", "library"), (6, "src", "core_model"), (7, "core/pivot", "analysis")]
MERGE_RULES = [("src", "source"), ("lib", "source"), ("tests", "checks"), ("source", "product"), ("app/index", "indexing")]
IGNORE_RULES = ["build", "dist", "node_modules", "src/index", "third_party", "out"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return file_lines(newest_files(spark, d))


def _imports(spark: SparkSession, d: str) -> DataFrame:
    """Staged, for the ladders read them more than once and the texts should be read only once."""
    return Staged(extract.imports(_lines(spark, d)), "imports").df


def _rules(spark: SparkSession, rows, value: str) -> DataFrame:
    return spark.createDataFrame(rows, f"ord int, match string, {value} string")


def path_parts(spark, d):
    p = F.col("path")
    s = P.segments(p)
    return file_paths(spark, d).select("project_id", "path", F.size(s).alias("n_segments"), P.folder_key(p).alias("folder_key"), P.extension(p).alias("extension"), P.file_name(p).alias("file_name"), P.stem(F.element_at(s, -1)).alias("stem"), P.parent(p).alias("parent"), F.array_join(F.slice(s, 1, 2), "/").alias("two_segments"))


def extension_classes(spark, d):
    c = P.extension_class(F.col("path"))
    return file_paths(spark, d).groupBy("project_id").agg(*[F.count_if(c == k).alias(f"{k}_files") for k in ("cpp", "qml", "web", "script", "data", "none")])


def language_counts(spark, d):
    return file_paths(spark, d).groupBy("project_id", P.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


def scan_filter(spark, d):
    p = F.col("path")
    return file_paths(spark, d).select("project_id", "path", P.is_relevant(p).alias("relevant"), P.extension(p).isin(*P.CPP).alias("cpp_source"), P.is_generated_name(p).alias("generated_name"), P.pruned_at(p).alias("pruned_at"))


def scan_manifest(spark, d):
    f = newest_files(spark, d).where(P.is_relevant(F.col("path")) & ~P.is_generated_name(F.col("path")) & P.pruned_at(F.col("path")).isNull())
    part = F.concat_ws("|", "path", F.coalesce(F.col("length").cast("string"), F.lit("")), F.date_format("modification_time", "yyyy-MM-dd HH:mm:ss"))
    per_file = f.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sum(F.conv(F.substring(F.md5(part), 1, 15), 16, 10).cast("decimal(38,0)")).alias("all"))
    # a sum over the files' hashes does not depend on their order, so no list of a project's files is made
    return per_file.select("project_id", "files", "bytes", F.sha2(F.col("all").cast("string"), 256).alias("fingerprint"))


def changed_files(spark, d):
    f = table(spark, d, "files").where("path IS NOT NULL").select("project_id", "path", "length", "modification_time").distinct()
    states = f.withColumn("r", F.row_number().over(Window.partitionBy("project_id", "path").orderBy(F.desc_nulls_last("modification_time"), F.desc_nulls_last("length"))))
    new, old = states.where("r = 1").drop("r"), states.where("r = 2").drop("r")
    same = old.select("project_id", "path", "length", "modification_time")
    return new.join(old.select("project_id", "path"), ["project_id", "path"], "left_semi").join(same, ["project_id", "path", "length", "modification_time"], "left_anti")


def module_inference(spark, d):
    return rollup.infer_modules(file_paths(spark, d))


def module_inference_single(spark, d):
    return rollup.single_path_module(file_paths(spark, d))


def common_folder(spark, d):
    p = file_paths(spark, d).select("project_id", P.language(F.col("path")).alias("language"), P.segments(P.parent(F.col("path"))).alias("dirs"))
    return rollup.common_prefix_length(p, ["project_id", "language"], "dirs")


def prefix_rule_last_wins(spark, d):
    return rules.last_wins(file_paths(spark, d), _rules(spark, ROLE_RULES, "role"), "role", ["project_id", "path"])


def prefix_rule_first_wins(spark, d):
    return rules.first_wins(file_paths(spark, d), _rules(spark, ROLE_RULES, "role"), "role", ["project_id", "path"])


def ignore_prefix_anti(spark, d):
    return rules.ignored(file_paths(spark, d), _rules(spark, [(n, m, "") for n, m in enumerate(IGNORE_RULES)], "none"))


def module_merge_fold(spark, d):
    return rules.fold_merges(file_paths(spark, d).withColumn("module", P.folder_key(F.col("path"))), MERGE_RULES)


def dependency_folders(spark, d):
    return file_paths(spark, d).where(P.is_dependency_segment(F.get(P.segments(F.col("path")), 0))).groupBy("project_id", P.folder_key(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def include_lines(spark, d):
    return extract.cpp_includes(_lines(spark, d))


def import_lines(spark, d):
    return extract.imports(_lines(spark, d))


def symbol_lines(spark, d):
    return extract.symbols(_lines(spark, d))


def file_facts(spark, d):
    lines = _lines(spark, d)
    key = ["project_id", "path"]
    count = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    out = count(lines, "n_lines").join(count(extract.cpp_includes(lines), "includes"), key, "left").join(count(extract.imports(lines), "imports"), key, "left").join(count(extract.symbols(lines), "symbols"), key, "left")
    return out.fillna(0, ["includes", "imports", "symbols"])


def include_resolution(spark, d):
    return resolve.resolve_includes(extract.cpp_includes(_lines(spark, d)), file_paths(spark, d))


def java_import_targets(spark, d):
    return resolve.resolve_java_imports(_imports(spark, d), file_paths(spark, d))


def script_import_targets(spark, d):
    return resolve.resolve_script_imports(_imports(spark, d), file_paths(spark, d))


def unique_basenames(spark, d):
    return resolve.unique_lookup(file_paths(spark, d).withColumn("base", F.substring_index("path", "/", -1)), ["project_id", "base"], "path")


def unique_suffixes(spark, d):
    return resolve.unique_lookup(resolve.path_suffixes(file_paths(spark, d)), ["project_id", "suffix"], "path")


def behaviour_signals(spark, d):
    return newest_files(spark, d).where("content IS NOT NULL").select("project_id", "path", F.array_join(extract.behaviour_signals(F.col("content")), ",").alias("signals"))


def import_clues(spark, d):
    return extract.import_clues(_lines(spark, d))


def sliding_complexity(spark, d):
    return extract.line_scores(_lines(spark, d))


def running_brace_depth(spark, d):
    return extract.brace_depth(_lines(spark, d))


def preview_anchors(spark, d):
    return extract.anchors(extract.line_scores(_lines(spark, d)))


def name_functions(spark, d):
    n = table(spark, d, "nodes").where("display_name IS NOT NULL").select("display_name").distinct()
    x = F.col("display_name")
    return n.select("display_name", T.humanize(x).alias("humanized"), T.split_camel(x).alias("camel"), T.clip(x, 12).alias("clipped"), T.compact_identifier(x).alias("compact"), F.array_join(T.identifier_tokens(x), " ").alias("tokens"))


def name_hash(spark, d):
    n = table(spark, d, "nodes").where("display_name IS NOT NULL").select("display_name").distinct()
    return n.select("display_name", T.polynomial_hash(F.col("display_name")).alias("hash"))


def document_highlights(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "^#+", "")))
    marks = F.slice(F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), lambda x: T.clip(x, 160))), 1, 3)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(marks, " / ").alias("highlights"))


def free_text_filter(spark, d):
    hay = F.lower(F.concat_ws(" ", "display_name", "qualified_name", "kind", "file_path"))
    return table(spark, d, "nodes").distinct().where(F.contains(hay, F.lower(F.trim(F.lit("  Planner ")))))\
        .select("id", "project_id", "display_name")


def single_files_by_module(spark, d):
    m = rollup.infer_modules(file_paths(spark, d))
    rank = F.when(P.extension(F.col("path")).isin(".cpp", ".cc"), 0).when(P.extension(F.col("path")).isin(".h", ".hpp"), 1).when(P.extension(F.col("path")).isin(".py", ".java", ".js", ".ts"), 2).otherwise(3)
    return m.groupBy("project_id", "module").agg(F.min_by("path", F.struct(rank, "path")).alias("primary_path"), F.count(F.lit(1)).alias("files"))


def file_clusters(spark, d):
    return file_paths(spark, d).groupBy("project_id", F.regexp_replace("path", r"\.[^.]*$", "").alias("cluster")).agg(F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_set(P.extension(F.col("path")))), ",").alias("extensions"))


def cpp_symbols(spark, d):
    return cpp_facts.cpp_symbols(newest_files(spark, d))


def cpp_call_resolution(spark, d):
    return cpp_facts.resolved_calls(newest_files(spark, d))


QUERIES = {f.__name__: f for f in (
    path_parts, extension_classes, language_counts, scan_filter, scan_manifest, changed_files, module_inference, module_inference_single, common_folder, prefix_rule_last_wins, prefix_rule_first_wins,
    ignore_prefix_anti, module_merge_fold, dependency_folders, include_lines, import_lines, symbol_lines, file_facts, include_resolution, java_import_targets, script_import_targets, unique_basenames,
    unique_suffixes, behaviour_signals, import_clues, sliding_complexity, running_brace_depth, preview_anchors, name_functions, name_hash, document_highlights, free_text_filter, single_files_by_module, file_clusters, cpp_symbols, cpp_call_resolution)}

_CPP, _EXT, _BASE = in_list(P.CPP), ext(), base()
_MANIFEST = f"({_BASE} IN ({in_list(P.MANIFESTS)}) OR regexp_matches({_BASE}, '\\.(pro|pri)$'))"
_BOOT = f"({_BASE} IN ({in_list(P.BOOTSTRAPS)}) OR {_MANIFEST} OR regexp_matches({_BASE}, '\\.(qrc|rc)$'))"
_RELEVANT = f"({_EXT} IN ({in_list([*P.CPP, *P.SCRIPT, *P.WEB, *P.OTHER_RELEVANT])}) OR {_MANIFEST})"
_GENERATED = f"""({_BASE} IN ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'bun.lockb') OR regexp_matches({_BASE}, '^(moc_|qrc_|ui_|cmake)') OR regexp_matches({_BASE}, 'qmltyperegistrations|qmlcache_loader|compilerid|featuretest|feature_tests')
  OR regexp_matches({_BASE}, '(\\.pb\\.h|\\.pb\\.cc|\\.generated\\.h|\\.designer\\.cs|_p\\.h|\\.pyc|\\.pyo)$'))"""
_SEG = "list_filter(string_split(path, '/'), lambda s: s <> '')"
_DEP = lambda s: f"(lower({s}) IN ({in_list(P.DEPENDENCY_DIRS)}) OR regexp_matches(lower({s}), 'qxlsx|vendor|dependency'))"
_PRUNED = f"""list_extract(list_filter(list_transform(range(1, len({_SEG})), lambda i: CASE WHEN lower({_SEG}[i]) IN ({in_list(P.BUILD_DIRS)}) OR regexp_matches(lower({_SEG}[i]), '^(cmake-build-|qtcreator-|msvc|\\.qt)') OR (i = 1 AND {_DEP(_SEG + '[i]')}) THEN lower({_SEG}[i]) END), lambda x: x IS NOT NULL), 1)"""
_LANG = f"CASE WHEN {_EXT} IN ({_CPP}) THEN 'cpp' WHEN {_EXT} = '.py' THEN 'python' WHEN {_EXT} = '.java' THEN 'java' WHEN {_EXT} IN ('.js', '.mjs', '.cjs') THEN 'javascript' WHEN {_EXT} IN ('.ts', '.tsx', '.mts', '.cts') THEN 'typescript' WHEN {_EXT} = '.qml' THEN 'qml' WHEN {_EXT} = '.json' THEN 'json' ELSE 'other' END"
_STEM = lambda s: f"regexp_replace({s}, '(.)\\.[^.]*$', '\\1')"
_PARENT = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
_RULES = "rules(ord, match, role) AS (VALUES " + ", ".join(f"({o}, '{m.rstrip('/')}', '{r}')" for o, m, r in ROLE_RULES) + ")"
_MEETS = lambda c, m: f"({c} = {m} OR starts_with({c}, {m} || '/'))"
_INC = LINES + f""", inc AS (SELECT project_id, path, line_no, CASE WHEN q <> '' THEN q ELSE a END AS target, q = '' AS is_system FROM (
  SELECT *, regexp_extract(line, '^\\s*#\\s*include\\s*"([^"]*)"', 1) AS q, regexp_extract(line, '^\\s*#\\s*include\\s*<([^>]*)>', 1) AS a FROM lines
  WHERE {_EXT} IN ({_CPP}) AND regexp_matches(line, '^\\s*#\\s*include\\s*("[^"]*"|<[^>]*>)')) WHERE q <> '' OR a <> '')"""
_IMP = LINES + f""", typed AS (SELECT * REPLACE (regexp_replace(line, '^\\s+', '') AS line), {_LANG} AS language FROM lines),
spec AS (SELECT *, CASE language
    WHEN 'python' THEN coalesce(nullif(regexp_extract(line, '^import ([^ ,.]*)', 1), ''), nullif(string_split(regexp_replace(regexp_extract(line, '^from (.*?) import ', 1), '^\\.+', ''), '.')[1], ''))
    WHEN 'java' THEN nullif(trim(string_split(regexp_extract(line, '^import (?:static )?(.*)$', 1), ';')[1]), '')
    WHEN 'javascript' THEN js WHEN 'typescript' THEN js END AS specifier
  FROM (SELECT *, coalesce(
    CASE WHEN contains(line, 'from ') THEN nullif(regexp_extract(regexp_replace(list_extract(string_split(line, 'from '), -1), '^[''" ]+', ''), '^[^''"]*'), '') END,
    CASE WHEN contains(line, 'require(') THEN nullif(regexp_extract(regexp_replace(regexp_extract(line, 'require\\((.*)$', 1), '^[''"]+', ''), '^[^''")]*'), '') END) AS js FROM typed)),
imp AS (SELECT project_id, path, line_no, language, CASE WHEN language = 'python' THEN specifier WHEN language = 'java' THEN list_extract(string_split(specifier, '.'), -1)
  WHEN starts_with(specifier, '@') THEN array_to_string(string_split(specifier, '/')[1:2], '/') ELSE string_split(specifier, '/')[1] END AS name, specifier FROM spec WHERE specifier IS NOT NULL)"""
_SYM = f""", sym AS (SELECT project_id, path, line_no, kind, name FROM (SELECT *, CASE
    WHEN language = 'python' AND pc <> '' THEN 'class' WHEN language = 'python' AND pd <> '' THEN 'function' WHEN language = 'java' AND ac <> '' THEN 'class'
    WHEN language IN ('javascript', 'typescript') THEN CASE WHEN ac <> '' THEN 'class' WHEN fn <> '' OR ar <> '' THEN 'function' END END AS kind,
    CASE WHEN language = 'python' THEN coalesce(nullif(pc, ''), nullif(pd, '')) WHEN language = 'java' THEN ac ELSE coalesce(nullif(ac, ''), nullif(fn, ''), ar) END AS name
  FROM (SELECT *, regexp_extract(line, '^class ([^(:. \\t]*)', 1) AS pc, regexp_extract(line, '^def ([^(]*)', 1) AS pd, regexp_extract(line, 'class ([^ {{<]*)', 1) AS ac, regexp_extract(line, 'function ([^(]*)', 1) AS fn,
    CASE WHEN contains(line, '=>') THEN rtrim(regexp_extract(line, '^(?:export const |const |let |var )([^=]*)=', 1)) ELSE '' END AS ar FROM typed)) WHERE kind IS NOT NULL)"""
_NORM = lambda e: "regexp_replace(" * 8 + f"regexp_replace(replace({e}, '\\', '/'), '(^|/)(?:\\./)+', '\\1', 'g')" + ", '(^|/)(?:[^/.]|\\.[^/.]|\\.\\.[^/]|[^/.][^/]|\\.[^/.][^/])[^/]*/\\.\\./', '\\1')" * 8
_SUFFIX = "suffixes AS (SELECT project_id, path, unnest(list_transform(range(1, len(seg) + 1), lambda i: array_to_string(seg[i:], '/'))) AS suffix FROM (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg FROM paths))"
_SCORE = "len(regexp_extract_all(line, '\\b(?:if|for|while|switch|case|catch|except|elif)\\b|&&|\\|\\|'))"
_SIG = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in words.split("|")) + f" THEN '{label}' END" for label, words in extract.SIGNALS.items())


def _merged() -> str:
    e = "string_split(path, '/')[1]"
    for m, t in MERGE_RULES:
        e = f"CASE WHEN {_MEETS('path', repr(m))} OR {_MEETS('(' + e + ')', repr(m))} THEN '{t}' ELSE {e} END"
    return e


_MODULES = f"""{PATHS}, p AS (SELECT project_id, path, seg, seg[1] AS top, coalesce(seg[2], '') AS s2, coalesce(seg[3], '') AS s3, len(seg) AS n, CASE WHEN len(seg) >= 3 AND NOT contains(seg[2], '.') THEN seg[2] END AS second,
    {_BOOT} AS boot, {_MANIFEST} AS manifest, CASE WHEN NOT {_BOOT} THEN lower({_STEM('seg[len(seg)]')}) END AS component, len(seg) >= 4 AND seg[1] = 'src' AND seg[2] IN ('main', 'test') AND seg[3] IN ('java', 'kotlin') AS is_java, seg[4:len(seg) - 1] AS package
  FROM (SELECT *, {_SEG} AS seg FROM paths)),
topstat AS (SELECT project_id, top, count(*) AS files, count(*) FILTER (n = 2) AS direct, count(DISTINCT CASE WHEN n = 2 THEN component END) AS stems, bool_or(n = 2 AND (boot OR manifest)) AS has_boot, count(DISTINCT second) AS seconds FROM p GROUP BY 1, 2),
prestat AS (SELECT project_id, top, second, count(*) AS pre_files, count(DISTINCT CASE WHEN n >= 4 AND NOT contains(s3, '.') THEN s3 END) AS thirds FROM p WHERE second IS NOT NULL GROUP BY 1, 2, 3),
jstat AS (SELECT project_id, s2, min(package) AS lo, max(package) AS hi FROM p WHERE is_java GROUP BY 1, 2),
jc AS (SELECT project_id, s2, coalesce(list_min(list_filter(range(1, greatest(len(lo), len(hi)) + 1), lambda i: lo[i] IS DISTINCT FROM hi[i])) - 1, len(lo)) AS common FROM jstat),
j AS (SELECT p.*, files, direct, stems, has_boot, seconds, pre_files, thirds, common, lower({_STEM('seg[len(seg)]')}) AS stem, lower(package[len(package)]) AS last, seg[1] || '/' || s2 AS two FROM p JOIN topstat USING (project_id, top) LEFT JOIN prestat USING (project_id, top, second) LEFT JOIN jc USING (project_id, s2))
SELECT project_id, path, CASE
  WHEN n = 1 THEN CASE WHEN contains(top, '.') THEN '(root)' ELSE top END
  WHEN {_DEP('top')} THEN top
  WHEN NOT regexp_matches(top, '^[0-9]+$') AND n = 2 AND direct >= 8 AND stems >= 5 AND has_boot AND (boot OR component <> '') THEN CASE WHEN boot THEN top ELSE top || '/' || component END
  WHEN is_java THEN CASE WHEN ends_with(stem, 'application') OR stem IN ('main', 'bootstrap', 'startup') THEN two || '/bootstrap' WHEN last NOT IN ('com', 'org', 'net', 'io', 'cn', 'dev', 'app') THEN two || '/' || last
    WHEN common > 0 AND len(package) > common THEN two || '/' || lower(package[common + 1]) WHEN stem = '' THEN two ELSE two || '/' || stem END
  WHEN top IN ({in_list(P.GROUPED_ROOTS)}) THEN CASE WHEN NOT contains(s2, '.') THEN two WHEN {_STEM('s2')} = '' THEN top ELSE top || '/' || {_STEM('s2')} END
  WHEN n >= 4 AND second IS NOT NULL AND pre_files >= 6 AND thirds >= 2 AND NOT contains(s3, '.') THEN two || '/' || s3
  WHEN second IS NOT NULL AND files >= 4 AND seconds >= 2 THEN two
  WHEN n >= 4 AND lower(s2) IN ({in_list(P.BRIDGE_DIRS)}) AND NOT contains(s3, '.') THEN top || '/' || s3
  ELSE top END AS module FROM j"""

SQL = {
    "path_parts": f"""WITH {PATHS} SELECT project_id, path, CAST(len({_SEG}) AS INTEGER) AS n_segments, string_split(path, '/')[1] AS folder_key, {_EXT} AS extension, {_BASE} AS file_name,
        {_STEM('list_extract(' + _SEG + ', -1)')} AS stem, {_PARENT} AS parent, array_to_string({_SEG}[1:2], '/') AS two_segments FROM paths""",
    "extension_classes": f"""WITH {PATHS}, c AS (SELECT project_id, CASE WHEN {_EXT} = '.qml' THEN 'qml' WHEN {_EXT} IN ({in_list(P.WEB)}) THEN 'web' WHEN {_EXT} IN ({in_list(P.SCRIPT)}) THEN 'script' WHEN {_EXT} = '.json' THEN 'data' WHEN {_EXT} IN ({_CPP}) THEN 'cpp' ELSE 'none' END AS k FROM paths)
        SELECT project_id, """ + ", ".join(f"count(*) FILTER (k = '{k}') AS {k}_files" for k in ("cpp", "qml", "web", "script", "data", "none")) + " FROM c GROUP BY project_id",
    "language_counts": f"WITH {PATHS} SELECT project_id, {_LANG} AS language, count(*) AS files FROM paths GROUP BY 1, 2",
    "scan_filter": f"WITH {PATHS} SELECT project_id, path, {_RELEVANT} AS relevant, {_EXT} IN ({_CPP}) AS cpp_source, {_GENERATED} AS generated_name, {_PRUNED} AS pruned_at FROM paths",
    "scan_manifest": f"""WITH {NEWEST} SELECT project_id, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes,
        sha256(CAST(sum(CAST(CAST('0x' || md5(path || '|' || coalesce(CAST(length AS VARCHAR), '') || coalesce('|' || strftime(modification_time, '%Y-%m-%d %H:%M:%S'), ''))[1:15] AS BIGINT) AS HUGEINT)) AS VARCHAR)) AS fingerprint
        FROM newest WHERE {_RELEVANT} AND NOT {_GENERATED} AND {_PRUNED} IS NULL GROUP BY project_id""",
    "changed_files": """WITH f AS (SELECT DISTINCT project_id, path, length, modification_time FROM files WHERE path IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY modification_time DESC NULLS LAST, length DESC NULLS LAST) AS r FROM f)
        SELECT a.project_id, a.path, a.length, a.modification_time FROM r a JOIN r b ON a.r = 1 AND b.r = 2 AND a.project_id = b.project_id AND a.path = b.path WHERE coalesce(a.length <> b.length, true) OR coalesce(a.modification_time <> b.modification_time, true)""",
    "module_inference": "WITH " + _MODULES,
    "module_inference_single": f"""WITH {PATHS}, p AS (SELECT project_id, path, seg, len(seg) AS n, seg[1] AS top, coalesce(seg[2], '') AS s2, lower({_STEM('seg[len(seg)]')}) AS stem, lower(seg[len(seg) - 1]) AS last, len(seg) >= 4 AND seg[1] = 'src' AND seg[2] IN ('main', 'test') AND seg[3] IN ('java', 'kotlin') AS is_java FROM (SELECT *, {_SEG} AS seg FROM paths))
        SELECT project_id, path, CASE WHEN n = 1 THEN CASE WHEN contains(top, '.') THEN '(root)' ELSE top END WHEN {_DEP('top')} OR regexp_matches(top, '^[0-9]+$') THEN top
        WHEN is_java THEN top || '/' || s2 || '/' || CASE WHEN ends_with(stem, 'application') OR stem IN ('main', 'bootstrap', 'startup') THEN 'bootstrap' WHEN n > 4 AND last NOT IN ('com', 'org', 'net', 'io', 'cn', 'dev', 'app') THEN last ELSE stem END
        WHEN top IN ({in_list(P.GROUPED_ROOTS)}) THEN CASE WHEN NOT contains(s2, '.') THEN top || '/' || s2 WHEN {_STEM('s2')} = '' THEN top ELSE top || '/' || {_STEM('s2')} END ELSE top END AS module FROM p""",
    "common_folder": f"""WITH {PATHS}, q AS (SELECT project_id, {_LANG} AS language, list_filter(string_split({_PARENT}, '/'), lambda s: s <> '') AS dirs FROM paths), e AS (SELECT project_id, language, min(dirs) AS lo, max(dirs) AS hi FROM q GROUP BY 1, 2)
        SELECT project_id, language, CAST(coalesce(list_min(list_filter(range(1, greatest(len(lo), len(hi)) + 1), lambda i: lo[i] IS DISTINCT FROM hi[i])) - 1, len(lo)) AS INTEGER) AS common FROM e""",
    "prefix_rule_last_wins": f"WITH {PATHS}, {_RULES} SELECT project_id, path, arg_max(role, ord) AS role FROM paths JOIN rules ON {_MEETS('path', 'match')} GROUP BY 1, 2",
    "prefix_rule_first_wins": f"WITH {PATHS}, {_RULES} SELECT project_id, path, arg_min(role, ord) AS role FROM paths JOIN rules ON {_MEETS('path', 'match')} GROUP BY 1, 2",
    "ignore_prefix_anti": f"WITH {PATHS} SELECT project_id, path FROM paths WHERE NOT (" + " OR ".join(_MEETS("path", f"'{m}'") for m in IGNORE_RULES) + ")",
    "module_merge_fold": f"WITH {PATHS} SELECT project_id, path, {_merged()} AS module FROM paths",
    "dependency_folders": f"WITH {PATHS} SELECT project_id, string_split(path, '/')[1] AS folder, count(*) AS files FROM paths WHERE {_DEP(_SEG + '[1]')} GROUP BY 1, 2",
    "include_lines": f"WITH {_INC} SELECT * FROM inc",
    "import_lines": f"WITH {_IMP} SELECT * FROM imp",
    "symbol_lines": f"WITH {_IMP}{_SYM} SELECT * FROM sym",
    "file_facts": f"""WITH {_IMP}{_SYM}, inc AS (SELECT project_id, path FROM lines WHERE {_EXT} IN ({_CPP}) AND regexp_matches(line, '^\\s*#\\s*include\\s*("[^"]+"|<[^>]+>)'))
        SELECT l.project_id, l.path, l.n AS n_lines, coalesce(a.n, 0) AS includes, coalesce(b.n, 0) AS imports, coalesce(c.n, 0) AS symbols FROM (SELECT project_id, path, count(*) AS n FROM lines GROUP BY 1, 2) l
        LEFT JOIN (SELECT project_id, path, count(*) AS n FROM inc GROUP BY 1, 2) a USING (project_id, path) LEFT JOIN (SELECT project_id, path, count(*) AS n FROM imp GROUP BY 1, 2) b USING (project_id, path) LEFT JOIN (SELECT project_id, path, count(*) AS n FROM sym GROUP BY 1, 2) c USING (project_id, path)""",
    "include_resolution": f"""WITH {_INC}, {PATHS}, {_SUFFIX}, us AS (SELECT project_id, suffix, min(path) AS path FROM suffixes GROUP BY 1, 2 HAVING min(path) = max(path)), ub AS (SELECT project_id, list_extract(string_split(path, '/'), -1) AS base, min(path) AS path FROM paths GROUP BY 1, 2 HAVING min(path) = max(path)),
        i AS (SELECT *, {_NORM('target')} AS root, CASE WHEN NOT is_system THEN {_NORM("CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') || '/' || target ELSE target END")} END AS near FROM inc)
        SELECT i.project_id, i.path, i.line_no, i.target, i.is_system, coalesce(a.path, b.path, c.path, e.path) AS resolved, CAST(CASE WHEN a.path IS NOT NULL THEN 1 WHEN b.path IS NOT NULL THEN 2 WHEN c.path IS NOT NULL THEN 3 WHEN e.path IS NOT NULL THEN 4 END AS INTEGER) AS rung
        FROM i LEFT JOIN paths a ON a.project_id = i.project_id AND a.path = i.near LEFT JOIN paths b ON b.project_id = i.project_id AND b.path = i.root LEFT JOIN us c ON c.project_id = i.project_id AND c.suffix = i.root
        LEFT JOIN ub e ON e.project_id = i.project_id AND e.base = list_extract(string_split(i.root, '/'), -1)""",
    "java_import_targets": f"""WITH {_IMP}, {PATHS}, j AS (SELECT DISTINCT project_id, path, specifier, ends_with(specifier, '.*') AS wild, replace(regexp_replace(specifier, '\\.\\*$', ''), '.', '/') AS s FROM imp WHERE language = 'java'),
        a AS (SELECT j.project_id, j.path, specifier, f.path AS resolved FROM j JOIN paths f ON f.project_id = j.project_id AND ends_with(f.path, '/' || s || '.java') WHERE NOT wild),
        b AS (SELECT j.project_id, j.path, specifier, f.path AS resolved FROM j JOIN paths f ON f.project_id = j.project_id AND ends_with(f.path, '/' || regexp_replace(s, '/[^/]*$', '') || '.java') WHERE NOT wild AND contains(s, '/') AND NOT EXISTS (SELECT 1 FROM a WHERE a.project_id = j.project_id AND a.path = j.path AND a.specifier = j.specifier)),
        c AS (SELECT j.project_id, j.path, specifier, f.path AS resolved FROM j JOIN paths f ON f.project_id = j.project_id AND contains(f.path, '/') AND ends_with('/' || regexp_replace(f.path, '/[^/]*$', ''), '/' || s) WHERE wild)
        SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c""",
    "script_import_targets": f"""WITH {_IMP}, {PATHS}, r AS (SELECT DISTINCT project_id, path, specifier FROM imp WHERE language IN ('javascript', 'typescript') AND (starts_with(specifier, './') OR starts_with(specifier, '../'))),
        t AS (SELECT *, {_NORM("CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') || '/' || specifier ELSE specifier END")} AS b FROM r), tries(rank, suffix) AS (VALUES {", ".join(f"({n}, '{x}')" for n, x in enumerate(resolve.SCRIPT_TRIES))}),
        h AS (SELECT t.project_id, t.path, specifier, arg_min(f.path, rank) AS resolved FROM t, tries, paths f WHERE f.project_id = t.project_id AND f.path = t.b || suffix GROUP BY 1, 2, 3) SELECT r.*, h.resolved FROM r LEFT JOIN h USING (project_id, path, specifier)""",
    "unique_basenames": f"WITH {PATHS} SELECT project_id, list_extract(string_split(path, '/'), -1) AS base, min(path) AS path FROM paths GROUP BY 1, 2 HAVING count(DISTINCT path) = 1",
    "unique_suffixes": f"WITH {PATHS}, {_SUFFIX} SELECT project_id, suffix, min(path) AS path FROM suffixes GROUP BY 1, 2 HAVING count(DISTINCT path) = 1",
    "behaviour_signals": f"WITH {NEWEST} SELECT project_id, path, array_to_string(list_filter([{_SIG}], lambda x: x IS NOT NULL), ',') AS signals FROM newest WHERE content IS NOT NULL",
    "import_clues": f"""WITH {LINES}, f AS (SELECT project_id, path, trim(line) AS t, min(line_no) AS n FROM lines WHERE regexp_matches(line, '^\\s*(#\\s*include|import |from |using |package )') GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY n) AS r FROM f)
        SELECT project_id, path, string_agg(t, ' | ' ORDER BY r) AS clues FROM r WHERE r <= 6 GROUP BY 1, 2""",
    "preview_anchors": f"""WITH RECURSIVE {LINES}, s AS (SELECT project_id, path, line_no, sum({_SCORE}) OVER (PARTITION BY project_id, path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 16 FOLLOWING) AS block FROM lines),
        c AS (SELECT project_id, path, CAST(line_no AS INTEGER) AS line_no, row_number() OVER (PARTITION BY project_id, path ORDER BY block DESC, line_no) AS k FROM s WHERE block >= 3),
        g(project_id, path, k, taken) AS (SELECT DISTINCT project_id, path, CAST(0 AS BIGINT), CAST([] AS INTEGER[]) FROM c UNION ALL SELECT g.project_id, g.path, c.k, CASE WHEN len(list_filter(taken, lambda y: abs(y - c.line_no) < 6)) > 0 THEN taken ELSE list_append(taken, c.line_no) END FROM g JOIN c ON c.project_id = g.project_id AND c.path = g.path AND c.k = g.k + 1)
        SELECT project_id, path, unnest(arg_max(taken, k)) AS line_no FROM g GROUP BY 1, 2""",
    "sliding_complexity": f"WITH {LINES}, s AS (SELECT project_id, path, line_no, {_SCORE} AS score FROM lines) SELECT project_id, path, line_no, CAST(score AS INTEGER) AS score, CAST(sum(score) OVER (PARTITION BY project_id, path ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 16 FOLLOWING) AS BIGINT) AS block FROM s",
    "running_brace_depth": f"""WITH {LINES}, s AS (SELECT *, (length(line) - length(replace(line, '{{', ''))) - (length(line) - length(replace(line, '}}', ''))) AS step FROM lines), x AS (SELECT *, sum(step) OVER w AS depth FROM s WINDOW w AS (PARTITION BY project_id, path ORDER BY line_no))
        SELECT project_id, path, line_no, CAST(depth AS BIGINT) AS depth, CAST(sum(CASE WHEN depth = 0 AND step < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, path ORDER BY line_no) AS BIGINT) AS scope FROM x""",
    "name_functions": """WITH n AS (SELECT DISTINCT display_name FROM nodes WHERE display_name IS NOT NULL) SELECT display_name, array_to_string(list_transform(string_split(translate(display_name, '_/-.', '    '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS humanized,
        regexp_replace(display_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS camel, CASE WHEN length(display_name) <= 12 THEN display_name ELSE display_name[1:9] || '...' END AS clipped, regexp_replace(display_name, '[^0-9A-Za-z_]', '', 'g') AS compact,
        coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace(display_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^0-9A-Za-z]+', ' ', 'g')), ' '), lambda x: length(x) >= 3)),
          lambda x: {'p': list_position(string_split(lower(regexp_replace(regexp_replace(display_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^0-9A-Za-z]+', ' ', 'g')), ' '), x), 'x': x})), lambda y: y.x), ' '), '') AS tokens FROM n""",
    "name_hash": """WITH n AS (SELECT DISTINCT display_name FROM nodes WHERE display_name IS NOT NULL) SELECT display_name, CASE WHEN display_name = '' THEN 0 ELSE CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(display_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 131 + c) % 2147483647) AS BIGINT) END AS hash FROM n""",
    "document_highlights": """WITH l AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^#+', ''))), lambda x: x <> ''), lambda x: CASE WHEN length(x) <= 160 THEN x ELSE x[1:157] || '...' END) AS a FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, coalesce(array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:3], ' / '), '') AS highlights FROM l""",
    "free_text_filter": "SELECT DISTINCT id, project_id, display_name FROM nodes WHERE contains(lower(concat_ws(' ', display_name, qualified_name, kind, file_path)), 'planner')",
    "single_files_by_module": f"""SELECT project_id, module, arg_min(path, CASE WHEN {_EXT} IN ('.cpp', '.cc') THEN '0' WHEN {_EXT} IN ('.h', '.hpp') THEN '1' WHEN {_EXT} IN ('.py', '.java', '.js', '.ts') THEN '2' ELSE '3' END || path) AS primary_path, count(*) AS files FROM (WITH {_MODULES}) GROUP BY 1, 2""",
    "file_clusters": f"WITH {PATHS} SELECT project_id, regexp_replace(path, '\\.[^.]*$', '') AS cluster, count(*) AS files, string_agg(DISTINCT {_EXT}, ',' ORDER BY {_EXT}) AS extensions FROM paths GROUP BY 1, 2",
}
