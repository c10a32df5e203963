"""What a single file or folder is worth reading for: labels, scores of lines and paths, syntax trees, proposals of rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import paths as P
from cartolith.operators import cpp_facts

# Languages by extension or file name.
LANGUAGES = [
    ("CMake", [".cmake"]), ("C++ Module", [".ixx", ".cppm"]), ("CUDA C++", [".cu"]), ("Objective-C++", [".mm"]), ("C++", [".cpp", ".cc", ".cxx", ".c", ".cp", ".c++"]), ("CUDA Header", [".cuh"]),
    ("C/C++ Header", [".h", ".hh", ".hpp", ".hxx", ".h++", ".ipp", ".inl", ".tpp", ".tcc", ".txx"]), ("QML", [".qml"]), ("Qt Resource", [".qrc"]), ("Qt Designer UI", [".ui"]), ("qmake", [".pro", ".pri"]), ("Qbs", [".qbs"]),
    ("Resource Script", [".rc"]), ("Assembly", [".s", ".asm"]), ("Module Definition", [".def"]), ("JavaScript", [".js", ".mjs", ".cjs"]), ("TypeScript", [".ts", ".tsx", ".mts", ".cts"]), ("Python", [".py"]), ("Java", [".java"]),
    ("Kotlin", [".kt", ".kts"]), ("Go", [".go"]), ("Rust", [".rs"]), ("JSON", [".json"]), ("YAML", [".yaml", ".yml"]), ("TOML", [".toml"]), ("XML", [".xml"]), ("HTML", [".html", ".htm"]), ("CSS", [".css", ".scss"]), ("Markdown", [".md"]),
]
# Parts of a path that tell a file's category, in the order in which they are asked.
TEST_PARTS = ["/test", "/spec", "/mock", "/fixture"]
PROJECT_SUFFIXES = [".cmake", ".qrc", ".ui", ".pro", ".pri", ".qbs", ".rc", ".s", ".asm", ".def"]
CONFIG_SUFFIXES = [".json", ".yaml", ".yml", ".toml", ".ini", ".xml"]
STYLE_SUFFIXES = [".qml", ".html", ".htm", ".css", ".scss"]
TOOL_PARTS = ["/script", "/tool", "/build", "/ci"]
# What a path is worth as an example of the project's code.
MAIN_FILES = ["main.cpp", "main.cc", "main.cxx", "main.c", "main.py", "main.go", "main.rs", "main.qml", "program.cs"]
APP_FILES = ["app.py", "server.js", "server.ts", "index.js", "index.ts", "index.tsx", "app.qml"]
PATH_WORTH = [(["/apps/"], 60), (["/src/"], 45), (["/app/", "/cmd/", "/server/", "/client/"], 35), (["/tests/", "/test/", "/spec/", "/example/", "/examples/"], -80), (["/third_party/", "/vendor/", "/external/"], -120)]
SUFFIX_WORTH = [([".qml"], 20), ([".cpp", ".cc", ".cxx", ".py", ".ts", ".tsx", ".js"], 12), ([".h", ".hh", ".hpp", ".hxx"], -8)]
# How lines of project files begin (or what they hold) that say something, and what these are worth.
PROJECT_LINES = {
    "cmake": (["project(", "cmake_minimum_required(", "find_package(", "add_executable(", "add_library(", "qt_add_executable(", "qt_add_qml_module(", "target_sources(", "target_link_libraries(", "target_include_directories(", "add_subdirectory(", "set(cmake_cxx_standard"], 120, ["qt6::", "qt_add_", "tree-sitter", "libclang"], 28),
    "qmake": (["qt +=", "config +=", "template =", "target =", "sources +=", "headers +=", "resources +=", "forms +=", "include("], 112, [], 0),
    "qbs": ([], 0, ["cppapplication", "product {", "depends {", "files:", "cpp.cxxlanguageversion", "qtc.coreplugin"], 110),
    "qmldir": (["module ", "plugin ", "singleton ", "internal ", "depends "], 115, [], 0),
    "ui": (["<class>", "<widget ", "<layout ", "<connection>", "<slot>", "<property name="], 102, ["qmainwindow", "qdialog", "qwidget"], 24),
    "rc": ([], 0, ["versioninfo", "manifest", " icon ", " dialog", " menu"], 96),
}
# Choices offered for folders, with the largest number of each.
CHOICES = {"presentation": 3, "web": 2, "entry": 4}


def _holds(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]) if words else F.lit(False)


def _begins(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(w)) for w in words]) if words else F.lit(False)


def language_label(path: Column) -> Column:
    name, ext = P.file_name(path), P.extension(path)
    out = F.when(name == "cmakelists.txt", "CMake").when(name == "qmldir", "QML Module")
    for label, suffixes in LANGUAGES:
        out = out.when(ext.isin(*suffixes), label)
    return out.when(ext == "", "Unknown").otherwise(F.upper(F.substring(ext, 2, 100)))


def category(path: Column) -> Column:
    low, ext, name = F.lower(path), P.extension(path), P.file_name(path)
    out = F.when(_holds(low, TEST_PARTS), "test").when(name.isin("cmakelists.txt", "qmldir") | ext.isin(*PROJECT_SUFFIXES), "project").when(ext.isin(*CONFIG_SUFFIXES), "data").when(ext.isin(*STYLE_SUFFIXES), "style")
    return out.when(ext == ".md", "document").when(_holds(low, TOOL_PARTS), "tool").otherwise("source")


def snippet_priority(path: Column) -> Column:
    """What a path is worth as an example: names of entry files, then folders and suffixes."""
    low, name, ext = F.lower(F.regexp_replace(path, r"\\", "/")), P.file_name(path), P.extension(path)
    score = F.when(name.isin(*MAIN_FILES), 240).when(name.isin(*APP_FILES), 210).otherwise(0)
    for parts, worth in PATH_WORTH:
        score = score + F.when(_holds(low, parts), worth).otherwise(0)
    by_suffix = F.when(F.lit(False), 0)
    for suffixes, worth in SUFFIX_WORTH:
        by_suffix = by_suffix.when(ext.isin(*suffixes), worth)
    return score + by_suffix.otherwise(0)


def retrieved(paths: DataFrame) -> DataFrame:
    """(project_id, kind, place, path, priority): the readme and document at the top, two manifests, and the two source
    files that are worth most."""
    path, low, name = F.col("path"), F.lower("path"), P.file_name(F.col("path"))
    top = F.instr("path", "/") == 0
    kind = F.when(top & F.startswith(name, F.lit("readme")), "readme").when(F.startswith(low, F.lit("docs/")) & P.extension(path).isin(".md", ".rst", ".txt"), "document").when(top & P.is_manifest(name), "manifest").when(P.language(path) != "other", "snippet")
    rows = paths.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("priority", F.when(F.col("kind") == "snippet", snippet_priority(path)).otherwise(0))
    most = F.when(F.col("kind").isin("readme", "document"), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("project_id", "kind").orderBy(F.desc("priority"), "path"))
    return rows.withColumn("place", place).where((F.col("place") <= 2) & (F.col("place") <= most)).select("project_id", "kind", "place", "path", "priority")


def preview_scores(scored: DataFrame) -> DataFrame:
    """(…, worth): what each line is worth in a preview. scored: project_id, path, line_no, line, block. Blank lines and
    lines of brackets or comments are left out."""
    text = F.trim(F.regexp_replace("line", r"\s+", " "))
    low = F.lower(text)
    rows = scored.withColumn("text", text).where("text <> ''").where(~F.col("text").rlike(r"^(?:[{}()\[\];,]+|//.*|/\*.*|\*.*|#(?!include|define).*)$"))
    declares = F.col("text").rlike(r"^(?:export |public |private |protected |static |async |abstract |final )*(?:class|struct|enum|interface|namespace|def|function|type) +[A-Za-z_]|^[A-Za-z_][\w:<>,&* ]* [A-Za-z_~][\w:]*\([^;]*\)[^;]*\{$")
    stem = F.lower(P.stem(F.substring_index("path", "/", -1)))
    own = (F.length(stem) >= 3) & F.contains(low, stem)
    worth = F.when(declares, 69).otherwise(0) + F.when(own, 55).otherwise(0) + F.when(low.rlike(r"^return | return "), 10).otherwise(0) + F.when(F.contains(text, F.lit("{")), 5).otherwise(0) + F.when(F.contains(text, F.lit("::")), 12).otherwise(0)
    worth = worth + F.when(F.startswith(low, F.lit("export ")), 42).otherwise(0) - F.when(F.col("line_no") <= 12, 6).otherwise(0) + F.col("block")
    return rows.withColumn("worth", worth.cast("bigint")).select("project_id", "path", "line_no", "worth")


def project_line_scores(lines: DataFrame) -> DataFrame:
    """(project_id, path, line_no, worth) of the lines of project files (project_id, path, line_no, line): what their
    beginning or words say by the kind of file; comments −20, blank lines and other files are left out."""
    name, ext, text = P.file_name(F.col("path")), P.extension(F.col("path")), F.lower(F.trim("line"))
    kind = F.when((name == "cmakelists.txt") | (ext == ".cmake"), "cmake").when(ext.isin(".pro", ".pri"), "qmake").when(ext == ".qbs", "qbs").when(name == "qmldir", "qmldir").when(ext == ".ui", "ui").when(ext == ".rc", "rc").when(ext == ".qrc", "qrc").when(ext.isin(".s", ".asm"), "asm").when(ext == ".def", "def")
    rows = lines.withColumn("kind", kind).withColumn("text", text).where("kind IS NOT NULL AND text <> ''")
    t, score = F.col("text"), F.lit(0)
    for name_, (starts, a, words, b) in PROJECT_LINES.items():
        score = score + F.when(F.col("kind") == name_, F.when(_begins(t, starts), a).otherwise(0) + F.when(_holds(t, words), b).otherwise(0)).otherwise(0)
    files = F.when(_begins(t, ["<qresource"]), 120).when(_begins(t, ["<file"]), F.when(_holds(t, [".qml", ".png", ".svg"]), 118).otherwise(98)).otherwise(0)
    score = score + F.when(F.col("kind") == "qrc", files).otherwise(0)
    score = score + F.when((F.col("kind") == "asm") & (F.endswith(t, F.lit(":")) | _begins(t, [".globl ", ".global ", ".section ", "global ", "extern "]) | _holds(t, [" proc"])), 92).otherwise(0)
    score = score + F.when((F.col("kind") == "def") & (_begins(t, ["library ", "exports", "description "]) | (~_begins(t, [";"]) & _holds(t, ["@"]))), 92).otherwise(0)
    score = F.when(_begins(t, ["//", "# ", "<!--"]), -20).otherwise(score + F.when((score > 0) & (F.col("line_no") <= 40), 12).otherwise(0))
    return rows.select("project_id", "path", "line_no", score.alias("worth"))


def qml_entries(files: DataFrame) -> DataFrame:
    """Distinct (project_id, path, entry) of the entry files that QML project files name."""
    rows = files.where("content IS NOT NULL").withColumn("entry", F.explode(F.regexp_extract_all("content", F.lit(r'\bmain(?:Ui)?File\s*:\s*"([^"]+)"'), F.lit(1))))
    return rows.select("project_id", "path", "entry").distinct()


def merge_pairs(paths: DataFrame) -> DataFrame:
    """Distinct (project_id, match, target): folders include and src that stand side by side in a folder of depth one or
    two, to be one module with it."""
    dirs = F.slice(P.segments(P.parent(F.col("path"))), 1, 3)
    prefixes = F.transform(F.sequence(F.lit(2), F.size(dirs)), lambda i: F.array_join(F.slice(dirs, 1, i), "/"))
    found = paths.where(F.size(dirs) >= 2).select("project_id", F.explode(prefixes).alias("match")).distinct()
    found = found.withColumn("target", P.parent(F.col("match"))).where(F.substring_index("match", "/", -1).isin("include", "src"))
    return found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("project_id", "target"))).where("n = 2").select("project_id", "match", "target")


def choices(roots: DataFrame, entries: DataFrame, scopes: DataFrame) -> DataFrame:
    """(project_id, choice, option, rule, match, value, chosen): what a user may decide, each option with its effect (a
    rule, null for none), and whether it is the one proposed.

    roots: project_id, folder, kind; entries: project_id, prefix; scopes: project_id, scope, role (presentation or web).
    Of the scopes and entries the first of CHOICES by name are offered."""
    def offer(df: DataFrame, name: Column, option: str, rule: str, value: str) -> DataFrame:
        effect = F.array(F.struct(F.lit(option).alias("option"), F.lit(rule).alias("rule"), F.lit(value).alias("value"), F.lit(True).alias("chosen")), F.struct(F.lit("keep").alias("option"), F.lit(None).cast("string").alias("rule"), F.lit("").alias("value"), F.lit(False).alias("chosen")))
        return df.select("project_id", name.alias("choice"), "at", F.inline(effect)).select("project_id", "choice", "option", "rule", F.col("at").alias("match"), "value", "chosen")

    def first(df: DataFrame, most: int) -> DataFrame:
        return df.distinct().withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy("at"))).where(F.col("r") <= most).drop("r")

    folders = lambda kind: roots.where(F.col("kind") == kind).select("project_id", F.col("folder").alias("at"))
    role = lambda r: first(scopes.where(F.col("role") == r).select("project_id", F.col("scope").alias("at")), CHOICES[r])
    each = lambda prefix: F.concat(F.lit(prefix), "at")
    parts = [
        offer(folders("generated"), each("generated:"), "ignore", "ignore", ""), offer(folders("optional"), F.lit("optional-ignore"), "ignore", "ignore", ""),  # one choice for all of these
        offer(role("presentation"), each("presentation:"), "presentation", "role", "presentation"), offer(role("web"), each("web:"), "web", "role", "web"),
        offer(first(entries.where("prefix <> ''").select("project_id", F.col("prefix").alias("at")), CHOICES["entry"]), each("entry:"), "entry", "entry", "true"),
    ]
    return reduce(DataFrame.unionByName, parts)


def select_options(offered: DataFrame, selected: DataFrame) -> DataFrame:
    """choices() with `chosen` as a user's selection (project_id, choice, option) has it; choices and options that are not
    offered change nothing, and a choice without a selection keeps its proposal."""
    picks = selected.join(offered.select("project_id", "choice", "option").distinct(), ["project_id", "choice", "option"], "left_semi").groupBy("project_id", "choice").agg(F.max("option").alias("pick"))
    return offered.join(picks, ["project_id", "choice"], "left").withColumn("chosen", F.coalesce(F.col("option") == F.col("pick"), F.col("chosen"))).drop("pick")


def draft_rules(base: DataFrame, offered: DataFrame) -> DataFrame:
    """Distinct (project_id, rule, match, value): the base rules and the effects of the chosen options."""
    return base.unionByName(offered.where("chosen AND rule IS NOT NULL").select("project_id", "rule", "match", "value")).distinct()


_TREE = "project_id string, path string, node_no int, parent_no int, kind string, name string, start_line int, end_line int, depth int"


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for p, path, text in zip(pdf["project_id"], pdf["path"], pdf["content"]):
            out += [(p, path, *row) for row in cpp_facts.tree(text)]
            if len(out) >= 50_000:
                yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _TREE.split(", ")])
                out = []
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _TREE.split(", ")])


def syntax_tree(files: DataFrame) -> DataFrame:
    """The scopes of C and C++ files as rows: the file is node 0 of depth 0; namespaces, types, functions, blocks and
    calls are below what holds them."""
    body = files.where(P.extension(F.col("path")).isin(*P.CPP) & F.col("content").isNotNull())
    return body.select("project_id", "path", "content").mapInPandas(_trees, _TREE)


def tree_sizes(tree: DataFrame) -> DataFrame:
    return tree.groupBy("project_id", "path").agg(F.count(F.lit(1)).alias("nodes"), (F.max("depth") + 1).alias("depth"))


def tree_dump(tree: DataFrame, most_depth: int = 4, most_children: int = 24) -> DataFrame:
    """(project_id, path, node_no, line): the tree as text down to a depth and to so many children of each node; what is
    below a node that is left out is left out too. A node with more children says how many more."""
    t = tree.where(F.col("depth") <= most_depth).withColumn("nth", F.row_number().over(Window.partitionBy("project_id", "path", "parent_no").orderBy("node_no")))
    holder = lambda df: df.select(F.col("project_id").alias("p"), F.col("path").alias("q"), F.col("node_no").alias("holder"))
    same = F.col("project_id").eqNullSafe(F.col("p")) & (F.col("path") == F.col("q"))
    out, level = [], t.where("depth = 0")
    for depth in range(most_depth):
        out.append(level)
        level = t.where((F.col("depth") == depth + 1) & (F.col("nth") <= most_children)).join(holder(level), same & (F.col("parent_no") == F.col("holder")), "left_semi")
    kept = reduce(DataFrame.unionByName, [*out, level])
    c = holder(tree.where("parent_no IS NOT NULL").select("project_id", "path", F.col("parent_no").alias("node_no"))).groupBy("p", "q", "holder").agg(F.count(F.lit(1)).alias("children"))
    j = kept.join(c, same & (F.col("node_no") == F.col("holder")), "left").fillna(0, ["children"])
    shown = F.when(F.col("depth") < most_depth, F.least("children", F.lit(most_children))).otherwise(0)
    more = F.when(F.col("children") > shown, F.concat(F.lit(" ... "), (F.col("children") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return j.select("project_id", "path", "node_no", F.concat(F.repeat(F.lit("  "), F.col("depth")), "kind", F.when(F.col("name") != "", F.concat(F.lit(" "), "name")).otherwise(""), F.lit(" ["), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("]"), more).alias("line"))


def tree_previews(tree: DataFrame, scored: DataFrame, n: int = 3) -> DataFrame:
    """(project_id, path, place, name, kind, start_line, worth): the n declarations of a file that are worth most: by kind,
    by the branch signs between their lines, by the file's own name. scored: project_id, path, line_no, score."""
    t = tree.where("kind IN ('class', 'struct', 'enum', 'function', 'method') AND name <> ''")
    # running sums tell the signs between two lines without joining lines to ranges
    s = scored.withColumn("upto", F.sum("score").over(Window.partitionBy("project_id", "path").orderBy("line_no"))).select("project_id", "path", "line_no", "score", "upto")
    at = lambda line, name: s.select(F.col("project_id").alias(f"{name}p"), F.col("path").alias(f"{name}q"), F.col("line_no").alias(f"{name}l"), F.col("upto").alias(f"{name}u"), F.col("score").alias(f"{name}s"))
    a, b = at("start_line", "a"), at("end_line", "b")
    j = t.join(a, t["project_id"].eqNullSafe(a["ap"]) & (t["path"] == a["aq"]) & (t["start_line"] == a["al"])).join(b, t["project_id"].eqNullSafe(b["bp"]) & (t["path"] == b["bq"]) & (t["end_line"] == b["bl"]))
    signs = F.col("bu") - F.col("au") + F.col("as")
    stem = F.lower(P.stem(F.substring_index("path", "/", -1)))
    base = F.when(F.col("kind").isin("class", "struct"), 60).when(F.col("kind") == "enum", 30).otherwise(50)
    worth = (base + F.least(signs * 4, F.lit(80)) + F.when((F.length(stem) >= 3) & (F.lower("name") == stem), 52).otherwise(0)).cast("bigint")
    ranked = j.withColumn("worth", worth).withColumn("place", F.row_number().over(Window.partitionBy("project_id", "path").orderBy(F.desc("worth"), "start_line", "node_no")))
    return ranked.where(F.col("place") <= n).select("project_id", "path", "place", "name", "kind", "start_line", "worth")


def reply_lookup(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (…, url, payload) with key, the SHA-256 of both, and the reply stored under it (stored: key, reply), null if
    there is none."""
    key = F.sha2(F.concat_ws("\n", F.coalesce("url", F.lit("")), F.coalesce("payload", F.lit(""))), 256)
    return requests.withColumn("key", key).join(stored, "key", "left")
