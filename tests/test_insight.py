"""File insight, syntax trees, proposals and reports on small fixtures."""

from pyspark.sql import functions as F

from cartolith.operators import cpp_facts, insight
from cartolith.plans import report_queries as R

CODE = """#include "x.h"
namespace app {
class Reader {
public:
    int next() {
        if (ready()) { return step(1) && more(); }
        return 0;
    }
};
enum Mode { A, B };
}
int main() {
    return run();
}
"""


def _files(spark, rows):
    return spark.createDataFrame(rows, "project_id string, path string, content string")


def test_tree_of_scopes_and_calls():
    rows = cpp_facts.tree(CODE)
    assert [(k, n, a, b, d) for _, _, k, n, a, b, d in rows] == [
        ("file", "", 1, 15, 0), ("namespace", "app", 2, 11, 1), ("class", "Reader", 3, 9, 2), ("method", "next", 5, 8, 3), ("call", "ready", 6, 6, 4), ("block", "", 6, 6, 4), ("call", "step", 6, 6, 5), ("call", "more", 6, 6, 5),
        ("enum", "Mode", 10, 10, 2), ("function", "main", 12, 14, 1), ("call", "run", 13, 13, 2)]
    assert [p for _, p, *_ in rows] == [None, 0, 1, 2, 3, 3, 5, 5, 1, 0, 9]
    assert cpp_facts.tree("") == [(0, None, "file", "", 1, 1, 0)] and cpp_facts.tree("void f() {\n g();")[1][5] == 2
    assert cpp_facts.tree("} } int a() { }")[1][2:4] == ("function", "a")


def test_tree_sizes_dump_and_previews(spark):
    f = _files(spark, [("p", "src/reader.cpp", CODE), (None, "src/n.cpp", "int a() { }"), ("p", "b.py", "x"), ("p", "null.cpp", None), ("p", "many.cpp", "void f() {\n" + "g();\n" * 30 + "}\n")])
    tree = insight.syntax_tree(f).persist()
    assert {(r.path, r.nodes, r.depth) for r in insight.tree_sizes(tree).collect()} == {("src/reader.cpp", 11, 6), ("src/n.cpp", 2, 2), ("many.cpp", 32, 3)}
    dump = {(r.path, r.node_no): r.line for r in insight.tree_dump(tree, 2, 3).collect()}
    assert dump["src/reader.cpp", 0] == "file [1-15]" and dump["src/reader.cpp", 2] == "    class Reader [3-9] ... 1 more" and ("src/reader.cpp", 3) not in dump
    assert dump["many.cpp", 1] == "  function f [1-32] ... 27 more" and len([k for k in dump if k[0] == "many.cpp"]) == 5 and dump["src/n.cpp", 1] == "  function a [1-1]"
    scored = spark.createDataFrame([("p", "src/reader.cpp", n, 2 if n == 6 else 0) for n in range(1, 16)], "project_id string, path string, line_no int, score int")
    best = [(r.name, r.worth) for r in insight.tree_previews(tree, scored).orderBy("place").collect()]
    assert best == [("Reader", 60 + 8 + 52), ("next", 58), ("main", 50)]
    assert insight.tree_dump(tree.limit(0)).count() == 0


def test_labels_and_priorities(spark):
    paths = ["a/CMakeLists.txt", "x/tests/main.cpp", "apps/src/main.cpp", "/apps/src/main.cpp", "ui/a.qml", "t.unknown", "noext", "x/tool/run.py", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [tuple(r) for r in df.select(insight.language_label(F.col("path")), insight.category(F.col("path")), insight.snippet_priority(F.col("path"))).collect()]
    assert got[:8] == [("CMake", "project", 0), ("C++", "test", 240 + 12 - 80), ("C++", "source", 240 + 45 + 12), ("C++", "source", 240 + 60 + 45 + 12), ("QML", "style", 20), ("UNKNOWN", "source", 0), ("Unknown", "source", 0), ("Python", "tool", 12)]


def test_retrieval_takes_so_many_of_each_kind(spark):
    rows = [("p", x) for x in ("README.md", "readme.txt", "docs/a.md", "docs/b.md", "package.json", "pom.xml", "build.gradle", "src/main.cpp", "src/z.cpp", "src/index.ts", "tests/main.cpp")]
    got = {(r.kind, r.place, r.path) for r in insight.retrieved(spark.createDataFrame(rows, "project_id string, path string")).collect()}
    assert got == {("readme", 1, "README.md"), ("document", 1, "docs/a.md"), ("manifest", 1, "build.gradle"), ("manifest", 2, "package.json"), ("snippet", 1, "src/main.cpp"), ("snippet", 2, "tests/main.cpp")}


def test_lines_of_project_files(spark):
    rows = [("CMakeLists.txt", 1, "project(demo)"), ("CMakeLists.txt", 50, "  target_link_libraries(a Qt6::Core)"), ("CMakeLists.txt", 3, "// x"), ("CMakeLists.txt", 4, ""), ("a.pro", 2, "QT += core"), ("r.qrc", 2, "<file>a.qml</file>"), ("x.asm", 9, "start:"), ("m.def", 1, "EXPORTS"), ("qmldir", 1, "module Demo"), ("w.ui", 1, '<widget class="QDialog">'), ("a.cpp", 1, "project(x)")]
    df = spark.createDataFrame([("p", *r) for r in rows], "project_id string, path string, line_no int, line string")
    got = {(r.path, r.line_no): r.worth for r in insight.project_line_scores(df).collect()}
    assert got == {("CMakeLists.txt", 1): 132, ("CMakeLists.txt", 50): 148, ("CMakeLists.txt", 3): -20, ("a.pro", 2): 124, ("r.qrc", 2): 130, ("x.asm", 9): 104, ("m.def", 1): 104, ("qmldir", 1): 127, ("w.ui", 1): 138}


def test_qml_entries_merge_pairs_and_replies(spark):
    f = _files(spark, [("p", "a.qmlproject", 'Project {\n mainFile: "ui/App.qml"\n mainUiFile: "ui/Form.qml"\n}'), ("p", "b.qml", None), ("p", "c.qml", "Item {}")])
    assert {tuple(r) for r in insight.qml_entries(f).collect()} == {("p", "a.qmlproject", "ui/App.qml"), ("p", "a.qmlproject", "ui/Form.qml")}
    paths = spark.createDataFrame([("p", x) for x in ("lib/include/a.h", "lib/src/a.cpp", "apps/x/include/b.h", "apps/x/src/deep/b.cpp", "only/src/c.cpp", "src/d.cpp", "include/d.h", "a/b/c/src/e.cpp", "a/b/c/include/e.h")] + [(None, "lib/src/z.cpp")], "project_id string, path string")
    assert {(r.match, r.target) for r in insight.merge_pairs(paths).collect()} == {("lib/include", "lib"), ("lib/src", "lib"), ("apps/x/include", "apps/x"), ("apps/x/src", "apps/x")}
    r = spark.createDataFrame([(1, "u", "a"), (2, "u", None), (3, None, "a")], "id int, url string, payload string")
    keyed = insight.reply_lookup(r, spark.createDataFrame([], "key string, reply string"))
    stored = keyed.where("id = 1").select("key", F.lit("hit").alias("reply"))
    assert {(x.id, x.reply) for x in insight.reply_lookup(r, stored).collect()} == {(1, "hit"), (2, None), (3, None)}


def test_choices_are_selected_and_recomputed(spark):
    roots = spark.createDataFrame([("p", "gen", "generated"), ("p", "docs", "optional"), ("p", "tests", "optional"), ("p", "src", "source")], "project_id string, folder string, kind string")
    entries = spark.createDataFrame([("p", f"e{k}") for k in range(6)] + [("p", "")], "project_id string, prefix string")
    scopes = spark.createDataFrame([("p", f"ui{k}", "presentation") for k in range(5)] + [("p", "web", "web")], "project_id string, scope string, role string")
    offered = insight.choices(roots, entries, scopes).persist()
    assert offered.where("rule = 'entry'").count() == 4 and offered.where("value = 'presentation'").count() == 3 and offered.where("choice = 'optional-ignore' AND chosen").count() == 2
    base = spark.createDataFrame([("p", "ignore", "gen", "")], "project_id string, rule string, match string, value string")
    picked = spark.createDataFrame([("p", "optional-ignore", "keep"), ("p", "web:web", "nothing"), ("p", "unknown", "keep")], "project_id string, choice string, option string")
    rules = {(r.rule, r.match) for r in insight.draft_rules(base, insight.select_options(offered, picked)).collect()}
    assert rules == {("ignore", "gen"), ("role", "ui0"), ("role", "ui1"), ("role", "ui2"), ("role", "web"), *(("entry", f"e{k}") for k in range(4))}


def test_labels_of_capabilities(spark):
    rows = [("a", "Graph Store", ["x"], ["m"], ["a.cpp"], 5, True), ("b", "Misc", [], ["m"], ["a.css", "b.html"], 5, True), ("c", "Helpers", [], ["m"], ["a.cpp"], 5, True), ("d", "Zzz", [], ["m"], [], 5, True), ("e", "Quux", ["HttpThing"], ["m"], ["q"], 5, False)]
    df = spark.createDataFrame(rows, "cluster string, name string, symbols array<string>, modules array<string>, example_files array<string>, priority int, visible boolean")
    assert {r.cluster: (r.label, r.priority, r.visible) for r in R._label(df).collect()} == {"a": ("graph", 245, True), "b": ("web_assets", 5, True), "c": ("utilities", 0, False), "d": (None, 5, True), "e": ("network", 5, False)}
