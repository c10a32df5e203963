"""Operators on literal graphs, paths and lines."""

import random

from pyspark.sql import functions as F

from cartolith.functions import paths as P
from cartolith.functions import text as T
from cartolith.operators import extract, graph, resolve, rollup, rules
from cartolith.sources import tables


def _g(spark, edges):
    return spark.createDataFrame([(a, b, w) for a, b, *r in edges for w in [r[0] if r else 1]], "f bigint, t bigint, w bigint")


def _n(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def _map(df, k="id"):
    return {r[k]: tuple(x for c, x in r.asDict().items() if c != k) for r in df.collect()}


def test_reach_chain_cycle_and_disconnected(spark):
    e = _g(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)])
    assert _map(graph.reach(e, _n(spark, [1]))) == {1: (0,), 2: (1,), 3: (2,), 4: (3,)}
    assert _map(graph.reach(e, _n(spark, []))) == {}


def test_components_are_mutual_reachability(spark):
    e = _g(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (6, 6), (5, 7), (7, 8), (8, 7), (9, 1)])
    assert {k: v[0] for k, v in _map(graph.components(_n(spark, range(1, 11)), e)).items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}
    comp = graph.components(_n(spark, range(1, 11)), e)
    assert {(r.f, r.t) for r in graph.condense(e, comp).collect()} == {(1, 3), (3, 7), (9, 1)}


def test_layers_put_cycles_last(spark):
    e = _g(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 4)])
    assert {k: v[0] for k, v in _map(graph.peel_layers(_n(spark, range(1, 6)), e)).items()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2}


def test_stage_and_heaviest_path(spark):
    e = _g(spark, [(1, 2, 5), (1, 3, 1), (3, 2, 1), (2, 4, 2)])
    assert {k: v[0] for k, v in _map(graph.stages(_n(spark, [1, 2, 3, 4]), e)).items()} == {1: 0, 2: 2, 3: 1, 4: 3}
    base = _n(spark, [1, 2, 3, 4]).withColumn("base", F.when(F.col("id") == 1, 1).otherwise(0))
    assert _map(graph.best_scores(base, e, True))[4] == (8, [1, 2, 4])


def test_degrees_sum_to_edges_and_directions_merge(spark):
    e = _g(spark, [(1, 2, 3), (2, 1, 4), (1, 3, 1)])
    d = _map(graph.degrees(e))
    assert sum(v[0] for v in d.values()) == sum(v[1] for v in d.values()) == 3
    assert {tuple(r) for r in graph.merged_directions(e).collect()} == {(1, 2, 7, True, True), (1, 3, 1, True, False)}


PATHS = [
    ("src/main/java/com/acme/shop/OrderService.java", "src/main/shop"), ("src/main/java/com/acme/ShopApplication.java", "src/main/bootstrap"), ("src/parser/lexer.cpp", "src/parser"), ("src/tool.cpp", "src/tool"),
    ("vendor/zlib/z.c", "vendor"), ("README.md", "(root)"), ("docs", "docs"), ("lib/a.cpp", "lib"), ("x/src/net/a.cpp", "x/net"),
]


def test_module_inference(spark):
    p = spark.createDataFrame([("p", a) for a, _ in PATHS], "project_id string, path string")
    assert {r.path: r.module for r in rollup.infer_modules(p).collect()} == dict(PATHS)


def test_flat_folder_is_split_by_stem(spark):
    names = ["main.cpp", "alpha.cpp", "alpha.h", "beta.cpp", "gamma.cpp", "delta.cpp", "eps.cpp", "zeta.cpp"]
    p = spark.createDataFrame([("p", f"Tool/{n}") for n in names], "project_id string, path string")
    m = {r.path: r.module for r in rollup.infer_modules(p).collect()}
    assert m["Tool/main.cpp"] == "Tool" and m["Tool/alpha.h"] == "Tool/alpha" and m["Tool/zeta.cpp"] == "Tool/zeta"


def test_include_ladder_prefers_the_nearest_and_refuses_the_ambiguous(spark):
    p = spark.createDataFrame([("p", x) for x in ["a/x.h", "a/m.cpp", "b/x.h", "c/only.h", "inc/deep/y.h"]], "project_id string, path string")
    inc = spark.createDataFrame([("p", "a/m.cpp", n, t, s) for n, (t, s) in enumerate([("x.h", False), ("x.h", True), ("b/x.h", True), ("deep/y.h", False), ("../b/x.h", False), ("nowhere/only.h", True), ("none.h", False)])], "project_id string, path string, line_no int, target string, is_system boolean")
    got = {r.line_no: (r.resolved, r.rung) for r in resolve.resolve_includes(inc, p).collect()}
    assert got == {0: ("a/x.h", 1), 1: (None, None), 2: ("b/x.h", 2), 3: ("inc/deep/y.h", 3), 4: ("b/x.h", 1), 5: ("c/only.h", 4), 6: (None, None)}


def test_java_and_script_imports(spark):
    p = spark.createDataFrame([("p", x) for x in ["src/a/B.java", "src/a/C.java", "web/app.js", "web/lib/index.ts", "web/u.ts"]], "project_id string, path string")
    imp = spark.createDataFrame([("p", "x.java", "java", "a.B"), ("p", "x.java", "java", "a.*"), ("p", "x.java", "java", "a.B.inner"), ("p", "web/app.js", "javascript", "./lib"), ("p", "web/app.js", "javascript", "./u"), ("p", "web/app.js", "javascript", "./gone"), ("p", "web/app.js", "javascript", "react")], "project_id string, path string, language string, specifier string")
    java = {(r.specifier, r.resolved) for r in resolve.resolve_java_imports(imp, p).collect()}
    assert java == {("a.B", "src/a/B.java"), ("a.*", "src/a/B.java"), ("a.*", "src/a/C.java"), ("a.B.inner", "src/a/B.java")}
    script = {r.specifier: r.resolved for r in resolve.resolve_script_imports(imp, p).collect()}
    assert script == {"./lib": "web/lib/index.ts", "./u": "web/u.ts", "./gone": None}


def test_edge_merge_is_idempotent(spark):
    rows = [(1, 2, "calls", 3, 1, "inferred", 1), (1, 2, "calls", 4, 1, "semantic", 2), (1, 1, "calls", 9, 1, "semantic", 1), (0, 2, "calls", 1, 1, "inferred", 1), (None, 2, "calls", 1, 1, "inferred", 1)]
    e = spark.createDataFrame(rows, "from_id bigint, to_id bigint, kind string, weight bigint, support_count bigint, fact_source string, observed_at int")
    a = [tuple(r) for r in resolve.merge_edges(e, True).collect()]
    assert a == [(1, 2, "calls", 7, 2, "semantic")]
    assert [tuple(r) for r in resolve.merge_edges(e, False).collect()] == [(1, 2, "calls", 3, 1, "semantic")]
    assert [tuple(r) for r in resolve.merge_edges(resolve.merge_edges(e, True).withColumn("observed_at", F.lit(1)), True).collect()] == a


def test_rules(spark):
    p = spark.createDataFrame([("p", "src/a/x.cpp"), ("p", "srcs/y.cpp")], "project_id string, path string")
    r = spark.createDataFrame([(1, "src", "one"), (2, "./src/a/", "two")], "ord int, match string, role string")
    assert [(x.path, x.role) for x in rules.last_wins(p, r, "role", ["path"]).collect()] == [("src/a/x.cpp", "two")]
    assert [(x.path, x.role) for x in rules.first_wins(p, r, "role", ["path"]).collect()] == [("src/a/x.cpp", "one")]
    assert [x.path for x in rules.ignored(p, r).collect()] == ["srcs/y.cpp"]
    folded = rules.fold_merges(p.withColumn("module", F.lit("src")), [("src", "core"), ("core", "kernel")])
    assert [x.module for x in folded.collect()] == ["kernel", "kernel"]


def test_extractors(spark):
    lines = [("p", "a.cpp", 1, '#include "x/y.h"'), ("p", "a.cpp", 2, "#include <z>"), ("p", "a.cpp", 3, '#include "bad>'), ("p", "m.py", 1, "from ..pkg.sub import thing"), ("p", "m.py", 2, "import os.path as p, sys"), ("p", "J.java", 1, "import static a.b.C;"), ("p", "s.ts", 1, "import x from '@scope/pkg/deep';"), ("p", "s.js", 1, "const a = require('./q');"), ("p", "s.js", 2, "export const f = (x) => x;"), ("p", "m.py", 3, "class Foo(Bar):")]
    df = spark.createDataFrame(lines, "project_id string, path string, line_no int, line string")
    assert {(r.target, r.is_system) for r in extract.cpp_includes(df).collect()} == {("x/y.h", False), ("z", True)}
    assert {(r.name, r.specifier) for r in extract.imports(df).collect()} == {("pkg", "pkg"), ("os", "os"), ("C", "a.b.C"), ("@scope/pkg", "@scope/pkg/deep"), (".", "./q")}
    assert {(r.kind, r.name) for r in extract.symbols(df).collect()} == {("function", "f"), ("class", "Foo")}


def test_text_functions(spark):
    df = spark.createDataFrame([("src/core_model.v2", ["a", "b", "c"])], "s string, a array<string>")
    r = df.select(T.humanize(F.col("s")).alias("h"), T.split_camel(F.lit("loadHTTPNode2X")).alias("c"), T.first_k(F.col("a"), 2).alias("k"), T.first_k(F.array().cast("array<string>"), 2).alias("n"), T.ratio(F.lit(1), F.lit(3)).alias("p"), T.ratio(F.lit(1), F.lit(0)).alias("z"), T.strip_code_fence(F.lit('```json\n{"a": 1}\n```')).alias("f"), T.polynomial_hash(F.lit("ab")).alias("x")).first()
    assert (r.h, r.c, r.k, r.n, r.p, r.z, r.f, r.x) == ("Src Core Model V2", "load HTTPNode2 X".replace("HTTPNode", "HTTPNode"), "a, b, +1 more", "none", "33.3%", "0.0%", '{"a": 1}', 97 * 131 + 98)


def test_path_functions(spark):
    r = spark.range(1).select(P.normalize(F.lit("./a//b/../c\\d.h")).alias("n"), P.extension(F.lit("a.b/c")).alias("e"), P.pruned_at(F.lit("x/Build/y.cpp")).alias("p"), P.pruned_at(F.lit("x/vendor/y.cpp")).alias("q"), P.is_generated_name(F.lit("a/moc_x.cpp")).alias("g")).first()
    assert r.e == ".b/c" and r.p == "build" and r.q is None and r.g is True


def test_repository_scan_and_config(spark, tmp_path):
    (tmp_path / "repo/src").mkdir(parents=True)
    (tmp_path / "repo/src/a.cpp").write_text("int a;\n")
    scan = tables.scan_repository(spark, str(tmp_path / "repo"), "p")
    assert [(r.path, r.length, r.content) for r in scan.collect()] == [("src/a.cpp", 7, "int a;\n")]
    (tmp_path / "c.json").write_text('{"version": 1, "analysis": {"ignoreDirectories": ["x"], "moduleMerges": [{"match": "a", "module": "b"}]}}')
    row = tables.project_config(spark, str(tmp_path / "c.json")).first()
    assert row.version == 1 and row.ignoreDirectories == ["x"] and row.moduleMerges[0].module == "b"
    (tmp_path / "cc.json").write_text('[{"directory": "/r", "file": "a.cpp", "arguments": ["c++", "-c", "-Ifoo", "-o", "a.o", "-MF", "d", "a.cpp", "libz.a"]}, {"directory": "/r", "file": "/r/a.cpp", "command": "c++ -c a.cpp"}, {"directory": "/r", "file": "n.txt", "command": "x"}]')
    cc = tables.compile_commands(spark, str(tmp_path / "cc.json"))
    rows = cc.select("path", tables.sanitized_arguments(F.col("arguments")).alias("a")).collect()
    assert [r.path for r in rows] == ["/r/a.cpp"] and rows[0].a in (["c++", "-Ifoo", "a.cpp"], ["c++", "a.cpp"])


def test_paths_fold_however_many_steps_up(spark):
    deep = "/".join(f"d{k}" for k in range(12)) + "/" + "../" * 10 + "x.h"
    r = spark.range(1).select(P.normalize(F.lit(deep)).alias("a"), P.normalize(F.lit("../../a/b")).alias("b"), P.normalize(F.lit("a/../../b")).alias("c"), P.normalize(F.lit("./a/./b/../c")).alias("d"), P.normalize(F.lit(None).cast("string")).alias("e")).first()
    assert tuple(r) == ("d0/d1/x.h", "../../a/b", "../b", "a/c", None)


def test_calls_of_a_frequent_name_resolve_in_their_namespace(spark):
    nodes = spark.createDataFrame([("p", n, "get", f"n{n % 40}::t{n}::get") for n in range(80)] + [("p", 500, "only", "deep::inner::only")], "project_id string, id bigint, display_name string, qualified_name string")
    calls = spark.createDataFrame([(1, "p", "get", "", "n3::t3"), (2, "p", "get", "", "n3"), (3, "p", "only", "", "deep"), (4, "p", "only", "", ""), (5, "p", "get", "", "none")], "call_id bigint, project_id string, callee string, type_prefix string, namespace_prefix string")
    got = {r.call_id: (r.target, r.rung) for r in resolve.resolve_calls(calls, nodes).collect()}
    assert got == {1: (3, 3), 2: (None, None), 3: (500, 4), 4: (500, 5), 5: (None, None)}


def test_graphs_in_rounds_equal_one_task(spark, monkeypatch):
    rnd = random.Random(4)
    edges = _g(spark, [(rnd.randrange(14), rnd.randrange(14), rnd.randrange(1, 9)) for _ in range(22)]).groupBy("f", "t").agg(F.max("w").alias("w")).persist()
    acyclic, nodes, seeds = edges.where("f < t"), _n(spark, range(16)), _n(spark, [0, 3])
    base = nodes.withColumn("base", F.col("id") % 3)

    def settle():
        return [sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (graph.placed(nodes, edges, seeds), graph.components(nodes, edges), graph.reach(edges, seeds), graph.peel_layers(nodes, edges), graph.best_scores(base, acyclic, keep_path=True))]

    together = settle()
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert settle() == together
    assert graph.placed(nodes.limit(0), edges.limit(0), seeds.limit(0)).count() == 0
