"""Small repositories from files to the graph."""

from collections import Counter

from pyspark.sql import functions as F

from cartolith.operators import graph
from cartolith.plans.analyze import analyze

WEB = {
    "server.js": "const routes = require('./src/routes/items')\nfunction start() { routes() }\n", "src/routes/items.js": "import svc from '../services/items.js'\nexport const list = (q) => svc(q)\n",
    "src/services/items.js": "import { Store } from '../store'\nexport class ItemService {}\n", "src/store/index.js": "export class Store {}\n", "package.json": "{}", "node_modules/x/i.js": "class Never {}",
}
CPP = {
    "app/main.cpp": '#include "engine.h"\n#include <vector>\nint main() { return core::run(1); }\n', "lib/engine.h": "namespace core { int run(int a); }\n",
    "lib/engine.cpp": '#include "engine.h"\nnamespace core { int helper() { return 1; }\nint run(int a) { return helper() + a; } }\n', "lib/moc_engine.cpp": "int x;",
}
PY = {"tool/cli.py": "import parser\nclass Cli:\n    pass\n", "tool/other.py": "def go():\n    pass\n", "parser/core.py": "from tool import cli\ndef parse(x):\n    return x\n"}


def _run(spark):
    rows = [(p, path, text) for p, repo in (("web", WEB), ("cpp", CPP), ("py", PY)) for path, text in repo.items()] + [("cpp", "lib/null.cpp", None)]
    a = analyze(spark.createDataFrame(rows, "project_id string, path string, content string"))
    return a.nodes.collect(), a.edges.collect()


def test_graphs(spark):
    nodes, edges = _run(spark)
    kinds = Counter((n.project_id, n.kind) for n in nodes)
    assert kinds["web", "file"] == 5 and kinds["cpp", "file"] == 4 and kinds["py", "file"] == 3
    for p in ("web", "cpp", "py"):
        assert sorted(n.id for n in nodes if n.project_id == p) == list(range(1, sum(c for (q, _), c in kinds.items() if q == p) + 1))
    assert len({(e.project_id, e.from_id, e.to_id, e.kind) for e in edges}) == len(edges) and all(e.from_id != e.to_id for e in edges)
    name = {(n.project_id, n.id): n.qualified_name for n in nodes}
    has = {(e.project_id, e.kind, name[e.project_id, e.from_id], name[e.project_id, e.to_id]) for e in edges}
    assert {("web", "includes", "server.js", "src/routes/items.js"), ("web", "includes", "src/routes/items.js", "src/services/items.js"), ("web", "includes", "src/services/items.js", "src/store/index.js")} <= has
    assert {("cpp", "includes", "app/main.cpp", "lib/engine.h"), ("cpp", "calls", "core::run", "core::helper"), ("cpp", "calls", "main", "core::run"), ("cpp", "depends_on", "app", "lib"), ("py", "includes", "tool/cli.py", "parser")} <= has
    assert ("py", "depends_on") not in {(e.project_id, e.kind) for e in edges}  # a module as target has no file


def test_stages_follow_dependencies(spark):
    nodes, edges = _run(spark)
    dep = [(e.from_id, e.to_id, e.weight) for e in edges if e.project_id == "web" and e.kind == "depends_on"]
    e = spark.createDataFrame(dep, "f bigint, t bigint, w bigint")
    ids = spark.createDataFrame([(n.id,) for n in nodes if n.project_id == "web" and n.kind == "module"], "id bigint")
    stage = {r.id: r.stage for r in graph.stages(ids, e).collect()}
    assert dep and all(stage[t] > stage[f] for f, t, _ in dep) and max(stage.values()) == 3
    assert ids.where(F.col("id") > 0).count() == len(stage)
