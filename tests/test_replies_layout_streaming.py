import random

from pyspark.sql import functions as F

from cartolith.functions import replies
from cartolith.operators import layout, overview
from cartolith.streaming import incremental


def test_first_object_minds_strings_and_escapes():
    f = replies.first_object
    assert f('say {"a": "}\\"{", "b": {"c": 1}} and {"d": 2}') == '{"a": "}\\"{", "b": {"c": 1}}'
    assert f("none") is None and f(None) is None and f("x { open") == "{ open"


def test_message_shapes(spark):
    rows = [('{"choices":[{"message":{"content":"a"}}]}',), ('{"choices":[{"message":{"content":[{"type":"text","text":"b"},{"type":"text","text":"c"}]}}]}',), ('{"output_text":"d"}',), ('{"candidates":[{"content":{"parts":[{"text":"e"}]}}]}',), ('{"data":{"data":{"content":"f"}}}',), ("not json",), (None,)]
    df = spark.createDataFrame(rows, "r string")
    assert [r[0] for r in df.select(replies.message_content(F.col("r"))).collect()] == ["a", "b\nc", "d", "e", "f", None, None]


def test_insight_and_annotations(spark):
    df = spark.createDataFrame([('```json\n{"summary": "s", "steps": [" a ", "", "a", "b"], "nodes": [{"id": 1, "label": "x"}, {"id": "2", "summary": " y "}, {"id": 3}, {"label": "z"}]}\n```',)], "t string")
    r = df.select(replies.insight(F.col("t")).alias("i")).first().i
    assert (r.summary, r.steps, r.risks) == ("s", ["a", "b"], None)
    assert {tuple(x) for x in replies.annotations(df, "t").collect()} == {(1, "x", ""), (2, "", "y")}
    nodes = spark.createDataFrame([(1, "old"), (2, "keep")], "id bigint, label string")
    assert {tuple(x) for x in replies.annotate(nodes, replies.annotations(df, "t"), "id", ["label"]).collect()} == {(1, "x"), (2, "keep")}


def test_islands(spark):
    df = spark.createDataFrame([("a", 0, 5, 1), ("a", 3, 4, 2), ("a", 7, 9, 3), ("a", 20, 21, 4), ("b", 0, 1, 5)], "k string, s int, e int, id int")
    assert {r.id: r.island for r in layout.islands(df, ["k"], "s", "e", ["id"], 2).collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1}


def test_segment_hits_match_brute_force(spark):
    rnd = random.Random(1)
    rects = [(i, float(x := rnd.randrange(0, 2000)), float(y := rnd.randrange(0, 900)), x + 220.0, y + 92.0) for i in range(40)]
    segs = []
    for i in range(60):
        x, y, n = rnd.randrange(-200, 2200), rnd.randrange(-100, 1000), rnd.randrange(0, 1200)
        segs.append((str(i), float(x), float(y), float(x + n), float(y)) if i % 2 else (str(i), float(x), float(y + n), float(x), float(y)))
    want = {}
    for s, x1, y1, x2, y2 in segs:
        for r, left, t, rr, b in rects:
            dx = min(max(x1, x2), rr + 6) - max(min(x1, x2), left - 6)
            dy = min(max(y1, y2), b + 6) - max(min(y1, y2), t - 6)
            if dx >= 0 and dy >= 0:
                want[s, r] = max(dx, dy)
    got = layout.segment_hits(spark.createDataFrame(segs, "seg string, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(rects, "rect int, left double, top double, right double, bottom double"), 6.0)
    assert {(r.seg, r.rect): r.length for r in got.collect()} == want


def test_long_segments_are_not_cut_into_every_cell(spark):
    far = 1e13
    rects = [(i, x, y, x + 220, y + 92) for i, (x, y) in enumerate([(0.0, 0.0), (0.0, far / 3), (320.0, 140.0), (far / 2, 1400.0), (-far, -500.0), (far, 280.0)])]
    segs = [("rail", 248.0, -far, 248.0, far), ("column", 100.0, far, 100.0, 0.0), ("row", -1000.0, 1446.0, far, 1446.0), ("end", 226.0, 50.0, far, 50.0), ("point", 330.0, 150.0, 330.0, 150.0), ("short", 331.0, 20.0, 331.0, 134.0), ("miss", 331.0, 20.0, 331.0, 133.0)]
    got = layout.segment_hits(spark.createDataFrame([(s[0], s[0] + "!", *s[1:]) for s in segs], "seg string, other string, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(rects, "rect int, left double, top double, right double, bottom double"), 6.0).collect()
    assert len(got) == 6 and all(r.other == r.seg + "!" for r in got)
    assert {(r.seg, r.rect): r.length for r in got} == {("column", 0): 98.0, ("column", 1): 104.0, ("row", 3): 232.0, ("end", 0): 0.0, ("point", 2): 0.0, ("short", 2): 0.0}
    none = spark.createDataFrame([], "seg string, x1 double, y1 double, x2 double, y2 double")
    assert layout.segment_hits(none, spark.createDataFrame(rects, "rect int, left double, top double, right double, bottom double"), 6.0).count() == 0


def test_capped_edges_are_greedy(spark):
    rnd = random.Random(2)
    edges = [("p", rnd.randrange(9), rnd.randrange(9), rnd.randrange(50)) for _ in range(90)]
    edges = list({(p, f, t): (p, f, t, w) for p, f, t, w in edges}.values())
    taken, outs, ins = [], {}, {}
    for _, f, t, w in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        if len(taken) < 18 and outs.get(f, 0) < 4 and ins.get(t, 0) < 4:
            taken.append((f, t))
            outs[f], ins[t] = outs.get(f, 0) + 1, ins.get(t, 0) + 1
    got = layout.capped_edges(spark.createDataFrame(edges, "p string, f bigint, t bigint, w bigint"), "p").orderBy("lane").collect()
    assert [(r.f, r.t) for r in got] == taken


def test_roles_and_noise(spark):
    zero = {f"{k}_files": 0 for k in ("cpp", "qml", "web", "script", "data")} | {f"{k}_count": 0 for k in overview.COUNTED}
    cases = [("vendor/zlib", {"cpp_files": 1}, "dependency"), ("a/store repo", {"script_files": 1}, "storage"), ("a/router", {"script_files": 1}, "interaction"), ("x/parser", {"cpp_files": 1}, "analysis"), ("zzz", {"data_files": 2}, "data"), ("zzz", {"class_count": 1}, "type_centric"), ("zzz", {"function_count": 1}, "procedure_centric")]
    for evidence, counts, want in cases:
        row = spark.createDataFrame([{**zero, **counts, "evidence": evidence}])
        assert row.select(overview.role(F.col("evidence"), F.lit(False))).first()[0] == want, evidence
    r = spark.range(1).select(overview.noise_class(F.lit("Tests\\a")).alias("t"), overview.noise_class(F.lit("src/gen/a")).alias("g"), overview.noise_class(F.lit("src/a")).alias("n")).first()
    assert (r.t, r.g, r.n) == ("test", "generated", None)


def test_refresh_extracts_only_what_changed(spark):
    schema = "project_id string, path string, length bigint, modification_time int"
    old = spark.createDataFrame([("p", "a", 1, 1), ("p", "b", 2, 1), ("p", "gone", 1, 1), (None, "n", None, None)], schema)
    new = spark.createDataFrame([("p", "a", 1, 1), ("p", "b", 2, 2), ("p", "c", 3, 1), (None, "n", None, None)], schema)
    assert {r.path for r in incremental.changed(new, old).collect()} == {"b", "c"} and {r.path for r in incremental.removed(new, old).collect()} == {"gone"}
    facts = spark.createDataFrame([("p", x, f"old {x}") for x in ("a", "b", "gone")], "project_id string, path string, fact string")
    out = incremental.refreshed(facts, new, old, lambda df: df.select("project_id", "path", F.concat(F.lit("new "), "path").alias("fact")))
    assert {r.fact for r in out.collect()} == {"old a", "new b", "new c"}


def test_stream_of_new_files(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("import os\n")
    run = lambda: incremental.sink_facts(incremental.watch(spark, str(root), "p"), lambda df: df.select("project_id", "path", F.length("content").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (root / "b.py").write_text("x")
    run()
    assert {(r.path, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.py", 10), ("b.py", 1)}
