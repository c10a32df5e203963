"""Graph operators over edges (f, t[, w]).

A graph of no more than ONE_TASK counted rows is settled by one task. A larger one takes loops of joins: each round is
written to shared storage, so the plan stays one round long and a lost executor costs no recomputation of earlier rounds,
and a round only moves what changed. Both ways give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.runtime import ONE_TASK, Staged, in_one_task


def _fits(*parts: Staged) -> bool:
    return sum(p.count() for p in parts) <= ONE_TASK


def _follow(edges: list[tuple]) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for f, *rest in edges:
        out.setdefault(f, []).append(tuple(rest))
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree): both from one aggregate over the ends."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("f").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("t").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def _reach_here(steps: list[tuple], seeds: list[tuple]) -> list[tuple]:
    after, hops = _follow(steps), {i: 0 for (i,) in seeds}
    front = list(hops)
    while front:
        ahead = []
        for f in front:
            for (t,) in after.get(f, ()):
                if t not in hops:
                    hops[t] = hops[f] + 1
                    ahead.append(t)
        front = ahead
    return list(hops.items())


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, hops): what can be reached from the seeds (id), with the least number of steps."""
    steps = Staged(edges.select("f", "t").distinct(), "steps")
    seen = Staged(seeds.select("id").distinct().withColumn("hops", F.lit(0)), "reach")
    if _fits(steps, seen):
        return in_one_task({"steps": steps.df, "seeds": seen.df.select("id")}, _reach_here, f"id {dict(seen.df.dtypes)['id']}, hops int")
    hop = 0
    while True:
        front = seen.df.where(F.col("hops") == hop)
        new = front.join(steps.df, front["id"] == steps.df["f"]).select(F.col("t").alias("id")).distinct().join(seen.df, "id", "left_anti").withColumn("hops", F.lit(hop + 1))
        found = Staged(new, "front")
        if not found.count():
            found.drop()
            return seen.df
        merged = Staged(seen.df.unionByName(found.df), "reach")
        seen.drop()
        found.drop()
        seen, hop = merged, hop + 1


def _trimmed(edges: Staged) -> Staged:
    """Edges whose ends both have edges in and out; others lie on no cycle."""
    while True:
        n = edges.count()
        if not n:
            return edges
        sources, targets = edges.df.select(F.col("f").alias("x")).distinct(), edges.df.select(F.col("t").alias("x")).distinct()
        both = sources.join(targets, "x", "left_semi")
        less = Staged(edges.df.join(both, edges.df["f"] == both["x"], "left_semi").join(both, F.col("t") == both["x"], "left_semi"), "trim")
        if less.count() == n:
            less.drop()
            return edges
        edges.drop()
        edges = less


def _spread(edges: DataFrame, start: DataFrame) -> Staged:
    """(id, c): the largest c that reaches id along edges."""
    state = Staged(start, "colour")
    while True:
        arriving = edges.join(state.df, edges["f"] == state.df["id"]).groupBy("t").agg(F.max("c").alias("a"))
        new = Staged(state.df.join(arriving, state.df["id"] == arriving["t"], "left").select("id", F.greatest("c", F.coalesce("a", "c")).alias("c"), (F.coalesce("a", "c") > F.col("c")).alias("moved")), "colour")
        state.drop()
        state = Staged(new.df.drop("moved"), "colour")
        done = new.df.where("moved").isEmpty()
        new.drop()
        if done:
            return state


def _components_here(nodes: list[tuple], edges: list[tuple]) -> list[tuple]:
    """By two depth-first walks: along the edges for the order of leaving, then against them in that order."""
    after, before = _follow(edges), _follow([(t, f) for f, t in edges])
    left, seen = [], set()
    for start in [*after]:
        stack = [(start, iter(after[start]))] if start not in seen else []
        seen.add(start)
        while stack:
            at, rest = stack[-1]
            for (t,) in rest:
                if t not in seen:
                    seen.add(t)
                    stack.append((t, iter(after.get(t, ()))))
                    break
            else:
                left.append(at)
                stack.pop()
    component: dict[int, int] = {}
    for start in reversed(left):
        if start in component:
            continue
        members, waiting = [start], [start]
        component[start] = start
        while waiting:
            for (f,) in before.get(waiting.pop(), ()):
                if f in seen and f not in component:
                    component[f] = start
                    members.append(f)
                    waiting.append(f)
        least = min(members)
        for m in members:
            component[m] = least
    return [(i, component.get(i, i)) for (i,) in nodes]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components, named by their smallest node.

    Nodes on no cycle are trimmed. Among the rest every node takes the largest id that reaches it; a node that keeps
    its own id is its colour's root, and the nodes of the colour that reach the root are its component. They leave,
    and the rest goes on."""
    left = Staged(edges.where("f <> t").select("f", "t").distinct(), "scc")
    own = Staged(nodes.select("id").distinct(), "ids")
    if _fits(left, own):
        return in_one_task({"nodes": own.df, "edges": left.df}, _components_here, "id bigint, component bigint")
    left = _trimmed(left)
    parts: list[DataFrame] = []
    while left.count():
        ids = left.df.select(F.col("f").alias("id")).distinct()
        colour = _spread(left.df, ids.withColumn("c", F.col("id")))
        cf, ct = colour.df.select(F.col("id").alias("f"), F.col("c").alias("cf")), colour.df.select(F.col("id").alias("t"), F.col("c").alias("ct"))
        inside = Staged(left.df.join(cf, "f").join(ct, "t").where("cf = ct").select(F.col("t").alias("f"), F.col("f").alias("t")), "inside")  # reversed
        back = reach(inside.df, colour.df.where("id = c").select("id"))
        member = Staged(back.select("id").join(colour.df, "id"), "member")
        parts.append(member.df)
        rest = Staged(left.df.join(member.df.select(F.col("id").alias("f")), "f", "left_anti").join(member.df.select(F.col("id").alias("t")), "t", "left_anti"), "scc")
        left.drop()
        left = _trimmed(rest)
    if not parts:
        return own.df.withColumn("component", F.col("id"))
    cyclic = parts[0]
    for p in parts[1:]:
        cyclic = cyclic.unionByName(p)
    named = cyclic.join(cyclic.groupBy("c").agg(F.min("id").alias("component")), "c").select("id", "component")
    return own.df.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def condense(edges: DataFrame, component: DataFrame) -> DataFrame:
    """(f, t, w) between components, w the largest weight of an edge between them."""
    a, b = component.select(F.col("id").alias("f"), F.col("component").alias("cf")), component.select(F.col("id").alias("t"), F.col("component").alias("ct"))
    return edges.join(a, "f").join(b, "t").where("cf <> ct").groupBy(F.col("cf").alias("f"), F.col("ct").alias("t")).agg(F.max("w").alias("w"))


def _scores_here(nodes: list[tuple], edges: list[tuple]) -> list[tuple]:
    score = {i: base for i, base in nodes}
    after, open_before = _follow(edges), {}
    for f, t, _ in edges:
        if f in score:
            open_before[t] = open_before.get(t, 0) + 1
    free = [i for i in score if not open_before.get(i)]
    while free:
        f = free.pop()
        for t, w in after.get(f, ()):
            if t in score:
                score[t] = max(score[t], score[f] + w)
                open_before[t] -= 1
                if not open_before[t]:
                    free.append(t)
    return list(score.items())


def best_scores(nodes: DataFrame, edges: DataFrame, keep_path: bool = False) -> DataFrame:
    """(id, score[, path]): the largest sum of base and weights over the paths that end in a node of an acyclic graph.
    nodes: id, base; edges join them. The path goes over the smallest of the predecessors that give the score, and begins
    where the base alone does."""
    base = Staged(nodes.select("id", F.col("base").cast("bigint").alias("score")), "base")
    held = Staged(edges.select("f", "t", F.col("w").cast("bigint").alias("w")), "weighted")
    if _fits(base, held):
        scores = in_one_task({"nodes": base.df, "edges": held.df}, _scores_here, "id bigint, score bigint")
    else:
        state = Staged(base.df.withColumn("moved", F.lit(True)), "score")
        while not state.df.where("moved").isEmpty():
            front = state.df.where("moved").select(F.col("id").alias("f"), "score")
            arriving = front.join(held.df, "f").groupBy("t").agg(F.max(F.col("score") + F.col("w")).alias("s"))
            better = F.coalesce(F.col("s") > F.col("score"), F.lit(False))
            new = Staged(state.df.drop("moved").join(arriving, state.df["id"] == arriving["t"], "left").select("id", F.when(better, F.col("s")).otherwise(F.col("score")).alias("score"), better.alias("moved")), "score")
            state.drop()
            state = new
        scores = state.df.select("id", "score")
    return _with_paths(scores, base.df, held.df) if keep_path else scores


def _with_paths(scores: DataFrame, base: DataFrame, edges: DataFrame) -> DataFrame:
    """scores with `path`, over each node's predecessor of the best way; one round a step of the longest path."""
    ends = scores.join(base.select("id", F.col("score").alias("alone")), "id").where("score > alone").select(F.col("id").alias("t"), "score")
    before = edges.join(ends, "t").join(scores.select(F.col("id").alias("f"), F.col("score").alias("fs")), "f").where("fs + w = score").groupBy("t").agg(F.min("f").alias("f"))
    way = Staged(before, "before").df
    front = Staged(scores.join(way, scores["id"] == way["t"], "left_anti").select("id", "score", F.array("id").alias("path")), "path")
    done = [front.df]
    while front.count():
        longer = front.df.select(F.col("id").alias("f"), "path").join(way, "f").join(scores, F.col("t") == scores["id"])
        front = Staged(longer.select("id", "score", F.concat("path", F.array("id")).alias("path")), "path")
        done.append(front.df)
    return reduce(DataFrame.unionByName, done)


def stages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, stage): the longest chain of predecessors in an acyclic graph."""
    return best_scores(nodes.select("id").withColumn("base", F.lit(0)), edges.withColumn("w", F.lit(1))).select("id", F.col("score").cast("int").alias("stage"))


def _placed_here(nodes: list[tuple], edges: list[tuple], seeds: list[tuple]) -> list[tuple]:
    component = dict(_components_here(nodes, [(f, t) for f, t in edges if f != t]))
    between = {(component[f], component[t]) for f, t in edges if f in component and t in component and component[f] != component[t]}
    stage = dict(_scores_here([(c, 0) for c in set(component.values())], [(f, t, 1) for f, t in between]))
    found = {i for i, _ in _reach_here(edges, seeds)}
    return [(i, c, stage[c], i in found) for i, c in component.items()]


def placed(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, component, stage, reachable): of each node its component, the stage of that among the components, and whether
    it can be reached from the seeds."""
    own, held, first = Staged(nodes.select("id").distinct(), "ids"), Staged(edges.select("f", "t", "w"), "edges"), seeds.select("id").distinct()
    if _fits(own, held):
        return in_one_task({"nodes": own.df, "edges": held.df.select("f", "t").distinct(), "seeds": first.join(own.df, "id", "left_semi")}, _placed_here, "id bigint, component bigint, stage int, reachable boolean")
    comp = Staged(components(own.df, held.df), "component").df
    stage = stages(comp.select(F.col("component").alias("id")).distinct(), Staged(condense(held.df, comp), "condensed").df)
    found = reach(held.df, first).select("id", F.lit(True).alias("reachable"))
    return comp.join(stage.withColumnRenamed("id", "component"), "component").join(found, "id", "left").select("id", "component", "stage", F.coalesce("reachable", F.lit(False)).alias("reachable"))


def _layers_here(nodes: list[tuple], edges: list[tuple]) -> list[tuple]:
    after, open_before = _follow(edges), {}
    for _, t in edges:
        open_before[t] = open_before.get(t, 0) + 1
    ids = {i for (i,) in nodes}
    free, layer, out = [i for i in ids if not open_before.get(i)], 0, {}
    while free:
        out.update(dict.fromkeys(free, layer))
        ahead = []
        for f in free:
            for (t,) in after.get(f, ()):
                open_before[t] -= 1
                if not open_before[t] and t in ids:
                    ahead.append(t)
        free, layer = ahead, layer + 1
    return [(i, out.get(i, layer)) for i in ids]


def peel_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer): round by round the nodes without an edge from a node that is left; what lies on or behind a cycle
    goes to one last layer."""
    left, layer, out = Staged(edges.where("f <> t").select("f", "t").distinct(), "layers"), 0, []
    rest = Staged(nodes.select("id").distinct(), "rest")
    if _fits(left, rest):
        return in_one_task({"nodes": rest.df, "edges": left.df}, _layers_here, "id bigint, layer int")
    while rest.count():
        free = rest.df.join(left.df.select(F.col("t").alias("id")).distinct(), "id", "left_anti")
        now = Staged(free, "layer")
        if not now.count():
            out.append(rest.df.withColumn("layer", F.lit(layer)))
            break
        out.append(now.df.withColumn("layer", F.lit(layer)))
        rest2 = Staged(rest.df.join(now.df, "id", "left_anti"), "rest")
        left2 = Staged(left.df.join(now.df.select(F.col("id").alias("f")), "f", "left_anti"), "layers")
        left.drop()
        left, rest, layer = left2, rest2, layer + 1
    result = out[0] if out else nodes.select("id").limit(0).withColumn("layer", F.lit(0))
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def merged_directions(edges: DataFrame) -> DataFrame:
    """(a, b, weight, forward, backward): one row per unordered pair."""
    return edges.where("f <> t").groupBy(F.least("f", "t").alias("a"), F.greatest("f", "t").alias("b")).agg(F.sum("w").alias("weight"), F.bool_or(F.col("f") < F.col("t")).alias("forward"), F.bool_or(F.col("f") > F.col("t")).alias("backward"))
