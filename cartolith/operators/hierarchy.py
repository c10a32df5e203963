"""Parent-child rows to full hierarchies by Euler tours and parallel list ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.runtime import ONE_TASK, Staged, small_side

#: Blocks into which the children of one parent are spread, so that no family has to be sorted by one task.
SIBLING_BLOCKS = 64
#: Rounds of leaf peeling before the rest is settled by pointer doubling (depth would else be the number of rounds).
PEEL_ROUNDS = 3
#: One arc in so many is a stop of the list ranking.
STOP_EVERY = 32
#: Names of ancestors that a task holds before it passes them on.
WALK_NAMES = 200_000


def _numbered(symbols: DataFrame, scope: str, key: str, parent: str) -> DataFrame:
    """One row per (scope, key) with a 64-bit id; the parent is the largest non-empty one among its rows."""
    par = F.when(F.col(parent) != "", F.col(parent))
    one = symbols.where(F.col(key).isNotNull()).groupBy(F.col(scope).alias("scope"), F.col(key).alias("key")).agg(F.max(par).alias("parent_key"))
    return one.withColumn("id", F.monotonically_increasing_id())


def _linked(nodes: DataFrame) -> DataFrame:
    """(id, parent): the parent's id, null where there is none in the scope."""
    up = nodes.select(F.col("scope").alias("s"), F.col("key").alias("k"), F.col("id").alias("parent"))
    return nodes.join(up, F.col("scope").eqNullSafe(F.col("s")) & (F.col("parent_key") == F.col("k")), "left").select("id", "parent")


def _whole(batches: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    held = [pdf for pdf in batches if len(pdf)]
    return pd.concat(held, ignore_index=True) if held else pd.DataFrame({c: np.empty(0, np.int64) for c in columns})


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted id stands in ids, -1 where it does not."""
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids, wanted, sorter=order), max(len(ids) - 1, 0))
    if not len(ids):
        return np.full(len(wanted), -1)
    return np.where(ids[order[at]] == wanted, order[at], -1)


def _cycles_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_cycle_nodes by doubling in one task."""
    rest = _whole(batches, ["id", "parent"])
    ids = rest["id"].to_numpy(np.int64)
    jump, reach = _places(ids, rest["parent"].to_numpy(np.int64)), 1
    while reach <= len(ids):
        jump = np.where(jump >= 0, jump[jump], -1)
        reach *= 2
    yield pd.DataFrame({"id": ids[np.unique(jump[jump >= 0])]})


def _cycle_nodes(links: DataFrame) -> Staged:
    """Ids on cycles. Leaves (and nodes whose parent is settled) are peeled for a few rounds; what is left is
    settled by doubling: a node whose 2^k-th ancestor exists for 2^k beyond the number of nodes that were not peeled
    is on or below a cycle, and the targets of these jumps are exactly the nodes on cycles."""
    rest = Staged(links.where(F.col("parent").isNotNull()), "peel")
    left = rest.count()
    for _ in range(PEEL_ROUNDS):
        if left <= ONE_TASK:
            break
        parents = rest.df.select(F.col("parent").alias("id")).distinct()
        ids = rest.df.select(F.col("id").alias("parent"))
        new = Staged(rest.df.join(parents, "id", "left_semi").join(ids, "parent", "left_semi").select("id", "parent"), "peel")
        rest.drop()
        before, rest = left, new
        left = rest.count()
        if left == before:
            break
    if left <= ONE_TASK:
        cycles = Staged(rest.df.repartition(1).mapInPandas(_cycles_here, "id bigint"), "cycles")
        rest.drop()
        return cycles
    jumps, reach, longest = Staged(rest.df.select("id", F.col("parent").alias("jump")), "jump"), 1, left
    while left and reach <= longest:
        hop = jumps.df.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        new = Staged(jumps.df.join(hop, "jump").select("id", F.col("next").alias("jump")), "jump")
        jumps.drop()
        jumps, reach = new, reach * 2
        left = jumps.count()
    cycles = Staged(jumps.df.select(F.col("jump").alias("id")).distinct(), "cycles")
    rest.drop()
    jumps.drop()
    return cycles


def _tour(forest: DataFrame) -> DataFrame:
    """Arcs (arc, nxt, w) of the Euler tours: arc 2*id enters a node (+1), arc 2*id+1 leaves it (-1).

    Siblings are ordered by (block, id): a window within (parent, block) links neighbours, and the last rows of the
    blocks, at most SIBLING_BLOCKS per parent, are linked to the next block's first."""
    kids = forest.where(F.col("parent").isNotNull()).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(SIBLING_BLOCKS)))
    inside = Window.partitionBy("parent", "block").orderBy("id")
    run = kids.withColumn("nextsib", F.lead("id").over(inside)).withColumn("first", F.first("id").over(inside))
    last = run.where(F.col("nextsib").isNull()).withColumn("nextsib", F.lead("first").over(Window.partitionBy("parent").orderBy("block")))
    linked = run.where(F.col("nextsib").isNotNull()).unionByName(last).select("id", "parent", "nextsib")
    eldest = kids.groupBy("parent").agg(F.min(F.struct("block", "id"))["id"].alias("child")).select(F.col("parent").alias("id"), "child")
    roots = forest.where(F.col("parent").isNull()).select("id", "parent", F.lit(None).cast("bigint").alias("nextsib"))
    nodes = linked.unionByName(roots).join(eldest, "id", "left")
    leave = F.col("id") * 2 + 1
    return nodes.select(
        F.inline(
            F.array(
                F.struct((F.col("id") * 2).alias("arc"), F.coalesce(F.col("child") * 2, leave).alias("nxt"), F.lit(1).alias("w")),
                F.struct(leave.alias("arc"), F.coalesce(F.col("nextsib") * 2, F.col("parent") * 2 + 1).alias("nxt"), F.lit(-1).alias("w")),
            )
        )
    )


def _jumped(arcs: DataFrame, resting) -> DataFrame:
    """arcs (arc, nxt, w, steps, last) with each pointer moved on, by jumps of doubling length, until it rests. Only
    pointers that still move are joined and written again; what rests stays where it was written."""
    moving, rested = Staged(arcs, "tour"), []
    while True:
        rested.append(moving.df.where(resting(F.col("nxt"))))
        live = moving.df.where(~resting(F.col("nxt")))
        if live.isEmpty():
            return reduce(DataFrame.unionByName, rested)
        every = reduce(DataFrame.unionByName, [*rested, live])
        target = every.select(F.col("arc").alias("nxt"), F.col("nxt").alias("n2"), F.col("w").alias("w2"), F.col("steps").alias("s2"), F.col("last").alias("l2"))
        moved = live.join(target, "nxt").select("arc", F.col("n2").alias("nxt"), (F.col("w") + F.col("w2")).alias("w"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("l2").alias("last"))
        moving = Staged(moved, "tour")


def _ranked_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pointer jumping of _ranked in one task."""
    arcs = _whole(batches, ["arc", "nxt", "w", "steps", "last"])
    ids, w, steps, last = arcs["arc"].to_numpy(np.int64), arcs["w"].to_numpy(np.int64).copy(), arcs["steps"].to_numpy(np.int64).copy(), arcs["last"].fillna(-1).to_numpy(np.int64).copy()
    nxt = np.where(arcs["nxt"].isna(), -1, _places(ids, arcs["nxt"].fillna(-1).to_numpy(np.int64)))
    live = np.flatnonzero(nxt >= 0)
    while len(live):
        to = nxt[live]
        w[live], steps[live], last[live], nxt[live] = w[live] + w[to], steps[live] + steps[to], last[to], nxt[to]
        live = live[nxt[live] >= 0]
    yield pd.DataFrame({"arc": ids, "w": w, "steps": steps, "last": last})


def _ranked(arcs: DataFrame) -> DataFrame:
    """(arc, w, steps, last): sum of weights and number of arcs from arc to the end of its tour, and the tour's last arc."""
    first = arcs.select("arc", "nxt", F.col("w").cast("bigint").alias("w"), F.lit(1).cast("bigint").alias("steps"), F.when(F.col("nxt").isNull(), F.col("arc")).alias("last"))
    return _rest_of_way(first)


def _rest_of_way(arcs: DataFrame, level: int = 0) -> DataFrame:
    """Every arc first runs to the next of the stops, one arc in STOP_EVERY by its hash (another at each level); then the stops alone are ranked
    in the same way, and one join gives each arc the rest of its way from there. So long tours cost rounds over ever
    fewer stops, and the last ONE_TASK of them are settled by one task. An arc has one predecessor, hence no join key is
    heavy but a stop, to which some STOP_EVERY arcs run."""
    held = Staged(arcs, "arcs")
    if held.count() <= ONE_TASK:
        return Staged(held.df.repartition(1).mapInPandas(_ranked_here, "arc bigint, w bigint, steps bigint, last bigint"), "ranked").df
    is_stop = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(STOP_EVERY)) == 0
    near = _jumped(held.df, lambda nxt: nxt.isNull() | is_stop(nxt))
    stops = _rest_of_way(Staged(near.where(is_stop(F.col("arc"))), "stops").df, level + 1)
    way = stops.select(F.col("arc").alias("nxt"), F.col("w").alias("w2"), F.col("steps").alias("s2"), F.col("last").alias("l2"))
    ended = near.where(F.col("nxt").isNull()).select("arc", "w", "steps", "last")
    return ended.unionByName(near.join(way, "nxt").select("arc", (F.col("w") + F.col("w2")).alias("w"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("l2").alias("last")))


def hierarchy(symbols: DataFrame, scope: str = "project_id", key: str = "identity_key", parent: str = "parent_identity_key") -> DataFrame:
    """(scope, key, parent_key, root_key, depth, entry, exit, descendants) for each distinct (scope, key).

    A node without a parent, or whose parent has no row in the scope, is a root of depth 0. Nodes on or below a
    cycle (a self-parent is one) have root_key '' and depth -1, and null entry, exit and descendants. entry and exit
    number the tour of the node's tree from 0: a is an ancestor of b iff their roots are equal and
    a.entry < b.entry < a.exit. Rows with a null key are no nodes; a null scope is a scope of its own; '' as parent
    means none; repeated rows count once and of conflicting parents the largest holds. Extra columns are ignored.
    """
    nodes = Staged(_numbered(symbols, scope, key, parent), "nodes")
    links = Staged(_linked(nodes.df), "links")
    cycles = _cycle_nodes(links.df)
    on_cycle = cycles.df.withColumn("cyclic", F.lit(True))
    forest = Staged(
        links.df.join(on_cycle, "id", "left").select("id", F.when(F.col("cyclic").isNull(), F.col("parent")).alias("parent"), F.col("cyclic").isNotNull().alias("cyclic")), "forest")
    links.drop()
    ranked = _ranked(_tour(forest.df.select("id", "parent")))
    enter = ranked.where(F.col("arc") % 2 == 0).select((F.col("arc") / 2).cast("bigint").alias("id"), (-F.col("w")).cast("int").alias("depth"), F.col("steps").alias("from_end"), ((F.col("last") - 1) / 2).cast("bigint").alias("root"))
    leave = ranked.where(F.col("arc") % 2 == 1).select(((F.col("arc") - 1) / 2).cast("bigint").alias("id"), F.col("steps").alias("exit_end"))
    roots = Staged(
        forest.df.where(F.col("parent").isNull()).join(nodes.df, "id").join(enter.select("id", F.col("from_end").alias("size")), "id")
        .select(F.col("id").alias("root"), F.col("key").alias("root_name"), "cyclic", "size"), "roots")
    placed = nodes.df.join(enter, "id").join(leave, "id").join(small_side(roots), "root")
    ok = ~F.col("cyclic")
    return placed.select(
        F.col("scope").alias(scope), F.col("key").alias(key), "parent_key", F.when(ok, F.col("root_name")).otherwise("").alias("root_key"),
        F.when(ok, F.col("depth")).otherwise(-1).cast("int").alias("depth"),
        F.when(ok, F.col("size") - F.col("from_end")).alias("entry"), F.when(ok, F.col("size") - F.col("exit_end")).alias("exit"),
        F.when(ok, ((F.col("from_end") - F.col("exit_end") - 1) / 2).cast("bigint")).alias("descendants"),
        F.col("id").alias("node_no"), F.col("root").alias("tree_no"),
    )


def _exits(bounds: np.ndarray):
    """Adds to rows (part, tree, exit) the last part that the node's interval reaches into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = np.empty(len(pdf), bounds.dtype)
            ends["tree"], ends["entry"] = pdf["tree"], pdf["exit"]
            yield pdf.assign(until=np.searchsorted(bounds, ends).astype(np.int32) - 1)

    return run


_ROWS = "part int, tree bigint, entry bigint, exit bigint, node bigint, name string"


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks each part in tour order with the stack of open nodes; rows of earlier parts only put open nodes there."""
    part, tree, stack = None, None, []
    nodes, ancestors, held = [], [], 0
    frame = lambda: pd.DataFrame({"node_no": pd.Series(nodes, dtype="int64"), "ancestors": pd.Series(ancestors, dtype="object")})
    for pdf in batches:
        for p, t, entry, end, node, name, seed in zip(pdf["part"], pdf["tree"], pdf["entry"], pdf["exit"], pdf["node"], pdf["name"], pdf["seed"]):
            if p != part or t != tree:
                part, tree, stack = p, t, []
            while stack and stack[-1][0] < entry:
                stack.pop()
            if not seed:
                nodes.append(node)
                ancestors.append([k for _, k in stack])
                held += 1 + len(stack)
                if held >= WALK_NAMES:
                    yield frame()
                    nodes, ancestors, held = [], [], 0
            stack.append((end, name))
    yield frame()


def with_ancestors(tree: DataFrame, key: str = "identity_key") -> DataFrame:
    """hierarchy() of the nodes off cycles, with `ancestors`, the keys from the root down to the parent.

    Nodes are range-partitioned by (tree, entry) at sampled quantiles, so a large tree is cut into many parts. A part
    begins with the nodes that are open there: every node is sent to the later parts that its interval reaches into,
    found by binary search over the parts' bounds (one pair a part). Each part is then walked alone."""
    ok = tree.where("depth >= 0").select(F.col("tree_no").alias("tree"), "entry", "exit", F.col("node_no").alias("node"), F.col(key).alias("name"))
    parts = Staged(ok.repartitionByRange("tree", "entry").withColumn("part", F.spark_partition_id()).select(*[c.split(" ")[0] for c in _ROWS.split(", ")]), "parts").df
    firsts = sorted((r.at["tree"], r.at["entry"], r.part) for r in parts.groupBy("part").agg(F.min(F.struct("tree", "entry")).alias("at")).collect())
    bounds = np.array([f[:2] for f in firsts], [("tree", np.int64), ("entry", np.int64)])
    number = F.create_map(*[F.lit(x) for k, f in enumerate(firsts) for x in (f[2], k)]) if firsts else F.lit(None)
    numbered = parts.withColumn("part", F.coalesce(number[F.col("part")], F.lit(0))) if firsts else parts
    reaching = numbered.mapInPandas(_exits(bounds), _ROWS + ", until int")
    own = numbered.withColumn("seed", F.lit(False))
    above = reaching.where("until > part").withColumn("part", F.explode(F.sequence(F.col("part") + 1, F.col("until")))).drop("until").withColumn("seed", F.lit(True))
    rows = own.unionByName(above.select(*own.columns))
    walked = rows.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "tree", "entry").mapInPandas(_walked, "node_no bigint, ancestors array<string>")
    return tree.where("depth >= 0").join(walked, "node_no")
