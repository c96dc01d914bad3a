"""The leave-out sample: components, bridges, cut vertices, and the fixed point of removing them.

Edges are deletion units between workers and firms. Node and unit keys are hashed to longs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..spec import PanelSpec, Withheld
from . import cut


def stars(pairs: DataFrame) -> DataFrame:
    """(node, root) for the nodes of pairs (u, v) of longs: the smallest of the component, by large-star and small-star steps."""
    e, before = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionAll(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """edges (w, f, ...) with root: the smallest node hash of the component; workers and firms are different nodes."""
    root = stars(edges.select(F.xxhash64(F.lit("w"), "w").alias("u"), F.xxhash64(F.lit("f"), "f").alias("v")))
    return edges.withColumn("node", F.xxhash64(F.lit("w"), "w")).join(root, "node").drop("node")


def largest(units: DataFrame) -> DataFrame:
    """The units of the component with most firms, then most mass; a tie is refused."""
    found = cut(components(units))
    rank = found.groupBy("root").agg(F.countDistinct("f").alias("firms"), F.sum("n").alias("mass")).orderBy(F.desc("firms"), F.desc("mass")).limit(2).collect()
    if not rank:
        raise Withheld("NO_LEAVEOUT_COMPONENT")
    if len(rank) == 2 and rank[0][1:] == rank[1][1:]:
        raise Withheld("AMBIGUOUS_LARGEST_COMPONENT")
    return found.where(F.col("root") == rank[0]["root"]).drop("root")


def _search(a: np.ndarray, b: np.ndarray, nodes: int) -> tuple[list[int], np.ndarray]:
    """(positions of bridges, whether a node is a cut vertex) of the multigraph of edges a - b between nodes 0 to nodes - 1.

    A depth-first search without recursion, on flat arrays of 4 bytes a number: about 24 bytes an edge and 28 a node.
    """
    flat = lambda x: memoryview(np.ascontiguousarray(x, np.int32))
    order = np.argsort(np.concatenate([a, b]), kind="stable")
    near, edge = flat(np.concatenate([b, a])[order]), flat(order % max(len(a), 1))
    del order
    end = np.cumsum(np.bincount(a, minlength=nodes) + np.bincount(b, minlength=nodes))
    at, end = flat(np.concatenate([[0], end[:-1]])), flat(end)
    seen, low, by, up = (flat(np.full(nodes, -1)) for _ in range(4))
    cuts, bridges, clock = np.zeros(nodes, bool), [], 0
    for start in range(nodes):
        if seen[start] >= 0:
            continue
        seen[start] = low[start] = clock
        clock += 1
        x, below = start, 0
        while True:
            i = at[x]
            if i < end[x]:
                at[x] = i + 1
                k = edge[i]
                if k == by[x]:
                    continue
                y = near[i]
                if seen[y] < 0:
                    seen[y] = low[y] = clock
                    clock += 1
                    by[y], up[y] = k, x
                    x = y
                elif seen[y] < low[x]:
                    low[x] = seen[y]
                continue
            if x == start:
                break
            above, least = up[x], low[x]
            if least < low[above]:
                low[above] = least
            if least > seen[above]:
                bridges.append(by[x])
            if above == start:
                below += 1
            elif least >= seen[above]:
                cuts[above] = True
            x = above
        if below > 1:
            cuts[start] = True
    return bridges, cuts


def weak_points(edges: list[tuple[int, int, int]]) -> tuple[set[int], set[int]]:
    """(bridges among edge numbers, cut vertices) of a multigraph of edges (number, a, b)."""
    numbers, a, b = np.array(edges, np.int64).reshape(-1, 3).T
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    bridges, cuts = _search(at[: len(a)], at[len(a) :], len(nodes))
    return set(numbers[bridges].tolist()), set(nodes[cuts].tolist())


def _weak(t: pa.Table) -> pa.Table:
    """Of cells (a, b, units: how many, u: one of them); a cell of several units is no bridge."""
    workers, a = np.unique(t.column("a").to_numpy(), return_inverse=True)
    firms, b = np.unique(t.column("b").to_numpy(), return_inverse=True)
    a, b = a.astype(np.int32), b.astype(np.int32) + np.int32(len(workers))
    bridges, cuts = _search(a, b, len(workers) + len(firms))
    bridges = np.sort(np.array(bridges, np.int64))
    bridges = t.column("u").to_numpy()[bridges[t.column("units").to_numpy()[bridges] == 1]]
    cuts = workers[cuts[: len(workers)]]
    return pa.table({"kind": pa.array(["bridge"] * len(bridges) + ["cut"] * len(cuts), pa.string()), "key": pa.array(np.concatenate([bridges, cuts]), pa.int64())})


def without_twins(cells: DataFrame) -> DataFrame:
    """cells (a, b, ...), one row for each a and b, less those that change no answer of the search: at most two workers of the same firms are kept, none of one firm.

    Of two workers with the same firms, two at least, neither is a cut vertex and no cell is a bridge, as each goes round the other;
    a third reaches only what these two do. A worker with one firm and several units there is a leaf. Sets of firms are told by
    their size and 128 bits of hashes, so no worker's firms are gathered.
    """
    bits = [F.bit_xor(F.xxhash64(F.lit(k), "b")).alias(f"bits{k}") for k in (1, 2)]
    kinds = cells.groupBy("a").agg(F.count("*").alias("k"), *bits).where("k > 1")
    kept = kinds.groupBy("k", "bits1", "bits2").agg(F.min("a").alias("a"), F.max("a").alias("a2"))
    return cells.join(kept.select(F.explode(F.array_distinct(F.array("a", "a2"))).alias("a")), "a", "left_semi")


def spread_weak(cells: DataFrame) -> DataFrame:
    """weak for cells (a, b, units: how many, u: one of them) with no task that sees all: the auxiliary graph of a breadth-first tree.

    A node stands for the edge to its parent. In a bipartite graph an edge outside the tree joins nodes that are neither above
    the other, so their edges share a block; a child's edge shares its parent's block if an edge outside the tree leaves the parent's
    subtree from the child's. Blocks are the components of these links. One round for each level of the tree, three times.
    """
    edges = cut(cells.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(cells.select(F.col("b").alias("x"), F.col("a").alias("y"))))
    start = stars(cells.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("root").alias("x")).distinct()
    levels = [cut(start.withColumn("parent", F.lit(None).cast("long")))]
    while True:
        found = levels[-1].select("x").join(edges, "x").groupBy(F.col("y").alias("x")).agg(F.min("x").alias("parent"))
        if len(levels) > 1:
            found = found.join(levels[-2].select("x"), "x", "left_anti")
        found = cut(found)
        if found.isEmpty():
            break
        levels.append(found)
    below, sized = None, []
    for level in reversed(levels):
        level = level.withColumn("size", F.lit(1)) if below is None else level.join(below.groupBy("parent").agg(F.sum("size").alias("s")).withColumnRenamed("parent", "x"), "x", "left").select("x", "parent", (1 + F.coalesce("s", F.lit(0))).alias("size"))
        below = cut(level)
        sized.append(below)
    numbered, above = [], None
    for level in reversed(sized):
        if above is None:
            above = cut(level.withColumn("pre", F.lit(0).cast("long")))
        else:  # siblings in 64 groups, so that a large parent's children aren't numbered in one task
            level = level.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(64)))
            groups = level.groupBy("parent", "salt").agg(F.sum("size").alias("s"))
            ahead = groups.withColumn("ahead", F.coalesce(F.sum("s").over(Window.partitionBy("parent").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
            inside = F.sum("size").over(Window.partitionBy("parent", "salt").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
            level = level.withColumn("inside", inside).join(ahead, ["parent", "salt"]).join(above.select(F.col("x").alias("parent"), F.col("pre").alias("p")), "parent")
            above = cut(level.select("x", "parent", "size", (F.col("p") + 1 + F.col("inside") + F.col("ahead")).alias("pre")))
        numbered.append(above)
    nodes = reduce(DataFrame.unionByName, numbered)
    one, two = nodes.select("x", F.col("parent").alias("px"), F.col("pre").alias("prex")), nodes.select(F.col("x").alias("y"), F.col("parent").alias("py"), F.col("pre").alias("prey"))
    outside = cut(edges.join(one, "x").join(two, "y").where("not (px <=> y) and not (py <=> x)").select("x", "y", "prey"))
    own = cut(outside.groupBy("x").agg(F.min("prey").alias("low"), F.max("prey").alias("high")))
    below, reach = None, []
    for level in reversed(numbered):
        level = level.join(own, "x", "left")
        if below is not None:
            up = below.groupBy("parent").agg(F.min("low").alias("l"), F.max("high").alias("h")).withColumnRenamed("parent", "x")
            level = level.join(up, "x", "left").select("x", "parent", "size", "pre", F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high"))
        below = cut(level)
        reach.append(below)
    nodes = cut(reduce(DataFrame.unionByName, reach))
    parents = nodes.where("parent is not null").select(F.col("x").alias("parent"), F.col("pre").alias("ppre"), F.col("size").alias("psize"))
    leaving = nodes.join(parents, "parent").where("low < ppre or high >= ppre + psize").select(F.col("x").alias("u"), F.col("parent").alias("v"))
    linked = outside.where("x < y").select(F.col("x").alias("u"), F.col("y").alias("v")).unionAll(leaving)
    block = stars(linked).withColumnRenamed("node", "x")
    nodes = cut(nodes.select("x", "parent").join(block, "x", "left").withColumn("block", F.coalesce("root", "x")))
    under = nodes.where("parent is not null").groupBy(F.col("parent").alias("x")).agg(F.min("block").alias("least"), F.max("block").alias("most"))
    cuts = nodes.join(under, "x").where("least <> most or (parent is not null and least <> block)").join(cells.select(F.col("a").alias("x")).distinct(), "x", "left_semi")
    alone = nodes.where("root is null and parent is not null").select(F.greatest("x", "parent").alias("g"), F.least("x", "parent").alias("l"))
    bridges = cells.where("units = 1").withColumn("g", F.greatest("a", "b")).withColumn("l", F.least("a", "b")).join(alone, ["g", "l"])
    return bridges.select(F.lit("bridge").alias("kind"), F.col("u").alias("key")).unionAll(cuts.select(F.lit("cut").alias("kind"), F.col("x").alias("key")))


def weak(units: DataFrame, local_cells: int = 5_000_000) -> DataFrame:
    """(kind, key): bridging units (hash of unit) and workers that are cut vertices (hash of worker).

    Workers with one unit can't be cut vertices and their unit is a bridge by definition, so they are told without the search;
    parallel units of a cell and workers of the same firms beyond two (see without_twins) are left out of it: neither changes another
    answer. So few firms leave few cells, however many workers. Up to local_cells cells that are left are searched in one task, more by spread_weak.
    """
    h = units.select(F.xxhash64("unit").alias("u"), F.xxhash64(F.lit("w"), "w").alias("a"), F.xxhash64(F.lit("f"), "f").alias("b"))
    single = h.groupBy("a").agg(F.count("*").alias("k"), F.min("u").alias("u")).where("k = 1")
    core = cut(h.join(single.select("a"), "a", "left_anti").groupBy("a", "b").agg(F.count_distinct("u").alias("units"), F.min("u").alias("u")))
    core = cut(without_twins(core))
    if core.count() > local_cells:
        found = spread_weak(core)
    else:
        found = core.groupBy(F.lit(0).alias("g")).applyInArrow(lambda t: _weak(t.select(["a", "b", "units", "u"])), "kind string, key long")
    return found.unionByName(single.select(F.lit("bridge").alias("kind"), F.col("u").alias("key")))


def select(rows: DataFrame, spec: PanelSpec) -> tuple[DataFrame, dict[str, int]]:
    """Rows of the leave-out sample and an account of what went at each step."""
    units = cut(rows.groupBy("unit", "w", "f").agg(F.sum("n").alias("n"), F.count("*").alias("rows")))
    facts = dict(units.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_in"), F.count("*").alias("units_in")).first().asDict())
    if not facts["units_in"]:
        raise Withheld("NO_LEAVEOUT_COMPONENT")
    per = units.groupBy("w").agg(F.count("*").alias("k"), F.sum("n").alias("mass"))
    movers = per.where("k > 1").select("w")
    history = cut(per.select("w", (F.col("k") > 1).alias("mover"), "mass"))
    got = history.agg(F.sum((~F.col("mover")).cast("long")).alias("stayers"), F.count("*").alias("workers"), F.countDistinct(F.xxhash64("w")).alias("hashes")).first()
    if got["hashes"] < got["workers"]:
        raise Withheld("WORKER_COLLISION")
    facts["stayers_in"] = got["stayers"]
    early = spec.deletion == "observation" and spec.stayers == "movers"
    live = cut(largest(units.join(movers, "w", "left_semi") if early else units))
    facts["units_component"] = live.count()
    if spec.deletion == "match":
        live = cut(live.join(movers, "w", "left_semi"))
    facts |= {"passes": 0, "bridges": 0, "cut_workers": 0, "thin_workers": 0}
    while True:
        if live.isEmpty():
            raise Withheld("NO_LEAVEOUT_COMPONENT")
        live = cut(largest(live))
        facts["passes"] += 1
        size = F.count("*") if spec.deletion == "match" else F.sum("n")
        thin = live.groupBy("w").agg(size.alias("k")).where("k < 2").select("w")
        k = thin.count()
        if k:
            facts["thin_workers"] += k
            live = cut(live.join(thin, "w", "left_anti"))
            continue
        found = cut(weak(live) if spec.deletion == "match" else _cells_weak(live))
        cuts = found.where("kind = 'cut'").select(F.col("key").alias("hw"))
        k = cuts.count()
        if k:
            facts["cut_workers"] += k
            live = cut(live.withColumn("hw", F.xxhash64(F.lit("w"), "w")).join(cuts, "hw", "left_anti").drop("hw"))
            continue
        bridges = found.where("kind = 'bridge'").select(F.col("key").alias("hu"))
        k = bridges.count() if spec.deletion == "match" else 0
        if not k:
            break
        facts["bridges"] += k
        live = cut(live.withColumn("hu", F.xxhash64("unit")).join(bridges, "hu", "left_anti").drop("hu"))
    kept = live.select("unit")
    if spec.deletion == "match" and spec.stayers == "both":
        able = history.where("not mover and mass >= 2").select("w")
        extra = units.join(able, "w", "left_semi").join(live.select("f").distinct(), "f", "left_semi").select("unit")
        facts["stayers_added"] = extra.count()
        kept = kept.unionAll(extra)
    out = cut(rows.join(kept, "unit", "left_semi").join(history.select("w", "mover"), "w"))
    got = out.agg(F.count("*").alias("rows_out"), F.countDistinct("unit").alias("units_out"), F.countDistinct("w").alias("workers_out"), F.countDistinct("f").alias("firms_out"), F.sum("n").cast("long").alias("physical_out")).first()
    return out, facts | got.asDict()


def _cells_weak(units: DataFrame) -> DataFrame:
    return weak(units.select(F.struct("w", "f").alias("unit"), "w", "f", "n").distinct()).where("kind = 'cut'")
