"""Blocks, cutpoints and bridges by an Euler tour and an auxiliary graph (Tarjan and Vishkin, 1985).

A spanning forest (Boruvka's rounds: every part takes its least outgoing edge) becomes a
tour that runs along each tree edge both ways.  Pointer jumping tells every step its place
in the tour, which gives parents, subtree sizes and preorder numbers; least and largest numbers
that a subtree's other edges reach are range minima over preorder, a doubling table.  Tree
edges, named by their child, are joined where they lie on a common cycle, and each
component of that graph is a block.  All rounds follow the logarithm of the graph's size,
whatever its depth, and no list of a vertex's neighbours is gathered.

That is for large graphs; small ones are solved many at once inside a task (``operators/packs.py``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arcwright.functions.durable import discard, settle
from arcwright.functions.flat import Flat, blocks_of
from arcwright.functions.numbering import number_rows
from arcwright.operators.components import star_components
from arcwright.operators.connectivity import component_count, component_roots, labels_of
from arcwright.operators.model import Graphs
from arcwright.operators.packs import solved


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """The edges of a spanning forest of ``pairs(u, v)``, u < v, each once.

    Edges are ordered by a hash of their ends, so the least ones of all parts close no cycle
    and parts shrink to less than half a round.
    """
    order = F.struct(F.xxhash64("u", "v").alias("h"), "u", "v").alias("w")
    edges = settle(pairs.select(F.col("u").alias("a"), F.col("v").alias("b"), order), "edges")
    taken: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a", "w"))
        least = settle(both.groupBy("a").agg(F.min(F.struct("w", "b")).alias("m")).select("a", "m.b", "m.w"), "least")
        taken.append(least.select("w.u", "w.v").distinct())
        into = star_components(least.select(F.col("a").alias("u"), F.col("b").alias("v")))
        to = lambda c: into.select(F.col("id").alias(c), F.col("component").alias("_" + c))
        moved = edges.join(to("a"), "a").join(to("b"), "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "w")
        after = settle(moved.groupBy("a", "b").agg(F.min("w").alias("w")), "edges")
        discard(edges)
        edges = after
    return settle(_union(taken), "forest") if taken else pairs.select("u", "v").limit(0)


def _toured(forest: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, par, root, pre, size) of every vertex of the forest, rooted at roots(id, root)."""
    both = forest.union(forest.select("v", "u"))
    # steps u -> v, numbered among those that enter v; after u -> v comes v -> w, w next to u around v
    steps = settle(number_rows(both, ["v"], ["u"], "rank", "step"), "steps")
    around = steps.groupBy("v").agg(F.count("*").alias("k"))
    turn = steps.join(around, "v").join(roots.select(F.col("id").alias("v"), "root"), "v").withColumn("rank", (F.col("rank") + 1) % F.col("k"))
    after = turn.join(steps.select("v", "rank", F.col("u").alias("w")), ["v", "rank"])
    last = (F.col("v") == F.col("root")) & (F.col("rank") == 0)
    onward = after.join(steps.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("step").alias("to")), ["v", "w"])
    now = settle(onward.select("step", F.when(~last, F.col("to")).alias("to"), F.lit(1).cast("long").alias("left")), "ranks")
    while True:  # how many steps are left, itself included
        jump = now.select(F.col("step").alias("to"), F.col("to").alias("far"), F.col("left").alias("more"))
        count = Observation()
        moved = now.join(jump, "to", "left").select("step", F.col("far").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        fresh = settle(moved.observe(count, F.count("to").alias("n")), "ranks")
        discard(now)
        now = fresh
        if not count.get.get("n"):
            break
    placed = steps.join(now.select("step", "left"), "step").select("u", "v", "left")
    back = placed.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("left").alias("up"))
    down = placed.join(back, ["u", "v"]).filter("left > up").join(roots.select(F.col("id").alias("v"), "root"), "v")
    down = down.select(F.col("v").alias("id"), F.col("u").alias("par"), "root", ((F.col("left") - F.col("up") + 1) / 2).cast("long").alias("size"), (-F.col("left")).alias("place"))
    ranked = settle(number_rows(down, ["root"], ["place"], "rank").select("id", "par", "root", (F.col("rank") + 1).alias("pre"), "size"), "toured")
    tops = ranked.groupBy("root").agg((F.count("*") + 1).alias("size")).select(F.col("root").alias("id"), F.lit(None).cast("long").alias("par"), "root", F.lit(0).cast("long").alias("pre"), "size")
    return settle(ranked.union(tops), "tree")


def _subtree_extremes(tree: DataFrame, own: DataFrame) -> DataFrame:
    """(id, low, high): least lo and largest hi of own(root, pre, lo, hi) over each vertex's subtree.

    A subtree is the run of ``size`` preorder numbers from its own.  Level by level a table of runs
    of 2^j numbers is doubled; a run of any size is covered by two that overlap.
    """
    asked = settle(tree.select("id", "root", "pre", "size", (F.length(F.bin("size")) - 1).alias("level")), "asked")
    deepest = asked.agg(F.max("level")).first()[0]
    table, parts = settle(own.select("root", "pre", "lo", "hi"), "runs"), []
    for level in range((deepest or 0) + 1):
        mine = asked.filter(F.col("level") == level).withColumn("end", F.col("pre") + F.col("size") - (1 << level))
        left = mine.join(table, ["root", "pre"])
        right = table.select("root", F.col("pre").alias("end"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        parts.append(settle(left.join(right, ["root", "end"]).select("id", F.least("lo", "lo2").alias("low"), F.greatest("hi", "hi2").alias("high")), "extremes"))
        ahead = table.select("root", (F.col("pre") - (1 << level)).alias("pre"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        # runs that would pass the end are in no subtree and go
        wider = settle(table.join(ahead, ["root", "pre"]).select("root", "pre", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi")), "runs")
        discard(table)
        table = wider
    return _union(parts)


def _split(g: Graphs) -> DataFrame:
    """(block, id): every vertex of each block by ids that are unique over all graphs."""
    base = g.graphs.select("graph_id", "base")
    pairs = settle(g.pairs().join(base, "graph_id").select((F.col("base") + F.col("u")).alias("u"), (F.col("base") + F.col("v")).alias("v")), "pairs")
    roots = settle(component_roots(g).join(base, "graph_id").select((F.col("base") + F.col("vid")).alias("id"), (F.col("base") + F.col("root")).alias("root")), "roots")
    forest = spanning_forest(pairs)
    tree = _toured(forest, roots)
    other = pairs.join(forest, ["u", "v"], "left_anti")
    at = lambda v, *more: tree.select(F.col("id").alias(v), F.col("pre").alias("p" + v), *more)
    other = settle(other.join(at("u", F.col("size").alias("su")), "u").join(at("v", F.col("size").alias("sv")), "v").select("u", "v", "pu", "pv", "su", "sv"), "other")
    ends = other.select(F.col("u").alias("id"), F.col("pv").alias("p")).union(other.select(F.col("v").alias("id"), F.col("pu").alias("p"))).groupBy("id").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    own = tree.join(ends, "id", "left").select("root", "pre", F.least("pre", F.coalesce("lo", "pre")).alias("lo"), F.greatest("pre", F.coalesce("hi", "pre")).alias("hi"))
    marked = settle(tree.join(_subtree_extremes(tree, own), "id"), "marked")
    up = tree.filter("par is not null").select(F.col("id").alias("par"), F.col("pre").alias("p_pre"), F.col("size").alias("p_size"))
    along = marked.join(up, "par").filter("low < p_pre or high >= p_pre + p_size").select(F.col("id").alias("u"), F.col("par").alias("v"))
    # edges between an ancestor and a descendant join nothing here: they show in low and high
    across = other.filter("pv >= pu + su or pu >= pv + sv").select("u", "v")
    joined = star_components(along.union(across))
    edges = tree.filter("par is not null").join(joined, "id", "left").select("id", "par", F.coalesce("component", "id").alias("block"))
    return settle(edges.select("block", F.explode(F.array("id", "par")).alias("id")).distinct(), "blocks")


def _of_blocks(tell: Callable, schema: str, otherwise: Callable[[Graphs], DataFrame]) -> Callable[[Graphs], DataFrame]:
    """An operator whose rows ``tell`` makes from the blocks of a batch of small graphs."""

    def solve(flat: Flat):
        u, v, count = flat.pairs()
        yield from tell(flat, u, v, count, *blocks_of(flat.total, u, v))

    return lambda g: solved(g, solve, schema, otherwise)


def _tell_members(flat: Flat, u, v, count, block, member):
    of = flat.home[member]
    # blocks are numbered through in order of graphs
    head = np.full(flat.graphs, np.iinfo(np.int64).max)
    np.minimum.at(head, of, block)
    return flat.rows(of, block=block - head[of], vid=flat.vid[member])


def _tell_cutpoints(flat: Flat, u, v, count, block, member):
    cut = np.flatnonzero(np.bincount(member, minlength=flat.total) > 1)
    return flat.rows(flat.home[cut], vid=flat.vid[cut])


def _tell_bridges(flat: Flat, u, v, count, block, member):
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    heads = heads[np.diff(np.append(heads, len(block))) == 2]
    a, b = member[heads], member[heads + 1]
    once = np.isin(a * flat.total + b, (u * flat.total + v)[count == 1])
    a, b = a[once], b[once]
    return flat.rows(flat.home[a], u=flat.vid[a], v=flat.vid[b])


def _tell_count(flat: Flat, u, v, count, block, member):
    heads = member[np.flatnonzero(np.diff(block, prepend=-1))]
    return flat.rows(np.arange(flat.graphs), blocks=flat.per_graph(flat.home[heads]))


def _tell_nonseparable(flat: Flat, u, v, count, block, member):
    label = labels_of(flat)
    comps = flat.per_graph(flat.home[label == np.arange(flat.total)])
    cut = flat.per_graph(flat.home[np.flatnonzero(np.bincount(member, minlength=flat.total) > 1)])
    return flat.rows(np.arange(flat.graphs), nonseparable=(comps == 1) & (flat.n >= 2) & (cut == 0))


def block_members(g: Graphs) -> DataFrame:
    """(graph_id, block, vid): blocks numbered by their two least vids; loops make no block.

    Two blocks share one vertex at most, so their two least vids tell them apart.
    """
    return g.shared("blocks", lambda: _of_blocks(_tell_members, "graph_id string, block long, vid long", _large_members)(g))


def _large_members(g: Graphs) -> DataFrame:
    """block_members by tours over the cluster."""
    return g.shared("toured", lambda: _block_members(g))


def _block_members(g: Graphs) -> DataFrame:
    v = g.vertices.join(g.graphs.select("graph_id", "base"), "graph_id").select("graph_id", "vid", (F.col("base") + F.col("vid")).alias("id"))
    members = settle(_split(g).join(v, "id").select("graph_id", F.col("block").alias("mark"), "vid"), "members")
    first = members.groupBy("graph_id", "mark").agg(F.min("vid").alias("v1"))
    second = members.join(first, ["graph_id", "mark"]).filter("vid > v1").groupBy("graph_id", "mark", "v1").agg(F.min("vid").alias("v2"))
    numbered = number_rows(second, ["graph_id"], ["v1", "v2"], "block")
    return members.join(numbered.select("graph_id", "mark", "block"), ["graph_id", "mark"]).select("graph_id", "block", "vid")


def cutpoints(g: Graphs) -> DataFrame:
    """Vertices in two blocks or more."""
    return _of_blocks(_tell_cutpoints, "graph_id string, vid long", _large_cutpoints)(g)


def _large_cutpoints(g: Graphs) -> DataFrame:
    return _large_members(g).groupBy("graph_id", "vid").agg(F.count("*").alias("blocks")).filter("blocks > 1").select("graph_id", "vid")


def bridges(g: Graphs) -> DataFrame:
    """Pairs joined by one edge only that make a block of two."""
    return _of_blocks(_tell_bridges, "graph_id string, u long, v long", _large_bridges)(g)


def _large_bridges(g: Graphs) -> DataFrame:
    two = _large_members(g).groupBy("graph_id", "block").agg(F.min("vid").alias("u"), F.max("vid").alias("v"), F.count("*").alias("n")).filter("n = 2")
    return two.join(g.pairs().filter("ucount = 1"), ["graph_id", "u", "v"]).select("graph_id", "u", "v")


def block_count(g: Graphs) -> DataFrame:
    return _of_blocks(_tell_count, "graph_id string, blocks long", _large_count)(g)


def _large_count(g: Graphs) -> DataFrame:
    b = _large_members(g).groupBy("graph_id").agg(F.count_distinct("block").alias("blocks"))
    return g.graphs.select("graph_id").join(b, "graph_id", "left").select("graph_id", F.coalesce("blocks", F.lit(0)).alias("blocks"))


def nonseparable(g: Graphs) -> DataFrame:
    """Connected, of two vertices or more, without a cutpoint."""
    return _of_blocks(_tell_nonseparable, "graph_id string, nonseparable boolean", _large_nonseparable)(g)


def _large_nonseparable(g: Graphs) -> DataFrame:
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    cut = _large_cutpoints(g).select("graph_id").distinct().withColumn("cut", F.lit(True))
    x = component_count(g).join(n, "graph_id", "left").join(cut, "graph_id", "left")
    return x.select("graph_id", (F.col("connected") & (F.col("n") >= 2) & F.col("cut").isNull()).alias("nonseparable"))
