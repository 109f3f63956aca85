"""Graph families, one boolean per graph, and traversability."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwright.functions.durable import settle
from arcwright.functions.flat import Flat, Steps, levels_from, of_one_order, spanning_ends
from arcwright.operators.adjacency import degrees, distinct_arcs, simple_flags
from arcwright.operators.connectivity import component_count, component_roots, labels_of, strong_components
from arcwright.operators.distance import reached_from
from arcwright.operators.model import Graphs
from arcwright.operators.packs import solved
from arcwright.operators.stats import order_size, possible_arcs


def is_complete(g: Graphs) -> DataFrame:
    d = order_size(g).join(distinct_arcs(g), "graph_id")
    return d.select("graph_id", (F.col("distinct_arcs") == possible_arcs(F.col("n"), F.col("kind") == "digraph")).alias("is_complete"), (F.col("m") == 0).alias("is_empty"))


def is_cycle_graph(g: Graphs) -> DataFrame:
    """Every degree 2 (in = out = 1 if directed), (strongly) connected, simple, n >= 3 (2)."""
    d = degrees(g).groupBy("graph_id").agg(F.bool_and(F.col("degree") == 2).alias("two"), F.bool_and((F.col("indeg") == 1) & (F.col("outdeg") == 1)).alias("one"))
    x = order_size(g).join(d, "graph_id").join(simple_flags(g), "graph_id").join(component_count(g), "graph_id")
    # with in = out = 1 everywhere a weakly connected digraph is one directed cycle
    turn = F.when(F.col("kind") == "digraph", (F.col("n") >= 2) & F.col("is_simple") & F.col("connected") & F.col("one")).otherwise((F.col("n") >= 3) & F.col("is_underlying_simple") & F.col("connected") & F.col("two"))
    return x.select("graph_id", turn.alias("is_cycle_graph"))


def _sides(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Component and side of every vertex."""
    label, (u, v, _) = labels_of(flat), flat.pairs()
    depth, _, _ = levels_from(flat.total, np.flatnonzero(label == np.arange(flat.total)), Steps.both_ways(flat.total, u, v))
    return label, (depth % 2).astype(np.int32)


def bipartition_sides(g: Graphs) -> DataFrame:
    """Parity of the distance from the least vertex of the component, direction ignored."""
    return solved(g, lambda flat: flat.rows(flat.home, vid=flat.vid, side=_sides(flat)[1]), "graph_id string, vid long, side int", _large_sides)


def _large_sides(g: Graphs) -> DataFrame:
    roots = component_roots(g)
    levels = reached_from(settle(g.nbrs().select("graph_id", "u", "v"), "steps"), roots.select("graph_id", F.col("root").alias("s")).distinct())
    return levels.select("graph_id", F.col("v").alias("vid"), (F.col("d") % 2).alias("side"))


def bipartite(g: Graphs) -> DataFrame:
    """is_bipartite, is_complete_bipartite and then the sides' sizes p and q; a loop or an edge within a side denies it."""

    def solve(flat: Flat):
        label, side = _sides(flat)
        bad = flat.per_graph(flat.at[side[flat.src] == side[flat.dst]])
        p, q = flat.per_graph(flat.home[side == 0]), flat.per_graph(flat.home[side == 1])
        comps = flat.per_graph(flat.home[label == np.arange(flat.total)])
        full = (bad == 0) & (comps == 1) & (flat.n >= 2) & ~_many(flat) & (q > 0) & (flat.m == p * q)
        have = np.flatnonzero(flat.n > 0)
        only = lambda x: pa.array(x[have], mask=~full[have])
        return flat.rows(have, is_bipartite=bad[have] == 0, is_complete_bipartite=full[have], p=only(p), q=only(q))

    return solved(g, solve, "graph_id string, is_bipartite boolean, is_complete_bipartite boolean, p long, q long", _large_bipartite)


def _many(flat: Flat) -> np.ndarray:
    """Has a graph parallel edges, whatever their direction, or a loop?"""
    u, _, count = flat.pairs()
    return (flat.most(flat.home[u], count) > 1) | (flat.per_graph(flat.at[flat.src == flat.dst]) > 0)


def _large_bipartite(g: Graphs) -> DataFrame:
    sides = settle(_large_sides(g), "sides")
    a = sides.select("graph_id", F.col("vid").alias("src"), F.col("side").alias("x"))
    b = sides.select("graph_id", F.col("vid").alias("dst"), F.col("side").alias("y"))
    bad = g.edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).filter("x = y").select("graph_id").distinct()
    p = sides.groupBy("graph_id").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("q"))
    x = p.join(bad.withColumn("bad", F.lit(True)), "graph_id", "left").join(order_size(g), "graph_id").join(simple_flags(g), "graph_id").join(component_count(g), "graph_id")
    yes = F.col("bad").isNull()
    full = yes & F.col("connected") & (F.col("n") >= 2) & F.col("is_underlying_simple") & (F.col("q") > 0) & (F.col("m") == F.col("p") * F.col("q"))
    size = lambda c: F.when(full, F.col(c)).alias(c)
    return x.select("graph_id", yes.alias("is_bipartite"), full.alias("is_complete_bipartite"), size("p"), size("q"))


def forest_flags(g: Graphs) -> DataFrame:
    """is_forest, is_tree, is_star and the star's centre (least vid); parallel edges and loops break a forest."""

    def solve(flat: Flat):
        u, v, _ = flat.pairs()
        comps = flat.per_graph(flat.home[labels_of(flat) == np.arange(flat.total)])
        forest = (flat.per_graph(flat.at[flat.src == flat.dst]) == 0) & (flat.m == flat.n - comps)
        near = np.bincount(np.concatenate([u, v]), minlength=flat.total).astype(np.int64)
        k = flat.most(flat.home, near)
        hub = np.full(flat.graphs, np.iinfo(np.int64).max)
        top = np.flatnonzero(near == k[flat.home])
        np.minimum.at(hub, flat.home[top], flat.vid[top])
        star = forest & (comps == 1) & ~_many(flat) & (k == flat.n - 1)
        return flat.rows(np.arange(flat.graphs), is_forest=forest, is_tree=forest & (comps == 1), is_star=star, centre=pa.array(hub, mask=~star))

    return solved(g, solve, "graph_id string, is_forest boolean, is_tree boolean, is_star boolean, centre long", _large_forest)


def _large_forest(g: Graphs) -> DataFrame:
    loops = g.edges.filter("src = dst").select("graph_id").distinct().withColumn("loop", F.lit(True))
    near = g.vertices.select("graph_id", F.col("vid").alias("u")).join(g.nbrs().groupBy("graph_id", "u").agg(F.count("*").alias("k")), ["graph_id", "u"], "left").fillna(0, ["k"])
    hub = near.groupBy("graph_id").agg(F.max(F.struct("k", (-F.col("u")).alias("u"))).alias("h")).select("graph_id", "h.k", (-F.col("h.u")).alias("hub"))
    x = order_size(g).join(component_count(g), "graph_id").join(loops, "graph_id", "left").join(hub, "graph_id", "left").join(simple_flags(g), "graph_id")
    forest = F.col("loop").isNull() & (F.col("m") == F.col("n") - F.col("components"))
    tree = forest & F.col("connected")
    star = tree & F.col("is_underlying_simple") & (F.coalesce("k", F.lit(0)) == F.col("n") - 1)
    return x.select("graph_id", forest.alias("is_forest"), tree.alias("is_tree"), star.alias("is_star"), F.when(star, F.col("hub")).alias("centre"))


def is_cyclic(g: Graphs) -> DataFrame:
    """Directed: a loop or a strong component of several vertices.  Undirected: no forest."""
    if not g.graphs.filter("directed").limit(1).count():
        return forest_flags(g).select("graph_id", (~F.col("is_forest")).alias("is_cyclic"))
    big = strong_components(g).groupBy("graph_id", "scc").count().filter("count > 1").select("graph_id").distinct()
    loops = g.edges.filter("src = dst").select("graph_id").distinct()
    round_ = big.union(loops).distinct().withColumn("yes", F.lit(True))
    x = g.graphs.join(round_, "graph_id", "left").join(forest_flags(g), "graph_id")
    return x.select("graph_id", F.when(F.col("directed"), F.col("yes").isNotNull()).otherwise(~F.col("is_forest")).alias("is_cyclic"))


def eulerian_status(g: Graphs) -> DataFrame:
    """yes, semi, no or none (no edges): parity or balance, and one component with edges; and why."""
    d = degrees(g)
    roots = component_roots(g)
    spread = g.edges.select("graph_id", F.col("src").alias("vid")).join(roots, ["graph_id", "vid"]).groupBy("graph_id").agg(F.count_distinct("root").alias("parts"))
    diff = F.col("outdeg") - F.col("indeg")
    s = d.groupBy("graph_id").agg(F.count_if(F.col("degree") % 2 == 1).alias("odd"), F.count_if(diff == 1).alias("plus"), F.count_if(diff == -1).alias("minus"), F.count_if(diff != 0).alias("off"))
    x = g.graphs.join(s, "graph_id").join(spread, "graph_id", "left")
    open_ = F.when(F.col("directed"), (F.col("plus") == 1) & (F.col("minus") == 1) & (F.col("off") == 2)).otherwise(F.col("odd") == 2)
    closed = F.when(F.col("directed"), F.col("off") == 0).otherwise(F.col("odd") == 0)
    kind = F.when(F.col("parts").isNull(), "none").when(F.col("parts") > 1, "no").when(closed, "yes").when(open_, "semi").otherwise("no")
    say = lambda c, after: F.concat(F.col(c).cast("string"), F.lit(after))
    why = F.when(kind == "none", "no edges").when(F.col("parts") > 1, say("parts", " components have edges"))
    why = why.when(F.col("directed"), F.when(closed, "every vertex is balanced").when(open_, "one vertex starts and one ends an open trail").otherwise(say("off", " vertices are unbalanced")))
    why = why.otherwise(F.when(closed, "every degree is even").otherwise(say("odd", " vertices have odd degree")))
    return x.select("graph_id", kind.alias("eulerian"), why.alias("reason"))


def _small(g: Graphs, most: int) -> DataFrame:
    return g.vertices.groupBy("graph_id").agg(F.count("*").alias("n")).filter(F.col("n") <= most)


def spanning_states(arcs: DataFrame, sizes: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph_id, n, s, v): spanning paths from s that end in v, one row each.

    A frontier of (visited mask, end), one vertex a round for all graphs at once; states
    that meet are one, so there are at most 2^n n of them for a start.
    """
    bit = lambda c: F.expr(f"shiftleft(cast(1 as bigint), cast({c} as int))")
    front = settle(starts.join(sizes, "graph_id").select("graph_id", "n", "s", F.col("s").alias("v"), bit("s").alias("mask"), F.lit(1).alias("k")), "front")
    ended = [front.filter("k = n")]
    while True:
        step = front.filter("k < n").withColumnRenamed("v", "u").join(arcs, ["graph_id", "u"]).filter(F.col("mask").bitwiseAND(bit("v")) == 0)
        front = settle(step.select("graph_id", "n", "s", "v", F.col("mask").bitwiseOR(bit("v")).alias("mask"), (F.col("k") + 1).alias("k")).distinct(), "front")
        if not front.limit(1).count():
            break
        ended.append(front.filter("k = n"))
    out = ended[0]
    for e in ended[1:]:
        out = out.union(e)
    return out.select("graph_id", "n", "s", "v").distinct()


HAMILTON_LIMIT = 16


def hamiltonian(g: Graphs, limit: int = HAMILTON_LIMIT) -> DataFrame:
    """Spanning cycle, for 3 (directed 2) <= n <= limit; null beyond, false below."""

    def solve(flat: Flat):
        yes = np.zeros(flat.graphs, dtype=bool)
        for n, places, into in of_one_order(flat, limit):
            yes[places] = (spanning_ends(n, into, 0) & into[:, 0]) != 0
        return _within_limit(flat, limit, "hamiltonian", yes & (flat.n >= np.where(flat.directed, 2, 3)))

    return solved(g, solve, "graph_id string, hamiltonian boolean", lambda x: _large_hamiltonian(x, limit))


def _within_limit(flat: Flat, limit: int, name: str, yes: np.ndarray):
    """Rows of graphs with vertices; null beyond ``limit``."""
    have = np.flatnonzero(flat.n > 0)
    return flat.rows(have, **{name: pa.array(yes[have], mask=flat.n[have] > limit)})


def _large_hamiltonian(g: Graphs, limit: int) -> DataFrame:
    sizes = _small(g, limit)
    arcs = g.arcs().join(sizes.select("graph_id"), "graph_id", "left_semi").select("graph_id", "u", "v")
    ways = spanning_states(arcs, sizes, sizes.select("graph_id", F.lit(0).cast("long").alias("s")))
    closed = ways.withColumnRenamed("v", "u").withColumn("v", F.col("s")).join(arcs, ["graph_id", "u", "v"], "left_semi").select("graph_id").distinct().withColumn("yes", F.lit(True))
    x = g.graphs.join(g.vertices.groupBy("graph_id").agg(F.count("*").alias("n")), "graph_id").join(closed, "graph_id", "left")
    least = F.when(F.col("directed"), 2).otherwise(3)
    return x.select("graph_id", F.when(F.col("n") > limit, F.lit(None).cast("boolean")).otherwise((F.col("n") >= least) & F.col("yes").isNotNull()).alias("hamiltonian"))


def traceable(g: Graphs, limit: int = HAMILTON_LIMIT) -> DataFrame:
    """Spanning path, for n <= limit; null beyond."""

    def solve(flat: Flat):
        yes = np.zeros(flat.graphs, dtype=bool)
        for n, places, into in of_one_order(flat, limit):
            yes[places] = spanning_ends(n, into, None) != 0
        return _within_limit(flat, limit, "traceable", yes)

    return solved(g, solve, "graph_id string, traceable boolean", lambda x: _large_traceable(x, limit))


def _large_traceable(g: Graphs, limit: int) -> DataFrame:
    sizes = _small(g, limit)
    arcs = g.arcs().join(sizes.select("graph_id"), "graph_id", "left_semi").select("graph_id", "u", "v")
    starts = g.vertices.select("graph_id", F.col("vid").alias("s"))
    found = spanning_states(arcs, sizes, starts).select("graph_id").distinct().withColumn("yes", F.lit(True))
    x = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n")).join(found, "graph_id", "left")
    return x.select("graph_id", F.when(F.col("n") > limit, F.lit(None).cast("boolean")).otherwise(F.col("yes").isNotNull()).alias("traceable"))


MAXIMAL_LIMIT = 12


def maximal_non_hamiltonian(g: Graphs, limit: int = MAXIMAL_LIMIT) -> DataFrame:
    """No spanning cycle, but any missing edge (directed: arc) alone would make one; null beyond ``limit``.

    A new arc u -> v closes a spanning cycle if and only if a spanning path leads from v to u,
    so one search for spanning paths from all starts answers for all missing edges at once.
    False below 3 (directed 2) vertices, as for hamiltonian.
    """

    def solve(flat: Flat):
        yes = np.zeros(flat.graphs, dtype=bool)
        for n, places, into in of_one_order(flat, limit):
            open_ = (n >= np.where(flat.directed[places], 2, 3)) & (spanning_ends(n, into, None) != 0)
            places, into = places[open_], into[open_]
            closed, idle = np.zeros(len(places), dtype=bool), np.zeros(len(places), dtype=bool)
            for v in range(n) if len(places) else ():
                there = spanning_ends(n, into, v)  # bit u: a spanning path leads from v to u
                closed |= (there & into[:, v]) != 0
                idle |= (~there & ~into[:, v] & ((1 << n) - 1) & ~(1 << v)) != 0
            yes[places] = ~closed & ~idle
        return _within_limit(flat, limit, "maximal_non_hamiltonian", yes)

    return solved(g, solve, "graph_id string, maximal_non_hamiltonian boolean", lambda x: _large_maximal(x, limit))


def _large_maximal(g: Graphs, limit: int) -> DataFrame:
    sizes = settle(_small(g, limit), "sizes")
    arcs = g.arcs().join(sizes.select("graph_id"), "graph_id", "left_semi").select("graph_id", "u", "v")
    mine = g.vertices.join(sizes.select("graph_id"), "graph_id", "left_semi")
    ways = spanning_states(arcs, sizes, mine.select("graph_id", F.col("vid").alias("s"))).select("graph_id", F.col("v").alias("u"), F.col("s").alias("v"))
    ways = settle(ways, "ways")
    closed = ways.join(arcs, ["graph_id", "u", "v"], "left_semi").select("graph_id").distinct().withColumn("ham", F.lit(True))
    every = mine.select("graph_id", F.col("vid").alias("u")).join(mine.select("graph_id", F.col("vid").alias("v")), "graph_id").filter("u <> v")
    missing = every.join(arcs, ["graph_id", "u", "v"], "left_anti").join(ways, ["graph_id", "u", "v"], "left_anti").select("graph_id").distinct().withColumn("idle", F.lit(True))
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    x = g.graphs.join(n, "graph_id").join(closed, "graph_id", "left").join(missing, "graph_id", "left")
    least = F.when(F.col("directed"), 2).otherwise(3)
    yes = (F.col("n") >= least) & F.col("ham").isNull() & F.col("idle").isNull()
    return x.select("graph_id", F.when(F.col("n") > limit, F.lit(None).cast("boolean")).otherwise(yes).alias("maximal_non_hamiltonian"))


def in_small_order(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
