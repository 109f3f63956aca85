"""Components, strong components, and what follows from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arcwright.functions.durable import discard, settle
from arcwright.functions.flat import Flat, Steps, least_labels, strong_labels
from arcwright.functions.numbering import number_rows
from arcwright.operators.components import star_components
from arcwright.operators.model import Graphs
from arcwright.operators.packs import solved


def labels_of(flat: Flat) -> np.ndarray:
    """The least vertex of each vertex's component, direction ignored."""
    return least_labels(flat.total, flat.src, flat.dst)


def component_roots(g: Graphs) -> DataFrame:
    """(graph_id, vid, root): the least vid of each vertex's component; direction is ignored."""
    solve = lambda flat: flat.rows(flat.home, vid=flat.vid, root=flat.vid[labels_of(flat)])
    return g.shared("roots", lambda: solved(g, solve, "graph_id string, vid long, root long", _large_roots))


def _large_roots(g: Graphs) -> DataFrame:
    """component_roots by star contractions over the cluster."""
    return g.shared("contracted", lambda: _component_roots(g))


def _component_roots(g: Graphs) -> DataFrame:
    e = g.edges.join(g.graphs.select("graph_id", "base"), "graph_id").filter("src <> dst")
    comp = star_components(e.select((F.col("base") + F.col("src")).alias("u"), (F.col("base") + F.col("dst")).alias("v")))
    v = g.vertices.join(g.graphs.select("graph_id", "base"), "graph_id").withColumn("id", F.col("base") + F.col("vid"))
    return v.join(comp, "id", "left").select("graph_id", "vid", (F.coalesce("component", "id") - F.col("base")).alias("root"))


def ranked(labels: DataFrame, root: str, name: str) -> DataFrame:
    """Components numbered by their least vid."""
    roots = number_rows(labels.select("graph_id", root).distinct(), ["graph_id"], [root], name)
    return labels.join(roots, ["graph_id", root]).select("graph_id", "vid", name)


def connected_components(g: Graphs) -> DataFrame:
    return ranked(component_roots(g), "root", "component")


def component_count(g: Graphs) -> DataFrame:
    """Number of components, and connectedness, of each graph."""

    def solve(flat: Flat):
        comps = flat.per_graph(flat.home[labels_of(flat) == np.arange(flat.total)])
        return flat.rows(np.arange(flat.graphs), components=comps, connected=comps == 1)

    return solved(g, solve, "graph_id string, components long, connected boolean", _large_count)


def _large_count(g: Graphs) -> DataFrame:
    c = _large_roots(g).groupBy("graph_id").agg(F.count_distinct("root").alias("components"))
    return g.graphs.select("graph_id").join(c, "graph_id", "left").select("graph_id", F.coalesce("components", F.lit(0)).alias("components"), (F.coalesce("components", F.lit(0)) == 1).alias("connected"))


def component_members(g: Graphs) -> DataFrame:
    """Size and least member of each component; members are rows of connected_components."""

    def solve(flat: Flat):
        root, size = np.unique(labels_of(flat), return_counts=True)
        return flat.rows(flat.home[root], root=flat.vid[root], size=size)

    return solved(g, solve, "graph_id string, root long, size long", lambda x: _large_roots(x).groupBy("graph_id", "root").agg(F.count("*").alias("size")))


def component_summary(g: Graphs) -> DataFrame:
    """Vertices and edges of each component, and whether it is a tree."""

    def solve(flat: Flat):
        label = labels_of(flat)
        root, n = np.unique(label, return_counts=True)
        m = np.bincount(label[flat.src], minlength=flat.total)[root].astype(np.int64)
        loops = np.bincount(label[flat.src[flat.src == flat.dst]], minlength=flat.total)[root]
        return flat.rows(flat.home[root], root=flat.vid[root], n=n, m=m, is_tree=(m == n - 1) & (loops == 0))

    return solved(g, solve, "graph_id string, root long, n long, m long, is_tree boolean", _large_summary)


def _large_summary(g: Graphs) -> DataFrame:
    roots = _large_roots(g)
    v = roots.groupBy("graph_id", "root").agg(F.count("*").alias("n"))
    e = g.edges.select("graph_id", F.col("src").alias("vid"), (F.col("src") == F.col("dst")).cast("int").alias("loop")).join(roots, ["graph_id", "vid"]).groupBy("graph_id", "root").agg(F.count("*").alias("m"), F.sum("loop").alias("loops"))
    d = v.join(e, ["graph_id", "root"], "left").fillna(0, ["m", "loops"])
    return d.select("graph_id", "root", "n", "m", ((F.col("m") == F.col("n") - 1) & (F.col("loops") == 0)).alias("is_tree"))


def _least_reaching(own: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, x): the least label among the vertices that reach each vertex over steps(u -> v).

    ``own(id, label)`` has labels that differ.  Besides one step, each round also jumps to
    the label that the vertex behind one's own label has found, so long ways take few rounds.
    """
    now = settle(own.select("id", "label", F.col("label").alias("x")), "spread")
    while True:
        moved = steps.join(now.select(F.col("id").alias("u"), F.col("x").alias("got")), "u").groupBy(F.col("v").alias("id")).agg(F.min("got").alias("got"))
        stepped = now.join(moved, "id", "left").select("id", "label", F.col("x").alias("old"), F.least("x", F.coalesce("got", "x")).alias("x1"))
        jumped = stepped.join(now.select(F.col("label").alias("x1"), F.col("x").alias("far")), "x1", "left")
        changed = Observation()
        after = jumped.select("id", "label", F.least("x1", F.coalesce("far", "x1")).alias("x"), (F.col("old") != F.least("x1", F.coalesce("far", "x1"))).alias("up"))
        after = settle(after.observe(changed, F.count_if("up").alias("n")).drop("up"), "spread")
        discard(now)
        now = after
        if not changed.get.get("n"):
            return now.select("id", "x")


def strong_components(g: Graphs) -> DataFrame:
    """(graph_id, vid, scc): least vid of each vertex's strong component."""

    def solve(flat: Flat):
        label = strong_labels(flat.total, Steps(flat.total, *flat.arcs()))
        return flat.rows(flat.home, vid=flat.vid, scc=flat.vid[label])

    return g.shared("sccs", lambda: solved(g, solve, "graph_id string, vid long, scc long", _strong_components))


def _strong_components(g: Graphs) -> DataFrame:
    """strong_components over the cluster.

    Every round labels the vertices anew at random and finds for each the least label that
    reaches it and the least label that it reaches.  Where both are one vertex, that vertex
    is in its strong component.  Vertices whose two labels differ from those of a neighbour
    are in another component than it, so arcs between them go; vertices that have lost all
    arcs on one side stand alone.  What is left is cut up as by quicksort, so the number of
    rounds follows the logarithm of the longest way.
    """
    arcs = g.arcs().join(g.graphs.select("graph_id", "base"), "graph_id")
    steps = settle(arcs.select((F.col("base") + F.col("u")).alias("u"), (F.col("base") + F.col("v")).alias("v")), "steps")
    vertices = g.vertices.join(g.graphs.select("graph_id", "base"), "graph_id").select("graph_id", "vid", (F.col("base") + F.col("vid")).alias("id"), "base")
    found: DataFrame | None = None
    turn = 0
    while steps.limit(1).count():
        ends = steps.select(F.col("u").alias("id")).distinct().join(steps.select(F.col("v").alias("id")).distinct(), "id", "left_semi")
        live = settle(ends, "live")
        inside = settle(steps.join(live.withColumnRenamed("id", "u"), "u", "left_semi").join(live.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v"), "steps")
        own = live.select("id", F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("i")).alias("label"))
        before = _least_reaching(own, inside).withColumnRenamed("x", "f")
        after = _least_reaching(own, inside.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumnRenamed("x", "b")
        labels = settle(before.join(after, "id"), "labels")
        done = labels.filter("f = b").select("id", F.col("f.i").alias("pivot"))
        found = done if found is None else found.union(done)
        left = labels.filter("f <> b")
        u, v = (left.select(F.col("id").alias(x), F.col("f").alias(f"f{x}"), F.col("b").alias(f"b{x}")) for x in "uv")
        steps = settle(inside.join(u, "u").join(v, "v").filter("fu = fv and bu = bv").select("u", "v"), "steps")
        turn += 1
    if found is None:
        return vertices.select("graph_id", "vid", F.col("vid").alias("scc"))
    root = found.groupBy("pivot").agg(F.min("id").alias("root"))
    named = found.join(root, "pivot").select("id", "root")
    return vertices.join(named, "id", "left").select("graph_id", "vid", (F.coalesce("root", "id") - F.col("base")).alias("scc"))


def strong_count(g: Graphs) -> DataFrame:
    c = strong_components(g).groupBy("graph_id").agg(F.count_distinct("scc").alias("strong_components"))
    return c.select("graph_id", "strong_components", (F.col("strong_components") == 1).alias("strongly_connected"))


def disconnecting_set(g: Graphs) -> DataFrame:
    """The neighbours of the vertex with fewest distinct neighbours (least vid on ties).

    No rows for a disconnected graph (nothing need go) and for a complete one (nothing helps).
    """
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    nb = g.nbrs()
    d = g.vertices.join(nb.groupBy("graph_id", F.col("u").alias("vid")).agg(F.count("*").alias("k")), ["graph_id", "vid"], "left").fillna(0, ["k"])
    low = d.groupBy("graph_id").agg(F.min(F.struct("k", "vid")).alias("m")).select("graph_id", F.col("m.k").alias("k"), F.col("m.vid").alias("u"))
    ok = low.join(n, "graph_id").join(component_count(g).filter("connected"), "graph_id", "left_semi").filter("k < n - 1")
    return nb.join(ok.select("graph_id", "u"), ["graph_id", "u"]).select("graph_id", F.col("v").alias("vid"))
