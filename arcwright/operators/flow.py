"""Edge and vertex connectivity by maximum flows (Menger, 1927).

Both numbers are least flows over a table of vertex pairs.  Spark deals the pairs of all
graphs out in packs of bounded size, each beside the arcs of its graph, which has few
vertices by the limit; one flow is a small search inside a task, and the packs' least flows
are added up by an aggregation.  No flow is followed beyond what some vertex's degree bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.functions.flat import Flat, Steps, least_labels, strong_labels
from arcwright.operators.model import Graphs
from arcwright.operators.packs import solved

VERTEX_LIMIT = 40
PAIRS_A_PACK = 64
UNBOUNDED = 1 << 40


class Network:
    """Capacities by node; what has been pushed is undone for the next pair."""

    def __init__(self, arcs: list[tuple[int, int, int]]):
        self.full: dict[int, dict[int, int]] = {}
        for u, v, c in arcs:
            own = self.full.setdefault(u, {})
            own[v] = own.get(v, 0) + c
            self.full.setdefault(v, {}).setdefault(u, 0)

    def flow(self, source: int, sink: int, enough: int) -> int:
        """The maximum flow from source to sink, or ``enough`` if it is no less."""
        left = {u: dict(row) for u, row in self.full.items()}
        sent = 0
        while sent < enough:
            depth = self._depths(left, source, sink)
            if sink not in depth:
                break
            sent += self._fill(left, depth, source, sink, enough - sent)
        return sent

    @staticmethod
    def _depths(left: dict[int, dict[int, int]], source: int, sink: int) -> dict[int, int]:
        depth, rim = {source: 0}, [source]
        while rim and sink not in depth:
            rim = [v for u in rim for v, c in left.get(u, {}).items() if c > 0 and v not in depth and depth.setdefault(v, depth[u] + 1)]
        return depth

    def _fill(self, left: dict[int, dict[int, int]], depth: dict[int, int], at: int, sink: int, most: int) -> int:
        """Push up to ``most`` from ``at`` along ways that get one deeper a step; dead ends lose their depth."""
        if at == sink:
            return most
        sent = 0
        for v, c in left[at].items():
            if sent == most:
                break
            if c > 0 and depth.get(v) == depth[at] + 1:
                got = self._fill(left, depth, v, sink, min(most - sent, c))
                left[at][v] -= got
                left[v][at] += got
                sent += got
        if not sent:
            depth[at] = -1
        return sent


def _least_flows(split: bool):
    """Least flow of each pack of pairs; ``split`` puts a capacity of one on every vertex instead of on arcs."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least = []
            for arcs, pairs, enough in zip(batch["arcs"], batch["pairs"], batch["bound"], strict=True):
                edges = [(int(a["u"]), int(a["v"]), int(a["mult"])) for a in arcs] if arcs is not None else []
                if split:  # vertex v: 2 v is where it is entered, 2 v + 1 where it is left
                    ends = {x for u, v, _ in edges for x in (u, v)}
                    edges = [(2 * u + 1, 2 * v, UNBOUNDED) for u, v, _ in edges] + [(2 * x, 2 * x + 1, 1) for x in ends]
                net = Network(edges)
                low = int(enough)
                for p in pairs:
                    if low == 0:
                        break
                    s, t = int(p["s"]), int(p["t"])
                    low = min(low, net.flow(2 * s + 1 if split else s, 2 * t if split else t, low))
                least.append(low)
            yield pd.DataFrame({"graph_id": batch["graph_id"], "low": pd.array(least, dtype="int64")})

    return work


def _least(pairs: DataFrame, arcs: DataFrame, bounds: DataFrame, split: bool) -> DataFrame:
    """(graph_id, low): the least flow over pairs(graph_id, s, t), and at most bounds(graph_id, bound)."""
    pack = F.floor(F.row_number().over(_by_graph("s", "t")) / PAIRS_A_PACK)
    packs = pairs.withColumn("pack", pack).groupBy("graph_id", "pack").agg(F.sort_array(F.collect_list(F.struct("s", "t"))).alias("pairs"))
    lists = arcs.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("u", "v", "mult"))).alias("arcs"))
    rows = packs.join(bounds, "graph_id").join(lists, "graph_id", "left").select("graph_id", "arcs", "pairs", "bound")
    return rows.mapInPandas(_least_flows(split), "graph_id string, low long").groupBy("graph_id").agg(F.min("low").alias("low"))


def _split(arcs: list[tuple[int, int, int]]) -> Network:
    """Capacity one on every vertex; vertex v: 2 v is where it is entered, 2 v + 1 where it is left."""
    ends = {x for u, v, _ in arcs for x in (u, v)}
    return Network([(2 * u + 1, 2 * v, UNBOUNDED) for u, v, _ in arcs] + [(2 * x, 2 * x + 1, 1) for x in ends])


def _edge_flow(n: int, arcs: list[tuple[int, int, int]], directed: bool, low: int) -> int:
    net = Network(arcs)
    for t in range(1, n):
        low = min(low, net.flow(0, t, low))
        low = min(low, net.flow(t, 0, low)) if directed else low
    return low


def _vertex_flow(n: int, arcs: list[tuple[int, int, int]], directed: bool, low: int) -> int:
    """Among the first k + 1 vertices one is outside a least cut of k, so flows beside vertices beyond ``low`` add nothing."""
    net, there, s = _split(arcs), {(u, v) for u, v, _ in arcs}, 0
    while s <= low and s < n:
        for t in range(s + 1, n):
            for x, y in ((s, t), (t, s)) if directed else ((s, t),):
                if (x, y) not in there:
                    low = min(low, net.flow(2 * x + 1, 2 * y, low))
        s += 1
    return low


def _solve_flows(name: str, most_vertices: int, by_edges: bool):
    """Connectivity numbers of a batch of small graphs; parts and degrees settle most of them before any flow."""

    def solve(flat: Flat):
        u, v, count = flat.counted_arcs()
        strong = flat.directed.any()
        label = strong_labels(flat.total, Steps(flat.total, u, v)) if strong else least_labels(flat.total, u, v)
        parts = flat.per_graph(flat.home[label == np.arange(flat.total)])
        weight = count if by_edges else None
        degree = np.minimum(*(np.bincount(x, weight, minlength=flat.total).astype(np.int64) for x in (u, v)))
        low = np.full(flat.graphs, np.iinfo(np.int64).max)
        np.minimum.at(low, flat.home, degree)
        value = np.where((parts > 1) | (flat.n <= 1), 0, np.minimum(low, 1))
        starts = np.searchsorted(u, np.append(flat.first, flat.total))
        for i in np.flatnonzero((parts == 1) & (flat.n > 1) & (low > 1) & (flat.n <= most_vertices)).tolist():
            a, b = starts[i], starts[i + 1]
            arcs = list(zip((u[a:b] - flat.first[i]).tolist(), (v[a:b] - flat.first[i]).tolist(), count[a:b].tolist(), strict=True))
            value[i] = (_edge_flow if by_edges else _vertex_flow)(int(flat.n[i]), arcs, bool(flat.directed[i]), int(low[i]))
        return flat.rows(np.arange(flat.graphs), **{name: pa.array(value, mask=(flat.n > most_vertices) | (flat.n == 0))})

    return solve


def _by_graph(*order: str):
    from pyspark.sql import Window

    return Window.partitionBy("graph_id").orderBy(*order)


def _within(g: Graphs, most_vertices: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes, arcs and vertices of the graphs with 1 to ``most_vertices`` vertices."""
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n")).filter(F.col("n") <= most_vertices)
    sized = n.join(g.graphs.select("graph_id", "directed"), "graph_id")
    arcs = g.arcs().join(n.select("graph_id"), "graph_id", "left_semi").select("graph_id", "u", "v", "mult")
    return sized, arcs, g.vertices.join(n.select("graph_id"), "graph_id", "left_semi").select("graph_id", "vid")


def _degree_bounds(arcs: DataFrame, vertices: DataFrame, weight) -> DataFrame:
    """The least sum of ``weight`` over the arcs that leave, or that enter, one vertex."""
    out = arcs.groupBy("graph_id", F.col("u").alias("vid")).agg(F.sum(weight).alias("out"))
    into = arcs.groupBy("graph_id", F.col("v").alias("vid")).agg(F.sum(weight).alias("into"))
    both = vertices.join(out, ["graph_id", "vid"], "left").join(into, ["graph_id", "vid"], "left").fillna(0, ["out", "into"])
    return both.groupBy("graph_id").agg(F.min(F.least("out", "into")).alias("bound"))


def edge_connectivity(g: Graphs, most_vertices: int = VERTEX_LIMIT) -> DataFrame:
    """(graph_id, edge_connectivity): the least number of edges whose removal (strongly) disconnects.

    Parallel edges count.  0 for a single vertex and for what is not (strongly) connected;
    null above ``most_vertices`` and for a graph without vertices.  Every cut parts vertex 0
    from another one, so flows from 0, and in digraphs to 0, are enough; a vertex of
    degree 0 or 1 settles the matter before any flow.
    """
    return solved(g, _solve_flows("edge_connectivity", most_vertices, by_edges=True), "graph_id string, edge_connectivity long", lambda x: _large_edge(x, most_vertices))


def _large_edge(g: Graphs, most_vertices: int) -> DataFrame:
    sized, arcs, vertices = _within(g, most_vertices)
    bounds = _degree_bounds(arcs, vertices, F.col("mult"))
    others = vertices.filter("vid > 0").join(sized.select("graph_id", "directed"), "graph_id").join(bounds.filter("bound > 0").select("graph_id"), "graph_id", "left_semi")
    forth = others.select("graph_id", F.lit(0).cast("long").alias("s"), F.col("vid").alias("t"))
    back = others.filter("directed").select("graph_id", F.col("vid").alias("s"), F.lit(0).cast("long").alias("t"))
    low = _least(forth.union(back), arcs, bounds, split=False)
    found = sized.join(bounds, "graph_id").join(low, "graph_id", "left")
    value = F.when(F.col("n") == 1, 0).otherwise(F.coalesce("low", "bound"))
    return g.graphs.select("graph_id").join(found.select("graph_id", value.cast("long").alias("edge_connectivity")), "graph_id", "left")


def vertex_connectivity(g: Graphs, most_vertices: int = VERTEX_LIMIT) -> DataFrame:
    """(graph_id, vertex_connectivity): the least number of vertices whose removal (strongly) disconnects.

    n - 1 for a complete graph; parallel edges make no difference; else as edge_connectivity.
    Flows run between all pairs without an arc from the one to the other.
    """
    return solved(g, _solve_flows("vertex_connectivity", most_vertices, by_edges=False), "graph_id string, vertex_connectivity long", lambda x: _large_vertex(x, most_vertices))


def _large_vertex(g: Graphs, most_vertices: int) -> DataFrame:
    sized, arcs, vertices = _within(g, most_vertices)
    bounds = _degree_bounds(arcs, vertices, F.lit(1))
    a = vertices.join(sized.select("graph_id", "directed"), "graph_id").select("graph_id", "directed", F.col("vid").alias("s"))
    every = a.join(vertices.select("graph_id", F.col("vid").alias("t")), "graph_id").filter("s < t or (directed and s <> t)").select("graph_id", "s", "t")
    apart = every.join(arcs.select("graph_id", F.col("u").alias("s"), F.col("v").alias("t")), ["graph_id", "s", "t"], "left_anti")
    low = _least(apart, arcs, bounds, split=True)
    found = sized.join(low, "graph_id", "left")
    return g.graphs.select("graph_id").join(found.select("graph_id", F.coalesce("low", F.col("n") - 1).cast("long").alias("vertex_connectivity")), "graph_id", "left")
