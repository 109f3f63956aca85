"""Graphs as tables, and the three derived tables that most operators start from.

graphs(graph_id, directed, weighted, multi, base), vertices(graph_id, vid, name),
edges(graph_id, eid, src, dst, weight).  ``vid`` and ``eid`` are 0-based positions and all
tie-breaks use them; ``base + vid`` is unique over all graphs of a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.functions.durable import settle
from arcwright.functions.numbering import number_rows


@dataclass
class Graphs:
    graphs: DataFrame
    vertices: DataFrame
    edges: DataFrame
    kept: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)
    large: list[Graphs] | None = field(default=None, repr=False, compare=False)  # see operators/packs.py

    def shared(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several operators ask for, written once for this graph set."""
        if name not in self.kept:
            self.kept[name] = settle(make(), name)
        return self.kept[name]

    def flagged_edges(self) -> DataFrame:
        return self.edges.join(self.graphs.select("graph_id", "directed"), "graph_id")

    def both_ways(self) -> DataFrame:
        """Edges as the adjacency sees them: undirected ones from both ends, loops once."""
        forth, back = F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))
        ways = F.when(~F.col("directed") & (F.col("src") != F.col("dst")), F.array(forth, back)).otherwise(F.array(forth))
        return self.flagged_edges().select("graph_id", "eid", F.explode(ways).alias("way"), "weight").select("graph_id", "eid", "way.u", "way.v", "weight")

    def mult(self) -> DataFrame:
        return self.both_ways().groupBy("graph_id", "u", "v").agg(F.count("*").alias("mult"))

    def arcs(self) -> DataFrame:
        return self.both_ways().filter("u <> v").groupBy("graph_id", "u", "v").agg(F.count("*").alias("mult"), F.min("weight").alias("min_w"))

    def pairs(self) -> DataFrame:
        """Joined pairs u < v whatever the direction, with their number of edges."""
        e = self.edges.filter("src <> dst")
        return e.groupBy("graph_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").alias("ucount"))

    def nbrs(self) -> DataFrame:
        turned = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        return self.pairs().select("graph_id", F.explode(turned).alias("way"), "ucount").select("graph_id", "way.u", "way.v", "ucount")


def snapshot(flags: DataFrame, vertices: DataFrame, edges: DataFrame, vertex_order: list[str], edge_order: list[str]) -> Graphs:
    """Index a graph table: 0-based vertex and edge ids by the given orders.

    flags(graph_id, directed, weighted, multi); vertices(graph_id, name, ...) with names
    unique in a graph; edges(graph_id, src_name, dst_name, weight, ...).  Edges whose ends
    are no vertices are dropped.  Graphs without vertices keep their row in ``graphs``.
    Coordinates x and y stay with the vertices where there are any.
    """
    v = settle(number_rows(vertices, ["graph_id"], vertex_order, "vid", "gid"), "vertices")
    base = v.groupBy("graph_id").agg((F.min("gid")).alias("base"))
    graphs = settle(flags.join(base, "graph_id", "left").withColumn("base", F.coalesce("base", F.lit(0))), "graphs")
    numbered = number_rows(edges, ["graph_id"], edge_order, "eid")
    s = v.select("graph_id", F.col("name").alias("src_name"), F.col("vid").alias("src"))
    d = v.select("graph_id", F.col("name").alias("dst_name"), F.col("vid").alias("dst"))
    e = numbered.join(s, ["graph_id", "src_name"]).join(d, ["graph_id", "dst_name"])
    spots = [c for c in ("x", "y") if c in vertices.columns]
    return Graphs(graphs, v.select("graph_id", "vid", "name", *spots), settle(e.select("graph_id", "eid", "src", "dst", "weight"), "edges"))


class Drawn(Graphs):
    """A graph table that is still to be indexed: its raw rows, and ``snapshot`` of them on demand.

    Operators that solve small graphs inside tasks (operators/packs.py) pack the raw rows and need no
    index.  All graphs have the same flags; without ``listed``, vertices are the ends of the edges.
    """

    def __init__(self, directed: bool, weighted: bool, multi: bool, vertices: DataFrame, edges: DataFrame, listed: bool, edge_order: list[str]):
        self.raw_vertices, self.raw_edges, self.listed, self.edge_order = vertices, edges, listed, edge_order
        self.flags = {"directed": directed, "weighted": weighted, "multi": multi}
        self.kept, self.large = {}, None

    def indexed(self, only: DataFrame | None = None) -> Graphs:
        """The tables of all graphs, or of those in only(graph_id)."""
        v, e = self.raw_vertices, self.raw_edges
        if only is not None:
            v, e = v.join(only, "graph_id", "left_semi"), e.join(only, "graph_id", "left_semi")
        flags = v.select("graph_id").distinct().select("graph_id", *[F.lit(x).alias(k) for k, x in self.flags.items()])
        return snapshot(flags, v, e, ["kind", "key"], self.edge_order)

    @cached_property
    def _tables(self) -> Graphs:
        return self.indexed()

    graphs = property(lambda self: self._tables.graphs)
    vertices = property(lambda self: self._tables.vertices)
    edges = property(lambda self: self._tables.edges)
