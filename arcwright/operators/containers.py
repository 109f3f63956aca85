"""Containers of vertex-disjoint paths and wide diameters, for graphs of few vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwright.operators.model import Graphs
from arcwright.operators.pairs import KEY, simple_paths

VERTEX_LIMIT = 8
PATHS_KEPT = 1500


def container_pairs(g: Graphs, most_vertices: int = VERTEX_LIMIT) -> DataFrame:
    """All pairs of distinct vertices (unordered if undirected) of graphs within the limit."""
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n")).filter(F.col("n") <= most_vertices)
    v = g.vertices.join(n, "graph_id", "left_semi").join(g.graphs.select("graph_id", "directed"), "graph_id")
    a, b = v.select("graph_id", "directed", F.col("vid").alias("s")), v.select("graph_id", F.col("vid").alias("t"))
    return a.join(b, "graph_id").filter("s < t or (directed and s <> t)").select(*KEY)


def containers(g: Graphs, most_vertices: int = VERTEX_LIMIT) -> DataFrame:
    """(graph_id, s, t, paths, kept): greedy sets of internally disjoint paths.

    From each path in turn, all paths in order that stay disjoint are added; a set within an
    earlier kept one is dropped.  ``kept`` holds the path numbers of each set, in order of vids.
    """
    found = simple_paths(g, container_pairs(g, most_vertices), most=PATHS_KEPT).select(*KEY, "path")
    listed = F.transform(F.sort_array(F.collect_list("path")), lambda p: F.struct(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))).alias("inner"), (F.size(p) - 1).alias("length")))
    rows = found.groupBy(*KEY).agg(listed.alias("p")).withColumn("paths", F.transform("p", lambda x, i: F.struct(i.alias("no"), x["inner"].alias("inner"), x["length"].alias("length")))).drop("p")

    def grow(seed: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            fits = (x["no"] != seed["no"]) & ~F.arrays_overlap(acc["used"], x["inner"])
            return F.when(fits, F.struct(F.concat(acc["used"], x["inner"]).alias("used"), F.concat(acc["set"], F.array(x["no"])).alias("set"))).otherwise(acc)

        return F.sort_array(F.aggregate("paths", F.struct(seed["inner"].alias("used"), F.array(seed["no"]).alias("set")), add)["set"])

    def keep(acc: Column, c: Column) -> Column:
        within = F.exists(acc, lambda k: F.size(F.array_except(c, k)) == 0)
        return F.when(within, acc).otherwise(F.concat(acc, F.array(c)))

    sets = rows.withColumn("sets", F.transform("paths", grow))
    return sets.select(*KEY, "paths", F.aggregate("sets", F.array().cast("array<array<int>>"), keep).alias("kept"))


def k_wide_distance(g: Graphs, most_vertices: int = VERTEX_LIMIT) -> DataFrame:
    """d_k(s, t): the least k-th shortest length over containers of width k or more."""
    c = containers(g, most_vertices).select(*KEY, "paths", F.explode("kept").alias("c"))
    lengths = F.sort_array(F.transform("c", lambda i: F.get(F.col("paths"), i)["length"]))
    each = c.select(*KEY, F.posexplode(lengths).alias("pos", "length"))
    return each.groupBy(*KEY, (F.col("pos") + 1).alias("k")).agg(F.min("length").alias("d_k"))


def wide_diameter(g: Graphs, most_vertices: int = VERTEX_LIMIT) -> DataFrame:
    """D_k: the largest d_k over the pairs that have width k."""
    return k_wide_distance(g, most_vertices).groupBy("graph_id", "k").agg(F.max("d_k").alias("diameter"))


DETAILED = 5


def container_detail(g: Graphs, most_vertices: int = VERTEX_LIMIT, most: int = DETAILED) -> DataFrame:
    """The widest containers of each pair: graph_id, s, t, place, width, longest, numbers.

    Width falling, then longest path rising, then the order of the containers; ``numbers`` are
    path numbers in order of vids, longest path first.  The number of containers of a pair is in
    ``containers``.  A pair's containers stand in one row, of bounded length by the limits.
    """
    c = containers(g, most_vertices).select(*KEY, "paths", F.size("kept").alias("containers"), F.posexplode("kept").alias("turn", "c"))
    length = lambda i: F.get(F.col("paths"), i)["length"]
    c = c.withColumn("width", F.size("c")).withColumn("longest", F.array_max(F.transform("c", length)))
    place = Window.partitionBy(*KEY).orderBy(F.desc("width"), "longest", "turn")
    ordered = F.transform(F.array_sort(F.transform("c", lambda i: F.struct((-length(i)).alias("l"), i.alias("i")))), lambda x: x["i"])
    return c.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most).select(*KEY, "place", "width", "longest", "containers", ordered.alias("numbers"))
