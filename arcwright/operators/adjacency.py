"""Adjacency projections: multiplicities, weights, neighbours, degrees, parallel edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwright.operators.model import Graphs


def edge_multiplicity(g: Graphs) -> DataFrame:
    """Edges per ordered pair, loops on the diagonal; undirected pairs in both orders."""
    return g.mult()


def underlying_multiplicity(g: Graphs) -> DataFrame:
    return g.pairs()


def weight_matrix(g: Graphs) -> DataFrame:
    """Lightest edge of each ordered pair; loops have none."""
    return g.arcs().select("graph_id", "u", "v", "min_w")


def out_neighbours(g: Graphs) -> DataFrame:
    return g.arcs().groupBy("graph_id", "u").agg(F.sort_array(F.collect_set("v")).alias("neighbours"))


def underlying_neighbours(g: Graphs) -> DataFrame:
    return g.nbrs().groupBy("graph_id", "u").agg(F.sort_array(F.collect_set("v")).alias("neighbours"))


def count_between(g: Graphs, pairs: DataFrame) -> DataFrame:
    """Edges s -> t and edges joining s and t, for the rows of pairs(graph_id, s, t)."""
    m = g.mult().select("graph_id", F.col("u").alias("s"), F.col("v").alias("t"), F.col("mult").alias("n_arcs"))
    u = g.nbrs().select("graph_id", F.col("u").alias("s"), F.col("v").alias("t"), "ucount")
    both = pairs.join(m, ["graph_id", "s", "t"], "left").join(u, ["graph_id", "s", "t"], "left")
    n = F.coalesce("n_arcs", F.lit(0))
    return both.select("graph_id", "s", "t", n.alias("n_arcs"), F.when(F.col("s") == F.col("t"), n).otherwise(F.coalesce("ucount", F.lit(0))).alias("n_joining"))


def binary_adjacency(g: Graphs) -> DataFrame:
    """Rows of 0 and 1, one text per vertex, built from the runs between its neighbours; n characters for each of n vertices."""
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    near = g.arcs().groupBy("graph_id", "u").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    x = g.vertices.select("graph_id", F.col("vid").alias("u")).join(n, "graph_id").join(near, ["graph_id", "u"], "left")
    zeros = lambda k: F.repeat(F.lit("0"), k.cast("int"))
    vs = F.coalesce("vs", F.array().cast("array<bigint>"))
    before = lambda i: F.coalesce(F.get("vs", i - 1), F.lit(-1))
    runs = F.array_join(F.transform(vs, lambda v, i: F.concat(zeros(v - before(i) - 1), F.lit("1"))), "")
    return x.select("graph_id", "u", F.concat(runs, zeros(F.col("n") - 1 - F.coalesce(F.array_max("vs"), F.lit(-1)))).alias("cells"))


def degrees(g: Graphs) -> DataFrame:
    """degree (a loop adds 2), indeg, outdeg and loops of every vertex."""
    loop = F.when(F.col("src") == F.col("dst"), 1).otherwise(0)
    ends = F.array(F.struct(F.col("src").alias("vid"), F.lit(0).alias("is_in")), F.struct(F.col("dst").alias("vid"), F.lit(1).alias("is_in")))
    x = g.edges.select("graph_id", loop.alias("loop"), F.explode(ends).alias("end")).select("graph_id", "loop", "end.*")
    n = x.groupBy("graph_id", "vid").agg(F.count("*").alias("degree"), F.sum("is_in").alias("ins"), F.sum(F.col("loop") * F.col("is_in")).alias("loops"))
    d = g.vertices.select("graph_id", "vid").join(n, ["graph_id", "vid"], "left").join(g.graphs.select("graph_id", "directed"), "graph_id").fillna(0, ["degree", "ins", "loops"])
    return d.select(
        "graph_id",
        "vid",
        "degree",
        F.when(F.col("directed"), F.col("ins")).otherwise(F.col("degree")).alias("indeg"),
        F.when(F.col("directed"), F.col("degree") - F.col("ins")).otherwise(F.col("degree")).alias("outdeg"),
        "loops",
    )


def isolated_vertices(g: Graphs) -> DataFrame:
    """Vertices of degree 0; a vertex with only a loop is not one."""
    touched = g.edges.select("graph_id", F.explode(F.array("src", "dst")).alias("vid"))
    return g.vertices.join(touched, ["graph_id", "vid"], "left_anti").select("graph_id", "vid", "name")


def loop_vertices(g: Graphs) -> DataFrame:
    return g.edges.filter("src = dst").groupBy("graph_id", F.col("src").alias("vid")).agg(F.count("*").alias("loops"))


def distinct_arcs(g: Graphs) -> DataFrame:
    """Number of adjacent pairs per graph: ordered if directed."""
    once = g.arcs().join(g.graphs.select("graph_id", "directed"), "graph_id").filter("directed or u < v")
    n = once.groupBy("graph_id").agg(F.count("*").alias("n"))
    return g.graphs.select("graph_id").join(n, "graph_id", "left").select("graph_id", F.coalesce("n", F.lit(0)).alias("distinct_arcs"))


def simple_flags(g: Graphs) -> DataFrame:
    """is_simple, is_underlying_simple and has_parallel of each graph."""
    m = g.mult().groupBy("graph_id").agg(F.max(F.when(F.col("u") == F.col("v"), 1).otherwise(0)).alias("loop"), F.max(F.when(F.col("u") != F.col("v"), F.col("mult"))).alias("most"))
    u = g.pairs().groupBy("graph_id").agg(F.max("ucount").alias("umost"))
    d = g.graphs.select("graph_id").join(m, "graph_id", "left").join(u, "graph_id", "left").fillna(0)
    return d.select(
        "graph_id", ((F.col("loop") == 0) & (F.col("most") <= 1)).alias("is_simple"), ((F.col("loop") == 0) & (F.col("umost") <= 1)).alias("is_underlying_simple"), (F.col("most") > 1).alias("has_parallel")
    )


def parallel_pairs(g: Graphs) -> DataFrame:
    many = g.arcs().join(g.graphs.select("graph_id", "directed"), "graph_id").filter("mult > 1 and (directed or u < v)")
    n = many.groupBy("graph_id").agg(F.count("*").alias("n"))
    return g.graphs.select("graph_id").join(n, "graph_id", "left").select("graph_id", F.coalesce("n", F.lit(0)).alias("parallel_pairs"))


def parallel_slots(g: Graphs) -> DataFrame:
    """Place and size of each edge within its group of parallel edges, and whether it runs backwards."""
    group = Window.partitionBy("graph_id", "lo", "hi")
    e = g.edges.select("graph_id", "eid", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), (F.col("src") > F.col("dst")).alias("reversed"))
    return e.select("graph_id", "eid", (F.row_number().over(group.orderBy("eid")) - 1).alias("slot"), F.count("*").over(group).alias("slots"), "reversed")
