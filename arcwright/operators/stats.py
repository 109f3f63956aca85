"""Graph-level statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwright.operators.adjacency import degrees, distinct_arcs
from arcwright.operators.model import Graphs


def round2(x: Column) -> Column:
    """Report rounding: floor(100 x + 0.5) / 100."""
    return F.floor(x * 100 + 0.5) / 100


def order_size(g: Graphs) -> DataFrame:
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    m = g.edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    d = g.graphs.join(n, "graph_id", "left").join(m, "graph_id", "left").fillna(0, ["n", "m"])
    return d.select("graph_id", "n", "m", F.when(F.col("directed"), "digraph").otherwise("graph").alias("kind"))


def possible_arcs(n: Column, directed: Column) -> Column:
    return F.when(directed, n * (n - 1)).otherwise(n * (n - 1) / 2).cast("double")


def density(g: Graphs) -> DataFrame:
    """Distinct arcs over possible ones, its label, and as a whole percentage (null below two vertices)."""
    d = order_size(g).join(distinct_arcs(g), "graph_id")
    ratio = F.when(F.col("n") < 2, 0.0).otherwise(F.col("distinct_arcs") / possible_arcs(F.col("n"), F.col("kind") == "digraph"))
    d = d.withColumn("density", ratio)
    label = F.when(F.col("n") < 2, "n/a").when(F.col("density") <= 0.3, "Sparse").when(F.col("density") >= 0.7, "Dense").otherwise("Moderate")
    percent = F.when(F.col("n") >= 2, F.floor(F.round("density", 9) * 100 + 0.5))
    return d.select("graph_id", F.round("density", 9).alias("density"), label.alias("label"), percent.alias("percent"))


def weight_summary(g: Graphs) -> DataFrame:
    w = g.edges.groupBy("graph_id").agg(F.sum("weight").alias("total"), F.min("weight").alias("lightest"), F.max("weight").alias("heaviest"))
    return g.graphs.select("graph_id").join(w, "graph_id", "left")


def _three_kinds(g: Graphs) -> DataFrame:
    return degrees(g).select("graph_id", "vid", F.expr("stack(3, 'total', degree, 'in', indeg, 'out', outdeg) as (kind, degree)"))


def degree_stats(g: Graphs) -> DataFrame:
    d = _three_kinds(g).groupBy("graph_id", "kind").agg(F.min("degree").alias("least"), F.max("degree").alias("most"), F.sum("degree").alias("s"), F.count("*").alias("c"))
    return d.select("graph_id", "kind", "least", "most", F.round(F.col("s") / F.col("c"), 9).alias("mean"))


def degree_distribution(g: Graphs) -> DataFrame:
    """Vertices per degree, in percent too, with the least vid of each degree.

    Members are found by joining back; no list is gathered, since one degree may hold most vertices.
    """
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    bins = _three_kinds(g).groupBy("graph_id", "kind", "degree").agg(F.count("*").alias("freq"), F.min("vid").alias("first_vid"))
    return bins.join(n, "graph_id").select("graph_id", "kind", "degree", "freq", F.round(100.0 * F.col("freq") / F.col("n"), 9).alias("percent"), "first_vid")


def degree_members(g: Graphs) -> DataFrame:
    """(graph_id, kind, degree, vid, name): the vertices of each degree, as rows however many they are."""
    return _three_kinds(g).join(g.vertices, ["graph_id", "vid"]).select("graph_id", "kind", "degree", "vid", "name")


def degree_names(g: Graphs, most: int = 50) -> DataFrame:
    """(graph_id, kind, degree, freq, names, more): the first ``most`` names of each degree by vid.

    ``more`` counts those that are left out; degree_members gives them all.  Vertices are cut
    down to the first ones of each range of vids before a list is made.
    """
    d = degree_members(g).withColumn("slot", F.floor(F.col("vid") / (64 * most)))
    bins = ["graph_id", "kind", "degree"]
    freq = d.groupBy(*bins).agg(F.count("*").alias("freq"))
    near = d.withColumn("place", F.row_number().over(Window.partitionBy(*bins, "slot").orderBy("vid"))).filter(F.col("place") <= most)
    first = near.withColumn("place", F.row_number().over(Window.partitionBy(*bins).orderBy("vid"))).filter(F.col("place") <= most)
    names = first.groupBy(*bins).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vid", "name"))), lambda x: x["name"]), ", ").alias("names"))
    return freq.join(names, bins).select(*bins, "freq", "names", F.greatest(F.col("freq") - most, F.lit(0)).alias("more"))
