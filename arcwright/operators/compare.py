"""Whole-graph set operations and comparison by labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwright.operators.adjacency import distinct_arcs
from arcwright.operators.model import Graphs
from arcwright.operators.stats import order_size, possible_arcs


def complement(g: Graphs) -> DataFrame:
    """Non-adjacent pairs of each graph; the output is quadratic in n, and it is whole."""
    v = g.vertices.join(g.graphs.select("graph_id", "directed"), "graph_id")
    a = v.select("graph_id", "directed", F.col("vid").alias("u"))
    b = v.select("graph_id", F.col("vid").alias("v"))
    every = a.join(b, "graph_id").filter("u < v or (directed and u <> v)")
    return every.join(g.arcs(), ["graph_id", "u", "v"], "left_anti").select("graph_id", "u", "v")


def complement_size(g: Graphs) -> DataFrame:
    d = order_size(g).join(distinct_arcs(g), "graph_id")
    return d.select("graph_id", (possible_arcs(F.col("n"), F.col("kind") == "digraph").cast("long") - F.col("distinct_arcs")).alias("complement_size"))


def _by_name(g: Graphs, prefix: str) -> DataFrame:
    a = g.vertices.select("graph_id", F.col("vid").alias("u"), F.col("name").alias("un"))
    b = g.vertices.select("graph_id", F.col("vid").alias("v"), F.col("name").alias("vn"))
    m = g.mult().join(a, ["graph_id", "u"]).join(b, ["graph_id", "v"])
    return m.select(F.col("graph_id").alias(f"{prefix}_id"), "un", "vn", F.col("mult").alias(f"{prefix}_mult"))


def label_subgraph(a: Graphs, b: Graphs, pairs: DataFrame) -> DataFrame:
    """Is graph a_id of ``a`` a subgraph of b_id of ``b``, vertices matched by name?

    pairs(a_id, b_id).  Returns is_subgraph, is_induced and same_labelled (induced and of
    equal order).  Names are unique within a graph here.
    """
    va = a.vertices.select(F.col("graph_id").alias("a_id"), "name")
    vb = b.vertices.select(F.col("graph_id").alias("b_id"), "name", F.lit(1).alias("there"))
    have = pairs.join(va, "a_id").join(vb, ["b_id", "name"], "left").groupBy("a_id", "b_id").agg(F.count("*").alias("na"), F.count("there").alias("common"))
    nb = b.vertices.groupBy(F.col("graph_id").alias("b_id")).agg(F.count("*").alias("nb"))
    ea, eb = _by_name(a, "a"), _by_name(b, "b")
    inside = (
        pairs.join(eb, "b_id")
        .join(va.select("a_id", F.col("name").alias("un")), ["a_id", "un"], "left_semi")
        .join(va.select("a_id", F.col("name").alias("vn")), ["a_id", "vn"], "left_semi")
    )
    both = pairs.join(ea, "a_id").join(inside, ["a_id", "b_id", "un", "vn"], "full").fillna(0, ["a_mult", "b_mult"])
    fit = both.groupBy("a_id", "b_id").agg(F.bool_and(F.col("a_mult") <= F.col("b_mult")).alias("le"), F.bool_and(F.col("a_mult") == F.col("b_mult")).alias("eq"))
    x = pairs.join(have, ["a_id", "b_id"]).join(nb, "b_id").join(fit, ["a_id", "b_id"], "left")
    all_in = F.col("na") == F.col("common")
    return x.select(
        "a_id",
        "b_id",
        (all_in & F.coalesce("le", F.lit(True))).alias("is_subgraph"),
        (all_in & F.coalesce("eq", F.lit(True))).alias("is_induced"),
        (all_in & F.coalesce("eq", F.lit(True)) & (F.col("na") == F.col("nb"))).alias("same_labelled"),
    )


def compare_report(a: Graphs, b: Graphs, pairs: DataFrame) -> DataFrame:
    """The six comparisons for pairs(a_id, b_id), and 'n/a' where only one graph is directed.

    same_labelled, a_in_b and b_in_a go by vertex names; isomorphic, a_embeds and b_embeds up to
    renaming, each with its first mapping by names.  Weights are ignored.
    """
    from arcwright.functions.durable import settle
    from arcwright.operators import matching

    key = matching.PAIR
    pairs = settle(pairs.select(*key).distinct(), "pairs")
    turned = pairs.select(F.col("a_id").alias("b_id"), F.col("b_id").alias("a_id")).select(*key)
    back = lambda df: df.select(F.col("a_id").alias("b_id"), F.col("b_id").alias("a_id"), *[c for c in df.columns if c not in key])

    def matched(find, x: Graphs, y: Graphs, asked: DataFrame, name: str, text: str) -> DataFrame:
        found = settle(find(x, y, asked), "matches")
        status = [c for c in found.columns if c not in (*key, "map")][0]
        return found.join(matching.mapping_string(found, x, y), key).select(*key, F.col(status).alias(name), F.col("mapping").alias(text))

    labels = label_subgraph(a, b, pairs).select(*key, "same_labelled", F.col("is_subgraph").alias("a_in_b"))
    other = back(label_subgraph(b, a, turned).select(*key, F.col("is_subgraph").alias("b_in_a")))
    iso = matched(matching.isomorphism, a, b, pairs, "isomorphic", "mapping")
    inside = matched(matching.subgraph_embedding, a, b, pairs, "a_embeds", "a_mapping")
    around = back(matched(matching.subgraph_embedding, b, a, turned, "b_embeds", "b_mapping"))
    out = pairs.join(labels, key).join(other, key).join(iso, key).join(inside, key).join(around, key)
    word = lambda c: F.when(F.col("isomorphic") == "n/a", "n/a").when(F.col(c), "yes").otherwise("no").alias(c)
    return out.select(*key, word("same_labelled"), word("a_in_b"), word("b_in_a"), "isomorphic", "mapping", "a_embeds", "a_mapping", "b_embeds", "b_mapping")
