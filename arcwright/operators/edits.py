"""Table edits and validation, in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwright.functions.numbering import number_rows
from arcwright.operators.model import Graphs


def remove_vertices(g: Graphs, gone: DataFrame) -> Graphs:
    """Drop gone(graph_id, vid) with their edges and close the gaps in both numberings."""
    v = number_rows(g.vertices.join(gone, ["graph_id", "vid"], "left_anti"), ["graph_id"], ["vid"], "new")
    s, d = v.select("graph_id", F.col("vid").alias("src"), F.col("new").alias("s")), v.select("graph_id", F.col("vid").alias("dst"), F.col("new").alias("d"))
    e = number_rows(g.edges.join(s, ["graph_id", "src"]).join(d, ["graph_id", "dst"]), ["graph_id"], ["eid"], "new")
    return Graphs(g.graphs, v.select("graph_id", F.col("new").alias("vid"), "name"), e.select("graph_id", F.col("new").alias("eid"), F.col("s").alias("src"), F.col("d").alias("dst"), "weight"))


def remove_edges(g: Graphs, gone: DataFrame) -> Graphs:
    e = number_rows(g.edges.join(gone, ["graph_id", "eid"], "left_anti"), ["graph_id"], ["eid"], "new")
    return Graphs(g.graphs, g.vertices, e.select("graph_id", F.col("new").alias("eid"), "src", "dst", "weight"))


def reverse_edges(g: Graphs, chosen: DataFrame) -> DataFrame:
    """Edges with the ends of chosen(graph_id, eid) swapped; a loop stays."""
    e = g.edges.join(chosen.withColumn("_turn", F.lit(True)), ["graph_id", "eid"], "left")
    turn = F.col("_turn").isNotNull()
    return e.select("graph_id", "eid", F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"), "weight")


def set_weights(g: Graphs, new: DataFrame) -> DataFrame:
    """Edges with the weights of new(graph_id, eid, new_weight) put in."""
    e = g.edges.join(new, ["graph_id", "eid"], "left")
    return e.select("graph_id", "eid", "src", "dst", F.coalesce("new_weight", "weight").alias("weight"))


def rename_vertices(g: Graphs, new: DataFrame) -> DataFrame:
    v = g.vertices.join(new, ["graph_id", "vid"], "left")
    return v.select("graph_id", "vid", F.coalesce("new_name", "name").alias("name"))


def check_names(vertices: DataFrame) -> DataFrame:
    """Why a name is refused: empty, too long (over 4), white space, taken; null if it is fine."""
    same = F.count("*").over(Window.partitionBy("graph_id", "name"))
    name = F.coalesce("name", F.lit(""))
    reason = F.when(F.length(name) == 0, "empty").when(F.length(name) > 4, "too long").when(name.rlike(r"\s"), "white space").when(same > 1, "taken")
    return vertices.select("graph_id", "vid", "name", reason.alias("reason"))


def check_new_edges(g: Graphs, batch: DataFrame) -> DataFrame:
    """Why a new edge (graph_id, turn, src, dst) is refused: loop or parallel, unless multi.

    Of a batch the first of a pair wins.
    """
    flags = g.graphs.select("graph_id", "directed", "multi")
    lo, hi = F.when(F.col("directed"), F.col("src")).otherwise(F.least("src", "dst")), F.when(F.col("directed"), F.col("dst")).otherwise(F.greatest("src", "dst"))
    x = batch.join(flags, "graph_id").withColumn("u", lo).withColumn("v", hi)
    x = x.join(g.mult().select("graph_id", "u", "v", F.lit(True).alias("there")), ["graph_id", "u", "v"], "left")
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id", "u", "v").orderBy("turn")))
    reason = F.when(F.col("multi"), None).when(F.col("src") == F.col("dst"), "loop").when(F.col("there") | (F.col("rank") > 1), "parallel")
    return x.select("graph_id", "turn", "src", "dst", reason.alias("reason"))


def parse_weight(text: Column) -> Column:
    """A positive finite number, comma or point as decimal mark, else null."""
    w = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    return F.when((w > 0) & (w < float("inf")), w)


def next_free_names(g: Graphs, want: int) -> DataFrame:
    """The ``want`` least non-negative integers that are no vertex name, per graph."""
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    tries = n.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + F.lit(want - 1))).alias("number"))
    free = tries.withColumn("name", F.col("number").cast("string")).join(g.vertices.select("graph_id", "name"), ["graph_id", "name"], "left_anti")
    w = Window.partitionBy("graph_id").orderBy("number")
    return free.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= want).select("graph_id", "name")


def set_mode(g: Graphs, modes: DataFrame) -> DataFrame:
    """``g.graphs`` with the flags of modes(graph_id, directed, weighted, multi); a null flag stays as it is.

    Edges are left as they are: a mode only says how they are read and which new ones are allowed.
    """
    new = modes.select("graph_id", *[F.col(c).alias("_" + c) for c in ("directed", "weighted", "multi")])
    flags = [F.coalesce("_" + c, c).alias(c) for c in ("directed", "weighted", "multi")]
    return g.graphs.join(new, "graph_id", "left").select("graph_id", *flags, "base")
