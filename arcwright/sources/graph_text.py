"""Graph files as text: the sectioned form and the older 0/1 adjacency form.

Sectioned: ``GRAPH 2``; ``directed``, ``weighted`` and ``multi`` each with true or false;
``vertices n`` and n lines ``name x y``; ``edges m`` and m lines ``from to weight``.
Adjacency: n; n names; n lines of n digits of which only those right of the diagonal count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.operators.model import Graphs


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, lines): whole files below ``path``; graph_id is the folder graph=... or the file."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    named = F.regexp_extract("file", "/graph=([^/]+)/", 1)
    graph = F.url_decode(F.when(named != "", named).otherwise(F.regexp_extract("file", "([^/]+)$", 1)))
    return rows.select(graph.alias("graph_id"), F.split("value", "\r\n|\r|\n").alias("lines"))


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"[^ \t\f\x0B]+"), F.lit(0))


def _text_lines(texts: DataFrame) -> DataFrame:
    """The files' lines without the blank ones at the end."""
    filled = F.array_max(F.transform("lines", lambda x, i: F.when(F.trim(F.regexp_replace(x, r"\s", " ")) != "", i)))
    return texts.select("graph_id", F.expr("lines").alias("_lines"), filled.alias("_last")).select("graph_id", F.when(F.col("_last").isNotNull(), F.slice("_lines", F.lit(1), F.col("_last") + 1)).otherwise(F.array().cast("array<string>")).alias("lines"))


def _is_sectioned(lines: str = "lines") -> Column:
    return F.coalesce(F.trim(F.get(lines, F.lit(0))).startswith("GRAPH"), F.lit(False))


def _count(line: Column, word: str) -> Column:
    """The count of a line ``word k``; null if the word is another one or k no number from 0."""
    w = _words(line)
    k = F.get(w, F.lit(1)).try_cast("int")
    return F.when((F.get(w, F.lit(0)) == word) & (k >= 0), k)


def _weight(text: Column) -> Column:
    """A weight of a file: a point, not a comma; null unless positive and finite."""
    w = text.try_cast("double")
    return F.when((w > 0) & (w < float("inf")), w)


def parse_graph_text(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """graphs, vertices(graph_id, vid, name, x, y), edges and rejected(graph_id) of sectioned files.

    A file is rejected whole if a section's word or count is another one, if a section is short,
    if a vertex lacks a name or whole coordinates, if an edge's end is no vertex number, or if
    a weight is not a positive finite number.  Lines after the last edge do not matter.
    """
    x = _text_lines(texts).filter(_is_sectioned())
    line = lambda i: F.get("lines", F.lit(i) if isinstance(i, int) else i)
    words = {w: _words(line(i + 1)) for i, w in enumerate(("directed", "weighted", "multi"))}
    for w, found in words.items():
        x = x.withColumn(w, F.when(F.get(found, F.lit(0)) == w, F.lower(F.get(found, F.lit(1))) == "true"))
    x = x.withColumn("n", _count(line(4), "vertices"))
    inside = lambda c: F.least(F.coalesce(F.col(c), F.lit(0)), F.size("lines"))  # noqa: E731  counts are not to be trusted
    x = x.withColumn("m", _count(line(inside("n") + 5), "edges"))
    v = F.transform(F.slice("lines", F.lit(6), inside("n")), lambda s: F.struct(F.get(_words(s), F.lit(0)).alias("name"), F.get(_words(s), F.lit(1)).try_cast("int").alias("x"), F.get(_words(s), F.lit(2)).try_cast("int").alias("y")))
    e = F.transform(
        F.slice("lines", inside("n") + 7, inside("m")),
        lambda s: F.struct(F.get(_words(s), F.lit(0)).try_cast("int").cast("long").alias("src"), F.get(_words(s), F.lit(1)).try_cast("int").cast("long").alias("dst"), _weight(F.get(_words(s), F.lit(2))).alias("weight")),
    )
    x = x.withColumn("v", v).withColumn("e", e)
    known = lambda i, n: i.isNotNull() & (i >= 0) & (i < n)
    fits = F.forall("v", lambda s: s["x"].isNotNull() & s["y"].isNotNull()) & F.forall("e", lambda s: known(s["src"], F.col("n")) & known(s["dst"], F.col("n")) & s["weight"].isNotNull())
    good = F.col("directed").isNotNull() & F.col("weighted").isNotNull() & F.col("multi").isNotNull() & (F.size("v") == F.col("n")) & (F.size("e") == F.col("m")) & fits
    x = x.withColumn("good", F.coalesce(good, F.lit(False)))
    fine, bad = x.filter("good"), x.filter("not good").select("graph_id")
    vertices = fine.select("graph_id", F.posexplode("v").alias("vid", "s")).select("graph_id", F.col("vid").cast("long").alias("vid"), "s.*")
    edges = fine.select("graph_id", F.posexplode("e").alias("eid", "s")).select("graph_id", F.col("eid").cast("long").alias("eid"), "s.*")
    return fine.select("graph_id", "directed", "weighted", "multi"), vertices, edges, bad


def _adjacency_files(texts: DataFrame) -> DataFrame:
    """Adjacency files with n, their names, rows and coordinates; ``fine`` if all of them hold."""
    x = _text_lines(texts).filter(~_is_sectioned()).withColumn("n", F.trim(F.get("lines", F.lit(0))).try_cast("int"))
    inside = F.least(F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)), F.size("lines"))
    x = x.withColumn("names", F.slice("lines", F.lit(2), inside)).withColumn("rows", F.slice("lines", inside + 2, inside)).withColumn("spots", F.slice("lines", 2 * inside + 2, inside))
    spot = lambda s, i: F.trim(F.get(F.split(s, ","), F.lit(i))).try_cast("int")
    x = x.withColumn("spots", F.transform("spots", lambda s: F.struct(spot(s, 0).alias("x"), spot(s, 1).alias("y"))))
    wide = F.forall(F.transform("rows", lambda s, j: (j == F.col("n") - 1) | (F.length(s) >= F.col("n"))), lambda b: b)
    fine = (F.col("n") >= 0) & (F.size("rows") == F.col("n")) & wide & F.forall("spots", lambda s: s["x"].isNotNull() & s["y"].isNotNull())
    return x.withColumn("fine", F.coalesce(fine, F.lit(False)))


def rejected_adjacency(texts: DataFrame) -> DataFrame:
    """graph_id of the files that ``parse_adjacency_text`` leaves out."""
    return _adjacency_files(texts).filter("not fine").select("graph_id")


def parse_adjacency_text(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vertices(graph_id, vid, name, x, y) and edges of adjacency files: undirected, unweighted, simple.

    After the rows, ``x,y`` lines may give the coordinates of the first vertices; others lie at 0,0.
    Files whose count is none, negative or more than their lines, whose rows are short or whose
    coordinates are no whole numbers are left out; ``rejected_adjacency`` lists them.
    """
    x = _adjacency_files(texts).filter("fine")
    at = lambda c: F.coalesce(F.get("spots", F.col("vid"))[c], F.lit(0)).alias(c)
    vertices = x.select("graph_id", "spots", F.posexplode("names").alias("vid", "name")).select("graph_id", F.col("vid").cast("long").alias("vid"), F.trim("name").alias("name"), at("x"), at("y"))
    rows = x.select("graph_id", "n", F.posexplode("rows").alias("u", "cells"))
    return vertices, rows.mapInArrow(_marked, "graph_id string, u long, v long")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(graph_id, u, v) where row u of a graph's cells has a 1 in column v right of the diagonal."""
    for batch in batches:
        of, us, vs = [], [], []
        for i, (n, u, cells) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "u", "cells")), strict=True)):
            codes = np.frombuffer(cells[u + 1 : n].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            found = np.flatnonzero(codes == ord("1")) + u + 1
            of.append(np.full(len(found), i))
            us.append(np.full(len(found), u))
            vs.append(found)
        columns = [np.concatenate([np.empty(0, dtype=np.int64), *x]).astype(np.int64) for x in (of, us, vs)]
        yield pa.RecordBatch.from_arrays([batch.column("graph_id").take(pa.array(columns[0])), *map(pa.array, columns[1:])], ["graph_id", "u", "v"])


def write_graph_text(g: Graphs, path: str) -> None:
    """One sectioned file per graph below ``path``/graph=<id>; blanks in names become ``_``.

    Vertices without coordinates are put at 0 0.

    A file is written by one task, a line at a time.
    """
    sizes = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    m = g.edges.groupBy("graph_id").agg(F.count("*").alias("m"))
    flags = g.graphs.join(sizes, "graph_id", "left").join(m, "graph_id", "left").fillna(0, ["n", "m"])
    word = lambda name, c: F.concat(F.lit(name + " "), F.col(c).cast("string"))
    head = flags.select("graph_id", F.posexplode(F.array(F.lit("GRAPH 2"), word("directed", "directed"), word("weighted", "weighted"), word("multi", "multi"), word("vertices", "n"))).alias("at", "line")).select("graph_id", F.lit(0).alias("part"), F.col("at").cast("long").alias("at"), "line")
    v = g.vertices.select("graph_id", F.lit(1).alias("part"), F.col("vid").alias("at"), F.concat_ws(" ", F.regexp_replace("name", r"\s+", "_"), *[F.coalesce(F.col(c).cast("string"), F.lit("0")) if c in g.vertices.columns else F.lit("0") for c in ("x", "y")]).alias("line"))
    mid = flags.select("graph_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("at"), word("edges", "m").alias("line"))
    e = g.edges.select("graph_id", F.lit(3).alias("part"), F.col("eid").alias("at"), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string")).alias("line"))
    _write(head.union(v).union(mid).union(e), path)


def write_adjacency_text(g: Graphs, path: str) -> None:
    """One 0/1 adjacency file per graph; dense, so for small graphs."""
    from arcwright.operators.adjacency import binary_adjacency

    head = g.vertices.groupBy("graph_id").agg(F.count("*").cast("string").alias("line")).select("graph_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), "line")
    v = g.vertices.select("graph_id", F.lit(1).alias("part"), F.col("vid").alias("at"), "name")
    e = binary_adjacency(g).select("graph_id", F.lit(2).alias("part"), F.col("u").alias("at"), F.col("cells").alias("line"))
    _write(head.union(v).union(e), path)


def _write(lines: DataFrame, path: str) -> None:
    """A file for each graph, line by line in order of part and at, so no file is one row."""
    dealt = lines.withColumnRenamed("graph_id", "graph").repartition("graph").sortWithinPartitions("graph", "part", "at")
    dealt.select("graph", "line").write.partitionBy("graph").text(path)
