"""Vertex-pair analysis for a table of pairs(graph_id, s, t)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwright.functions.durable import discard, settle
from arcwright.functions.flat import Flat, semipaths
from arcwright.operators.adjacency import loop_vertices
from arcwright.operators.distance import all_sources, metric_reach, reached_from, reached_weights, underlying_hop_distance
from arcwright.operators.families import in_small_order
from arcwright.operators.model import Graphs
from arcwright.operators.packs import solved

KEY = ["graph_id", "s", "t"]


def pair_adjacency(g: Graphs, pairs: DataFrame) -> DataFrame:
    """Edges s -> t, edges t -> s, and loops where s = t."""
    m = g.mult()
    there = m.select("graph_id", F.col("u").alias("s"), F.col("v").alias("t"), F.col("mult").alias("n_there"))
    back = m.select("graph_id", F.col("u").alias("t"), F.col("v").alias("s"), F.col("mult").alias("n_back"))
    loops = loop_vertices(g).select("graph_id", F.col("vid").alias("s"), "loops")
    d = pairs.join(there, KEY, "left").join(back, KEY, "left").join(loops, ["graph_id", "s"], "left").fillna(0, ["n_there", "n_back", "loops"])
    return d.select(*KEY, "n_there", "n_back", F.when(F.col("s") == F.col("t"), F.col("loops")).otherwise(0).alias("loops"))


def pair_reachability(g: Graphs, pairs: DataFrame) -> DataFrame:
    """reachable, hops (-1 if not) and least weight (null if not)."""
    src = pairs.select("graph_id", "s").distinct()
    hops = reached_weights(g, src, by_hops=True).select("graph_id", "s", F.col("v").alias("t"), F.col("d").cast("int").alias("hops"))
    weights = reached_weights(g, src).select("graph_id", "s", F.col("v").alias("t"), F.col("d").alias("weight"))
    d = pairs.join(hops, KEY, "left").join(weights, KEY, "left")
    return d.select(*KEY, F.col("hops").isNotNull().alias("reachable"), F.coalesce("hops", F.lit(-1)).alias("hops"), "weight")


def _grow(front: DataFrame, step, keep) -> DataFrame:
    """All rows that ``keep`` picks along a frontier that ``step`` extends until it is empty."""
    out = front.filter(keep)
    while True:
        front = settle(step(front), "front")
        if not front.limit(1).count():
            return out
        out = out.union(front.filter(keep))


OPENED = 1024  # prefixes of a pair that one round extends


def _first_in_order(start: DataFrame, step, arrived, most: int) -> DataFrame:
    """(graph_id, s, t, way): the first ``most`` ways of each pair in array order, without listing the others.

    ``start`` holds prefixes (graph_id, s, t, way, end); ``step`` extends some by one.  Each round
    extends, of every pair, only its first prefixes in order.  Once a pair has ``most`` ways,
    prefixes behind the last of them lead to none that counts and go; so do ways behind it.
    """
    first = Window.partitionBy(*KEY).orderBy("way")
    waiting = settle(start, "front")
    found: DataFrame | None = None
    while True:
        ranked = settle(waiting.withColumn("place", F.row_number().over(first)), "ranked")
        grown = settle(step(ranked.filter(F.col("place") <= OPENED).drop("place")), "grown")
        new = grown.filter(arrived).select(*KEY, "way")
        if found is None:
            new = new.union(start.filter(arrived).select(*KEY, "way"))
        both = new if found is None else found.union(new)
        found = settle(both.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most).drop("place"), "found")
        last = found.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("way").alias("last")).filter(F.col("n") == most).select(*KEY, "last")
        left = ranked.filter(F.col("place") > OPENED).drop("place").union(grown)
        after = settle(left.join(last, KEY, "left").filter("last is null or way <= last").drop("last"), "front")
        discard(waiting)
        waiting = after
        if not waiting.limit(1).count():
            return found


def simple_paths(g: Graphs, pairs: DataFrame, most: int = 300) -> DataFrame:
    """The first ``most`` simple paths of each pair in order of vids, numbered shortest first.

    Vertices from which no way leads to t are never stepped on, and the first paths are
    found without listing all of them, whose number is exponential.
    """
    arcs = settle(g.arcs().select("graph_id", F.col("u").alias("end"), F.col("v").alias("next")), "steps")
    ways = _leading_to(g, pairs)
    start = pairs.select(*KEY, F.array("s").alias("way"), F.col("s").alias("end"))

    def step(front: DataFrame) -> DataFrame:
        live = front.filter("end <> t")
        grown = live.join(arcs, ["graph_id", "end"]).filter(~F.array_contains("way", F.col("next"))).join(ways, ["graph_id", "t", "next"], "left_semi")
        return grown.select(*KEY, F.concat("way", F.array("next")).alias("way"), F.col("next").alias("end"))

    found = _first_in_order(start, step, F.col("end") == F.col("t"), most).withColumnRenamed("way", "path")
    by_size = Window.partitionBy(*KEY).orderBy(F.size("path"), "path")
    return found.select(*KEY, (F.row_number().over(by_size) - 1).alias("path_no"), "path")


def _leading_to(g: Graphs, pairs: DataFrame) -> DataFrame:
    """(graph_id, t, next): the vertices from which a way leads to each t."""
    back = settle(g.arcs().select("graph_id", F.col("v").alias("u"), F.col("u").alias("v")), "back")
    return settle(reached_from(back, pairs.select("graph_id", F.col("t").alias("s")).distinct()).select("graph_id", F.col("s").alias("t"), F.col("v").alias("next")), "ways")


def path_lengths(g: Graphs, pairs: DataFrame) -> DataFrame:
    """Shortest and longest simple path of each pair, and the number of all its simple paths.

    Paths are counted, not listed: those from s over the same vertices to the same end are one
    row with their number, for all t at once.  A pair without a path has no row; numbers beyond
    a long raise.
    """
    wanted = settle(pairs.select(*KEY).distinct(), "pairs")
    live = _leading_to(g, wanted).select("graph_id", "next").distinct()
    steps = settle(g.arcs().select("graph_id", F.col("u").alias("end"), F.col("v").alias("next")).join(live, ["graph_id", "next"], "left_semi"), "steps")
    start = wanted.select("graph_id", "s").distinct()
    front = settle(start.select("graph_id", "s", F.array("s").alias("over"), F.col("s").alias("end"), F.lit(1).cast("long").alias("paths")), "front")
    found: DataFrame | None = None
    while front.limit(1).count():
        length = F.size("over") - 1
        new = front.withColumnRenamed("end", "t").join(wanted, KEY).select(*KEY, length.alias("shortest"), length.alias("longest"), "paths")
        both = (new if found is None else found.union(new)).groupBy(*KEY).agg(F.min("shortest").alias("shortest"), F.max("longest").alias("longest"), F.sum("paths").alias("paths"))
        merged = settle(both, "found")
        grown = front.join(steps, ["graph_id", "end"]).filter(~F.array_contains("over", F.col("next")))
        grown = grown.groupBy("graph_id", "s", F.array_sort(F.concat("over", F.array("next"))).alias("over"), F.col("next").alias("end")).agg(F.sum("paths").alias("paths"))
        after = settle(grown, "front")
        discard(front)
        if found is not None:
            discard(found)
        front, found = after, merged
    return found if found is not None else wanted.select(*KEY, F.lit(0).alias("shortest"), F.lit(0).alias("longest"), F.lit(0).cast("long").alias("paths"))


def geodesics(g: Graphs, pairs: DataFrame, most: int = 50) -> DataFrame:
    """All shortest paths of each pair in the active metric, the first ``most`` by vids."""
    dist = settle(metric_reach(g, pairs.select("graph_id", "s").distinct()), "dist")
    length = F.when(F.col("weighted"), F.col("min_w")).otherwise(1.0)
    arcs = g.arcs().join(g.graphs.select("graph_id", "weighted"), "graph_id").select("graph_id", "u", "v", length.alias("w"))
    du = dist.select("graph_id", "s", F.col("v").alias("u"), F.col("d").alias("du"))
    dv = dist.select("graph_id", "s", "v", F.col("d").alias("dv"))
    tight = settle(du.join(arcs, ["graph_id", "u"]).join(dv, ["graph_id", "s", "v"]).filter("abs(du + w - dv) <= 1e-9").select("graph_id", "s", F.col("u").alias("end"), F.col("v").alias("next")), "tight")
    # walked from t back to s, so only arcs that lie on a way to t are opened
    start = pairs.select(*KEY, F.array("t").alias("path"), F.col("t").alias("next"))

    def step(front: DataFrame) -> DataFrame:
        grown = front.filter("next <> s").join(tight, ["graph_id", "s", "next"])
        return grown.select(*KEY, F.concat(F.array("end"), F.col("path")).alias("path"), F.col("end").alias("next"))

    found = _grow(settle(start, "front"), step, F.col("next") == F.col("s")).select(*KEY, "path")
    return in_small_order(found, KEY, ["path"], most)


def trails(g: Graphs, pairs: DataFrame, most: int = 300) -> DataFrame:
    """Walks without a repeated edge, the first ``most`` by edge ids, numbered shortest first.

    Found as simple_paths are: steps only where t can still be reached, and no full listing.
    """
    e = g.flagged_edges()
    forth = e.select("graph_id", "eid", F.col("src").alias("end"), F.col("dst").alias("next"))
    steps = settle(forth.union(e.filter("not directed and src <> dst").select("graph_id", "eid", F.col("dst").alias("end"), F.col("src").alias("next"))), "steps")
    ways = _leading_to(g, pairs)
    start = pairs.select(*KEY, F.array().cast("array<bigint>").alias("way"), F.col("s").alias("end"))

    def step(front: DataFrame) -> DataFrame:
        grown = front.join(steps, ["graph_id", "end"]).filter(~F.array_contains("way", F.col("eid"))).join(ways, ["graph_id", "t", "next"], "left_semi")
        return grown.select(*KEY, F.concat("way", F.array("eid")).alias("way"), F.col("next").alias("end"))

    arrived = (F.col("end") == F.col("t")) & (F.size("way") > 0)
    found = _first_in_order(start, step, arrived, most).withColumnRenamed("way", "trail")
    by_size = Window.partitionBy(*KEY).orderBy(F.size("trail"), "trail")
    return found.select(*KEY, (F.row_number().over(by_size) - 1).alias("trail_no"), "trail")


def walk_counts(g: Graphs, pairs: DataFrame, longest: int = 8) -> DataFrame:
    """Number of walks s -> t of each length 1..min(max(n, 4), 8); parallel edges multiply.

    Counts are exact to 38 digits and come back as decimals.
    """
    n = g.vertices.groupBy("graph_id").agg(F.least(F.greatest(F.count("*"), F.lit(4)), F.lit(longest)).alias("k"))
    m = g.mult().select("graph_id", F.col("u").alias("v"), F.col("v").alias("next"), "mult")
    front = settle(pairs.select("graph_id", "s").distinct().select("graph_id", "s", F.col("s").alias("v"), F.lit(1).cast("decimal(38,0)").alias("walks")), "walks")
    out = None
    for length in range(1, longest + 1):
        grown = front.join(m, ["graph_id", "v"]).groupBy("graph_id", "s", F.col("next").alias("v")).agg(F.sum(F.col("walks") * F.col("mult")).cast("decimal(38,0)").alias("walks"))
        front = settle(grown, "walks")
        mine = pairs.join(n, "graph_id").filter(F.col("k") >= length).join(front.withColumnRenamed("v", "t"), KEY, "left")
        mine = mine.select(*KEY, F.lit(length).alias("length"), F.coalesce("walks", F.lit(0).cast("decimal(38,0)")).alias("walks"))
        out = mine if out is None else out.union(mine)
    return out


def example_walk(g: Graphs, pairs: DataFrame) -> DataFrame:
    """(graph_id, s, t, walk): one walk s -> t that repeats a vertex; no row where the rule gives none.

    For s = t: out to the least neighbour with an arc back, and back.  Else along the first
    geodesic, with its first step that has an arc back gone forth, back and forth again.
    """
    arcs = g.arcs().select("graph_id", "u", "v")
    back = arcs.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"))
    mutual = settle(arcs.join(back, ["graph_id", "u", "v"]), "mutual")
    near = mutual.groupBy("graph_id", F.col("u").alias("s")).agg(F.min("v").alias("x"))
    closed = pairs.filter("s = t").join(near, ["graph_id", "s"]).select(*KEY, F.array("s", "x", "s").alias("walk"))
    first = geodesics(g, pairs.filter("s <> t"), most=1)
    steps = first.select(*KEY, "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "u")).withColumn("v", F.get("path", F.col("i") + 1))
    turn = steps.join(mutual, ["graph_id", "u", "v"]).groupBy(*KEY, "path").agg(F.min("i").alias("i"))
    there, rest = F.slice("path", F.lit(1), F.col("i") + 2), F.expr("slice(path, i + 1, size(path) - i)")
    return closed.union(turn.select(*KEY, F.concat(there, rest).alias("walk")))


def semipath(g: Graphs, pairs: DataFrame) -> DataFrame:
    """The lexicographically least shortest path when direction is ignored."""
    hops = settle(underlying_hop_distance(g, pairs.select("graph_id", "s").distinct()).filter("hops >= 0"), "hops")
    a = hops.select("graph_id", "s", F.col("v").alias("u"), F.col("hops").alias("hu"))
    tight = settle(a.join(g.nbrs(), ["graph_id", "u"]).join(hops, ["graph_id", "s", "v"]).filter("hops = hu + 1").select("graph_id", "s", F.col("u").alias("end"), F.col("v").alias("next")), "tight")
    start = pairs.select(*KEY, F.array("t").alias("path"), F.col("t").alias("next"))

    def step(front: DataFrame) -> DataFrame:
        grown = front.filter("next <> s").join(tight, ["graph_id", "s", "next"])
        return grown.groupBy(*KEY, "end").agg(F.min(F.concat(F.array("end"), F.col("path"))).alias("path")).select(*KEY, "path", F.col("end").alias("next"))

    found = _grow(settle(start, "front"), step, F.col("next") == F.col("s"))
    return found.groupBy(*KEY).agg(F.min("path").alias("path"))


def underlying_parents(g: Graphs, sources: DataFrame) -> DataFrame:
    """(graph_id, s, v, hops, parent): the vertex before v on its semipath from s; null at s itself.

    What is reached from s when direction is ignored; of ways equally long the least one counts.
    """
    found = underlying_hop_distance(g, sources).filter("hops >= 0").select("graph_id", "s", F.col("v").alias("t"))
    p = semipath(g, settle(found, "pairs"))
    n = F.size("path")
    return p.select("graph_id", "s", F.col("t").alias("v"), (n - 1).alias("hops"), F.when(n > 1, F.get("path", n - 2)).alias("parent"))


def semipath_arrows(g: Graphs, pairs: DataFrame | None = None) -> DataFrame:
    """(graph_id, s, t, semipath, directed_path): the semipath's names with a sign for each step, for all pairs by default.

    A dash in a graph; in a digraph an arrow forth, back or both ways.  ``directed_path`` says
    whether every step has an arc forth.
    """
    if pairs is None:

        def solve(flat: Flat):
            for s, t, text, forth in semipaths(flat):
                yield from flat.rows(flat.home[s], s=flat.vid[s], t=flat.vid[t], semipath=text, directed_path=forth)

        every = lambda x: all_sources(x).join(x.vertices.select("graph_id", F.col("vid").alias("t")), "graph_id")
        return solved(g, solve, "graph_id string, s long, t long, semipath string, directed_path boolean", lambda x: semipath_arrows(x, every(x)), named=True)
    p = settle(semipath(g, pairs), "semipaths")
    name = g.vertices.select("graph_id", F.col("vid").alias("v"), "name")
    steps = p.select(*KEY, F.posexplode("path").alias("i", "v"), "path").withColumn("u", F.when(F.col("i") > 0, F.get("path", F.col("i") - 1)))
    forth = g.arcs().select("graph_id", "u", "v", F.lit(True).alias("forth"))
    back = g.arcs().select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"), F.lit(True).alias("back"))
    x = steps.join(name, ["graph_id", "v"]).join(forth, ["graph_id", "u", "v"], "left").join(back, ["graph_id", "u", "v"], "left").join(g.graphs.select("graph_id", "directed"), "graph_id")
    sign = F.when(F.col("i") == 0, "").when(~F.col("directed"), " – ").when(F.col("forth") & F.col("back"), " ↔ ").when(F.col("forth"), " → ").otherwise(" ← ")
    told = x.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("i", F.concat(sign, "name").alias("text")))).alias("x"), F.bool_and((F.col("i") == 0) | F.col("forth").isNotNull()).alias("directed_path"))
    return told.select(*KEY, F.array_join(F.transform("x", lambda y: y["text"]), "").alias("semipath"), "directed_path")


GEODESICS_SHOWN, PATHS_SHOWN, TRAILS_SHOWN = 4, 25, 15


def pair_report(g: Graphs, pairs: DataFrame) -> DataFrame:
    """One row for each pair: adjacency, reachability, distances, walks, and listings cut for display.

    Counts say how many geodesics (of 50 kept), paths and trails (of 300) there are, the flags
    whether there are more; ``geodesics``, ``paths`` and ``trails`` list the first 4, 25 and 15
    as vids (trails as edge ids), shortest first.
    """
    pairs = settle(pairs.select(*KEY).distinct(), "pairs")
    listed = lambda df, col, order, shown, kept, name: df.groupBy(*KEY).agg(
        F.least(F.count("*"), F.lit(kept)).alias("n_" + name), (F.count("*") > kept).alias(f"more_{name}"),
        F.slice(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(col).alias("_way")))), lambda x: x["_way"]), 1, shown).alias(name),
    )
    geo = listed(geodesics(g, pairs, most=51), "path", ["path"], GEODESICS_SHOWN, 50, "geodesics")
    p = settle(simple_paths(g, pairs, 301), "paths")
    paths = listed(p, "path", [F.size("path"), "path"], PATHS_SHOWN, 300, "paths")
    t = settle(trails(g, pairs, 301), "trails")
    shown = listed(t, "trail", [F.size("trail"), "trail"], TRAILS_SHOWN, 300, "trails").join(t.groupBy(*KEY).agg(F.max(F.size("trail")).alias("longest_trail")), KEY)
    counts = walk_counts(g, pairs).groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("length", "walks"))), lambda x: x["walks"]).alias("walk_counts"))
    near = pair_adjacency(g, pairs).join(pair_reachability(g, pairs), KEY)
    out = near.join(counts, KEY, "left").join(geo, KEY, "left").join(path_lengths_of(p), KEY, "left").join(paths, KEY, "left").join(shown, KEY, "left")
    out = out.join(example_walk(g, pairs).withColumnRenamed("walk", "example_walk"), KEY, "left").join(semipath_arrows(g, pairs), KEY, "left")
    return out.fillna(0, ["n_geodesics", "n_paths", "n_trails"]).fillna(False, ["more_geodesics", "more_paths", "more_trails"])


def path_lengths_of(paths: DataFrame) -> DataFrame:
    return paths.groupBy(*KEY).agg(F.min(F.size("path") - 1).alias("shortest_path"), F.max(F.size("path") - 1).alias("longest_path"))


def path_weight(g: Graphs, paths: DataFrame) -> DataFrame:
    """Sum of the lightest weights along paths(graph_id, s, t, path)."""
    steps = paths.select(*KEY, "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("u"), F.element_at("path", i + 1).alias("v")))).alias("x")).filter("size(path) > 1")
    w = steps.select(*KEY, "path", "x.u", "x.v").join(g.arcs(), ["graph_id", "u", "v"]).groupBy(*KEY, "path").agg(F.sum("min_w").alias("weight"))
    return w


def geodesic_edges(g: Graphs, pairs: DataFrame) -> DataFrame:
    """Edge ids on any geodesic: of each step the least id among the lightest edges."""
    p = geodesics(g, pairs).filter("size(path) > 1")
    steps = p.select(*KEY, F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("u"), F.element_at("path", i + 1).alias("v")))).alias("x")).select(*KEY, "x.u", "x.v").distinct()
    best = g.both_ways().groupBy("graph_id", "u", "v").agg(F.min(F.struct("weight", "eid")).alias("b")).select("graph_id", "u", "v", F.col("b.eid").alias("eid"))
    return steps.join(best, ["graph_id", "u", "v"]).select(*KEY, "eid").distinct()
