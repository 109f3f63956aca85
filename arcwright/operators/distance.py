"""Distances from chosen sources, level by level."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arcwright.functions.durable import discard, settle
from arcwright.functions.flat import Flat, Steps, hops_between, ranges
from arcwright.operators.model import Graphs
from arcwright.operators.packs import solved


KEPT_TABLES = 16  # tables of a search that are read side by side before they become one


def _all_rows(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def reached_from(steps: DataFrame, sources: DataFrame, both_ways: bool = False) -> DataFrame:
    """BFS: (graph_id, s, v, d) for what each source reaches over steps(graph_id, u, v).

    Each level is a table of its own: a round reads the last level and what was reached, and
    writes only the new vertices.  What was reached is rewritten as one table every 16 levels.
    Where every step can be taken back (``both_ways``), a level's neighbours lie in it, before
    it or behind it, so a round reads the last two levels alone.
    """
    front = settle(sources.select("graph_id", "s", F.col("s").alias("v"), F.lit(0).alias("d")).distinct(), "level")
    tables, level, last = [front], 0, front
    while True:
        level += 1
        grown = front.select("graph_id", "s", F.col("v").alias("u")).join(steps, ["graph_id", "u"]).select("graph_id", "s", "v").distinct()
        known = last.union(front) if both_ways and level > 1 else _all_rows(tables)
        found = Observation()
        fresh = grown.join(known, ["graph_id", "s", "v"], "left_anti").withColumn("d", F.lit(level))
        last, front = front, settle(fresh.observe(found, F.count("*").alias("n")), "level")
        if not found.get.get("n"):
            return _all_rows(tables)
        tables.append(front)
        if len(tables) > KEPT_TABLES:
            older, tables = tables[:-2], [settle(_all_rows(tables[:-2]), "seen"), *tables[-2:]]
            for t in older:
                discard(t)


def _hop_rows(steps_of):
    """Rows of the hops between all vertices of a batch of small graphs."""

    def solve(flat: Flat):
        for sources, size, hops in hops_between(flat, steps_of(flat)):
            s = np.repeat(sources, size)
            yield from flat.rows(flat.home[s], s=flat.vid[s], v=ranges(np.zeros_like(size), size), hops=hops)

    return solve


HOPS = "graph_id string, s long, v long, hops int"


def hop_distance(g: Graphs, sources: DataFrame | None = None) -> DataFrame:
    """Hops along arcs from sources(graph_id, s), or all vertices, to every vertex; -1 where there is no way."""
    if sources is None:
        solve = _hop_rows(lambda flat: Steps(flat.total, *flat.arcs()))
        return solved(g, solve, HOPS, lambda x: hop_distance(x, all_sources(x)))
    steps = settle(g.arcs().select("graph_id", "u", "v"), "steps")
    return _with_unreached(g, sources, reached_from(steps, sources))


def underlying_hop_distance(g: Graphs, sources: DataFrame | None = None) -> DataFrame:
    """Hops when direction is ignored."""
    if sources is None:
        solve = _hop_rows(lambda flat: Steps.both_ways(flat.total, *flat.pairs()[:2]))
        return solved(g, solve, HOPS, lambda x: underlying_hop_distance(x, all_sources(x)))
    steps = settle(g.nbrs().select("graph_id", "u", "v"), "steps")
    return _with_unreached(g, sources, reached_from(steps, sources, both_ways=True))


def _with_unreached(g: Graphs, sources: DataFrame, found: DataFrame) -> DataFrame:
    every = sources.select("graph_id", "s").distinct().join(g.vertices.select("graph_id", F.col("vid").alias("v")), "graph_id")
    return every.join(found, ["graph_id", "s", "v"], "left").select("graph_id", "s", "v", F.coalesce("d", F.lit(-1)).alias("hops"))


AT = ["graph_id", "s", "v"]


def _least(tables: list[DataFrame]) -> DataFrame:
    """The least distance among all rows of each source and vertex, with its bucket."""
    return _all_rows(tables).groupBy(*AT).agg(F.min("d").alias("d"), F.min("b").alias("b"))


def reached_weights(g: Graphs, sources: DataFrame, by_hops: bool = False, max_rounds: int = 100_000) -> DataFrame:
    """(graph_id, s, v, d): least total weight over the lightest parallel edges (or 1 an arc).

    Delta-stepping: a bucket is as wide as the mean size of a graph's weights, and buckets are
    taken in turn.  Rounds push the rows that changed in the bucket over arcs no longer than
    its width; when none changes any more, its vertices are pushed once over the longer arcs.
    A round writes only rows that became better.  Negative weights are allowed, since a row
    that falls back into an earlier bucket is pushed again; a negative cycle within reach has
    no distances and raises after ``max_rounds``, which is an alarm and no bound on graphs.
    """
    if by_hops:
        steps = settle(g.arcs().select("graph_id", "u", "v"), "steps")
        return reached_from(steps, sources).withColumn("d", F.col("d").cast("double"))
    arcs = g.arcs().select("graph_id", "u", "v", F.col("min_w").alias("w"))
    widths = arcs.groupBy("graph_id").agg(F.avg(F.abs("w")).alias("mean")).select("graph_id", F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0).alias("width"))
    steps = settle(arcs.join(widths, "graph_id"), "steps")
    short, far = steps.filter("w <= width"), steps.filter("w > width")
    known = [settle(sources.select("graph_id", "s", F.col("s").alias("v"), F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("b")).distinct(), "relax")]
    rounds, spent = 0, []

    def pushed(front: DataFrame, over: DataFrame, bucket: int) -> tuple[DataFrame, int]:
        """The rows that became better, and how many of them are of this bucket or an earlier one."""
        nonlocal known, rounds
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError("weights did not settle")
        via = front.select("graph_id", "s", F.col("v").alias("u"), "d").join(over, ["graph_id", "u"]).withColumn("d", F.col("d") + F.col("w"))
        via = via.groupBy(*AT).agg(F.min("d").alias("d"), F.min(F.floor(F.col("d") / F.col("width"))).alias("b"))
        before = _all_rows(known).select(*AT, F.col("d").alias("was"))
        better = via.join(before, AT, "left").groupBy(*AT, "d", "b").agg(F.min("was").alias("was")).filter("was is null or d < was - 1e-12")
        seen = Observation()
        better = better.select(*AT, "d", "b").observe(seen, F.count("*").alias("n"), F.count_if(F.col("b") <= bucket).alias("here"))
        better = settle(better, "relax")
        told = seen.get
        if told.get("n"):
            known.append(better)
        if len(known) > KEPT_TABLES:
            spent.extend(known)
            known = [settle(_least(known), "relax")]
        return better, told.get("here") or 0

    bucket: int | None = 0
    while bucket is not None:
        front = _least(known).filter(F.col("b") == bucket)
        here = 1
        while here:
            touched = [front]
            while here:
                front, here = pushed(front, short, bucket)
                front = front.filter(F.col("b") <= bucket)
                touched.append(front)
                if len(touched) > KEPT_TABLES:
                    touched = [settle(_least(touched), "touched")]
                    spent.extend(touched)
            front, here = pushed(_least(touched), far, bucket)
            front = front.filter(F.col("b") <= bucket)
        bucket = _least(known).filter(F.col("b") > bucket).agg(F.min("b")).first()[0]
        while spent:
            discard(spent.pop())
    out = settle(_least(known).select(*AT, "d"), "reached")
    for t in known:
        discard(t)
    return out


def weighted_distance(g: Graphs, sources: DataFrame) -> DataFrame:
    """As reached_weights, with infinity for vertices that are not reached."""
    found = reached_weights(g, sources)
    every = sources.select("graph_id", "s").distinct().join(g.vertices.select("graph_id", F.col("vid").alias("v")), "graph_id")
    return every.join(found, ["graph_id", "s", "v"], "left").select("graph_id", "s", "v", F.coalesce("d", F.lit(float("inf"))).alias("dist"))


def metric_reach(g: Graphs, sources: DataFrame) -> DataFrame:
    """Distances in each graph's own metric: weights where it is weighted, hops elsewhere."""
    flags = g.graphs.select("graph_id", "weighted")
    heavy, light = flags.filter("weighted").select("graph_id"), flags.filter("not weighted").select("graph_id")
    out = []
    for side, by_hops in ((heavy, False), (light, True)):
        mine = settle(sources.join(side, "graph_id", "left_semi"), "sources")
        if mine.limit(1).count():
            out.append(reached_weights(g, mine, by_hops))
    if not out:
        return g.edges.sparkSession.createDataFrame([], "graph_id string, s long, v long, d double")
    return out[0] if len(out) == 1 else out[0].union(out[1])


def all_sources(g: Graphs) -> DataFrame:
    return g.vertices.select("graph_id", F.col("vid").alias("s"))


def distance_matrix(g: Graphs) -> DataFrame:
    """All pairs in the active metric, in long form; infinity where there is no way."""
    every = all_sources(g).join(g.vertices.select("graph_id", F.col("vid").alias("v")), "graph_id")
    return every.join(metric_reach(g, all_sources(g)), ["graph_id", "s", "v"], "left").select("graph_id", "s", "v", F.coalesce("d", F.lit(float("inf"))).alias("dist"))


def degree_centrality(g: Graphs) -> DataFrame:
    """Distinct underlying neighbours over n - 1; 0 for a single vertex."""
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    k = g.nbrs().groupBy("graph_id", F.col("u").alias("vid")).agg(F.count("*").alias("k"))
    d = g.vertices.join(k, ["graph_id", "vid"], "left").join(n, "graph_id")
    return d.select("graph_id", "vid", F.round(F.when(F.col("n") > 1, F.coalesce("k", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0), 9).alias("centrality"))


SOURCES_A_BATCH = 512  # of each graph


def source_batches(g: Graphs, batch: int = SOURCES_A_BATCH) -> list[DataFrame]:
    """All vertices as sources, ``batch`` vids of each graph at a time: rows held are batch x n."""
    most = g.vertices.agg(F.max("vid")).first()[0]
    every = all_sources(g)
    return [every.filter(F.col("s").between(a, a + batch - 1)) for a in range(0, (-1 if most is None else most) + 1, batch)]


def _closeness(g: Graphs, sources: DataFrame, dist: DataFrame) -> DataFrame:
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    r = dist.filter("s <> v").groupBy("graph_id", "s").agg(F.count("*").alias("reach"), F.sum("d").alias("total"))
    d = sources.select("graph_id", "s").distinct().join(r, ["graph_id", "s"], "left").join(n, "graph_id")
    value = F.when(F.col("total") > 0, F.col("reach") / F.col("total") * F.col("reach") / (F.col("n") - 1)).otherwise(0.0)
    return d.select("graph_id", F.col("s").alias("vid"), F.round(value, 9).alias("closeness"))


def closeness(g: Graphs, sources: DataFrame | None = None, batch: int = SOURCES_A_BATCH) -> DataFrame:
    """(reach / sum of distances) * (reach / (n - 1)), distances outwards in the active metric.

    Of the given sources, or of all vertices by batches.
    """
    if sources is not None:
        return _closeness(g, sources, metric_reach(g, sources))
    parts = [settle(_closeness(g, some, metric_reach(g, some)), "closeness") for some in source_batches(g, batch)]
    return _all_of(parts, g, "closeness double")


def _all_of(parts: list[DataFrame], g: Graphs, column: str) -> DataFrame:
    if not parts:
        return g.vertices.sparkSession.createDataFrame([], f"graph_id string, vid long, {column}")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _dependencies(g: Graphs, src: DataFrame, dist: DataFrame) -> DataFrame:
    """(graph_id, vid, x): dependencies of the sources in ``src`` on each vertex.

    Arcs on shortest ways form a graph without cycles, so path counts sigma and the
    dependencies delta come from pushing rows along them until no row is left.
    """
    length = F.when(F.col("weighted"), F.col("min_w")).otherwise(1.0)
    arcs = g.arcs().join(g.graphs.select("graph_id", "weighted"), "graph_id").select("graph_id", "u", "v", length.alias("w"))
    du = dist.select("graph_id", "s", F.col("v").alias("u"), F.col("d").alias("du"))
    dv = dist.select("graph_id", "s", "v", F.col("d").alias("dv"))
    tight = settle(du.join(arcs, ["graph_id", "u"]).join(dv, ["graph_id", "s", "v"]).filter("abs(du + w - dv) <= 1e-9").select("graph_id", "s", "u", "v"), "tight")

    def pushed(start: DataFrame, step) -> DataFrame:
        total, front = start, settle(start, "front")
        while True:
            front = settle(step(front), "front")
            if not front.limit(1).count():
                return total.groupBy("graph_id", "s", "v").agg(F.sum("x").alias("x"))
            total = total.union(front)

    forward = lambda f: f.withColumnRenamed("v", "u").join(tight, ["graph_id", "s", "u"]).groupBy("graph_id", "s", "v").agg(F.sum("x").alias("x"))
    sigma = settle(pushed(src.select("graph_id", "s", F.col("s").alias("v"), F.lit(1.0).alias("x")).distinct(), forward), "sigma")
    share = tight.join(sigma.select("graph_id", "s", F.col("v").alias("u"), F.col("x").alias("xu")), ["graph_id", "s", "u"]).join(sigma.withColumnRenamed("x", "xv"), ["graph_id", "s", "v"])
    share = settle(share.select("graph_id", "s", "u", "v", (F.col("xu") / F.col("xv")).alias("r")), "share")
    backward = lambda f: f.join(share, ["graph_id", "s", "v"]).groupBy("graph_id", "s", F.col("u").alias("v")).agg(F.sum(F.col("x") * F.col("r")).alias("x"))
    ones = sigma.select("graph_id", "s", "v", F.lit(1.0).alias("x"))
    delta = pushed(settle(backward(ones), "delta"), backward)
    return delta.filter("v <> s").groupBy("graph_id", F.col("v").alias("vid")).agg(F.sum("x").alias("x"))


def _normalised(g: Graphs, sums: DataFrame) -> DataFrame:
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    d = g.vertices.join(sums.groupBy("graph_id", "vid").agg(F.sum("x").alias("x")), ["graph_id", "vid"], "left").join(n, "graph_id")
    # undirected: halved sums over (n-1)(n-2)/2 is the same quotient
    return d.select("graph_id", "vid", F.round(F.when(F.col("n") > 2, F.coalesce("x", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0), 9).alias("betweenness"))


def betweenness(g: Graphs, sources: DataFrame | None = None, batch: int = SOURCES_A_BATCH) -> DataFrame:
    """Shortest-path betweenness of every vertex, normalised; over all sources by batches, or over those given."""
    parts = []
    for some in [sources] if sources is not None else source_batches(g, batch):
        dist = settle(metric_reach(g, some), "dist")
        parts.append(settle(_dependencies(g, some, dist), "delta"))
        discard(dist)
    return _normalised(g, _all_of(parts, g, "x double"))


def vertex_report(g: Graphs, batch: int = SOURCES_A_BATCH) -> DataFrame:
    """One row for each vertex: degrees, loops, whether it is isolated, has a loop, is a cutpoint;
    distinct neighbours, component, reach, eccentricity (null where a vertex is not reached) and
    the three centralities to two decimals.

    Sources are searched by batches, and each batch's distances once for all columns.
    """
    from arcwright.operators.adjacency import degrees
    from arcwright.operators.blocks import cutpoints
    from arcwright.operators.connectivity import component_roots
    from arcwright.operators.stats import round2

    at = ["graph_id", "vid"]
    reach, close, delta = [], [], []
    for some in source_batches(g, batch):
        dist = settle(metric_reach(g, some), "dist")
        reach.append(settle(dist.groupBy("graph_id", F.col("s").alias("vid")).agg(F.count("*").alias("r"), F.max("d").alias("far")), "reach"))
        close.append(settle(_closeness(g, some, dist), "closeness"))
        delta.append(settle(_dependencies(g, some, dist), "delta"))
        discard(dist)
    n = g.vertices.groupBy("graph_id").agg(F.count("*").alias("n"))
    near = g.nbrs().groupBy("graph_id", F.col("u").alias("vid")).agg(F.count("*").alias("neighbours"))
    x = g.vertices.join(degrees(g).select(*at, "degree", "indeg", "outdeg", "loops"), at).join(near, at, "left").join(component_roots(g), at).join(_all_of(reach, g, "r long, far double"), at).join(n, "graph_id")
    x = x.join(degree_centrality(g), at).join(_all_of(close, g, "closeness double"), at).join(_normalised(g, _all_of(delta, g, "x double")), at)
    x = x.join(cutpoints(g).withColumn("cut", F.lit(True)), at, "left")
    return x.select(
        *at, "name", "degree", "indeg", "outdeg", "loops", (F.col("degree") == 0).alias("isolated"), (F.col("loops") > 0).alias("has_loop"), F.col("cut").isNotNull().alias("cutpoint"),
        F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.col("root").alias("component_root"), (F.col("r") - 1).alias("reached"), F.when(F.col("r") == F.col("n"), F.col("far")).alias("eccentricity"),
        round2(F.col("centrality")).alias("degree_centrality"), round2(F.col("closeness")).alias("closeness"), round2(F.col("betweenness")).alias("betweenness"),
    )
