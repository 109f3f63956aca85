"""Isomorphism, embedding of a pattern and self-complementarity: first images in order.

Colours that neighbours' colours refine (Weisfeiler and Leman, 1968) rule most pairs out.  For
the rest, images of the first graph's vertices grow one vertex a round for all pairs of
graphs at once.  The first graph's vertices go by falling degree, then vid; candidates
come from the neighbours of an image where there is one, in blocks of ascending vid.  Each
round opens, of every pair, only the partial images that come first in order and leaves
the others pending, as backtracking would: symmetric graphs do not flood the frontier, and
the first complete image that nothing pending precedes is the least one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwright.functions.durable import discard, settle
from arcwright.functions.numbering import number_rows
from arcwright.operators.adjacency import degrees, simple_flags
from arcwright.operators.model import Graphs
from arcwright.operators.stats import order_size

OPENED = 2048  # partial images of a pair that one round opens
BLOCK = 256  # candidates that an opened image gets a round
BUDGET = 2_000_000  # opened images of a pair before it is left undetermined
PAIR = ["a_id", "b_id"]


def _seen_arcs(g: Graphs) -> DataFrame:
    """Arcs as their two ends see them: (graph_id, u, v, way, mult); an undirected one is seen once."""
    arcs = g.arcs().join(g.graphs.select("graph_id", "directed"), "graph_id").select("graph_id", "u", "v", "mult", "directed")
    out = arcs.select("graph_id", "u", "v", F.lit("out").alias("way"), "mult")
    return out.union(arcs.filter("directed").select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"), F.lit("in").alias("way"), "mult"))


def _add(h: Column) -> Column:
    """A sum of hashes: the same for any order, and unlike xor not blind to repeats."""
    return F.sum(h.cast("decimal(20,0)")).cast("string")


def refined_colours(sides: list[Graphs]) -> list[DataFrame]:
    """(graph_id, vid, colour) of each side's vertices, refined in step until no colour splits.

    Vertices that an isomorphism maps to each other always have one colour; the reverse need
    not hold (and two hashes may meet), so colours only rule out.
    """
    own = [degrees(g).join(g.graphs.select("graph_id", "directed"), "graph_id").select(F.lit(i).alias("side"), "graph_id", "vid", F.xxhash64("directed", "degree", "indeg", "outdeg", "loops").alias("colour")) for i, g in enumerate(sides)]
    arcs = [_seen_arcs(g).select(F.lit(i).alias("side"), "graph_id", "u", "v", "way", "mult") for i, g in enumerate(sides)]
    now, steps = (settle(x[0] if len(x) == 1 else x[0].union(x[1]), "colours") for x in (own, arcs))
    kinds = 0
    while True:
        more = now.select("side", "graph_id", "colour").distinct().count()
        if more <= kinds:
            break
        kinds = more
        around = steps.join(now.withColumnRenamed("vid", "v"), ["side", "graph_id", "v"]).groupBy("side", "graph_id", F.col("u").alias("vid")).agg(_add(F.xxhash64("way", "mult", "colour")).alias("around"))
        after = settle(now.join(around, ["side", "graph_id", "vid"], "left").select("side", "graph_id", "vid", F.xxhash64("colour", "around").alias("colour")), "colours")
        discard(now)
        now = after
    return [now.filter(F.col("side") == i).drop("side") for i in range(len(sides))]


def _plan(a: Graphs, info: DataFrame) -> DataFrame:
    """A row for each vertex of the first graphs in its turn k: what its image must have.

    ``need`` lists arcs to earlier turns j: way 'out' is image(j) -> candidate, 'in' the reverse.
    """
    turned = number_rows(info.withColumn("_fall", -F.col("degree")), ["graph_id"], ["_fall", "vid"], "k").drop("_fall")
    turned = settle(turned, "turns")
    at = lambda v, k: turned.select("graph_id", F.col("vid").alias(v), F.col("k").alias(k))
    arcs = _seen_arcs(a).join(at("u", "j"), ["graph_id", "u"]).join(at("v", "k"), ["graph_id", "v"]).filter("j < k")
    need = arcs.groupBy("graph_id", "k").agg(F.sort_array(F.collect_list(F.struct("j", "way", "mult"))).alias("need"))
    none = F.array().cast(need.schema["need"].dataType)
    return turned.join(need, ["graph_id", "k"], "left").withColumn("need", F.coalesce("need", none)).withColumnRenamed("graph_id", "a_id")


def _steps(b: Graphs) -> DataFrame:
    """(b_id, way, at, block, c, mult): candidates in blocks; 'any' from -1 gives all vertices."""
    every = b.vertices.select("graph_id", F.lit("any").alias("way"), F.lit(-1).cast("long").alias("at"), F.col("vid").alias("c"), F.lit(0).cast("long").alias("mult"))
    arcs = _seen_arcs(b).select("graph_id", "way", F.col("u").alias("at"), F.col("v").alias("c"), "mult")
    ranked = number_rows(every.union(arcs), ["graph_id", "way", "at"], ["c"], "rank")
    return settle(ranked.select(F.col("graph_id").alias("b_id"), "way", "at", F.floor(F.col("rank") / BLOCK).alias("block"), "c", "mult"), "steps")


def first_images(a: Graphs, b: Graphs, pairs: DataFrame, a_info: DataFrame, b_info: DataFrame, fits: Column, budget: int = BUDGET) -> DataFrame:
    """(a_id, b_id, map, spent): the first image of graph a_id within b_id, or null, for pairs(a_id, b_id).

    An image keeps at least the arcs of a_id, with their multiplicities.  ``fits`` says from the
    columns x (of a_info) and y (of b_info) whether a candidate may stand for a vertex.
    ``spent`` is true where ``budget`` ended the search.
    """
    plan = settle(_plan(a, a_info).select("a_id", F.col("k"), F.col("vid").alias("u"), "need", F.struct(*[c for c in a_info.columns if c not in ("graph_id", "vid")]).alias("x")), "plan")
    order = plan.groupBy("a_id").agg(F.count("*").alias("n"))
    steps = _steps(b)
    blocks = settle(steps.groupBy("b_id", "way", "at", "block").agg(F.min("c").alias("first")), "blocks")
    y = settle(b_info.select(F.col("graph_id").alias("b_id"), F.col("vid").alias("c"), F.struct(*[c for c in b_info.columns if c not in ("graph_id", "vid")]).alias("y")), "info")
    mult = settle(b.mult().select(F.col("graph_id").alias("b_id"), F.col("u").alias("p"), F.col("v").alias("q"), F.col("mult").alias("has")), "mult")
    start = pairs.select(*PAIR).distinct().join(order, "a_id", "left").select(*PAIR, F.coalesce("n", F.lit(0)).alias("n"))
    image = F.array().cast("array<bigint>")
    now = settle(start.select(*PAIR, "n", image.alias("image"), F.lit(0).cast("long").alias("block"), F.array(F.lit(-1).cast("long")).alias("key")), "images")
    done: list[DataFrame] = []
    place = Window.partitionBy(*PAIR).orderBy("key")
    for turn in range(max(1, -(-budget // OPENED))):
        ranked = settle(now.withColumn("place", F.row_number().over(place)), "ranked")
        whole = F.size("image") == F.col("n")
        ended = settle(ranked.filter((F.col("place") == 1) & whole).select(*PAIR, "image"), "ended")
        done.append(ended)
        left = ranked.join(ended.select(*PAIR), PAIR, "left_anti")
        opened = left.filter((F.col("place") <= OPENED) & ~whole)
        kept = left.filter((F.col("place") > OPENED) | whole).drop("place")
        at = opened.drop("place", "key").withColumn("k", F.size("image").cast("long")).join(plan, ["a_id", "k"])
        lead = F.get("need", F.lit(0))
        at = at.withColumn("way", F.coalesce(lead["way"], F.lit("any"))).withColumn("at", F.coalesce(F.get("image", lead["j"].cast("int")), F.lit(-1).cast("long")))
        later = at.withColumn("block", F.col("block") + 1).join(blocks, ["b_id", "way", "at", "block"]).select(*PAIR, "n", "image", "block", F.concat("image", F.array("first")).alias("key"))
        grown = at.join(steps, ["b_id", "way", "at", "block"]).filter(~F.array_contains("image", F.col("c")) & (F.col("mult") >= F.coalesce(lead["mult"], F.lit(0))))
        grown = grown.join(y, ["b_id", "c"]).filter(fits).select(*PAIR, "n", "image", "c", F.expr("slice(need, 2, greatest(size(need) - 1, 0))").alias("need"))
        # arcs to the other earlier images, each looked up
        plain = grown.filter(F.size("need") == 0).select(*PAIR, "n", "image", "c")
        asked = grown.select(*PAIR, "n", "image", "c", F.explode("need").alias("d")).withColumn("o", F.get("image", F.col("d.j").cast("int")))
        out = F.col("d.way") == "out"
        asked = asked.withColumn("p", F.when(out, F.col("o")).otherwise(F.col("c"))).withColumn("q", F.when(out, F.col("c")).otherwise(F.col("o")))
        held = asked.join(mult, ["b_id", "p", "q"], "left").groupBy(*PAIR, "n", "image", "c").agg(F.bool_and(F.coalesce("has", F.lit(0)) >= F.col("d.mult")).alias("ok")).filter("ok").drop("ok")
        fresh = plain.union(held).withColumn("image", F.concat("image", F.array("c"))).select(*PAIR, "n", "image", F.lit(0).cast("long").alias("block"), F.concat("image", F.array(F.lit(-1).cast("long"))).alias("key"))
        after = settle(kept.union(later).union(fresh), "images")
        discard(now)
        now = after
        if not now.limit(1).count():
            break
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    # images stand in turn order; tell them by vid
    named = found.select(*PAIR, F.posexplode("image").alias("k", "c")).join(plan.select("a_id", "k", "u"), ["a_id", "k"]).groupBy(*PAIR).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("u", "c")))).alias("map"))
    empty = F.create_map().cast("map<bigint,bigint>")
    got = start.join(found.select(*PAIR, F.lit(True).alias("hit")), PAIR, "left").join(named, PAIR, "left").join(now.select(*PAIR).distinct().withColumn("open", F.lit(True)), PAIR, "left")
    return got.select(*PAIR, F.when(F.col("hit"), F.coalesce("map", empty)).alias("map"), F.coalesce("open", F.lit(False)).alias("spent"))


def _status(found: DataFrame, all_pairs: DataFrame, name: str) -> DataFrame:
    told = all_pairs.join(found, PAIR, "left")
    status = F.when(~F.col("same_kind"), "n/a").when(F.col("map").isNotNull(), "yes").when(F.col("spent"), "undetermined").otherwise("no")
    return told.select(*PAIR, status.alias(name), "map")


def _sized_pairs(a: Graphs, b: Graphs, pairs: DataFrame) -> DataFrame:
    """pairs(a_id, b_id) with both orders and sizes, and whether both or neither are directed."""
    side = lambda g, x: order_size(g).join(g.graphs.select("graph_id", "directed"), "graph_id").select(F.col("graph_id").alias(f"{x}_id"), F.col("n").alias(f"{x}_n"), F.col("m").alias(f"{x}_m"), F.col("directed").alias(f"{x}_directed"))
    x = pairs.select(*PAIR).distinct().join(side(a, "a"), "a_id").join(side(b, "b"), "b_id")
    return settle(x.withColumn("same_kind", F.col("a_directed") == F.col("b_directed")), "pairs")


def _only(g: Graphs, ids: DataFrame, column: str) -> Graphs:
    """The graphs that ``ids`` names."""
    mine = settle(ids.select(F.col(column).alias("graph_id")).distinct(), "ids")
    return Graphs(*(t.join(mine, "graph_id", "left_semi") for t in (g.graphs, g.vertices, g.edges)))


def isomorphism(a: Graphs, b: Graphs, pairs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a_id, b_id, isomorphic, map) for pairs(a_id, b_id): 'yes' with the first renaming, 'no',
    'undetermined' where the budget ends the search, 'n/a' if only one of them is directed.

    Multiplicities and loops must agree, weights are ignored.  With equal numbers of edges an
    image that keeps all arcs has no others, so keeping them is all that is checked.
    """
    x = _sized_pairs(a, b, pairs)
    even = x.filter("same_kind and a_n = b_n and a_m = b_m")
    ga, gb = _only(a, even, "a_id"), _only(b, even, "b_id")
    colours = [settle(c, "refined") for c in refined_colours([ga, gb])]
    sign = [c.groupBy("graph_id").agg(_add(F.xxhash64("colour")).alias("sign")) for c in colours]
    alike = even.join(sign[0].select(F.col("graph_id").alias("a_id"), F.col("sign").alias("a_sign")), "a_id", "left").join(sign[1].select(F.col("graph_id").alias("b_id"), F.col("sign").alias("b_sign")), "b_id", "left")
    alike = settle(alike.filter("a_sign <=> b_sign").select(*PAIR), "alike")
    info = [degrees(g).join(c, ["graph_id", "vid"]).select("graph_id", "vid", "degree", "colour") for g, c in zip((ga, gb), colours, strict=True)]
    found = first_images(_only(a, alike, "a_id"), _only(b, alike, "b_id"), alike, info[0].join(alike.select(F.col("a_id").alias("graph_id")).distinct(), "graph_id", "left_semi"), info[1], F.col("x.colour") == F.col("y.colour"), budget)
    return _status(found, x, "isomorphic")


def subgraph_embedding(a: Graphs, b: Graphs, pairs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a_id, b_id, embeds, map): is there a copy of a_id inside b_id, not necessarily induced?

    As isomorphism; degrees, loops and multiplicities of an image may be larger.  b_id may be
    large: candidates are looked up through its arcs, and no graph is gathered.
    """
    x = _sized_pairs(a, b, pairs)
    may = settle(x.filter("same_kind and a_n <= b_n and a_m <= b_m").select(*PAIR), "may")
    ga, gb = _only(a, may, "a_id"), _only(b, may, "b_id")
    info = [degrees(g).select("graph_id", "vid", "degree", "indeg", "outdeg", "loops") for g in (ga, gb)]
    fits = (F.col("y.outdeg") >= F.col("x.outdeg")) & (F.col("y.indeg") >= F.col("x.indeg")) & (F.col("y.loops") >= F.col("x.loops"))
    return _status(first_images(ga, gb, may, *info, fits, budget), x, "embeds")


def complement_graphs(g: Graphs) -> Graphs:
    """The complements as graphs: simple, of weight 1."""
    from arcwright.operators.compare import complement

    e = number_rows(complement(g).select("graph_id", F.col("u").alias("src"), F.col("v").alias("dst")), ["graph_id"], ["src", "dst"], "eid")
    return Graphs(g.graphs, g.vertices, settle(e.select("graph_id", "eid", "src", "dst", F.lit(1.0).alias("weight")), "complement"))


def self_complementary(g: Graphs, budget: int = BUDGET) -> DataFrame:
    """(graph_id, self_complementary, note): simple, with as many edges as its complement, and isomorphic to it."""
    from arcwright.operators.compare import complement_size

    x = order_size(g).join(simple_flags(g), "graph_id").join(complement_size(g), "graph_id")
    x = settle(x.select("graph_id", "is_simple", (F.col("m") == F.col("complement_size")).alias("even")), "even")
    mine = _only(g, x.filter("is_simple and even"), "graph_id")
    pairs = mine.graphs.select(F.col("graph_id").alias("a_id"), F.col("graph_id").alias("b_id"))
    found = isomorphism(mine, complement_graphs(mine), pairs, budget).select(F.col("a_id").alias("graph_id"), "isomorphic")
    note = F.when(~F.col("is_simple"), "not simple").when(~F.col("even"), "other number of edges").otherwise(F.col("isomorphic"))
    return x.join(found, "graph_id", "left").select("graph_id", F.when(note == "undetermined", F.lit(None).cast("boolean")).otherwise(note == "yes").alias("self_complementary"), note.alias("note"))


def mapping_string(matches: DataFrame, a: Graphs, b: Graphs) -> DataFrame:
    """(a_id, b_id, mapping): names of a map as ``x→y, ...`` in the order of a's vids; null without a map."""
    each = matches.select(*PAIR, F.explode("map").alias("u", "v"))
    named = lambda g, key, vid, out: g.vertices.select(F.col("graph_id").alias(key), F.col("vid").alias(vid), F.col("name").alias(out))
    steps = each.join(named(a, "a_id", "u", "un"), ["a_id", "u"]).join(named(b, "b_id", "v", "vn"), ["b_id", "v"])
    text = steps.groupBy(*PAIR).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("u", F.concat("un", F.lit("→"), "vn").alias("t")))), lambda s: s["t"]), ", ").alias("mapping"))
    return matches.select(*PAIR).join(text, PAIR, "left")
