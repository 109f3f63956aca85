"""Text forms of values, and the overview of a graph as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwright.operators.connectivity import component_count
from arcwright.operators.families import bipartite, eulerian_status, forest_flags, is_complete
from arcwright.operators.model import Graphs
from arcwright.operators.stats import density, order_size


def format_number(x: Column) -> Column:
    """Whole numbers below 1e12 as integers, others with up to 3 decimals, infinity as a sign."""
    far = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = (x == F.floor(x)) & (F.abs(x) < 1e12)
    short = F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", "")
    return F.when(far, "∞").when(whole, F.floor(x).cast("string")).otherwise(short)


def subscript(x: Column) -> Column:
    return F.translate(x.cast("string"), "0123456789", "₀₁₂₃₄₅₆₇₈₉")


def html_escape(x: Column) -> Column:
    out = x
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def path_string(paths: DataFrame, g: Graphs, keys: list[str], arrow: str = " → ") -> DataFrame:
    """Names along ``path``, joined by arrows."""
    steps = paths.select(*keys, "path", F.posexplode("path").alias("at", "vid")).join(g.vertices, ["graph_id", "vid"])
    named = steps.groupBy(*keys, "path").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("x"))
    return named.select(*keys, F.array_join(F.transform("x", lambda y: y["name"]), arrow).alias("path_string"))


def set_string(members: DataFrame, g: Graphs, keys: list[str]) -> DataFrame:
    """(keys, text): the names of members(keys, vid) in order of vids, as ``{a,b}``; keys hold graph_id."""
    named = members.select(*keys, "vid").join(g.vertices, ["graph_id", "vid"])
    return _joined(named, keys, "name", ",").select(*keys, F.concat(F.lit("{"), "text", F.lit("}")).alias("text"))


def edge_name(g: Graphs) -> DataFrame:
    """(graph_id, eid, edge_name): ``(a→b)`` in a digraph, ``(a–b)`` in a graph."""
    end = lambda c: g.vertices.select("graph_id", F.col("vid").alias(c), F.col("name").alias(c + "_name"))
    x = g.flagged_edges().join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"])
    sign = F.when(F.col("directed"), "→").otherwise("–")
    return x.select("graph_id", "eid", F.concat(F.lit("("), "src_name", sign, "dst_name", F.lit(")")).alias("edge_name"))


def _joined(rows: DataFrame, keys: list[str], column: str, sep: str, order: str = "vid") -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("t"))))
    return rows.groupBy(*keys).agg(F.count("*").alias("k"), F.array_join(F.transform(items, lambda x: x["t"]), sep).alias("text"))


LISTED = 64  # vertices of a graph whose overview lists names


def overview_report(g: Graphs, listed: int = LISTED) -> DataFrame:
    """(graph_id, section, property, value, state) rows of all properties of each graph with vertices.

    Names of components, bridges, cutpoints, blocks and sides are listed for graphs of at most
    ``listed`` vertices; of larger ones the counts are given, and component_members,
    bridges, cutpoints, block_members and bipartition_sides have the rows.
    """
    from arcwright.functions.durable import settle
    from arcwright.operators import blocks, flow, matching
    from arcwright.operators.adjacency import degrees, parallel_pairs, simple_flags
    from arcwright.operators.compare import complement_size
    from arcwright.operators.connectivity import component_roots, strong_count
    from arcwright.operators.families import bipartition_sides, hamiltonian, is_cycle_graph, is_cyclic, maximal_non_hamiltonian, traceable
    from arcwright.operators.stats import weight_summary

    key = "graph_id"
    sizes = order_size(g).filter("n > 0")
    small = sizes.filter(F.col("n") <= listed).select(key)
    cut = settle(blocks.cutpoints(g), "cutpoints")
    bridge = settle(blocks.bridges(g), "bridges")
    bridge_ids = bridge.join(g.edges.select(key, "eid", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")), [key, "u", "v"]).select(key, "eid")

    def names(rows: DataFrame, column: str, sep: str, order: str, out: str) -> DataFrame:
        """k_<out> for every graph, t_<out> for the small ones."""
        k = rows.groupBy(key).agg(F.count("*").alias("k_" + out))
        t = _joined(rows.join(small, key, "left_semi"), [key], column, sep, order).select(key, F.col("text").alias("t_" + out))
        return k.join(t, key, "left")

    within = lambda rows: rows.join(small, key, "left_semi")
    comp = set_string(within(component_roots(g)), g, [key, "root"])
    comp = _joined(comp, [key], "text", " ", "root").select(key, F.col("text").alias("t_comp"))
    members = blocks.block_members(g)
    block = _joined(set_string(within(members), g, [key, "block"]), [key], "text", " ", "block").select(key, F.col("text").alias("t_block"))
    sides = within(bipartition_sides(g)).join(g.vertices, [key, "vid"])
    side = lambda i: _joined(sides.filter(F.col("side") == i), [key], "name", ", ").select(key, F.col("text").alias(f"t_side{i}"))
    centre = g.vertices.select(key, F.col("vid").alias("centre"), F.col("name").alias("centre_name"))

    x = sizes.join(g.graphs.select(key, "directed", "weighted"), key)
    for part in (
        density(g).withColumnRenamed("label", "sparse"), simple_flags(g), parallel_pairs(g), weight_summary(g), degrees(g).groupBy(key).agg(F.sum("loops").alias("loops")), component_count(g), strong_count(g),
        flow.vertex_connectivity(g), flow.edge_connectivity(g), blocks.nonseparable(g), is_complete(g), is_cycle_graph(g), bipartite(g), forest_flags(g), is_cyclic(g), eulerian_status(g),
        hamiltonian(g), traceable(g), maximal_non_hamiltonian(g), complement_size(g), matching.self_complementary(g),
        names(bridge_ids.join(edge_name(g), [key, "eid"]), "edge_name", ", ", "eid", "bridge"), names(cut.join(g.vertices, [key, "vid"]), "name", ", ", "vid", "cut"),
        members.groupBy(key).agg(F.count_distinct("block").alias("k_block")), comp, block, side(0), side(1),
    ):
        x = x.join(settle(part, "part"), key, "left")  # a row a graph; written alone, so no plan holds them all
    x = x.join(centre, [key, "centre"], "left")
    x = settle(x.fillna(0, ["loops", "k_bridge", "k_cut", "k_block", "strong_components"]), "overview")

    n, both = F.col("n"), F.lit(" — ")
    text = lambda c: F.col(c).cast("string")
    word = lambda c: F.when(F.col(c), "yes").otherwise("no")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    more = lambda count, names: F.when(F.col(names).isNotNull(), say(text(count), both, F.col(names))).otherwise(text(count))
    sub = lambda c: subscript(c)

    def row(section: str, name: str, value: Column, state: Column | str = "NONE", when: Column | None = None) -> Column:
        out = F.struct(F.lit(section).alias("section"), F.lit(name).alias("property"), value.cast("string").alias("value"), (F.lit(state) if isinstance(state, str) else state).alias("state"))
        return out if when is None else F.when(when, out)

    yes_no = lambda c: F.when(F.col(c), "YES").otherwise("NO")
    loops, many, directed = F.col("loops") > 0, F.col("has_parallel"), F.col("directed")
    why = F.when(loops & many, "loops and parallel edges").when(loops, "loops").otherwise("parallel edges")
    multi = F.when(many, say("yes", both, text("parallel_pairs"), " pair(s) with parallel edges", F.when(loops, ", plus loops (pseudograph)").otherwise(""))).when(loops, "no parallel edges, but has loops (pseudograph)").otherwise("no")
    limit = lambda c, most: F.coalesce(text(c), F.lit(f"not computed (more than {most} vertices)"))
    ham_open, mnh_open = n < F.when(directed, 2).otherwise(3), F.col("maximal_non_hamiltonian").isNull()
    side_text = lambda c: F.coalesce(F.col(c), F.lit("none"))
    bip = F.when(~F.col("is_bipartite"), F.when(loops, "no — a loop is an odd cycle").otherwise("no — contains an odd cycle")).when(F.col("t_side0").isNotNull(), say("yes", both, "{", side_text("t_side0"), "} | {", side_text("t_side1"), "}")).otherwise("yes")
    comps = F.when(directed, say("weak ", text("components"), ", strong ", text("strong_components"))).otherwise(more("components", "t_comp"))
    ham = F.when(ham_open, "n/a (needs at least 3 vertices)").when(F.col("hamiltonian").isNull(), "not checked (more than 16 vertices)").otherwise(word("hamiltonian"))
    mnh = F.when(ham_open, "n/a").when(mnh_open, "not checked (more than 12 vertices)").when(F.col("hamiltonian"), "no — the graph is Hamiltonian").otherwise(word("maximal_non_hamiltonian"))
    euler = F.when(F.col("eulerian") == "yes", say("yes — Euler circuit (", F.col("reason"), ")")).when(F.col("eulerian") == "semi", say("semi — ", F.col("reason"))).otherwise(say("no — ", F.col("reason")))
    own = F.when(F.col("note") == "yes", "yes").when(F.col("note") == "undetermined", "undetermined (search limit reached)").when(F.col("note") == "no", "no").otherwise(say("no (", F.col("note"), ")"))
    rows = F.array(
        row("basics", "type", say(F.when(directed, "Directed").otherwise("Undirected"), ", ", F.when(F.col("weighted"), "weighted").otherwise("unweighted"))),
        row("basics", "order", n),
        row("basics", "size", F.col("m")),
        row("basics", "simple", F.when(F.col("is_simple"), "yes").otherwise(say("no — has ", why)), yes_no("is_simple")),
        row("basics", "multigraph", multi, yes_no("has_parallel")),
        row("basics", "weights", say("total ", format_number(F.col("total")), ", min ", format_number(F.col("lightest")), ", max ", format_number(F.col("heaviest"))), when=F.col("weighted") & (F.col("m") > 0)),
        row("basics", "density", F.when(n < 2, "n/a").otherwise(say(F.col("sparse"), " (", text("percent"), "% of possible edges)"))),
        row("connectivity", "connected", word("connected"), yes_no("connected")),
        row("connectivity", "strongly connected", word("strongly_connected"), yes_no("strongly_connected"), when=directed),
        row("connectivity", "components", comps),
        row("connectivity", "vertex connectivity", limit("vertex_connectivity", flow.VERTEX_LIMIT)),
        row("connectivity", "edge connectivity", limit("edge_connectivity", flow.VERTEX_LIMIT)),
        row("connectivity", "bridges", F.when(F.col("k_bridge") == 0, "none").otherwise(more("k_bridge", "t_bridge")), F.when(F.col("k_bridge") == 0, "NO").otherwise("WARN")),
        row("connectivity", "cutpoints", F.when(F.col("k_cut") == 0, "none").otherwise(more("k_cut", "t_cut")), F.when(F.col("k_cut") == 0, "NO").otherwise("WARN")),
        row("connectivity", "blocks", F.when(F.col("k_block") == 0, "none").otherwise(more("k_block", "t_block"))),
        row("connectivity", "nonseparable", word("nonseparable"), yes_no("nonseparable")),
        row("family", "complete", F.when(F.col("is_complete"), say("yes — K", sub(n))).otherwise("no"), yes_no("is_complete")),
        row("family", "empty", F.when(F.col("is_empty"), say("yes — E", sub(n))).otherwise("no"), yes_no("is_empty")),
        row("family", "cycle", F.when(F.col("is_cycle_graph"), say("yes — C", sub(n))).otherwise("no"), yes_no("is_cycle_graph")),
        row("family", "bipartite", bip, yes_no("is_bipartite")),
        row("family", "complete bipartite", F.when(F.col("is_complete_bipartite"), say("yes — K", sub(F.col("p")), ",", sub(F.col("q")))).otherwise("no"), yes_no("is_complete_bipartite")),
        row("family", "star", F.when(F.col("is_star"), say("yes — K", sub(F.lit(1)), ",", sub(n - 1), " (centre ", F.col("centre_name"), ")")).otherwise("no"), yes_no("is_star")),
        row("family", "tree", word("is_tree"), yes_no("is_tree")),
        row("family", "forest", F.when(F.col("is_forest"), say("yes — ", text("components"), " tree(s)")).otherwise("no"), yes_no("is_forest")),
        row("family", "cyclic", F.when(F.col("is_cyclic"), "Cyclic").otherwise("Acyclic"), F.when(F.col("is_cyclic"), "WARN").otherwise("YES")),
        row("traversal", "eulerian", euler, F.when(F.col("eulerian") == "yes", "YES").when(F.col("eulerian") == "semi", "WARN").otherwise("NO")),
        row("traversal", "hamiltonian", ham, F.when(ham_open | F.col("hamiltonian").isNull(), "NONE").otherwise(yes_no("hamiltonian"))),
        row("traversal", "traceable", F.when(F.col("traceable").isNull(), "not checked").otherwise(word("traceable")), F.when(F.col("traceable").isNull(), "NONE").otherwise(yes_no("traceable"))),
        row("traversal", "maximal non-hamiltonian", mnh, F.when(ham_open | mnh_open, "NONE").otherwise(yes_no("maximal_non_hamiltonian"))),
        row("related", "complement", say("complement has ", text("complement_size"), " edge(s)")),
        row("related", "self-complementary", own, F.when(F.col("note") == "yes", "YES").otherwise("NONE")),
    )
    return x.select(key, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(key, "r.*")
