"""Small graphs solved inside tasks: no rounds, the same rows as the distributed way, odd raw rows."""

import random

import pytest
from test_graph_queries import graphs_of
from test_reports import plain_blocks

from arcwright.jobs import graph_queries
from arcwright.operators import blocks, connectivity, distance, families, flow, packs, pairs
from arcwright.operators.model import Drawn, Graphs

RNG = random.Random(11)
NAMED = {"none": (0, []), "lone": (1, []), "loop": (1, [(0, 0)]), "apart": (5, [(0, 1), (3, 2), (3, 2)]), "ring": (12, [(i, (i + 1) % 12) for i in range(12)]), "path": (15, [(i, i + 1) for i in range(14)])}
for _i in range(20):
    _n = RNG.randrange(1, 7)
    NAMED[f"g{_i}"] = (_n, [(RNG.randrange(_n), RNG.randrange(_n)) for _ in range(RNG.randrange(0, 2 * _n))])

OPERATORS = [
    blocks.block_members, blocks.block_count, blocks.cutpoints, blocks.bridges, blocks.nonseparable, connectivity.component_roots, connectivity.component_count, connectivity.component_members,
    connectivity.component_summary, connectivity.strong_components, families.forest_flags, families.bipartite, families.bipartition_sides, distance.hop_distance, distance.underlying_hop_distance,
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def no_rounds(*_, **__):
    raise AssertionError("a round over the cluster")


@pytest.mark.parametrize("directed", [False, True])
def test_small_graphs_take_no_rounds_and_agree_with_the_distributed_way(spark, monkeypatch, directed):
    with monkeypatch.context() as m:
        for module, name in ((blocks, "star_components"), (connectivity, "star_components"), (blocks, "spanning_forest"), (families, "reached_from"), (distance, "reached_from"), (connectivity, "_least_reaching")):
            m.setattr(module, name, no_rounds)
        g = graphs_of(spark, NAMED, directed=directed)
        alone = [rows(f(g)) for f in OPERATORS]
    got = {}
    for name, block, vid in alone[0]:
        got.setdefault(name, {}).setdefault(block, set()).add(vid)
    for name, (n, edges) in NAMED.items():
        assert [got.get(name, {})[b] for b in sorted(got.get(name, {}))] == sorted(map(set, plain_blocks(n, edges)), key=sorted), name
    monkeypatch.setattr(packs, "SMALL", 20)  # the ring and the path are large
    g = Graphs(g.graphs, g.vertices, g.edges)
    for f in (connectivity.strong_components,) if directed else (blocks.block_members, connectivity.component_summary, families.bipartition_sides):
        assert rows(f(g)) == alone[OPERATORS.index(f)], f.__name__


@pytest.mark.parametrize("listed", [False, True])
def test_raw_rows_are_numbered_alike_packed_and_indexed(spark, monkeypatch, listed):
    """Null kinds, keys and names, repeated edges, ends that are no listed vertices, equal kinds of several keys."""
    kinds, raw = ["a", "b", None, "ä"], []
    for i in range(300):
        (s, x), (t, y) = (RNG.choice(kinds), RNG.choice([0, 1, 2, None])), (RNG.choice(kinds), RNG.choice([0, 1]))
        name = lambda k, j: None if k is None or j is None else f"{k}{j}"
        raw.append((f"g{RNG.randrange(30)}", s, x, name(s, x), t, y, name(t, y), 1.0, i))
    edges = spark.createDataFrame(raw, "graph_id string, skind string, skey long, src_name string, dkind string, dkey long, dst_name string, weight double, o1 long")
    ends = edges.selectExpr("graph_id", "skind as kind", "skey as key", "src_name as name").union(edges.select("graph_id", "dkind", "dkey", "dst_name")).distinct()
    if listed:  # one kind is missing, and one graph has no edge
        ends = ends.filter("kind is null or kind <> 'b'").union(spark.createDataFrame([("alone", "a", 5, "a5")], ends.schema))
    drawn = Drawn(True, False, True, ends, edges, listed, ["o1"])
    whole = drawn.indexed()
    for f in (connectivity.component_summary, connectivity.strong_components, distance.hop_distance):
        assert rows(f(drawn)) == rows(f(whole)), f.__name__
    monkeypatch.setattr(packs, "SMALL", 12)
    some = Drawn(True, False, True, ends, edges, listed, ["o1"])
    assert packs.rest(some) is not None and packs.rest(some) is not some
    assert rows(connectivity.component_summary(some)) == rows(connectivity.component_summary(whole))


@pytest.mark.parametrize("directed", [False, True])
def test_searches_of_small_graphs_take_no_rounds_and_agree_with_the_distributed_way(spark, monkeypatch, directed):
    few = {k: NAMED[k] for k in ("none", "lone", "loop", "apart", "ring", "g0", "g1", "g2", "g3", "g4")} | {"k5": (5, [(i, j) for i in range(5) for j in range(5) if i != j]), "p3": (4, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 0)])}
    g = graphs_of(spark, few, directed=directed)
    limited = [(flow.vertex_connectivity, flow._large_vertex, 40), (flow.edge_connectivity, flow._large_edge, 40), (families.hamiltonian, families._large_hamiltonian, 5), (families.traceable, families._large_traceable, 5), (families.maximal_non_hamiltonian, families._large_maximal, 5)]
    with monkeypatch.context() as m:
        for module, name in ((flow, "_least"), (families, "spanning_states"), (pairs, "semipath")):
            m.setattr(module, name, no_rounds)
        alone = [rows(f(g, most)) for f, _, most in limited]
        arrows = rows(pairs.semipath_arrows(g))
    pick = range(len(limited)) if directed else (0, 4)
    for i in pick:
        assert alone[i] == rows(limited[i][1](g, limited[i][2])), limited[i][1].__name__
    assert arrows == rows(pairs.semipath_arrows(g, graph_queries.all_pairs(g)))
