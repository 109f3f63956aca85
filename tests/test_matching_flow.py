"""Connectivity numbers, maximal non-Hamiltonian graphs, isomorphism and embedding on known and random graphs."""

import itertools
import random

import pytest
from test_graph_queries import KNOWN, column, graphs_of

from arcwright.operators import families, flow, matching

PETERSEN = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
# the Petersen graph with vertex 0 opened into a triangle
TIETZE = [(a, b) for a, b in PETERSEN if 0 not in (a, b)] + [(0, 1), (10, 4), (11, 5), (0, 10), (10, 11), (11, 0)]


def of(mult, n, s, directed):
    return sum(c for (u, v), c in mult.items() if u in s and v not in s)


def reach(n, arcs, gone, start):
    seen, todo = {start}, [start]
    while todo:
        u = todo.pop()
        for v in range(n):
            if (u, v) in arcs and v not in gone and v not in seen:
                seen.add(v)
                todo.append(v)
    return seen


def numbers(n, edges, directed):
    mult = {}
    for u, v in edges:
        if u != v:
            mult[u, v] = mult.get((u, v), 0) + 1
            if not directed:
                mult[v, u] = mult.get((v, u), 0) + 1
    if n == 1:
        return 0, 0
    lam = min(of(mult, n, set(s), directed) for k in range(1, n) for s in itertools.combinations(range(n), k))
    for k in range(n - 1):
        for gone in map(set, itertools.combinations(range(n), k)):
            if any(len(reach(n, mult, gone, s)) < n - k for s in range(n) if s not in gone):
                return lam, k
    return lam, n - 1


def test_connectivity_of_known_graphs(spark):
    big = {"over": (41, [(i, (i + 1) % 41) for i in range(41)]), "ring40": (40, [(i, (i + 1) % 40) for i in range(40)]), "tietze": (12, TIETZE), "tri": (4, [(0, 1), (1, 2), (2, 0), (2, 3)]), "none": (0, [])}
    g = graphs_of(spark, KNOWN | big)
    lam, kap = column(flow.edge_connectivity(g), "edge_connectivity"), column(flow.vertex_connectivity(g), "vertex_connectivity")
    want = {"k26": (2, 2), "wheel": (3, 3), "path13": (1, 1), "cycle8": (2, 2), "k5": (4, 4), "star": (1, 1), "lone": (0, 0), "loop": (0, 0), "twice": (2, 1), "apart": (0, 0)}
    want |= {"over": (None, None), "ring40": (2, 2), "tietze": (3, 3), "tri": (1, 1), "none": (None, None)}
    assert {k: (lam[k], kap[k]) for k in lam} == want


@pytest.mark.parametrize("directed", [False, True])
def test_connectivity_of_random_graphs(spark, directed):
    rng = random.Random(11)
    named = {}
    for i in range(60):
        n = rng.randrange(1, 8)
        named[f"g{i}"] = (n, [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 4 * n))])
    g = graphs_of(spark, named, directed=directed)
    lam, kap = column(flow.edge_connectivity(g), "edge_connectivity"), column(flow.vertex_connectivity(g), "vertex_connectivity")
    assert {k: (lam[k], kap[k]) for k in named} == {k: numbers(n, e, directed) for k, (n, e) in named.items()}
    if not directed:  # an old inequality, for simple graphs
        simple = {k: (n, list({(min(a, b), max(a, b)) for a, b in e if a != b})) for k, (n, e) in named.items() if n > 1}
        s = graphs_of(spark, simple)
        lam, kap = column(flow.edge_connectivity(s), "edge_connectivity"), column(flow.vertex_connectivity(s), "vertex_connectivity")
        low = {k: min(sum(x in p for p in e) for x in range(n)) for k, (n, e) in simple.items()}
        assert all(kap[k] <= lam[k] <= low[k] for k in simple)


def test_maximal_non_hamiltonian(spark):
    g = graphs_of(spark, {"tietze": (12, TIETZE), "petersen": (10, PETERSEN), "tri": (4, [(0, 1), (1, 2), (2, 0), (2, 3)]), "over": (13, []), "one": (1, []), "two": (2, [])} | {k: KNOWN[k] for k in ("k26", "wheel", "cycle8", "star", "k5")})
    got = column(families.maximal_non_hamiltonian(g), "maximal_non_hamiltonian")
    assert {k for k, v in got.items() if v} == {"tietze", "petersen", "tri"} and got["over"] is None
    d = graphs_of(spark, {"half": (2, [(0, 1)]), "both": (2, [(0, 1), (1, 0)]), "none": (2, []), "ring": (3, [(0, 1), (1, 2)])}, directed=True)
    assert {k for k, v in column(families.maximal_non_hamiltonian(d), "maximal_non_hamiltonian").items() if v} == {"half"}


def first_image(na, ea, nb, eb, directed, exact):
    def table(edges):
        m = {}
        for u, v in edges:
            m[u, v] = m.get((u, v), 0) + 1
            if not directed and u != v:
                m[v, u] = m.get((v, u), 0) + 1
        return m

    a, b = table(ea), table(eb)
    if na > nb or len(ea) > len(eb) or (exact and (na, len(ea)) != (nb, len(eb))):
        return None
    degree = [sum((u == x) + (v == x) for u, v in ea) for x in range(na)]
    turn = sorted(range(na), key=lambda x: (-degree[x], x))
    for image in itertools.permutations(range(nb), na):  # in ascending order
        at = dict(zip(turn, image, strict=True))
        if all((b.get((at[u], at[v]), 0) == a.get((u, v), 0)) if exact else (b.get((at[u], at[v]), 0) >= a.get((u, v), 0)) for u in at for v in at):
            return at
    return None


@pytest.mark.parametrize("directed", [False, True])
def test_first_images_of_random_graphs(spark, monkeypatch, directed):
    monkeypatch.setattr(matching, "OPENED", 3)  # images wait their turn, and candidates come in several blocks
    monkeypatch.setattr(matching, "BLOCK", 2)
    rng = random.Random(4)
    named, pairs = {}, []
    for i in range(8):
        n = rng.randrange(1, 6)
        e = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 2 * n))]
        p = rng.sample(range(n), n)
        wide = n + rng.randrange(2)
        named |= {f"a{i}": (n, e), f"b{i}": (n, [(p[u], p[v]) if rng.random() < 0.5 or directed else (p[v], p[u]) for u, v in e]), f"c{i}": (wide, [(p[u], p[v]) for u, v in e] + [(rng.randrange(wide), rng.randrange(wide)) for _ in range(2)])}
        pairs += [(f"a{i}", f"b{i}"), (f"a{i}", f"c{i}"), (f"c{i}", f"a{i}"), (f"a{i}", f"a{(i + 1) % 8}")]
    g = graphs_of(spark, named, directed=directed)
    asked = spark.createDataFrame(pairs, "a_id string, b_id string")
    for find, name, exact in ((matching.isomorphism, "isomorphic", True), (matching.subgraph_embedding, "embeds", False)):
        for r in find(g, g, asked).collect():
            want = first_image(*named[r["a_id"]], *named[r["b_id"]], directed, exact)
            assert (r[name], r["map"]) == ("no" if want is None else "yes", want), r


def test_graphs_that_degrees_do_not_tell_apart(spark):
    rng = random.Random(8)
    ring = lambda at, n: [(at + i, at + (i + 1) % n) for i in range(n)]
    prism = ring(0, 6) + ring(6, 6) + [(i, i + 6) for i in range(6)]
    twisted = ring(0, 12) + [(i, i + 6) for i in range(6)]
    p = rng.sample(range(12), 12)
    named = {"prism": (12, prism), "twisted": (12, twisted), "moved": (12, [(p[u], p[v]) for u, v in prism]), "bare": (20, []), "bare2": (20, []), "one": (20, ring(0, 20)), "two": (20, ring(0, 10) + ring(10, 10))}
    g = graphs_of(spark, named)
    asked = spark.createDataFrame([("prism", "twisted"), ("prism", "moved"), ("bare", "bare2"), ("one", "two"), ("two", "two")], "a_id string, b_id string")
    got = {(r["a_id"], r["b_id"]): r for r in matching.isomorphism(g, g, asked).collect()}
    assert {k: r["isomorphic"] for k, r in got.items()} == {("prism", "twisted"): "no", ("prism", "moved"): "yes", ("bare", "bare2"): "yes", ("one", "two"): "no", ("two", "two"): "yes"}
    assert got["bare", "bare2"]["map"] == {i: i for i in range(20)}
    m = got["prism", "moved"]["map"]
    assert {frozenset((m[u], m[v])) for u, v in prism} == {frozenset(e) for e in named["moved"][1]}
    few = matching.isomorphism(g, g, asked.filter("b_id = 'twisted'"), budget=1).collect()
    assert [r["isomorphic"] for r in few] == ["undetermined"]


def test_a_pattern_inside_a_large_graph(spark):
    n = 600
    web = [(i, (i * 7 + 1) % n) for i in range(n)] + [(0, i) for i in range(1, 300)] + [(590, 591), (591, 592), (592, 593), (593, 590), (590, 592), (591, 593)]
    tree = [(i, i // 2) for i in range(1, n)]
    pattern = {"k4": (4, list(itertools.combinations(range(4), 2))), "claw": (4, [(3, 0), (3, 1), (3, 2)])}
    a = graphs_of(spark, pattern)
    b = graphs_of(spark, {"web": (n, web), "tree": (n, tree), "digraph": (1, [])})
    asked = spark.createDataFrame(list(itertools.product(["k4", "claw"], ["web", "tree"])), "a_id string, b_id string")
    got = {(r["a_id"], r["b_id"]): r for r in matching.subgraph_embedding(a, b, asked).collect()}
    assert {k: r["embeds"] for k, r in got.items()} == {("k4", "web"): "yes", ("k4", "tree"): "no", ("claw", "web"): "yes", ("claw", "tree"): "yes"}
    assert got["k4", "web"]["map"] == {0: 590, 1: 591, 2: 592, 3: 593} and got["claw", "web"]["map"][3] == 0
    d = graphs_of(spark, {"d": (2, [(0, 1)])}, directed=True)
    assert matching.subgraph_embedding(d, b, spark.createDataFrame([("d", "web")], "a_id string, b_id string")).first()["embeds"] == "n/a"


def test_self_complementary_graphs(spark):
    bull = [(0, 1), (1, 2), (2, 0), (1, 3), (2, 4)]
    g = graphs_of(spark, {"path4": (4, [(0, 1), (1, 2), (2, 3)]), "claw": (4, [(0, 1), (0, 2), (0, 3)]), "c5": (5, [(i, (i + 1) % 5) for i in range(5)]), "bull": (5, bull), "loop": (1, [(0, 0)]), "one": (1, []), "k3": (3, [(0, 1), (1, 2), (0, 2)])})
    assert {k for k, v in column(matching.self_complementary(g), "self_complementary").items() if v} == {"path4", "c5", "bull", "one"}
    d = graphs_of(spark, {"ring": (3, [(0, 1), (1, 2), (2, 0)]), "arc": (2, [(0, 1)])}, directed=True)
    assert {k for k, v in column(matching.self_complementary(d), "self_complementary").items() if v} == {"ring", "arc"}
