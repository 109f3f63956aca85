"""Reports, containers, blocks and path listings on known graphs and against plain searches."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_graph_queries import KNOWN, SF, TABLES, column, graphs_of, plain

from arcwright.jobs import graph_queries
from arcwright.operators import blocks, compare, containers, distance, matching, pairs, report, stats

FAST = ["maximal_non_hamiltonian", "isomorphism", "block_members", "example_walk_daily", "trails_daily", "semipath_arrows", "degree_names", "bipartition_sides", "underlying_parents"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = graph_queries.QUERIES[name](spark, SF)
    want = con.sql(graph_queries.ORACLES[name])
    cols, rows = want.columns, want.fetchall()
    assert sorted(df.columns) == sorted(cols) and rows
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(map(plain, r)) for r in rows), key=repr)


def plain_blocks(n, edges):
    """Sets of vertices that no single other vertex parts, by trying each."""
    near = {v: {b if a == v else a for a, b in edges if v in (a, b) and a != b} for v in range(n)}

    def side(gone, start):
        seen, todo = {start}, [start]
        while todo:
            for w in near[todo.pop()] - seen - {gone}:
                seen.add(w)
                todo.append(w)
        return seen

    linked = {(u, v) for u in range(n) for v in side(None, u) - {u} if all(v in side(w, u) for w in range(n) if w not in (u, v))}
    return {frozenset({u, v} | {x for x in range(n) if (x, u) in linked and (x, v) in linked}) for u, v in linked}


def test_blocks_of_random_graphs_and_a_long_path(spark):
    rng = random.Random(6)
    named = {}
    for i in range(25):
        n = rng.randrange(1, 11)
        named[f"g{i}"] = (n, [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 2 * n))])
    named["path"] = (300, [(i, i + 1) for i in range(299)])
    g = graphs_of(spark, named)
    got = {}
    for r in blocks.block_members(g).collect():
        got.setdefault(r["graph_id"], {}).setdefault(r["block"], set()).add(r["vid"])
    for name, (n, edges) in named.items():
        mine = got.get(name, {})
        if name == "path":
            assert mine == {i: {i, i + 1} for i in range(299)}
        else:
            assert [mine[b] for b in sorted(mine)] == sorted(map(set, plain_blocks(n, edges)), key=sorted), name


def walk(n, edges, directed, s, t):
    """All simple paths and trails s -> t in order, by plain recursion."""
    out = {}
    for i, (u, v) in enumerate(edges):
        out.setdefault(u, []).append((i, v))
        if not directed and u != v:
            out.setdefault(v, []).append((i, u))
    paths, trails = set(), set()

    def path(way):
        if way[-1] == t:
            paths.add(way)
            return
        for _, v in out.get(way[-1], []):
            if v not in way:
                path((*way, v))

    def trail(at, used):
        if at == t and used:
            trails.add(used)
        for i, v in out.get(at, []):
            if i not in used:
                trail(v, (*used, i))

    path((s,))
    trail(s, ())
    return sorted(paths), sorted(trails)


@pytest.mark.parametrize("directed", [False, True])
def test_pair_reports_of_random_graphs(spark, monkeypatch, directed):
    monkeypatch.setattr(pairs, "OPENED", 8)
    rng = random.Random(9)
    named = {f"g{i}": (n := rng.randrange(1, 5), [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 5))]) for i in range(6)}
    g = graphs_of(spark, named, directed=directed)
    short = lambda ways: sorted(ways, key=lambda w: (len(w), w))
    for r in pairs.pair_report(g, graph_queries.all_pairs(g)).collect():
        n, edges = named[r["graph_id"]]
        ways, trails = walk(n, edges, directed, r["s"], r["t"])
        assert (r["n_paths"], r["more_paths"], r["n_trails"], r["more_trails"]) == (min(len(ways), 300), len(ways) > 300, min(len(trails), 300), len(trails) > 300)
        assert [tuple(p) for p in r["paths"] or []] == short(ways[:301])[:25] and [tuple(p) for p in r["trails"] or []] == short(trails[:301])[:15]
        assert r["reachable"] == bool(ways) and r["hops"] == (min(map(len, ways)) - 1 if ways else -1)
        least = [w for w in ways if len(w) - 1 == r["hops"]]
        assert r["n_geodesics"] == len(least) and [tuple(p) for p in r["geodesics"] or []] == least[:4]
        assert (r["shortest_path"], r["longest_path"]) == ((r["hops"], max(map(len, ways)) - 1) if ways else (None, None))
        assert r["longest_trail"] == (max(map(len, trails)) if trails else None)
        assert r["walk_counts"][0] == sum((u, v) == (r["s"], r["t"]) or (not directed and u != v and (v, u) == (r["s"], r["t"])) for u, v in edges)


def test_first_paths_of_a_complete_graph(spark):
    k = 12
    g = graphs_of(spark, {"k12": (k, [(i, j) for i in range(k) for j in range(i)])})
    got = pairs.simple_paths(g, spark.createDataFrame([("k12", 0, 11)], "graph_id string, s long, t long"))
    rows = sorted(r["path"] for r in got.collect())
    want = []

    def path(way):
        if len(want) == 300:
            return
        if way[-1] == 11:
            want.append(way)
            return
        for v in range(k):
            if v not in way:
                path([*way, v])

    path([0])
    assert rows == want


def test_path_lengths_count_every_path(spark):
    k = 8
    g = graphs_of(spark, {"k8": (k, [(i, j) for i in range(k) for j in range(i)]), "apart": (3, [(0, 1), (0, 1)])})
    wanted = [("k8", 0, 7), ("k8", 7, 3), ("k8", 2, 2), ("apart", 0, 1), ("apart", 0, 2)]
    got = pairs.path_lengths(g, spark.createDataFrame(wanted, "graph_id string, s long, t long"))
    every = sum(math.perm(k - 2, inner) for inner in range(k - 1))
    assert every == 1957  # beyond the 300 that a listing keeps
    assert {(r["graph_id"], r["s"], r["t"]): (r["shortest"], r["longest"], r["paths"]) for r in got.collect()} == {
        ("k8", 0, 7): (1, 7, every), ("k8", 7, 3): (1, 7, every), ("k8", 2, 2): (0, 0, 1), ("apart", 0, 1): (1, 1, 1),
    }


def test_containers_in_detail(spark):
    g = graphs_of(spark, {"k4less": (4, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]), "cycle": (5, [(i, (i + 1) % 5) for i in range(5)])})
    rows = {(r["graph_id"], r["s"], r["t"], r["place"]): r for r in containers.container_detail(g).collect()}
    # 2 and 3 are joined through 0 and through 1, at best both
    best = rows["k4less", 2, 3, 1]
    assert (best["width"], best["longest"]) == (2, 2) and len(best["numbers"]) == 2
    assert [rows["cycle", 0, 2, p]["width"] for p in (1,)] == [2] and rows["cycle", 0, 2, 1]["longest"] == 3
    paths = {(r["graph_id"], r["s"], r["t"]): r["paths"] for r in containers.containers(g).collect()}
    for (name, s, t, place), r in rows.items():
        lengths = [paths[name, s, t][i]["length"] for i in r["numbers"]]
        inner = [v for i in r["numbers"] for v in paths[name, s, t][i]["inner"]]
        assert place <= 5 and lengths == sorted(lengths, reverse=True) and lengths[0] == r["longest"] and len(inner) == len(set(inner))


def test_overview_of_known_graphs(spark):
    g = graphs_of(spark, {k: KNOWN[k] for k in ("k26", "wheel", "k5", "star", "twice", "apart", "lone", "loop")} | {"none": (0, [])})
    rows = {}
    for r in report.overview_report(g).collect():
        rows.setdefault(r["graph_id"], {})[r["property"]] = (r["value"], r["state"])
    assert set(rows) == {"k26", "wheel", "k5", "star", "twice", "apart", "lone", "loop"} and len(rows["k26"]) == 29
    assert rows["k26"]["complete bipartite"] == ("yes — K₂,₆", "YES") and rows["k26"]["bipartite"] == ("yes — {0, 1} | {2, 3, 4, 5, 6, 7}", "YES")
    assert rows["k26"]["edge connectivity"] == ("2", "NONE") and rows["k26"]["eulerian"] == ("yes — Euler circuit (every degree is even)", "YES")
    assert rows["wheel"]["hamiltonian"] == ("yes", "YES") and rows["wheel"]["maximal non-hamiltonian"] == ("no — the graph is Hamiltonian", "NO")
    assert rows["k5"]["complete"] == ("yes — K₅", "YES") and rows["k5"]["density"] == ("Dense (100% of possible edges)", "NONE")
    assert rows["star"]["star"] == ("yes — K₁,₆ (centre 0)", "YES") and rows["star"]["cutpoints"] == ("1 — 0", "WARN") and rows["star"]["bridges"][0].startswith("6 — (0–1), (0–2)")
    assert rows["star"]["blocks"] == ("6 — {0,1} {0,2} {0,3} {0,4} {0,5} {0,6}", "NONE")
    assert rows["twice"]["simple"] == ("no — has parallel edges", "NO") and rows["twice"]["multigraph"] == ("yes — 1 pair(s) with parallel edges", "YES")
    assert rows["apart"]["components"] == ("2 — {0,1} {2,3}", "NONE") and rows["apart"]["eulerian"] == ("no — 2 components have edges", "NO")
    assert rows["lone"]["hamiltonian"] == ("n/a (needs at least 3 vertices)", "NONE") and rows["lone"]["self-complementary"] == ("yes", "YES") and rows["lone"]["traceable"] == ("yes", "YES")
    assert rows["loop"]["multigraph"] == ("no parallel edges, but has loops (pseudograph)", "NO") and rows["loop"]["self-complementary"][0] == "no (not simple)"


def test_compare_report(spark):
    g = graphs_of(spark, {"path": (3, [(0, 1), (1, 2)]), "other": (3, [(1, 0), (0, 2)]), "tri": (3, [(0, 1), (1, 2), (2, 0)])})
    asked = spark.createDataFrame([("path", "other"), ("path", "tri"), ("path", "path")], "a_id string, b_id string")
    got = {r["b_id"]: r for r in compare.compare_report(g, g, asked).collect()}
    say = lambda r: tuple(r[c] for c in ("same_labelled", "a_in_b", "b_in_a", "isomorphic", "mapping", "a_embeds", "b_embeds"))
    assert say(got["other"]) == ("no", "no", "no", "yes", "0→1, 1→0, 2→2", "yes", "yes")
    assert say(got["tri"]) == ("no", "yes", "no", "no", None, "yes", "no")
    assert say(got["path"])[:4] == ("yes", "yes", "yes", "yes")
    d = graphs_of(spark, {"d": (3, [(0, 1)])}, directed=True)
    mixed = compare.compare_report(g, d, spark.createDataFrame([("path", "d")], "a_id string, b_id string")).first()
    assert {mixed[c] for c in ("same_labelled", "isomorphic", "a_embeds", "b_embeds")} == {"n/a"}


def test_batches_of_sources_change_nothing(spark):
    rng = random.Random(2)
    g = graphs_of(spark, {"w": (9, [(rng.randrange(9), rng.randrange(9), rng.randrange(1, 4)) for _ in range(20)])}, directed=True, weighted=True)
    for find, value in ((distance.betweenness, "betweenness"), (distance.closeness, "closeness")):
        whole = {r["vid"]: r[value] for r in find(g).collect()}
        parts = {r["vid"]: r[value] for r in find(g, batch=4).collect()}
        assert whole.keys() == parts.keys() and all(math.isclose(whole[v], parts[v], abs_tol=1e-8) for v in whole)


def test_text_forms(spark):
    row = spark.createDataFrame([(1024, "a<b>&\"c\"")], "n int, t string").select(report.subscript(F.col("n")).alias("s"), report.html_escape(F.col("t")).alias("h")).first()
    assert row["s"] == "₁₀₂₄" and row["h"] == "a&lt;b&gt;&amp;\"c\""
    g = graphs_of(spark, {"star": KNOWN["star"]})
    names = {(r["kind"], r["degree"]): r for r in stats.degree_names(g, 2).collect()}
    assert (names["total", 1]["freq"], names["total", 1]["names"], names["total", 1]["more"]) == (6, "1, 2", 4)
    assert column(report.edge_name(g), "edge_name", "eid")[0] == "(0–1)"
    found = matching.isomorphism(g, g, spark.createDataFrame([("star", "star")], "a_id string, b_id string"))
    assert matching.mapping_string(found, g, g).first()["mapping"] == ", ".join(f"{i}→{i}" for i in range(7))
