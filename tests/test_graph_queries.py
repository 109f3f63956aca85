"""Registered graph queries against their SQL, and goldens for small known graphs."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from arcwright.jobs import graph_queries
from arcwright.operators import adjacency, compare, connectivity, distance, edits, families, stats
from arcwright.operators.components import star_components
from arcwright.operators.model import snapshot

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")
FAST = ["edge_multiplicity_directed", "degrees_directed", "density", "component_summary", "forest_flags", "eulerian_status", "hop_distance", "simple_paths", "walk_counts", "label_subgraph", "remove_vertices", "check_new_edges", "parallel_slots"]


def plain(x):
    x = x.item() if hasattr(x, "item") else x
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = graph_queries.QUERIES[name](spark, SF)
    want = con.sql(graph_queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = want.columns
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def graphs_of(spark, named, directed=False, weighted=False):
    """A graph table from {graph_id: (n, [(u, v[, w])])}."""
    flags = spark.createDataFrame([(k, directed, weighted, True) for k in named], "graph_id string, directed boolean, weighted boolean, multi boolean")
    v = [(k, str(i), i) for k, (n, _) in named.items() for i in range(n)]
    e = [(k, str(x[0]), str(x[1]), float(x[2]) if len(x) > 2 else 1.0, i) for k, (_, es) in named.items() for i, x in enumerate(es)]
    return snapshot(
        flags,
        spark.createDataFrame(v, "graph_id string, name string, pos int"),
        spark.createDataFrame(e, "graph_id string, src_name string, dst_name string, weight double, pos int"),
        ["pos"],
        ["pos"],
    )


def column(df, value, key="graph_id"):
    return {r[key]: r[value] for r in df.collect()}


KNOWN = {
    "k26": (8, [(a, b) for a in (0, 1) for b in range(2, 8)]),
    "wheel": (6, [(i, (i + 1) % 5) for i in range(5)] + [(i, 5) for i in range(5)]),
    "path13": (13, [(i, i + 1) for i in range(12)]),
    "cycle8": (8, [(i, (i + 1) % 8) for i in range(8)]),
    "k5": (5, [(i, j) for i in range(5) for j in range(i)]),
    "star": (7, [(0, i) for i in range(1, 7)]),
    "lone": (1, []),
    "loop": (1, [(0, 0)]),
    "twice": (2, [(0, 1), (1, 0)]),
    "apart": (4, [(0, 1), (2, 3)]),
}


@pytest.fixture(scope="module")
def known(spark):
    return graphs_of(spark, KNOWN)


def test_families_of_known_graphs(known):
    forest = {r["graph_id"]: r for r in families.forest_flags(known).collect()}
    assert {k for k, r in forest.items() if r["is_tree"]} == {"path13", "star", "lone"}
    assert {k for k, r in forest.items() if r["is_star"]} == {"star", "lone"}
    assert forest["apart"]["is_forest"] and not forest["twice"]["is_forest"]
    sides = {r["graph_id"]: r for r in families.bipartite(known).collect()}
    assert {k for k, r in sides.items() if r["is_bipartite"]} == {"k26", "path13", "cycle8", "star", "lone", "twice", "apart"}
    assert {k for k, r in sides.items() if r["is_complete_bipartite"]} == {"k26", "star"}
    assert {k for k, v in column(families.is_cycle_graph(known), "is_cycle_graph").items() if v} == {"cycle8"}
    assert {k for k, v in column(families.is_complete(known), "is_complete").items() if v} == {"k5", "lone", "loop", "twice"}


def test_traversal_of_known_graphs(known):
    euler = column(families.eulerian_status(known), "eulerian")
    assert {k: euler[k] for k in ("k26", "wheel", "path13", "cycle8", "k5", "lone", "twice", "apart")} == {"k26": "yes", "wheel": "no", "path13": "semi", "cycle8": "yes", "k5": "yes", "lone": "none", "twice": "yes", "apart": "no"}
    ham = column(families.hamiltonian(known), "hamiltonian")
    assert {k for k, v in ham.items() if v} == {"wheel", "cycle8", "k5"}
    trace = column(families.traceable(known), "traceable")
    assert {k for k, v in trace.items() if v} == {"wheel", "path13", "cycle8", "k5", "lone", "loop", "twice"}


def test_degree_rules(known):
    d = {(r["graph_id"], r["vid"]): r for r in adjacency.degrees(known).collect()}
    assert d["loop", 0]["degree"] == 2 and d["loop", 0]["loops"] == 1
    assert sum(r["degree"] for (g, _), r in d.items() if g == "k26") == 24
    assert column(compare.complement_size(known), "complement_size")["path13"] == 66
    assert {r["graph_id"] for r in adjacency.isolated_vertices(known).collect()} == {"lone"}


def test_components_and_distances(known, spark):
    assert column(connectivity.component_count(known), "components")["apart"] == 2
    src = spark.createDataFrame([("path13", 0), ("apart", 0)], "graph_id string, s long")
    hops = {(r["graph_id"], r["v"]): r["hops"] for r in distance.hop_distance(known, src).collect()}
    assert hops["path13", 12] == 12 and hops["apart", 1] == 1 and hops["apart", 2] == -1
    between = {(r["graph_id"], r["vid"]): r["betweenness"] for r in distance.betweenness(known).collect()}
    assert between["star", 0] == 1.0 and between["star", 1] == 0.0


def test_empty_graph_table(spark):
    g = graphs_of(spark, {"none": (0, [])})
    assert stats.order_size(g).first()["n"] == 0
    assert connectivity.connected_components(g).count() == 0
    assert adjacency.degrees(g).count() == 0


def test_star_components_on_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1400)] + [(7777, 7777)]
    got = {r["id"]: r["component"] for r in star_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1400)} == {1000} and 7777 not in got
    assert star_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_parse_weight(spark):
    rows = spark.createDataFrame([("2,5",), (" 3 ",), ("-1",), ("0",), ("abc",), ("Infinity",), (None,), ("NaN",)], "t string")
    got = [r["w"] for r in rows.select(edits.parse_weight(F.col("t")).alias("w")).collect()]
    assert got == [2.5, 3.0, None, None, None, None, None, None]


def test_blocks_of_known_graphs(spark):
    from arcwright.operators import blocks

    g = graphs_of(spark, {"tri": (4, [(0, 1), (1, 2), (2, 0), (2, 3)]), "k26": KNOWN["k26"], "star": KNOWN["star"], "twice": KNOWN["twice"]})
    sizes = {}
    for r in blocks.block_members(g).groupBy("graph_id", "block").count().collect():
        sizes.setdefault(r["graph_id"], []).append(r["count"])
    assert {k: sorted(v) for k, v in sizes.items()} == {"tri": [2, 3], "k26": [8], "star": [2] * 6, "twice": [2]}
    assert {(r["graph_id"], r["vid"]) for r in blocks.cutpoints(g).collect()} == {("tri", 2), ("star", 0)}
    assert {r["graph_id"] for r in blocks.bridges(g).collect()} == {"tri", "star"}


def test_wide_diameters_of_known_graphs(spark):
    from arcwright.operators import containers

    g = graphs_of(spark, {k: KNOWN[k] for k in ("k26", "cycle8", "k5", "star", "wheel")})
    got = {}
    for r in sorted(containers.wide_diameter(g).collect(), key=lambda r: r["k"]):
        got.setdefault(r["graph_id"], []).append(r["diameter"])
    assert got == {"k26": [2, 3, 2, 2, 2, 2], "cycle8": [4, 7], "k5": [1, 2, 3, 2], "star": [2], "wheel": [2, 2, 4]}


def test_rejected_graph_files(spark, tmp_path):
    from arcwright.sources import graph_text

    good = "GRAPH 2\ndirected TRUE\nweighted no\nmulti false extra\nvertices 2\na  1\t-2 tail\nb 3 +4\nedges 1\n0 1 2.5\n\n"
    swaps = {
        "far": ("0 1 2.5", "0 7 1"), "minus": ("0 1 2.5", "-1 0 1"), "nan": ("2.5", "NaN"), "zero": ("2.5", "0"), "endless": ("2.5", "Infinity"), "comma": ("2.5", "2,5"), "bare": ("0 1 2.5", "0 1"), "half": ("0 1 2.5", "0.5 1 1"),
        "foo": ("directed", "foo"), "bar": ("vertices 2", "bar 2"), "case": ("edges", "Edges"), "flag": ("weighted no", "weighted"), "nospot": ("b 3 +4", "b"), "onespot": ("b 3 +4", "b 3"), "part": ("b 3 +4", "b 3 4.5"),
        "wide": ("b 3 +4", "b 3 3000000000"), "more": ("edges 1", "edges 2"), "less": ("vertices 2", "vertices 1"), "none": ("0 1 2.5\n\n", "\n"), "order": ("directed TRUE\nweighted no", "weighted no\ndirected TRUE"),
    }
    for name, (old, new) in swaps.items():
        assert old in good
        (tmp_path / name).write_text(good.replace(old, new))
    (tmp_path / "good").write_text(good)
    (tmp_path / "dos").write_text(good.replace("\n", "\r\n"))
    (tmp_path / "mac").write_text(good.replace("\n", "\r") + "after the last edge")
    old = "3\nA\n B \nC\n0x1\n..1\n\n5,5\n -6 , 7\n\n"
    (tmp_path / "old").write_text(old)
    (tmp_path / "oldshort").write_text(old.replace("..1", ".."))
    (tmp_path / "oldspot").write_text(old.replace("5,5", "5;5"))
    texts = graph_text.read_texts(spark, str(tmp_path))
    graphs, vertices, edges, bad = graph_text.parse_graph_text(texts)
    assert {r["graph_id"] for r in bad.collect()} == set(swaps) and {tuple(r) for r in graphs.collect()} == {(k, True, False, False) for k in ("good", "dos", "mac")}
    assert sorted(map(tuple, edges.filter("graph_id = 'good'").collect())) == [("good", 0, 0, 1, 2.5)] and edges.count() == 3
    assert sorted(map(tuple, vertices.filter("graph_id = 'dos'").collect())) == [("dos", 0, "a", 1, -2), ("dos", 1, "b", 3, 4)]
    v, e = graph_text.parse_adjacency_text(texts)
    assert {(r["graph_id"], r["u"], r["v"]) for r in e.collect()} == {("old", 0, 2), ("old", 1, 2)}
    assert sorted(map(tuple, v.collect())) == [("old", 0, "A", 5, 5), ("old", 1, "B", -6, 7), ("old", 2, "C", 0, 0)]
    assert {r["graph_id"] for r in graph_text.rejected_adjacency(texts).collect()} == {"oldshort", "oldspot"}


def test_graph_files_keep_coordinates(spark, tmp_path):
    from arcwright.sources import graph_text

    flags = spark.createDataFrame([("g", True, True, True), ("none", False, False, False)], "graph_id string, directed boolean, weighted boolean, multi boolean")
    v = spark.createDataFrame([("g", "a  b", 7, -8), ("g", "c", 0, 9)], "graph_id string, name string, x int, y int")
    e = spark.createDataFrame([("g", "c", "a  b", 0.1), ("g", "c", "c", 1e9)], "graph_id string, src_name string, dst_name string, weight double")
    g = snapshot(flags, v, e, ["name"], ["weight"])
    graph_text.write_graph_text(g, str(tmp_path / "out"))
    graphs, vertices, edges, bad = graph_text.parse_graph_text(graph_text.read_texts(spark, str(tmp_path / "out")))
    assert bad.count() == 0 and {tuple(r) for r in graphs.collect()} == {("g", True, True, True), ("none", False, False, False)}
    assert sorted(map(tuple, vertices.collect())) == [("g", 0, "a_b", 7, -8), ("g", 1, "c", 0, 9)]
    assert sorted(map(tuple, edges.collect())) == [("g", 0, 1, 0, 0.1), ("g", 1, 1, 1, 1e9)]


def test_strong_components_of_long_ways_and_a_grid(spark):
    path = [(i, i + 1) for i in range(99)]
    ring = [(i, (i + 1) % 60) for i in range(60)] + [(5, 60), (60, 61), (61, 60)]
    # rows of a grid are rings; columns only lead down
    grid = [(10 * r + c, 10 * r + (c + 1) % 10) for r in range(6) for c in range(10)] + [(10 * r + c, 10 * r + 10 + c) for r in range(5) for c in range(10)]
    g = graphs_of(spark, {"path": (100, path), "ring": (63, ring), "grid": (60, grid)}, directed=True)
    got = {(r["graph_id"], r["vid"]): r["scc"] for r in connectivity.strong_components(g).collect()}
    want = {("path", i): i for i in range(100)} | {("ring", i): 0 for i in range(60)} | {("ring", 60): 60, ("ring", 61): 60, ("ring", 62): 62} | {("grid", i): i // 10 * 10 for i in range(60)}
    assert got == want


def test_files_with_untrusted_counts(spark):
    from arcwright.sources import graph_text

    good = "GRAPH 2\ndirected true\nweighted false\nmulti false\nvertices 2\na 1 2\nb 3 4\nedges 1\n0 1 1.5"
    files = {"good": good, "less": good.replace("vertices 2", "vertices -7"), "none": good.replace("edges 1", "edges -2"), "many": good.replace("vertices 2", "vertices 2147483647"), "word": good.replace("vertices 2", "vertices x"), "short": "GRAPH 2"}
    files |= {"adj": "2\na\nb\n01\n10", "minus": "-2\na\nb", "huge": "2000000000\na", "odd": "x\na", "bare": "0"}
    texts = spark.createDataFrame([(k, v.split("\n")) for k, v in files.items()], "graph_id string, lines array<string>")
    graphs, vertices, edges, bad = graph_text.parse_graph_text(texts)
    assert [r["graph_id"] for r in graphs.collect()] == ["good"] and vertices.count() == 2
    assert [(r["src"], r["dst"], r["weight"]) for r in edges.collect()] == [(0, 1, 1.5)]
    assert {r["graph_id"] for r in bad.collect()} == {"less", "none", "many", "word", "short"}
    v, e = graph_text.parse_adjacency_text(texts)
    assert v.count() == 2 and [(r["graph_id"], r["u"], r["v"]) for r in e.collect()] == [("adj", 0, 1)]
    assert {r["graph_id"] for r in graph_text.rejected_adjacency(texts).collect()} == {"minus", "huge", "odd"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_components_of_whole_tables(spark):
    for name, end in (("connected_components_all", "l_suppkey"), ("component_summary_all", "l_partkey")):
        up = {}

        def find(x, up=up):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        pairs = duckdb.sql(f"select 'c' || o_custkey, 'x' || {end} from '{SF}/lineitem.parquet' join '{SF}/orders.parquet' on l_orderkey = o_orderkey").fetchall()
        for a, b in pairs:
            up[find(a)] = find(b)
        size = {}
        for x in list(up):
            size[find(x)] = size.get(find(x), 0) + 1
        rows = graph_queries.QUERIES[name](spark, SF).collect()
        if name == "component_summary_all":
            assert sorted(r["n"] for r in rows) == sorted(size.values()) and sum(r["m"] for r in rows) == len(pairs)
        else:
            got = {}
            for r in rows:
                got[r["component"]] = got.get(r["component"], 0) + 1
            assert sorted(got.values()) == sorted(size.values())


def test_vertex_report_of_known_graphs(spark):
    g = graphs_of(spark, {"path": (3, [(0, 1), (1, 2)]), "apart": (3, [(0, 1)])})
    rows = {(r["graph_id"], r["vid"]): r for r in distance.vertex_report(g).collect()}
    mid, end, lone = rows["path", 1], rows["path", 0], rows["apart", 2]
    assert (mid["degree"], mid["neighbours"], mid["eccentricity"], mid["betweenness"], mid["closeness"]) == (2, 2, 1.0, 1.0, 1.0)
    assert (end["eccentricity"], end["reached"], end["component_root"]) == (2.0, 2, 0)
    assert (lone["degree"], lone["reached"], lone["eccentricity"], lone["component_root"], lone["degree_centrality"]) == (0, 0, None, 2, 0.0)
