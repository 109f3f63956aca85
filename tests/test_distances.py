"""Distances against relaxation of all arcs in turn."""

import random
from math import inf

import pytest
from pyspark.sql import functions as F

from arcwright.operators import distance
from tests.test_graph_queries import graphs_of


def least_ways(n, arcs, s):
    dist = [inf] * n
    dist[s] = 0.0
    for _ in range(n):
        for u, v, w in arcs:
            dist[v] = min(dist[v], dist[u] + w)
    return dist


def found(g, named):
    rows = distance.weighted_distance(g, distance.all_sources(g)).collect()
    assert len(rows) == sum(n * n for n, _ in named.values())
    return {(r["graph_id"], r["s"], r["v"]): r["dist"] for r in rows}


def test_weighted_distances_of_many_weights(spark, monkeypatch):
    monkeypatch.setattr(distance, "KEPT_TABLES", 3)
    rng = random.Random(9)
    named = {}
    for k in range(6):
        n = rng.randrange(3, 10)
        heavy = lambda: rng.choice([0.0, 0.25, 1.0, 3.5, rng.random(), 20.0])
        named[f"g{k}"] = (n, [(rng.randrange(n), rng.randrange(n), heavy()) for _ in range(3 * n)])
    named["zero"] = (3, [(0, 1, 0.0), (1, 2, 0.0)])
    named["bare"] = (2, [])
    # each bucket's vertices are reached over many short arcs, and once over one long arc
    named["way"] = (9, [(i, i + 1, 0.125) for i in range(7)] + [(0, 8, 90.0), (7, 8, 90.0)])
    for directed in (True, False):  # undirected edges are arcs both ways
        got = found(graphs_of(spark, named, directed=directed, weighted=True), named)
        for k, (n, edges) in named.items():
            arcs = edges + ([] if directed else [(v, u, w) for u, v, w in edges])
            for s in range(n):
                for v, d in enumerate(least_ways(n, arcs, s)):
                    assert got[k, s, v] == pytest.approx(d), (k, s, v, directed)


def test_negative_weights_reopen_earlier_buckets_and_cycles_raise(spark):
    rng = random.Random(4)
    n = 7
    named = {"down": (n, [(u, v, rng.randrange(-4, 9) * 1.0) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.6])}
    got = found(graphs_of(spark, named, directed=True, weighted=True), named)
    for s in range(n):
        for v, d in enumerate(least_ways(n, named["down"][1], s)):
            assert got["down", s, v] == pytest.approx(d)
    g = graphs_of(spark, {"ring": (2, [(0, 1, -1.0), (1, 0, 0.5)])}, directed=True, weighted=True)
    with pytest.raises(RuntimeError, match="did not settle"):
        distance.reached_weights(g, distance.all_sources(g), max_rounds=6)


def test_hops_over_more_levels_than_are_kept_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(distance, "KEPT_TABLES", 3)
    n = 11
    named = {"way": (n, [(i, i + 1, 1) for i in range(n - 1)]), "ring": (n, [(i, (i + 1) % n, 1) for i in range(n)])}
    for directed in (True, False):
        g = graphs_of(spark, named, directed=directed)
        src = g.vertices.select("graph_id", F.col("vid").alias("s")).filter("s in (0, 7)")
        out = {(r["graph_id"], r["s"], r["v"]): r["hops"] for r in distance.hop_distance(g, src).collect()}
        under = {(r["graph_id"], r["s"], r["v"]): r["hops"] for r in distance.underlying_hop_distance(g, src).collect()}
        for s in (0, 7):
            for v in range(n):
                ring = (v - s) % n
                assert under["way", s, v] == abs(v - s)
                assert under["ring", s, v] == min(ring, n - ring)
                assert out["way", s, v] == ((v - s if v >= s else -1) if directed else abs(v - s))
                assert out["ring", s, v] == (ring if directed else min(ring, n - ring))
