"""Exact top-k inner-product search: a ball tree in every shard.

Rows are dealt into shards of bounded size.  A shard's task builds a ball tree and
answers a block of queries by branch and bound: a node with centre c and radius r holds
no score above q.c + |q| r, nodes are visited in the order of that bound, and a node
below the query's current kth score is never opened.  The kth scores are shared: shards are
searched in three passes of a sixteenth, a quarter and the rest of them, and after each pass
every query's kth score so far is the floor that the next one starts from.

A task holds one shard and a pack of up to QUERY_BLOCK * BLOCKS_A_PACK queries, and builds the
shard's tree once for all of them, so a row is sent once for each 32,768 queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwright.functions.durable import settle

SHARD_ROWS = 1024
QUERY_BLOCK = 512
BLOCKS_A_PACK = 64
PASSES = ((0, 0), (1, 4), (5, 15))  # shard numbers modulo 16
LEAF = 32


def finite(v: Column) -> Column:
    """True for an array without null, NaN or infinite components."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, ok)


def build_balls(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[dict]]:
    """Row order and nodes (start, end, centre, radius, children) of a ball tree."""
    order, nodes = np.arange(len(x)), []

    def grow(a: int, b: int) -> int:
        rows = x[order[a:b]]
        centre = rows.mean(axis=0)
        dist = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        me = len(nodes)
        nodes.append({"a": a, "b": b, "c": centre, "r": float(dist.max()), "kids": ()})
        if b - a > leaf and nodes[me]["r"] > 0:
            far = rows[dist.argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            side = rows @ (far - other)
            order[a:b] = order[a:b][np.argsort(side, kind="stable")]
            mid = (a + b) // 2
            nodes[me]["kids"] = (grow(a, mid), grow(mid, b))
        return me

    grow(0, len(x))
    return order, nodes


def _scores(q: np.ndarray, x: np.ndarray, how: str) -> np.ndarray:
    if how == "double":  # every partial sum is an integer below 2**53, so this is exact
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if how == "long":
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def search_shard(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int, tree: tuple[np.ndarray, list[dict]] | None = None) -> list[tuple[int, int, int]]:
    """(query, vec, score) of the best k of this shard that may reach the shared kth score.

    ``kth`` is the score that each query already holds k times over, or None; ``tree`` is the
    shard's ball tree where it is built already.
    """
    most = int(np.abs(x).max(initial=0)), int(np.abs(q).max(initial=0))
    bound = max(1, most[0]) * max(1, most[1]) * max(1, x.shape[1])
    how = "double" if bound < 2**53 else "long" if bound < 2**63 else "object"
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    order, nodes = tree or build_balls(xf)
    norm = np.sqrt((qf**2).sum(axis=1))
    slack = 1e-9 * (1.0 + norm * np.sqrt((xf**2).sum(axis=1)).max(initial=0))
    floor = np.where(kth == None, -np.inf, kth).astype(np.float64)  # noqa: E711
    # descend: which leaves can each query still need under its shared kth score
    leaves, reach, todo = [], [], [(0, np.ones(len(q), dtype=bool))]
    while todo:
        at, live = todo.pop()
        node = nodes[at]
        upper = qf @ node["c"] + norm * node["r"] + slack
        live = live & (upper >= floor)
        if not live.any():
            continue
        if node["kids"]:
            todo += [(kid, live) for kid in node["kids"]]
        else:
            leaves.append(node)
            reach.append(np.where(live, upper, -np.inf))
    if not leaves:
        return []
    reach_m = np.array(reach).T
    visit = np.argsort(-reach_m, axis=1, kind="stable")
    best_s = np.full((len(q), k), np.iinfo(np.int64).min, dtype=np.int64)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max, dtype=np.int64)
    held = np.zeros(len(q), dtype=np.int64)
    rows = np.arange(len(q))
    for step in range(len(leaves)):
        leaf_of = visit[:, step]
        upper = reach_m[rows, leaf_of]
        now = np.maximum(floor, np.where(held >= k, best_s[:, -1].astype(np.float64), -np.inf))
        live = (upper > -np.inf) & (upper >= now)
        if not live.any():
            break
        for leaf in np.unique(leaf_of[live]):
            who = np.flatnonzero(live & (leaf_of == leaf))
            part = order[leaves[leaf]["a"] : leaves[leaf]["b"]]
            got = _scores(q[who], x[part], how)
            cand = np.broadcast_to(ids[part], got.shape)
            own = cand == qids[who][:, None]
            got = np.where(own, np.iinfo(np.int64).min, got)
            cand = np.where(own, np.iinfo(np.int64).max, cand)
            held[who] += (~own).sum(axis=1)
            s = np.concatenate([best_s[who], got], axis=1)
            i = np.concatenate([best_i[who], cand], axis=1)
            pick = np.lexsort((i, -np.maximum(s, -(2**63) + 1)), axis=1)[:, :k]
            best_s[who], best_i[who] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    real = (best_i != np.iinfo(np.int64).max) & (best_s.astype(np.float64) >= floor[:, None])
    return [(int(qids[a]), int(best_i[a, b]), int(best_s[a, b])) for a, b in zip(*np.nonzero(real), strict=True)]


def _searcher(k: int):
    def work(key, shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(shard) and len(block):
            x, ids = np.array(shard["v"].tolist(), dtype=np.int64).reshape(len(shard), -1), shard["vec_id"].to_numpy()
            tree = build_balls(x.astype(np.float64))
            for pack in block["pack"]:
                qids = np.array([p["query_id"] for p in pack], dtype=np.int64)
                q = np.array([p["v"] for p in pack], dtype=np.int64).reshape(len(pack), -1)
                kth = np.array([None if p["kth"] is None or p["kth"] != p["kth"] else int(p["kth"]) for p in pack], dtype=object)
                found += search_shard(ids, x, qids, q, kth, k, tree)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return work


def _search(base: DataFrame, queries: DataFrame, shards: int, turn: tuple[int, int], blocks: int, k: int) -> DataFrame:
    """Every query block against every shard of one pass; both sides of a task are of bounded size."""
    mine = F.pmod("shard", F.lit(16)).between(*turn)
    packs = queries.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "v", "kth")).alias("pack"))
    most = (blocks - 1) // BLOCKS_A_PACK
    left = base.filter(mine).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(most))))
    # shard numbers in two steps, so that no row holds a long array of them
    high = packs.withColumn("high", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // 1024))))
    every = high.withColumn("shard", F.explode(F.sequence(F.col("high") * 1024, F.least(F.col("high") * 1024 + 1023, F.lit(shards - 1)))))
    right = every.filter(mine).select("dim", "shard", F.floor(F.col("block") / BLOCKS_A_PACK).cast("int").alias("group"), "pack")
    keys = ["dim", "shard", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_searcher(k), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k rows of ``vectors(vec_id, v)`` with the largest inner product for each query.

    ``v`` is an array<long>; ``queries(query_id, v)`` likewise.  Rows whose id is the
    query's own never count, whether or not they are repeated; ties go to the smaller
    vec_id.  Null ids or vectors take no part, vectors meet only vectors of their own
    length, and empty inputs give no rows.  Scores are exact; a score beyond a long is
    clamped to it.  Other columns are ignored.
    Returns query_id, rank, vec_id, score.
    """
    base = vectors.select("vec_id", "v").filter("vec_id is not null and v is not null").withColumn("dim", F.size("v"))
    # places are drawn once and written, so rows that repeat an id are spread over the shards
    base = settle(base.withColumn("place", F.rand(6)), "vectors")
    ask = queries.select("query_id", "v").filter("query_id is not null and v is not null").withColumn("dim", F.size("v"))
    ask = settle(ask, "queries")
    shards = max(1, math.ceil(base.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(ask.count() / QUERY_BLOCK))
    base = base.withColumn("shard", F.floor(F.col("place") * shards).cast("int")).drop("place")
    ask = ask.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(blocks)).cast("int"))
    best: DataFrame | None = None
    for turn in PASSES:
        if turn[0] >= shards:
            break
        told = ask.withColumn("kth", F.lit(None).cast("double"))
        if best is not None:
            kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
            # a double may stand above a long of more than 53 bits, so such floors are left out
            told = ask.join(kth.withColumn("kth", F.when(F.abs("kth") < 2.0**52, F.col("kth"))), "query_id", "left")
        found = _search(base, told, shards, turn, blocks, k)
        best = settle(_best(found if best is None else best.union(found), k).drop("rank"), "best")
    return _best(best, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(finite(F.col("embedding")))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long")).alias("v"))
    asked = whole.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id")
    return exact_topk(whole, asked, k=10)


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024.0::double * x::double)) as v
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
  where q.vec_id % 100 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
