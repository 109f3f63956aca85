"""Embedding near-duplicates by lattice hashing.

Each table projects a unit vector onto a random orthonormal frame and decodes every
eight coordinates to the nearest point of the E8 lattice; the points name a cell.  A
vector lives in its own cell of each table and also knocks at the neighbouring cells that
its projection is nearest to.  Vectors that meet in a cell are compared by cosine in
double precision.  A pair is counted only in the first cell in which it meets, which a
task can tell from the two vectors alone, so links are counted without listing pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.functions.durable import discard, settle
from arcwright.functions.runs import starts_of, whole_runs
from arcwright.llm.topk import finite
from arcwright.operators.components import star_components

TABLES = 6
BLOCKS = 2  # E8 blocks a table, 8 coordinates each
PROBES = 4
CELL_SIDE = 0.35  # for 64 components; scaled by sqrt(64 / dimension)
BUCKET_BLOCK = 1024


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    for signs in itertools.product((0.5, -0.5), repeat=8):
        if sum(s < 0 for s in signs) % 2 == 0:
            out.append(np.array(signs))
    return np.array(out)


NEIGHBOURS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    off = (x - near)[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of D8 and D8 shifted by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class Lattice:
    """The tables' frames for vectors of one dimension, the same on every executor."""

    def __init__(self, dim: int, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES):
        rng = np.random.default_rng([dim, tables, blocks])
        self.tables, self.blocks, self.probes = tables, blocks, probes
        wide = 8 * blocks
        self.side = CELL_SIDE * np.sqrt(64 / max(dim, 1))
        self.frames = [np.linalg.qr(rng.normal(size=(max(dim, wide), wide)))[0][:dim] for _ in range(tables)]
        self.shifts = [rng.random(wide) for _ in range(tables)]
        self.mixer = rng.integers(1, 2**62, size=wide, dtype=np.int64) * 2 + 1

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """int64 [row, table, 1 + probes]: the home cell, then the probed ones."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), dtype=np.int64)
        moves = (2 * NEIGHBOURS).astype(np.int64)
        step = np.concatenate([moves @ self.mixer[8 * i : 8 * i + 8] for i in range(self.blocks)])
        for t in range(self.tables):
            y = unit @ self.frames[t] / self.side + self.shifts[t]
            home = np.concatenate([nearest_e8(y[:, 8 * i : 8 * i + 8]) for i in range(self.blocks)], axis=1)
            code = (2 * home).astype(np.int64) @ self.mixer
            gain = np.concatenate([(y - home)[:, 8 * i : 8 * i + 8] @ NEIGHBOURS.T for i in range(self.blocks)], axis=1)
            near = np.argsort(-gain, axis=1, kind="stable")[:, : self.probes]
            out[:, t, 0] = code
            out[:, t, 1:] = code[:, None] + step[near]
        return out


def _units(v: pd.Series) -> np.ndarray:
    x = np.array(v.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _hash_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lattices: dict[int, Lattice] = {}
    for batch in batches:
        for dim, part in batch.groupby("dim"):
            lat = lattices.setdefault(dim, Lattice(int(dim)))
            for a in range(0, len(part), 2048):
                some = part.iloc[a : a + 2048]
                cells = lat.cells(_units(some["v"]))
                n, t, w = cells.shape
                yield pd.DataFrame(
                    {
                        "dim": np.full(n * t * w, dim, dtype=np.int32),
                        "tab": np.tile(np.repeat(np.arange(t, dtype=np.int32), w), n),
                        "cell": cells.ravel(),
                        "home": np.tile(np.arange(w) == 0, n * t),
                        "rep": np.repeat(some["rep"].to_numpy(), t * w),
                    }
                )


def _first_meeting(lat: Lattice, x: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Of linked pairs (i, j) that meet in this cell: do they meet here first?"""
    rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    cells = lat.cells(x[rows])
    a, b = cells[back[: len(i)]], cells[back[len(i) :]]
    first = np.ones(len(i), dtype=bool)
    for t in range(table + 1):
        ha, hb = a[:, t, 0], b[:, t, 0]
        at_a, at_b = (b[:, t, :] == ha[:, None]).any(axis=1), (a[:, t, :] == hb[:, None]).any(axis=1)
        if t < table:
            first &= ~(at_a | at_b)
        else:  # both may knock at each other: the lesser home cell counts
            other = np.where(ha == cell, hb, ha)
            first &= ~(at_a & at_b & (ha != hb)) | (other > cell) | (ha == hb)
    return first


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row reachable over the links (i, j)."""
    lab = np.arange(n)
    while True:
        low = lab.copy()
        np.minimum.at(low, i, lab[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == lab).all():
            return lab
        lab = low


def _compare(threshold: float):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices: dict[int, Lattice] = {}
        keys = ["dim", "tab", "cell", "bi", "bj"]
        for frame in whole_runs(batches, keys):
            x = None
            out: list[pd.DataFrame] = []
            cuts = starts_of(frame, keys)
            dims, tabs, cells = (frame[k].to_numpy() for k in keys[:3])
            own, bi, bj = (frame[k].to_numpy() for k in ("blk", "bi", "bj"))
            home, rep, m = (frame[k].to_numpy() for k in ("home", "rep", "m"))
            for a, b in itertools.pairwise(cuts):
                if b - a < 2 or not home[a:b].any():
                    continue
                lat = lattices.setdefault(dims[a], Lattice(int(dims[a])))
                x = _units(frame["v"].iloc[a:b])
                left = np.flatnonzero(home[a:b])
                hit_i, hit_j = np.nonzero(x[left] @ x.T >= threshold)
                hit_i = left[hit_i]
                # home with home once, home with knocker once; of two blocks only pairs across
                keep = (hit_i != hit_j) & (~home[a:b][hit_j] | (hit_i < hit_j))
                if bi[a] != bj[a]:
                    keep &= own[a:b][hit_i] != own[a:b][hit_j]
                i, j = hit_i[keep], hit_j[keep]
                if not len(i):
                    continue
                first = _first_meeting(lat, x, i, j, int(tabs[a]), int(cells[a]))
                ids, mult = rep[a:b], m[a:b]
                links = np.bincount(i[first], mult[j[first]], b - a) + np.bincount(j[first], mult[i[first]], b - a)
                some = np.flatnonzero(links)
                lab = _labels(b - a, i, j)
                hang = np.flatnonzero(lab != np.arange(b - a))
                out.append(pd.DataFrame({"a": ids[some], "b": ids[some], "n": links[some].astype(np.int64)}))
                out.append(pd.DataFrame({"a": ids[hang], "b": ids[lab[hang]], "n": np.zeros(len(hang), dtype=np.int64)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return work


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Links of cosine >= ``threshold`` among the rows of ``vectors(vec_id, embedding)``.

    One row per row of ``vectors``: vec_id, n_links (other rows linked directly),
    component_id (least vec_id reachable) and kept (it is that least one).  Rows whose
    vector is null, empty, zero or holds null or non-finite components, and rows with a
    null vec_id, link with nothing; the latter get a null component.  Vectors meet only
    vectors of their own length.  Equal vectors are one class of which one member is
    compared; repeated rows count as rows.  Other columns are ignored.

    Recall: a pair just at the threshold meets in one table with a chance of at least
    2/3, so in six tables more than 99.8 % are found, and nearly all nearer pairs.
    """
    v = F.col("embedding")
    good = F.col("vec_id").isNotNull() & finite(v) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").withColumn("good", F.coalesce(good, F.lit(False)))
    usable = rows.filter("good").select("vec_id", "embedding")
    classes = settle(usable.groupBy(F.col("embedding").alias("v")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "classes")
    sized = classes.withColumn("dim", F.size("v"))
    met = settle(sized.select("dim", "rep", "v").mapInPandas(_hash_cells, "dim int, tab int, cell long, home boolean, rep long"), "cells")
    spot = ["dim", "tab", "cell"]
    busy = met.groupBy(*spot).agg(F.count("*").alias("all"), F.count_if("home").alias("homes")).filter("all > 1 and homes > 0")
    # a crowded cell is cut into blocks; every two blocks of it are one task's group
    side = F.pmod(F.xxhash64("rep"), F.col("parts"))
    placed = (
        met.join(busy.select(*spot, F.ceil(F.col("all") / BUCKET_BLOCK).alias("parts")), spot)
        .withColumn("blk", side)
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select(*spot, "rep", "home", "blk", F.least("blk", "with").alias("bi"), F.greatest("blk", "with").alias("bj"))
    )
    keys = [*spot, "bi", "bj"]
    full = placed.join(classes, "rep").repartition(*keys).sortWithinPartitions(*keys)
    found = settle(full.select(*keys, "blk", "home", "rep", "m", "v").mapInPandas(_compare(threshold), "a long, b long, n long"), "links")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    parts = star_components(found.filter("n = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "rep")
    told = classes.join(counts, "rep", "left").join(parts, "rep", "left")
    told = told.select(F.col("v").alias("embedding"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.join(told, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    discard(met)
    return out


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), u as (
  select vec_id, e, sqrt(list_inner_product(e, e)) as r from v
), link as (
  select a.vec_id as x, b.vec_id as y from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.r * b.r) >= 0.95
), reach as (
  select vec_id as x, vec_id as y from embeddings
  union
  select reach.x, link.y from reach join link on reach.y = link.x
), n as (select x, count(*) as n_links from link group by x)
select e.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select x, min(y) as component_id from reach group by x) c on c.x = e.vec_id
left join n on n.x = e.vec_id
"""
