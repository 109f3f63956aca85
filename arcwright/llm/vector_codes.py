"""Vector code compression: product quantisation in exact integers.

Vectors are cut into equal parts, and each part position has a codebook.  A round builds a
kd-tree over every codebook and broadcasts them; tasks search them for their vectors by
branch and bound and return integer sums for each entry, which Spark adds up.  A box is
entered when its least possible distance equals the best so far, too, so of equally near
entries that of the lower index is always found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.functions.durable import settle
from arcwright.llm.topk import finite

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LEAF = 8
SEARCH_ROWS = 4096
#: Above this an integer component could carry a squared distance beyond 64 bits.
LARGEST = 1 << 26
#: A label that holds more than this share of the rows is joined apart; so there are fewer of them than its inverse.
HOT_SHARE = 1 / 256


class KdTree:
    """The entries of one codebook, split at medians of the widest side, with a box a node."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray) -> tuple:
        e = self.entries[own]
        low, high = (e.min(axis=0), e.max(axis=0)) if len(own) else (np.zeros(e.shape[1], dtype=np.int64),) * 2
        if len(own) <= LEAF or not e.shape[1]:
            return low, high, np.sort(own), None, None
        order = own[np.argsort(e[:, int((high - low).argmax())], kind="stable")]
        half = len(order) // 2
        return low, high, None, self._node(order[:half]), self._node(order[half:])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry for each row of ``x``; ties to the lower index."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.full(len(x), len(self.entries), dtype=np.int64)
        self._visit(self.root, x, np.arange(len(x)), best, index)
        return index, best

    def _visit(self, node: tuple, x: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        own, left, right = node[2:]
        if own is not None:
            d = ((x[rows][:, None, :] - self.entries[own][None, :, :]) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            d, at = d[np.arange(len(rows)), at], own[at]
            better = (d < best[rows]) | ((d == best[rows]) & (at < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], at[better]
            return
        to_left, to_right = _box_distance(left, x[rows]), _box_distance(right, x[rows])
        first = to_left <= to_right
        # the nearer child of every row first, then the other one where it may hold an entry as near
        for child, some, bound in ((left, first, None), (right, ~first, None), (right, first, to_right), (left, ~first, to_left)):
            if bound is not None:
                some = some & (bound <= best[rows])
            if some.any():
                self._visit(child, x, rows[some], best, index)


def _box_distance(node: tuple, x: np.ndarray) -> np.ndarray:
    out = np.maximum(np.maximum(node[0] - x, x - node[1]), 0)
    return (out * out).sum(axis=1)


def _vectors(batch: pa.RecordBatch, trees: Sequence[KdTree]) -> np.ndarray:
    """[row, part, position] of a batch whose column ``q`` holds lists of one length."""
    q = batch.column("q")
    return q.flatten().to_numpy(zero_copy_only=False).reshape(len(q), len(trees), trees[0].entries.shape[1])


def _assigned(batches: Iterator[pa.RecordBatch], trees: Sequence[KdTree]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, SEARCH_ROWS):
            part = batch.slice(a, SEARCH_ROWS)
            x = _vectors(part, trees)
            found = [t.nearest(x[:, k]) for k, t in enumerate(trees)]
            yield part, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(trees):
    """One row for each part, entry and position that a task's vectors fall on; position -1 counts them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x, index, _ in _assigned(batches, trees.value):
            if total is None:
                entries = len(trees.value[0].entries)
                total, count = np.zeros((len(trees.value), entries, x.shape[2]), dtype=np.int64), np.zeros((len(trees.value), entries), dtype=np.int64)
            for k in range(len(trees.value)):
                np.add.at(total[k], index[:, k], x[:, k])
                count[k] += np.bincount(index[:, k], minlength=count.shape[1])
        if total is None:
            return
        part, entry = np.nonzero(count)
        wide = total.shape[2]
        spots, values = np.tile(np.arange(-1, wide), len(part)), np.column_stack([count[part, entry], total[part, entry]]).ravel()
        names = [np.repeat(v, wide + 1) for v in (part, entry)]
        yield pa.record_batch([pa.array(v.astype(np.int64)) for v in (*names, spots, values)], names=["part", "entry", "spot", "total"])

    return work


def _codes(trees):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, index, error in _assigned(batches, trees.value):
            code = [bytes(row).hex() for row in index.astype(np.uint8)]
            yield pa.record_batch([part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return work


def _updated(books: np.ndarray, sums: list) -> np.ndarray:
    """Entries replaced by floor(sum / count), exactly; entries without vectors stay."""
    got = {(r["part"], r["entry"], r["spot"]): int(r["total"]) for r in sums}
    out = books.copy()
    for (part, entry, spot), total in got.items():
        if spot >= 0:
            out[part, entry, spot] = total // got[part, entry, -1]
    return out


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def quantised(embedding: Column, scale: int = SCALE) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [part, entry, position] of ``rows(vec_id, label, q)`` after the rounds.

    They start as the parts of the ``entries`` least vec_ids (nulls last, repeats by vector).
    The driver holds the codebooks and one row for each of their components, no more.
    """
    spark = rows.sparkSession
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()
    books = np.array([r["q"] for r in seeds], dtype=np.int64)
    books = books.reshape(len(seeds), parts, books.shape[1] // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
        each = rows.select("vec_id", "label", "q").mapInArrow(_sums(trees), "part long, entry long, spot long, total long")
        added = each.groupBy("part", "entry", "spot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        books = _updated(books, added)
        trees.unpersist()
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Codes of ``vectors(vec_id, embedding, label)``: vec_id, label, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped; of a table
    without other rows nothing comes back.  Null ids are kept and never lead a codebook unless
    too few others exist; repeated rows count as rows.  All vectors must have one length,
    a multiple of ``parts``, and components of less than 2^26 / ``scale``: the call raises
    otherwise.  Other columns are ignored.  ``error`` is the squared distance to the entries,
    summed over parts; ``label_error`` its sum over equal labels, nulls together.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte, so a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", "label", "embedding").filter(F.coalesce(finite(F.col("embedding")), F.lit(False)))
    shape = kept.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    schema = "vec_id long, label {}, code string, error long, label_error decimal(38,0), codebooks_sha256 string".format(vectors.schema["label"].dataType.simpleString())
    if shape["low"] is None:
        return spark.createDataFrame([], schema)
    if shape["low"] != shape["high"] or shape["low"] % parts:
        raise ValueError(f"vectors of {shape['low']} to {shape['high']} components: one length is needed, a multiple of {parts}")
    if (shape["most"] or 0) * scale >= LARGEST:
        raise ValueError(f"components of {shape['most']} are too large for exact 64-bit distances")
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", quantised(F.col("embedding"), scale).alias("q"))
    books = fit_codebooks(rows, parts, entries, rounds)
    trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
    coded = settle(rows.mapInArrow(_codes(trees), ", ".join(schema.split(", ")[:4])), "codes")
    trees.unpersist()
    sums = settle(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"), F.count("*").alias("_rows")), "labels")
    total = sums.agg(F.sum("_rows")).first()[0]
    big = F.col("_rows") > total * HOT_SHARE
    names = [F.col("label").alias("_label"), "label_error"]
    hot, cold = F.broadcast(sums.filter(big).select(*names)), sums.filter(~big).select(*names)
    same = F.col("label").eqNullSafe(F.col("_label"))
    told = coded.join(hot, same).union(coded.join(hot.select("_label"), same, "left_anti").join(cold, same)).drop("_label")
    return told.withColumn("codebooks_sha256", F.lit(books_digest(books)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return done.select("vec_id", "code", "error", F.col("label_error").cast("long").alias("label_error"), "codebooks_sha256")


_ROUND = """
d{r} as (
  select x.id, x.part, b.entry, sum((x.q - b.q) * (x.q - b.q)) as dist
  from x join b{r} b on b.part = x.part and b.spot = x.spot group by x.id, x.part, b.entry
),
a{r} as (
  select id, part, entry, dist from (select *, row_number() over (partition by id, part order by dist, entry) as r from d{r}) z where r = 1
),
"""
_UPDATE = """
s{r} as (
  select x.part, a.entry, x.spot, sum(x.q)::hugeint as total, count(*)::hugeint as c
  from x join a{r} a on a.id = x.id and a.part = x.part group by x.part, a.entry, x.spot
),
b{n} as (
  select b.part, b.entry, b.spot, case when s.c is null then b.q else (s.total - (((s.total % s.c) + s.c) % s.c)) // s.c end as q
  from b{r} b left join s{r} s on s.part = b.part and s.entry = b.entry and s.spot = b.spot
),
"""
OP12_SQL = f"""
with kept as (
  select row_number() over (order by vec_id nulls last, embedding) as id, vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0
),
x as (
  select id, ((i - 1) // (len(embedding) // 16))::bigint as part, ((i - 1) % (len(embedding) // 16))::bigint as spot, floor(256 * embedding[i]::double)::bigint as q
  from (select id, embedding, unnest(range(1, len(embedding) + 1)) as i from kept) y
),
b0 as (select part, id - 1 as entry, spot, q::hugeint as q from x where id <= 64),
{_ROUND.format(r=0)}{_UPDATE.format(r=0, n=1)}{_ROUND.format(r=1)}{_UPDATE.format(r=1, n=2)}{_ROUND.format(r=2)}
told as (
  select k.vec_id, k.label, string_agg(lower(printf('%02x', a.entry::integer)), '' order by a.part) as code, sum(a.dist)::bigint as error
  from kept k join a2 a on a.id = k.id group by k.id, k.vec_id, k.label
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(cast(q as varchar), ',' order by part, entry, spot)) from b2) as codebooks_sha256
from told
"""
