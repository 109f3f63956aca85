"""Mixing sources to target weights by entropy balancing.

Among all ways to take the documents of source s at rates r_d between 0 and a cap, so that
the words taken are the source's target T_s, the one closest in relative entropy to taking
each document once is an exponential tilt,  r_d = min(cap, exp(lambda_s * x_d)),  with x_d
the document's words in units of the source's scale.  The lambdas minimise the convex dual,
whose gradient  sum_d size_d r_d - T_s  and curvature are grouped sums over the documents:
each Newton step is one distributed aggregation for all sources at once, kept inside a
bracket that every step narrows, until all gradients are as good as zero.  The rates are
then rounded to whole copies of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from arcwright.functions.durable import discard, settle

WORD = r"[^\x20\x09-\x0D]+"
ROUNDING_GROUP = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], cap: float, share: float = 1.0) -> DataFrame:
    """Targets of the rows (source, source_size): ``share`` of all tokens dealt out by weight.

    Sources stand in code-point order, null last; the weights repeat along them.  A
    target stops at ``cap`` times its source's size and the excess goes to the others
    by weight: the level of a water filling, found with running sums over the sources
    ordered by cap / weight.  One row per source goes through these windows.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    fill = Window.orderBy("room", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    rows = (
        sources.withColumn("weight", weight)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("most").over(fill), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.lit(float(share)) * F.col("all_size") - F.col("capped")) / (F.col("all_weight") - F.col("gone")))
    )
    level = F.min_by(F.when(F.col("level") <= F.col("room"), F.col("level")), F.when(F.col("level") <= F.col("room"), F.col("room"))).over(everything)
    # no row below its room: every source is at its cap
    return rows.withColumn("target", F.coalesce(F.least("most", F.col("weight") * level), F.col("most"))).select(
        "source", "source_size", "source_docs", "weight", "target"
    )


def balance(sizes: DataFrame, targets: DataFrame, cap: float, max_steps: int = 200) -> DataFrame:
    """lambda of each source: rows (source_t, scale, lam) for sources with words and a target above 0.

    ``sizes(source_t, size, docs)`` counts documents by size, which is all that the dual
    asks of them; ``targets(source_t, target)``.  A target at the cap of everything has
    lambda at the upper end of its bracket.
    """
    top = math.log(cap)
    live = sizes.filter("size > 0").join(targets.filter("target > 0"), F.expr("source_t <=> goal_source")).drop("goal_source")
    words, square = F.col("size") * F.col("docs"), F.col("size").cast("double") * F.col("size") * F.col("docs")
    start = live.groupBy("source_t").agg(F.sum(words).alias("s"), (F.sum(square) / F.sum(words)).alias("scale"), F.min("size").alias("least"), F.first("target").alias("target"))
    ratio, near = F.log(F.col("target") / F.col("s")), F.col("scale") / F.col("least")  # the shortest document's x is 1 / near
    low, high = F.least(F.lit(0.0), ratio * near), F.when(ratio > 0, top * near).otherwise(0.0)
    full = F.col("target") >= cap * F.col("s") * (1 - 1e-12)
    now = start.select("source_t", "scale", "target", low.alias("low"), high.alias("high"), F.when(full, high).otherwise(ratio).alias("lam"), full.alias("done"))
    now = settle(now, "dual")
    for _ in range(max_steps):
        named = now.withColumnRenamed("source_t", "of")
        x = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.lit(top), F.col("lam") * x))
        slope = F.when(F.col("lam") * x < top, rate * x).otherwise(0.0)
        sums = live.drop("target").join(named.filter("not done").select("of", "scale", "lam"), F.expr("source_t <=> of"))
        sums = sums.groupBy("source_t").agg(F.sum(words * rate).alias("f"), F.sum(words * slope).alias("h")).withColumnRenamed("source_t", "of_sum")
        told = now.join(sums, F.expr("source_t <=> of_sum"), "left")
        gap = F.col("f") - F.col("target")
        told = told.withColumn("low", F.when(gap <= 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(gap >= 0, F.col("lam")).otherwise(F.col("high")))
        newton = F.col("lam") - gap / F.col("h")
        inside = (F.col("h") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        good = (F.abs(gap) <= 1e-9 * F.col("target")) | (F.col("high") - F.col("low") <= 1e-12 * F.greatest(F.lit(1.0), F.abs("lam")))
        done = F.col("done") | F.coalesce(good, F.lit(True))
        lam = F.when(done, F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        left = Observation()
        after = settle(told.select("source_t", "scale", "target", "low", "high", lam.alias("lam"), done.alias("done")).observe(left, F.count_if(~F.col("done")).alias("n")), "dual")
        discard(now)
        now = after
        if not left.get.get("n"):
            return now.select("source_t", "scale", "lam")
    raise RuntimeError("the dual did not settle")


def _round_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole copies along each group, largest documents first.

    Each document gets floor or ceil of its rate, whichever keeps the words taken so far
    nearer to the words wanted so far, so a group ends within about its smallest document.
    """
    key, owed = None, 0.0
    for batch in batches:
        copies = np.zeros(len(batch), dtype=np.int64)
        groups, sizes, rates = batch["group"].to_numpy(), batch["size"].to_numpy(), batch["rate"].to_numpy()
        for i in range(len(batch)):
            if groups[i] != key:
                key, owed = groups[i], 0.0
            low, size = int(np.floor(rates[i])), float(sizes[i])
            part = rates[i] - low
            owed += part * size
            up = part > 0 and owed >= size / 2
            owed -= size if up else 0.0
            copies[i] = low + up
        yield batch.assign(copies=copies)


def _row_key() -> list[Column]:
    """128 bits that name a row's doc_id, text and source; a hash passes nulls over, so they are told apart."""
    parts = ["doc_id", "text", "source", F.concat(*[F.isnull(c).cast("string") for c in ("doc_id", "text", "source")])]
    return [F.xxhash64(*parts).alias("_mix_x"), F.xxhash64(F.lit(1), *parts).alias("_mix_y")]


def plan_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """How often each document is taken: one row per row of ``docs``.

    Takes the columns doc_id, text and source; others are ignored.  Returns doc_id,
    source, size, source_size, target, rate, copies, taken.

    A null text has size 0 and is taken as often as its rate says (0 words).  A null
    source is a source of its own, ordered last.  Repeated rows are mixed one by one.
    A corpus without words has target 0 everywhere and takes nothing; an empty table
    gives an empty result.  The rounding order hangs on size and a hash of doc_id
    (of the whole row where doc_id is null) alone, so reruns agree.
    """
    return _plan(docs, weights, cap).drop("_mix_x", "_mix_y")


def _plan(docs: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """The plan with the row keys."""
    sized = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *_row_key()), "sizes")
    # rows without a doc_id are spread by their content: they are no group of their own
    turn = F.when(F.col("doc_id").isNull(), F.col("_mix_x")).otherwise(F.xxhash64("doc_id"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    targets = settle(source_targets(sources, weights, cap), "targets")
    counted = settle(sized.groupBy(F.col("source").alias("source_t"), "size").agg(F.count("*").alias("docs")), "counted")
    tilts = balance(counted, targets.select(F.col("source").alias("goal_source"), "target"), float(cap)).withColumnRenamed("source_t", "source_l")
    t = targets.withColumnRenamed("source", "source_t").join(tilts, F.expr("source_t <=> source_l"), "left").drop("source_l")
    tilt = F.exp(F.least(F.lit(math.log(cap)), F.col("lam") * F.col("size") / F.col("scale")))
    rate = F.when(F.col("lam").isNull(), 0.0).when(F.col("size") == 0, 1.0).otherwise(tilt)
    near = F.abs(F.col("rate") - F.round("rate")) < 1e-9
    rows = (
        sized.join(t, F.expr("source <=> source_t"))
        .withColumn("rate", rate)
        .withColumn("rate", F.when(near, F.round("rate")).otherwise(F.col("rate")))
        # a source is cut into groups of about ROUNDING_GROUP documents, so a hot source is no hot key
        .withColumn("sub", F.pmod(turn, F.ceil(F.col("source_docs") / F.lit(ROUNDING_GROUP))))
        .withColumn("group", F.concat_ws(":", F.hex(F.coalesce("source", F.lit(""))), F.col("source").isNull().cast("string"), F.col("sub").cast("string")))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "group", turn.alias("turn"), "_mix_x", "_mix_y")
    )
    dealt = rows.repartition("group").sortWithinPartitions("group", F.desc("size"), "turn", "doc_id", "_mix_x")
    schema = "doc_id long, source string, size long, source_size long, target double, rate double, group string, turn long, _mix_x long, _mix_y long, copies long"
    return dealt.mapInPandas(_round_group, schema).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "_mix_x", "_mix_y"
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``docs`` with each row repeated as the plan says (and gone at 0 copies).

    Null doc_ids are rows like others.  Rows that repeat doc_id, text and source share the
    copies planned for them, so none is taken more than ``cap`` times.  All columns are kept.
    """
    key = ["_mix_x", "_mix_y"]
    plan = _plan(docs, weights, cap).groupBy(*key).agg(F.sum("copies").alias("_mix_copies"), F.count("*").alias("_mix_rows")).filter("_mix_copies > 0")
    # merge: the plan grows with the corpus, and the numbering needs the same deal
    joined = docs.select("*", *_row_key()).join(plan.hint("merge"), key)
    numbered = joined.withColumn("_mix_turn", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    copies = F.expr("cast(_mix_copies div _mix_rows as int) + int(_mix_turn <= _mix_copies % _mix_rows)")
    return numbered.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
