"""Connected components by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arcwright.functions.durable import discard, settle


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Hang every larger neighbour of u on the least vertex around u."""
    both = _both_ways(pairs)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Hang u and its smaller neighbours on the least of them."""
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def star_components(pairs: DataFrame, max_rounds: int = 120) -> DataFrame:
    """Component of every vertex that occurs in ``pairs(u, v)``: rows (id, component).

    ``component`` is the least id in the component.  Loops and nulls are ignored; an
    empty input gives no rows.  A contraction is two aggregations with map-side combine
    and two joins, whose hub keys AQE may split; after each the edge list is written to the
    shared folder, so plans stay small, and its check sum is observed while it is written.
    """
    sums = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    first = Observation()
    now = settle(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().observe(first, *sums), "stars")
    before = first.get
    for _ in range(max_rounds):
        shape = Observation()
        edges = _small_star(_large_star(now)).filter("u <> v").distinct()
        after = settle(edges.observe(shape, *sums), "stars")
        discard(now)
        now = after
        if shape.get == before:
            break
        before = shape.get
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
