"""Row numbers over a distributed sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcwright.functions.durable import settle


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """0-based position of each row within its group, by ``order``; ``total`` numbers all rows.

    One range-partitioned sort; a group may span partitions, so one very large group is no
    single task.  Only a row per (partition, group) goes through the window of offsets.
    Rows that tie on ``group`` and ``order`` are numbered in any order.
    """
    keys = [*group, *order]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    mark = F.monotonically_increasing_id()
    fixed = settle(spread.withColumn("_mark", mark).withColumn("_part", F.shiftright("_mark", 33)), "numbered")
    firsts = fixed.groupBy("_part", *group).agg(F.min("_mark").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.orderBy("_part", "_first").rowsBetween(Window.unboundedPreceding, -1)
    bases = firsts.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    if total:
        parts = firsts.groupBy("_part").agg(F.sum("_rows").alias("_rows"), F.min("_first").alias("_first"))
        parts = parts.select("_part", F.coalesce(F.sum("_rows").over(overall), F.lit(0)).alias("_all"))
        bases = bases.join(parts, "_part")
    out = fixed.join(bases.drop("_rows"), ["_part", *group]).withColumn(name, F.col("_base") + F.col("_mark") - F.col("_first"))
    if total:
        out = out.withColumn(total, F.col("_all") + F.col("_mark").bitwiseAND((1 << 33) - 1))
    return out.select(*df.columns, name, *([total] if total else []))
