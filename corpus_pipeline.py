"""The corpus pipeline: stages that each take documents and return documents.

Toxic documents go, repeated chunks of lines are taken out of the texts, one document of
each near-duplicate group stays, sources are mixed to target weights, and what is left is
encoded by byte-level BPE.  Each stage works on all that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwright.functions.durable import settle
from arcwright.llm import bpe, jaccard, lines, mixing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go; the others stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of multi-line chunks go from the texts; n_chars follows the text."""
    done = lines.dedup_lines(docs)
    return done.withColumn("n_chars", F.when(F.col("_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays, once.

    Rows are told apart by doc_id and text, so a text goes only for its own near copies.  Of
    near copies that share the least doc_id one stays, and equal rows of a doc_id count once.
    Texts without words have no near copies, and rows with a null doc_id stand in no group: all
    of them stay.  Other columns are kept as they are, and an empty table stays empty.
    """
    near = jaccard.near_documents(docs).filter("doc_id is not null and n_shingles > 0")
    near = settle(near.select("doc_id", "text_key", "component_id", "kept"), "near")
    stays = near.filter("kept").groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    own = "_"  # no column of the table starts like those that are added
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    gone = near.join(stays, ["doc_id", "text_key"], "left_anti").select(F.col("doc_id").alias(f"{own}id"), F.col("text_key").alias(f"{own}gone")).distinct()
    keyed = docs.withColumn(f"{own}key", F.unhex(F.md5(F.col("text").cast("binary"))))
    named = keyed.filter("doc_id is not null").join(gone, (F.col("doc_id") == F.col(f"{own}id")) & (F.col(f"{own}key") == F.col(f"{own}gone")), "left_anti")
    same = Window.partitionBy("doc_id", f"{own}key").orderBy("doc_id")
    left = named.withColumn(f"{own}turn", F.row_number().over(same)).filter(f"{own}turn = 1").select(*docs.columns)
    return left.union(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the entropy-balanced mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, a row for each document taken."""
    return bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The trained field and the rounding of copies have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, "stage")
    return docs
