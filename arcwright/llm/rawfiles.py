"""Binary files through Spark's own writers, so that lost executors leave no half files.

Spark has a reader of whole binary files but only a text writer.  A string column may hold
any bytes, and the text writer puts them down as they are, followed by a separator.  So a
payload that ends in a zero byte is written without that byte, with a separator of one
zero byte: the file holds the payload exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_raw(rows: DataFrame, path: str, parts: list[str], payload: str = "payload") -> None:
    """One file for each row of ``rows``; every payload ends in a zero byte.

    Rows are told apart by the string columns ``parts``, which become folders.
    """
    body = F.col(payload)
    cut = F.substring(body, F.lit(1), F.length(body) - 1).cast("string")
    rows.select(*parts, cut.alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").partitionBy(*parts).text(path)


def read_raw(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """The files below ``path``: path and, if wanted, content; ``kind`` and ``shard`` from their folders."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.regexp_extract("path", "/kind=([^/]+)/", 1)
    shard = F.regexp_extract("path", "/shard=([^/]+)/", 1)
    return rows.select("path", kind.alias("kind"), shard.alias("shard"), *(["content"] if content else []))
