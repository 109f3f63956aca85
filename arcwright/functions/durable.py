"""Tables that outlive a lost executor.

Iterative jobs cut their lineage by writing each round as Parquet below the
folder that the cluster names in ``spark.checkpoint.dir``, which the driver and
all executors share.  Only where that setting is unset and driver and tasks are one process
(tests, a laptop) is a folder of our own taken; on a cluster the setting is needed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads what was written."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`settle` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    base = work_folder(spark)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if base.removeprefix("file://").lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
