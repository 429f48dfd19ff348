"""Where long lineages are cut: tables in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import reachable, shared_dir

BATCH_BYTES = 4 << 20


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, for helper columns beside all of its own."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of text that Python workers get at once (rows alone do not), and let them import this package.

    A session setting, as Spark reads it when a plan runs; a smaller one stays.
    """
    reachable(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{_own_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lanternfish/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A lost executor costs its running tasks only, as nothing before the table
    is computed again.
    """
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written here; results that still read them are lost.

    Results are plans over such tables, so only who has used them up can tell when.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
