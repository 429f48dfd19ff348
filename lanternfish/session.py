"""Session construction shared by tests, the bench and the entry module."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "lanternfish", cpus: str | None = None, partitions: int = 8) -> SparkSession:
    """A local session with the settings every query assumes (UTC, AQE on)."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return reachable(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local master gets a temporary one, which goes with the
    process; on a cluster, where executors would not share it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lanternfish-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    The driver may have found it by ``sys.path`` alone, which workers do not see.
    On a cluster the package has to be installed, or sent along, as usual.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def read(spark: SparkSession, sf_dir: str, table: str):
    """One table of a scale-factor folder, by a path only Spark has to open."""
    return reachable(spark).read.parquet(f"{sf_dir}/{table}.parquet")
