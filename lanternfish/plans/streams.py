"""Queries that run as streams over the driver's tables, each table read once as it is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import sessions
from .seeds import SPLITS


def _folder(spark: SparkSession) -> str:
    """A folder of this run in the shared folder of the cluster, or a temporary one where none is named."""
    return f"{shared_dir(spark)}/lanternfish/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table's files as a stream; the pattern lets a single file stand for a folder."""
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table[:-1]}[{table[-1]}].parquet")


def activity_windows(spark, sf):
    """Events by user and hour.  Batches give the windows that changed, so old ones leave the state; the last count of each is the table's."""
    out = _folder(spark)
    made = sessions.activity_windows(_stream(spark, sf, "events").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "user_id"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{out}/rows")

    made.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("start timestamp, user_id bigint, events bigint, batch int").parquet(f"{out}/rows")
    return rows.groupBy("start", "user_id").agg(F.max_by("events", "batch").alias("events"))


WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, user_id, count(*) AS events FROM events GROUP BY 1, 2"


def split_values(spark, sf):
    """Values that lie across two turns of a conversation, by keyed state."""
    out = _folder(spark)
    rows = _stream(spark, sf, "conversations").selectExpr(*SPLITS)
    found = sessions.split_over(rows)
    q = found.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("session_id string, category string, fingerprint string").parquet(f"{out}/rows").where("category = 'api_key'").distinct()


SPLIT_SQL = """WITH n AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, 'api_key' AS category, substr(sha256('AK' || 'IA' || upper(substr(md5(CAST(conv_id AS VARCHAR)), 1, 16))), 1, 16) AS fingerprint
FROM n WHERE turn % 2 = 0 AND nxt IS NOT NULL"""

QUERIES = {"stream_activity_windows": activity_windows, "stream_split_values": split_values}
ORACLES = {"stream_activity_windows": WINDOWS, "stream_split_values": SPLIT_SQL}
