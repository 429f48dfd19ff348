"""Small JSON inputs: labels, keep files, pending queues, manifests, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<path:string,root:string,snapshot_path:string,kind:string,copied_via:string,size:bigint,sha256:string,schema_version:int>"
MANIFEST = f"manifest_version int, tool string, tool_version string, created_at string, kind string, provenance map<string,string>, files array<{ENTRY}>, schema_versions map<string,int>"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(path).select(F.col("value").alias("text"))


def labels(raw: DataFrame) -> DataFrame:
    """id, label, origin, purpose of a label file (text); what is no object is dropped, a missing label is made."""
    entries = raw.select(F.explode(F.from_json("text", "struct<sessions:map<string,string>>")["sessions"]).alias("id", "entry")).where(F.ltrim("entry").startswith("{"))
    got = lambda k: F.get_json_object("entry", f"$.{k}")
    made = F.when(got("origin").isNotNull() | got("purpose").isNotNull(), F.concat(F.coalesce(got("origin"), F.lit("?")), F.lit(":"), F.coalesce(got("purpose"), F.lit("unlabeled"))))
    text = lambda c: F.coalesce(c, F.lit(""))
    return entries.select("id", text(F.coalesce(F.nullif(got("label"), F.lit("")), made)).alias("label"), text(got("origin")).alias("origin"), text(got("purpose")).alias("purpose"))


def keep_ids(raw: DataFrame) -> DataFrame:
    """id, of a keep file; none if it is damaged."""
    return raw.select(F.explode(F.from_json("text", "struct<ids:array<string>,title_patterns:array<string>>")["ids"]).alias("id")).distinct()


def keep_patterns(raw: DataFrame) -> list[str]:
    """All title patterns of a keep file, which become one regular expression."""
    rows = raw.select(F.explode(F.from_json("text", "struct<title_patterns:array<string>>")["title_patterns"]).alias("p")).collect()
    return [r["p"] for r in rows]


def pending(raw: DataFrame) -> DataFrame:
    """id, first_seen, of a pending queue; none if it is damaged."""
    return raw.select(F.explode(F.from_json("text", "map<string,bigint>")).alias("id", "first_seen")).where("first_seen IS NOT NULL")


def manifests(spark: SparkSession, *paths: str) -> DataFrame:
    """One row a manifest, with the name of its folder; unsupported versions are marked."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(list(paths))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(name.alias("name"), "*", F.coalesce(F.col("manifest_version").isin(1, 2) & F.col("files").isNotNull(), F.lit(False)).alias("supported"))


def manifest_entries(rows: DataFrame) -> DataFrame:
    return rows.select("name", F.explode("files").alias("f")).select("name", "f.*").withColumn("root", F.coalesce("root", F.lit("data")))


def hook_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, hook_status, of the verdict files in a folder."""
    rows = spark.read.schema("publication_status string").option("multiLine", "true").json(folder)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("session_id"), F.col("publication_status").alias("hook_status"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row (text) of a whole file."""
    return _whole(spark, path)
