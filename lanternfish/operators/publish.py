"""Whether an export may be published: its own scan against the verdicts of the session hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import scan

SESSION_SUFFIXES = [".md", ".json"]
INDEX_NAMES = ["index.md", "index.json"]


def index_entries(index_json: DataFrame, index_md: DataFrame, files: DataFrame) -> DataFrame:
    """(file, title) listed by index.json, else by the links of index.md, else every session-shaped file.

    ``index_json`` and ``index_md``: text, of at most one row.  ``files``: file.
    """
    schema = "struct<sessions:array<struct<file:string,title:string>>>"
    listed = index_json.select(F.from_json("text", schema)["sessions"].alias("s")).where("s IS NOT NULL")
    by_json = listed.select(F.explode("s").alias("e")).select("e.file", "e.title").where("file IS NOT NULL")
    link = r"\[\[([^\]|]+?)(?:\|([^\]]*))?\]\]"
    pairs = index_md.select(F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(link), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(link), F.lit(2)).alias("t"))).alias("e"))
    shaped = F.lower(F.regexp_extract("e.n", r"(\.[^./]+)$", 1)).isin(*SESSION_SUFFIXES)
    by_md = pairs.select(F.when(shaped, F.col("e.n")).otherwise(F.concat("e.n", F.lit(".md"))).alias("file"), F.nullif(F.col("e.t"), F.lit("")).alias("title"))
    plain = files.where(F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1)).isin(*SESSION_SUFFIXES) & ~F.col("file").isin(*INDEX_NAMES)).select("file", F.lit(None).cast("string").alias("title"))
    ranked = [df.withColumn("source", F.lit(i)) for i, df in enumerate((by_json, by_md, plain))]
    first = listed.select(F.lit(0).alias("source")).unionByName(ranked[1].select("source")).unionByName(files.select(F.lit(2).alias("source"))).agg(F.min("source").alias("best"))
    every = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    return every.join(F.broadcast(first), F.col("source") == F.col("best")).select("file", "title")


def gate(entries: DataFrame, texts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A row an export: session_id, file, publication_status, findings, secrets, hook_status, warning.

    ``entries``: file, title; ``texts``: file, text (absent if the file is missing);
    ``verdicts``: session_id, hook_status.
    """
    name = F.substring_index("file", "/", -1)
    met = entries.join(texts.select("file", "text", F.lit(True).alias("there")), "file", "left").withColumn("session_id", scalars.export_session_id(name, F.col("text")))
    counts = scan.text_findings(texts).groupBy("file").agg(F.count(F.lit(1)).alias("findings"), F.count_if(scan.secrets(F.col("category"))).alias("secrets"))
    met = met.drop("text").join(counts, "file", "left").join(verdicts, "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = F.when(F.col("there").isNull(), "MISSING").otherwise(scan.status(F.coalesce("secrets", F.lit(0)), F.coalesce("findings", F.lit(0))))
    met = met.select("session_id", "file", "title", status.alias("publication_status"), zero("findings"), zero("secrets"), "hook_status")
    stale = (F.col("hook_status") == "BLOCKED") & (F.col("publication_status") == "CLEAN")
    return met.withColumn("warning", F.when(F.col("publication_status") == "MISSING", "listed but missing").when(stale, "blocked by the hook but scans clean"))


def overall(gated: DataFrame) -> DataFrame:
    """One row: sessions by status and the overall verdict, which any warning makes REVIEW at least.

    Missing exports count as clean in ``sessions_clean``; ``sessions_missing`` tells them apart.
    """
    n = lambda s: F.count_if(F.col("publication_status") == s)
    one = gated.agg(F.count(F.lit(1)).alias("sessions_total"), n("BLOCKED").alias("sessions_blocked"), n("REVIEW").alias("sessions_review"), n("MISSING").alias("sessions_missing"), F.count("warning").alias("warnings"))
    verdict = F.when(F.col("sessions_blocked") > 0, "BLOCKED").when((F.col("sessions_review") > 0) | (F.col("warnings") > 0) | (F.col("sessions_missing") > 0), "REVIEW").otherwise("CLEAN")
    return one.withColumn("sessions_clean", F.col("sessions_total") - F.col("sessions_blocked") - F.col("sessions_review")).withColumn("publication_status", verdict)


def ordered(gated: DataFrame) -> DataFrame:
    return gated.orderBy(F.coalesce("session_id", F.lit("None")), "file")
