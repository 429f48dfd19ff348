"""Masking: planned edits and new texts, never a change in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect
from ..functions.jsontext import looks_json, redact_cell


def redact_texts(files: DataFrame) -> DataFrame:
    """file, new_text, edits of texts (file, text); unchanged texts keep theirs and have no edits."""
    made = files.select("file", detect.redact(F.col("text")).alias("r"))
    return made.select("file", F.col("r.text").alias("new_text"), F.col("r.edits").alias("edits"))


def redact_cells(cells: DataFrame) -> DataFrame:
    """file, location, new_value, edits of the cells that change.

    ``cells``: file, location, value, and semantic (true where the cell is the
    output of a sensitive read).  JSON is rewritten leaf by leaf by an Arrow UDF,
    everything else natively.
    """
    json_like = looks_json(F.col("value"))
    semantic = F.coalesce("semantic", F.lit(False))
    plain = cells.where(F.col("value").isNotNull() & (F.col("value") != "") & ~json_like).withColumn("whole", semantic & ~F.contains("value", F.lit(detect.TAG)))
    whole = F.struct(detect.tag(F.col("value")).alias("text"), F.array(F.struct(F.lit(detect.SEMANTIC).alias("category"), F.lit(None).cast("int").alias("line"), detect.fingerprint(F.col("value")).alias("fingerprint"))).alias("edits"))
    plain = plain.select("file", "location", F.when(F.col("whole"), whole).otherwise(detect.redact(F.col("value"))).alias("r"))
    nested = cells.where(json_like).select("file", "location", redact_cell(F.col("value"), semantic).alias("r"))
    both = plain.unionByName(nested).where(F.size("r.edits") > 0)
    return both.select("file", "location", F.col("r.text").alias("new_value"), F.col("r.edits").alias("edits"))


def edit_rows(planned: DataFrame, location: str = "text") -> DataFrame:
    """Planned edits one a row, in no order: a sort would make the plan twice, once for its ranges."""
    place = F.col("location") if "location" in planned.columns else F.lit(location)
    rows = planned.select("file", place.alias("location"), F.explode_outer("edits").alias("e")).where(F.col("e").isNotNull())
    return rows.select("file", "location", F.col("e.category").alias("category"), F.col("e.line").alias("line"), F.col("e.fingerprint").alias("fingerprint"))


def apply_cells(rows: DataFrame, planned: DataFrame, column: str) -> DataFrame:
    """A table's rows (with file and location) with the planned cells of one column replaced."""
    new = planned.select(F.col("file").alias("__f"), F.col("location").alias("__l"), "new_value")
    met = rows.join(new, (F.col("file") == F.col("__f")) & (F.col("location") == F.col("__l")), "left")
    return met.withColumn(column, F.coalesce("new_value", F.col(column))).select(*rows.columns)
