"""Snapshots of stores: manifests, verification, differences, rotation, restore plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

NAME = r"^\d{8}T\d{6}Z(-\d+)?$"
PRE_RESTORE = "pre-restore-"
VERSIONS = (1, 2)
MAX_AGE_S = 24 * 3600
REQUIRED = "state.vscdb"
# Stores known to hold credentials.
SENSITIVE = ["globalStorage/state.vscdb", "credentials.toml", "*.pem", "*.key"]
SQLITE_SUFFIXES = [".db", ".vscdb"]
CONFIG_DIRS = [".agent"]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def is_sqlite(path: Column) -> Column:
    return suffix(path).isin(*SQLITE_SUFFIXES)


def under(path: Column, directory: str) -> Column:
    return (path == directory) | path.startswith(directory.rstrip("/") + "/")


def discover(files: DataFrame, config_dirs: list[str] | None = None, excluded_dirs: list[str] | None = None) -> DataFrame:
    """Stores among files (root, path): databases by suffix, and everything in a config folder; no sidecars."""
    path = F.col("path")
    side = path.rlike(r"(-wal|-shm|-journal)$")
    out = reduce(lambda a, d: a | under(path, d), excluded_dirs or [], F.lit(False))
    in_config = F.split(path, "/")[0].isin(*(config_dirs or CONFIG_DIRS)) & F.contains(path, F.lit("/"))
    kind = F.when(is_sqlite(path), "sqlite").when(in_config, "file")
    return files.where(~side & ~out).withColumn("kind", kind).where("kind IS NOT NULL").dropDuplicates(["root", "path"])


def manifest_files(stores: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Manifest entries of stores (root, path, kind, content or size and sha256), with ``excluded``."""
    hit = scalars.excluded(F.col("path"), exclude or [])
    placed = F.when(F.col("root") == "config", F.concat(F.lit("config/"), "path")).otherwise(F.col("path"))
    return stores.select("root", "path", placed.alias("snapshot_path"), "kind", "size", "sha256", hit.alias("excluded"))


def entry_status(manifest: DataFrame, snapshot: DataFrame) -> DataFrame:
    """A row an entry: ok, invalid-path, missing, sha256-mismatch, size-mismatch or integrity-failed.

    ``snapshot``: path, size, sha256, integrity (null where it was not checked).
    """
    found = snapshot.select(F.col("path").alias("at"), F.col("size").alias("real_size"), F.col("sha256").alias("real_sha"), "integrity")
    safe = scalars.normal_path(F.coalesce("snapshot_path", "path"))
    met = manifest.withColumn("safe", safe).join(found, F.col("safe") == F.col("at"), "left")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    status = (
        F.when(F.col("safe").isNull(), "invalid-path").when(F.col("at").isNull(), "missing").when(~same("real_sha", "sha256"), "sha256-mismatch")
        .when(~same("real_size", "size"), "size-mismatch").when((F.col("kind") == "sqlite") & (F.coalesce("integrity", F.lit("ok")) != "ok"), "integrity-failed").otherwise("ok")
    )
    return met.select(scalars.display_path(F.col("path"), F.col("root")).alias("path"), status.alias("status"))


def verified(statuses: DataFrame) -> DataFrame:
    """(checked, failed, ok) of a snapshot."""
    return statuses.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") != "ok").alias("failed"), F.coalesce(F.bool_and(F.col("status") == "ok"), F.lit(True)).alias("ok"))


def covers(path: Column, required: str = REQUIRED) -> Column:
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    return (flat == required) | flat.endswith("/" + required) if required == REQUIRED else F.contains(path, F.lit(required))


def deletion_gate(headers: DataFrame, entries: DataFrame, snapshot: DataFrame, now: float, max_age_s: float = MAX_AGE_S, required: str = REQUIRED) -> DataFrame:
    """A row a snapshot: ok and the reason why not, by the looser test that deletions ask for.

    ``headers``: name, manifest_version, created_at.  Sizes and digests count
    only where the manifest has them; a date in the future is no reason.
    """
    found = snapshot.select("name", F.col("path").alias("at"), F.col("size").alias("real_size"), F.col("sha256").alias("real_sha"))
    met = entries.join(found, (entries["name"] == found["name"]) & (F.coalesce(entries["snapshot_path"], entries["path"]) == F.col("at")), "left").drop(found["name"])
    fine = F.col("at").isNotNull() & F.coalesce(F.col("size") == F.col("real_size"), F.lit(True)) & F.coalesce(F.col("sha256") == F.col("real_sha"), F.lit(True))
    per = met.groupBy("name").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~fine).alias("failed"), F.coalesce(F.bool_or(covers(F.col("path"), required)), F.lit(False)).alias("covered"))
    all_ = headers.join(per, "name", "left").withColumn("age", F.lit(float(now)) - scalars.created_at(F.col("created_at")))
    reason = (
        F.when(~F.coalesce(F.col("manifest_version").isin(*VERSIONS), F.lit(False)), "unsupported manifest version").when(F.col("age").isNull(), "no usable created_at")
        .when(F.col("age") > max_age_s, "too old").when(~F.coalesce("covered", F.lit(False)), "not covered").when(F.col("failed") > 0, "files failed")
    )
    return all_.select("name", reason.isNull().alias("ok"), reason.alias("reason"), F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("failed", F.lit(0)).alias("failed"))


def compare(manifest: DataFrame, snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """Manifest entries against live stores: same, different, snapshot-only, live-only or snapshot-missing.

    All by (root, path).  ``snapshot`` and ``live`` have size, sha256 and, for
    databases, content (a digest of their rows), which then decides.
    """
    s = snapshot.select("root", "path", F.col("content").alias("snap_content"), F.lit(True).alias("in_snapshot"))
    at = live.select("root", "path", F.col("size").alias("live_size"), F.col("sha256").alias("live_sha256"), F.col("content").alias("live_content"), F.lit(True).alias("in_live"))
    m = manifest.select("root", "path", "kind", "size", "sha256", F.lit(True).alias("listed")).join(s, ["root", "path"], "left")
    met = m.join(at, ["root", "path"], "full_outer")
    content = F.when((F.col("kind") == "sqlite") & F.col("snap_content").isNotNull() & F.col("live_content").isNotNull(), F.col("snap_content") == F.col("live_content"))
    equal = F.coalesce(content, F.col("live_sha256").eqNullSafe(F.col("sha256")))
    status = F.when(F.col("listed").isNull(), "live-only").when(F.col("in_snapshot").isNull(), "snapshot-missing").when(F.col("in_live").isNull(), "snapshot-only").when(equal, "same").otherwise("different")
    met = met.withColumn("status", status)
    both = F.col("status").isin("same", "different")
    return met.select(scalars.display_path(F.col("path"), F.col("root")).alias("path"), "status", F.when(both, F.col("live_size") - F.col("size")).alias("size_delta"), F.when(both, F.col("live_sha256").eqNullSafe(F.col("sha256"))).alias("bytes_equal"))


def compare_counts(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """Tables (tab, n) of two databases whose row counts differ, or that only one of them has."""
    met = snapshot.select("tab", F.col("n").alias("snapshot_n")).join(live.select("tab", F.col("n").alias("live_n")), "tab", "full_outer")
    return met.where(~F.col("snapshot_n").eqNullSafe(F.col("live_n")))


def drift(compared: DataFrame) -> DataFrame:
    """(status, files) and whether nothing has drifted."""
    w = Window.partitionBy(F.lit(1))
    counts = compared.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
    return counts.withColumn("identical", F.min(F.col("status") == "same").over(w))


def content_digest(rows: DataFrame, *by: str) -> DataFrame:
    """An order-free digest of rows: count, and sum and XOR of row hashes; partial aggregation, no sort."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in rows.columns if c not in by]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 15), 16, 10).cast("bigint")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor")]
    return rows.groupBy(*by).agg(*sums)


def snapshot_kind(name: Column, kind: Column) -> Column:
    return F.when(name.startswith(PRE_RESTORE) | F.coalesce(kind == "pre-restore", F.lit(False)), "pre-restore").when(name.rlike(NAME), "snapshot").otherwise("unknown")


def listing(manifests: DataFrame) -> DataFrame:
    """Snapshots (name, kind, created_at, sizes array), newest name first."""
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return manifests.select("name", snapshot_kind(F.col("name"), F.col("kind")).alias("kind"), "created_at", F.size("sizes").cast("bigint").alias("files"), total.alias("size")).orderBy(F.desc("name"))


def rotation(listed: DataFrame, keep: int) -> DataFrame:
    """Snapshots beyond the ``keep`` newest by name; other kinds never go."""
    snapshots = listed.where("kind = 'snapshot'")
    kept = snapshots.orderBy(F.desc("name")).limit(keep).select(F.col("name").alias("kept"))
    return snapshots.join(F.broadcast(kept), F.col("name") == F.col("kept"), "left_anti").select("name")


def restore_plan(manifest: DataFrame, existing: DataFrame, current: DataFrame) -> DataFrame:
    """A row an entry: where it goes, whether something is overwritten, and a warning if schema versions differ.

    An entry that climbs out of its root is ``refused``.  ``current``: path, schema_version.
    """
    there = existing.select(F.col("root").alias("r"), F.col("path").alias("p"), F.lit(True).alias("there"))
    now = current.select(F.col("path").alias("cp"), F.col("schema_version").alias("live_version"))
    safe = scalars.normal_path(F.col("path"))
    met = manifest.withColumn("safe", safe).join(there, (F.col("root") == F.col("r")) & (F.col("safe") == F.col("p")), "left").join(now, F.col("path") == F.col("cp"), "left")
    bad = F.col("safe").isNull() | (F.coalesce("safe", F.lit("")) == "") | ~F.col("root").isin("data", "config")
    action = F.when(bad, "refused").when(F.col("there"), "would_overwrite").otherwise("would_write")
    warn = F.when(F.col("schema_version").isNotNull() & F.col("live_version").isNotNull() & (F.col("schema_version") != F.col("live_version")), "schema version differs")
    return met.select(scalars.display_path(F.col("path"), F.col("root")).alias("path"), action.alias("action"), warn.alias("warning"))
