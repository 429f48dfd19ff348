"""Files as rows: walking, telling kinds apart, reading text.

Files are listed first, by path alone; contents are read once, last, and never
sorted or shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are not walked, suffixes and magic of databases.
SKIP_DIRS = [".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv"]
DB_SUFFIXES = [".db", ".sqlite", ".sqlite3"]
MAGIC = "53514C69746520666F726D6174203300"
SNIFF_BYTES = 8192


FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _roots(paths: tuple[str, ...]) -> list[str]:
    """The paths without those that lie under another one of them."""
    own = {p.rstrip("/") or "/" for p in paths}
    return sorted(p for p in own if not any(p != q and p.startswith(q.rstrip("/") + "/") for q in own))


def _listed(root: str) -> Iterator[Path]:
    """All files of a local path, without the folders that are skipped below it."""
    if os.path.isfile(root):
        yield Path(root)
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIP_DIRS)
        yield from (Path(folder) / n for n in sorted(names))


def _unseen(file: Path, root: str) -> bool:
    """Whether Spark's file sources leave a file out: an empty one, or one with a hidden name on its way."""
    way = file.relative_to(root).parts if file != Path(root) else (file.name,)
    return any(n.startswith((".", "_")) for n in way) or file.stat().st_size == 0


def _read(file: Path) -> tuple:
    """A file that cannot be read has no content; size and time have defaults where they are not known."""
    try:
        stat = file.stat()
        when, size = datetime.fromtimestamp(stat.st_mtime, UTC), stat.st_size
    except OSError:
        when, size = None, 0
    try:
        return f"file:{file}", when, size, file.read_bytes()
    except OSError:
        return f"file:{file}", when, size, None


def walk(spark: SparkSession, *paths: str) -> DataFrame:
    """path, modificationTime, length, content of all files under the paths, each once.

    Folders in SKIP_DIRS are not walked below a path that was given; one that was
    given itself is.  Spark's file sources leave out empty files and names that
    start with a dot or an underscore; on local paths those are listed and read
    by the driver beside them.  On other stores they are not seen.
    """
    roots = _roots(paths)
    local = {r: r.removeprefix("file://").removeprefix("file:") for r in roots if "://" not in r or r.startswith("file:")}
    local = {r: os.path.abspath(p) for r, p in local.items()}
    unseen = [_read(f) for p in local.values() for f in _listed(p) if _unseen(f, p)]
    rows = None
    for root in roots:
        base = local.get(root, root)
        if root in local and all(_unseen(f, base) for f in _listed(base)):
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        below = F.split(F.substr(F.regexp_replace("path", "^file:/+", "/"), F.lit(len(base) + 1)), "/") if root in local else F.split(F.replace("path", F.lit(base), F.lit("")), "/")
        part = found.where(~F.arrays_overlap(F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0))), F.array(*[F.lit(d) for d in SKIP_DIRS])))
        rows = part if rows is None else rows.unionByName(part)
    beside = spark.createDataFrame(unseen, FILE)
    return beside if rows is None else rows.unionByName(beside) if unseen else rows


def target_type(path: Column, content: Column) -> Column:
    """``sqlite`` by suffix or magic, ``binary`` for a NUL near the start, else ``text``."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    head = F.substring(content, 1, SNIFF_BYTES)
    magic = F.hex(F.substring(content, 1, 16)) == MAGIC
    nul = F.position(F.lit("\0"), F.decode(head, "ISO-8859-1")) > 0
    return F.when(suffix.isin(*DB_SUFFIXES) | magic, "sqlite").when(content.isNull() | nul, "binary").otherwise("text")


def targets(files: DataFrame) -> DataFrame:
    """file, type, content."""
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), target_type(F.col("path"), F.col("content")).alias("type"), "content")


def texts(found: DataFrame) -> DataFrame:
    """(file, text) of text targets; invalid bytes become replacement characters."""
    return found.where("type = 'text'").select("file", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def strict_texts(found: DataFrame) -> DataFrame:
    """(file, text, error): invalid UTF-8 is an error and has no text."""
    raw = F.col("content").cast("string")
    good = F.is_valid_utf8(raw)
    rows = found.where("type <> 'sqlite'")
    binary = F.col("type") == "binary"
    return rows.select("file", F.when(good & ~binary, raw).alias("text"), F.when(binary, "skipped: binary file").when(~good, "not valid UTF-8").alias("error"))
