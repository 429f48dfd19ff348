"""SQLite stores as a Spark data source, read-only.

``spark.read.format("sqlite_store").option("path", file).option("table", name)``
reads one table with its rowid; ``table`` left out gives the catalogue of tables.
Equality filters go down to SQLite, and a table is split into ranges of rowids.
With ``cells`` it gives the text values of a table one a row, whatever the type of
the column they are in; a table WITHOUT ROWID is read in one piece, by its key.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

RANGE_ROWS = 200_000
CELL = StructType([StructField("rowid", LongType()), StructField("key", StringType()), StructField("col", StringType()), StructField("session_id", StringType()), StructField("value", StringType())])


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str):
    d = (declared or "").upper()
    if "INT" in d:
        return LongType()
    if "BLOB" in d:
        return BinaryType()
    return DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB")) else StringType()


def has_rowid(con: sqlite3.Connection, table: str) -> bool:
    """Whether a table can be read by rowid; one that cannot be read at all is an error."""
    try:
        con.execute(f"SELECT rowid FROM {quoted(table)} LIMIT 1")
        return True
    except sqlite3.OperationalError:
        con.execute(f"SELECT * FROM {quoted(table)} LIMIT 1")
        return False


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(None)
        self.first, self.last = first, last


class StoreReader(DataSourceReader):
    def __init__(self, path: str, table: str | None, schema: StructType, cells: bool = False):
        self.path, self.table, self.names, self.equal, self.cells = path, table, [f.name for f in schema.fields], {}, cells
        self.kinds = [f.dataType for f in schema.fields]

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - Spark's name
        for f in filters:
            if self.table and isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, (int, str)):
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if not self.table:
            return [RowRange(0, 0)]
        with connect(self.path) as con:
            if not has_rowid(con, self.table):
                return [RowRange(0, 0)]
            first, last = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        return [RowRange(a, min(a + RANGE_ROWS - 1, last)) for a in range(first, last + 1, RANGE_ROWS)] if first is not None else [RowRange(0, -1)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        with connect(self.path) as con:
            con.text_factory = lambda b: b.decode("utf-8", "replace")
            if not self.table:
                yield from con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")
                return
            if self.cells:
                yield from self._cells(con, partition)
                return
            where = "".join(f" AND {quoted(c)} = ?" for c in self.equal)
            columns = ", ".join("rowid" if n == "rowid" else quoted(n) for n in self.names)
            sql = f"SELECT {columns} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ?{where}"
            for row in con.execute(sql, (partition.first, partition.last, *self.equal.values())):
                yield tuple(self._as(v, k) for v, k in zip(row, self.kinds, strict=True))

    def _cells(self, con: sqlite3.Connection, partition: RowRange) -> Iterator[tuple]:
        info = con.execute(f"PRAGMA table_info({quoted(self.table)})").fetchall()
        names = [c[1] for c in info]
        own = {c: v for c, v in self.equal.items() if c == "session_id"}
        if own and "session_id" not in names:
            return
        where = "".join(f" AND {quoted(c)} = ?" for c in own)
        by_row = has_rowid(con, self.table)
        place, limits = ("rowid", (partition.first, partition.last)) if by_row else ("0", (0, 0))
        keys = [names.index(c[1]) for c in sorted((c for c in info if c[5]), key=lambda c: c[5])]
        for rowid, *values in con.execute(f"SELECT {place}, {', '.join(map(quoted, names))} FROM {quoted(self.table)} WHERE {place} BETWEEN ? AND ?{where}", (*limits, *own.values())):
            session = values[names.index("session_id")] if "session_id" in names else None
            key = None if by_row else "/".join(str(values[i]) for i in keys)
            for name, value in zip(names, values, strict=True):
                if isinstance(value, str) and value:
                    yield rowid if by_row else None, key, name, None if session is None else str(session), value

    @staticmethod
    def _as(value, kind):
        """SQLite's types are the values', not the columns': what does not fit is text or null."""
        if value is None or isinstance(kind, StringType):
            return value if value is None or isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
        if isinstance(kind, BinaryType):
            return value if isinstance(value, bytes) else str(value).encode()
        if isinstance(kind, LongType):
            return value if isinstance(value, int) else None
        return float(value) if isinstance(value, (int, float)) else None


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_store"

    def schema(self) -> StructType:
        table = self.options.get("table")
        if not table:
            return StructType([StructField("name", StringType())])
        if self.options.get("cells"):
            return CELL
        with connect(self.options["path"]) as con:
            info = con.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
        own = [StructField(c[1], _kind(c[2])) for c in info if c[1] != "rowid"]
        return StructType([StructField("rowid", LongType()), *own])

    def reader(self, schema: StructType) -> DataSourceReader:
        return StoreReader(self.options["path"], self.options.get("table"), schema, bool(self.options.get("cells")))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)


def table(spark: SparkSession, path: str, name: str, session_id: str | None = None) -> DataFrame:
    """One table; of one session only if asked (a table without such a column then gives none)."""
    rows = spark.read.format("sqlite_store").option("path", path).option("table", name).load()
    if session_id is None:
        return rows
    key = "id" if name == "sessions" else "session_id"
    return rows.where(F.col(key) == session_id) if key in rows.columns else rows.limit(0)


def tables(spark: SparkSession, path: str) -> list[str]:
    return [r["name"] for r in spark.read.format("sqlite_store").option("path", path).load().collect()]


def unreadable(path: str) -> dict[str, str]:
    """Tables of a store that cannot be read at all, as those of a module that is not there, and why."""
    found = {}
    with connect(path) as con:
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        for (name,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            try:
                has_rowid(con, name)
            except sqlite3.Error as problem:
                found[name] = str(problem)
    return found


def cells(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """Every text value of a store: file, tab, col, rowid, session_id, location, value.

    What counts is the value's own type, not the column's.  Values of a table
    WITHOUT ROWID have no rowid and are located by their primary key.  Tables that
    cannot be read are left out here and named by ``unreadable``.  A scan of one
    session also leaves out ``sessions`` itself and tables without a session.
    """
    parts, broken = None, unreadable(path)
    for name in tables(spark, path):
        if name in broken or session_id is not None and name == "sessions":
            continue
        rows = spark.read.format("sqlite_store").option("path", path).option("table", name).option("cells", "true").load()
        if session_id is not None:
            rows = rows.where(F.col("session_id") == session_id)
        where = F.coalesce(F.concat(F.lit("#rowid="), F.col("rowid").cast("string")), F.concat(F.lit("#key="), F.col("key")))
        place = F.concat(F.lit(name + "."), F.col("col"), where)
        part = rows.select(F.lit(path).alias("file"), F.lit(name).alias("tab"), "col", "rowid", "session_id", place.alias("location"), "value")
        parts = part if parts is None else parts.unionByName(part)
    return parts if parts is not None else spark.createDataFrame([], "file string, tab string, col string, rowid bigint, session_id string, location string, value string")


def live_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of all sessions of a store; none where it is missing."""
    if not os.path.isfile(path.removeprefix("file:")):
        return spark.createDataFrame([], "id string")
    return table(spark, path, "sessions").select("id").distinct()


def schema_version(path: str) -> int | None:
    """The largest version in a store's ledger of migrations, else its ``user_version``; null if neither tells."""
    try:
        with connect(path) as con:
            ledgers = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND lower(name) LIKE '%schema%version%' OR type = 'table' AND lower(name) LIKE '%migration%' ORDER BY name")]
            for name in ledgers:
                if any(c[1] == "version" for c in con.execute(f"PRAGMA table_info({quoted(name)})")):
                    top = con.execute(f"SELECT max(version) FROM {quoted(name)}").fetchone()[0]
                    if isinstance(top, int):
                        return top
            return con.execute("PRAGMA user_version").fetchone()[0] or None
    except (sqlite3.Error, OSError):
        return None
