import duckdb
import pytest

from lanternfish.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus="4", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    """A value that compares alike from either engine."""
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same_rows(spark_df, duck_result) -> None:
    columns = sorted(spark_df.columns)
    names = [c[0] for c in duck_result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    a = sorted(tuple(plain(r[c]) for c in columns) for r in spark_df.collect())
    b = sorted(tuple(plain(r[i]) for i in at) for r in duck_result.fetchall())
    assert a == b
