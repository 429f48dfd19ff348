import pytest
from pyspark.sql import functions as F

from lanternfish.functions import scalars
from lanternfish.operators import inventory


def values(spark, made, items):
    return [r[0] for r in spark.createDataFrame([(x,) for x in items], "v string").select(made(F.col("v"))).collect()]


def test_roles_and_texts(spark):
    raw = ['{"role": "USER"}', '{"role": 1, "type": "ai-reply"}', '{"kind": "x"}', "[1]", "oops", '{"role": {"user": 1}}', '{"author": "human"}']
    assert values(spark, scalars.role_of, raw) == ["user", "assistant", None, None, None, None, "user"]
    assert values(spark, scalars.text_of, ['{"text": " ", "content": "c"}', '{"content": {"a": 1}, "prompt": "p"}', "{}"]) == ["c", "p", ""]


def test_verdicts(spark):
    answers = ["keep", "Delete!", '{"keep": true}', '{"keep": "false"}', '{"verdict": "durable"}', '{"abstained": true}', "well, no keep", "I would keep it", "hm", ""]
    assert values(spark, scalars.parse_verdict, answers) == [True, False, True, False, True, None, False, True, None, None]


def test_paths_and_names(spark):
    assert values(spark, scalars.leftover_sid, ["a.db-wal", "b.lock", "c.db", "d.db-shm"]) == ["a", "b", None, "d"]
    assert values(spark, scalars.normal_path, ["a/./b", "a/../b", "../x", "/abs", "a/../../x", ""]) == ["a/b", "b", None, None, None, ""]
    assert values(spark, lambda c: scalars.excluded(c, ["*.pem", "credentials.toml"]), ["k/a.pem", "x/CREDENTIALS.toml", "b.md"]) == [True, True, False]
    assert values(spark, scalars.created_at, ["1970-01-01T00:00:10Z", "1970-01-01T00:00:10", "12.5", "x"]) == [10.0, 10.0, 12.5, None]
    ids = spark.createDataFrame([("2024-01-02_abc.md", "x"), ("n.md", "t\nsession_id: s1 \n"), ("j.json", '{"session_id": "q"}'), ("z.md", "")], "n string, t string")
    assert [r[0] for r in ids.select(scalars.export_session_id(F.col("n"), F.col("t"))).collect()] == ["abc", "s1", "q", None]


def test_tiers():
    assert scalars.parse_tiers(None) == {1, 2} and scalars.parse_tiers("tier3, 1") == {1, 3} and scalars.parse_tiers("all") == {1, 2, 3}
    with pytest.raises(ValueError):
        scalars.parse_tiers("4")


def test_empty_pattern_list_matches_nothing(spark):
    assert values(spark, lambda c: scalars.any_pattern(c, []), ["", "a"]) == [False, False]


def test_not_in_has_sql_semantics(spark):
    keys = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k int")
    n = lambda c, p: sorted(str(r.k) for r in inventory.orphans(c, p, "k", "k").collect())
    assert n(keys(1, None, 3), keys(1)) == ["3"] and n(keys(1, 3), keys(1, None)) == [] and n(keys(1, None), keys(*[None]).limit(0)) == ["1", "None"]


def test_files_touched(spark):
    rows = spark.createDataFrame([("s", '{"file": "/a/b", "x": "/c", "args": {"paths": ["d/e", "d/e", 3]}}', None), ("s", "bad", '{"path": "nope"}')], "session_id string, tool_call_json string, tool_call_update_json string")
    assert [tuple(r) for r in inventory.tool_counts(rows).collect()] == [("s", 2, 2)]


def test_shell_patterns(spark):
    import fnmatch
    import re

    from lanternfish.functions import scalars

    names = ["a.pem", "ab.key", "x/b.pem", "[a].pem", "a-c.t", "]x", "a\nb", "!z", "^z", "z&&y"]
    for pattern in ["*.pem", "?.pem", "[ab].pem", "[!a]*", "[a-c]*.k?y", "[]x]*", "[!]]x", "[[]a].pem", "a[", "*\n*", "[^z]*", "[!-~]z", "z&&y", "[&z]*"]:
        want = [n for n in names if fnmatch.fnmatchcase(n, pattern)]
        rows = spark.createDataFrame([(n,) for n in names], "n string").where(__import__("pyspark").sql.functions.col("n").rlike(scalars.glob_regex(pattern)))
        assert [r.n for r in rows.collect()] == want, pattern
        re.compile(scalars.glob_regex(pattern).replace(r"\z", r"\Z"))


def test_summaries_and_sizes(spark):
    from pyspark.sql import functions as F

    from lanternfish.functions import scalars

    rows = spark.createDataFrame([("t", "p", -5), ("t", "", 1536), (None, None, 0)], "t string, p string, n long")
    got = [tuple(r) for r in rows.select(scalars.session_summary(F.col("t"), F.col("p")), scalars.fmt_bytes(F.col("n"))).collect()]
    assert got == [("t\n\np", "0 B"), ("t", "1.5 KB"), ("", "0 B")]


def test_units_and_ties_of_sizes(spark):
    from lanternfish.functions import scalars

    sizes = [2**40 - 1, 2**40, 3300000 * 330000, 1280, 1792, 2271645998566605, 2283630675309363, 2251799867371984, 2**63 - 1]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select(scalars.fmt_bytes(F.col("n")), scalars.fmt_bytes(F.col("n"), "GB")).collect()

    def shown(n, units):
        size = float(n)
        for unit in units:
            size /= 1024
            if size < 1024 or unit == units[-1]:
                return f"{size:.1f} {unit}"

    assert [tuple(r) for r in rows] == [(shown(n, scalars.UNITS), shown(n, scalars.UNITS[:3])) for n in sizes]
