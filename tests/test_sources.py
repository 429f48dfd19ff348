import hashlib
import json
import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import inventory, publish, scan, snapshots
from lanternfish.sources import files, sidecars, sinks, sqlite

MAIL = "me@example.org"


@pytest.fixture
def store(tmp_path):
    path = tmp_path / "store.db"
    con = sqlite3.connect(path)
    con.executescript(
        """CREATE TABLE sessions (id TEXT, title TEXT, working_directory TEXT, created_at INTEGER, last_activity_at INTEGER);
        CREATE TABLE message_nodes (row_id INTEGER PRIMARY KEY, session_id TEXT, chat_message TEXT);
        CREATE TABLE odd (k TEXT PRIMARY KEY, v TEXT) WITHOUT ROWID;"""
    )
    con.execute("INSERT INTO odd VALUES ('k', 'plain')")
    con.executemany("INSERT INTO sessions VALUES (?, ?, ?, ?, ?)", [("a", "One", "/w/p", 1, 2), ("b", "Two", None, 3, None)])
    con.executemany("INSERT INTO message_nodes VALUES (?, ?, ?)", [(i, "ab"[i % 2], json.dumps({"role": "user", "text": f"hi {MAIL if i == 3 else i}"})) for i in range(1, 8)])
    con.commit()
    con.close()
    return str(path)


def test_sqlite_source(spark, store):
    sqlite.register(spark)
    before = hashlib.sha256(Path(store).read_bytes()).hexdigest()
    assert sqlite.tables(spark, store) == ["message_nodes", "odd", "sessions"]
    rows = sqlite.table(spark, store, "message_nodes")
    assert rows.columns == ["rowid", "row_id", "session_id", "chat_message"] and rows.count() == 7
    assert {r.rowid for r in sqlite.table(spark, store, "message_nodes", "a").collect()} == {2, 4, 6}
    assert sqlite.table(spark, store, "sessions", "b").count() == 1
    cells = sqlite.cells(spark, store)
    assert {r.tab for r in cells.select("tab").distinct().collect()} == {"message_nodes", "odd", "sessions"}
    found = scan.cell_findings(cells.select("file", "location", "value")).collect()
    assert [(f.category, f.location) for f in found] == [("email", "message_nodes.chat_message#rowid=3:line 1")]
    assert scan.cell_findings(sqlite.cells(spark, store, "a").select("file", "location", "value")).count() == 0
    assert hashlib.sha256(Path(store).read_bytes()).hexdigest() == before


def test_delete_rows_and_vacuum(store):
    assert sinks.delete_session_rows(store, ["a", "nobody"]) == 1
    con = sqlite3.connect(store)
    assert con.execute("SELECT count(*) FROM message_nodes").fetchone()[0] == 4
    con.close()
    assert not sinks.vacuum(store, True, False, 1, (1,)) and not sinks.vacuum(store, False, False, 9, (1,)) and sinks.vacuum(store, False, False, 1, (1,))


def test_walk_and_dispatch(spark, tmp_path):
    for name, data in {"a.md": b"hi " + MAIL.encode(), ".git/x.md": b"no", "b.bin": b"a\0b", "c": b"SQLite format 3\0rest", "d.db": b"x", "bad.txt": b"\xff\xfe ok"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.targets(files.walk(spark, str(tmp_path)))
    assert {Path(r.file).name: r.type for r in found.collect()} == {"a.md": "text", "b.bin": "binary", "c": "sqlite", "d.db": "sqlite", "bad.txt": "text"}
    assert {Path(r.file).name for r in files.texts(found).collect()} == {"a.md", "bad.txt"}
    errors = {Path(r.file).name: r.error for r in files.strict_texts(found).collect()}
    assert errors == {"a.md": None, "bad.txt": "not valid UTF-8", "b.bin": "skipped: binary file"}


def test_sidecars(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps({"version": 1, "sessions": {"s1": {"origin": "automation"}, "s2": "junk", "s3": {"label": "L", "origin": "x", "purpose": "p"}}}))
    got = {r.id: (r.label, r.origin) for r in sidecars.labels(sidecars.read_text(spark, str(tmp_path / "labels.json"))).collect()}
    assert got == {"s1": ("automation:unlabeled", "automation"), "s3": ("L", "x")}
    (tmp_path / "keep.json").write_text('{"ids": ["a", "a"], "title_patterns": ["^x"]}')
    raw = sidecars.read_text(spark, str(tmp_path / "keep.json"))
    assert [r.id for r in sidecars.keep_ids(raw).collect()] == ["a"] and sidecars.keep_patterns(raw) == ["^x"]
    (tmp_path / "bad.json").write_text("{nope")
    bad = sidecars.read_text(spark, str(tmp_path / "bad.json"))
    assert sidecars.keep_ids(bad).count() == 0 and sidecars.pending(bad).count() == 0 and sidecars.labels(bad).count() == 0
    sinks.save_pending({"s": 5}, str(tmp_path / "q.json"))
    assert [tuple(r) for r in sidecars.pending(sidecars.read_text(spark, str(tmp_path / "q.json"))).collect()] == [("s", 5)]
    sinks.save_pending({}, str(tmp_path / "q.json"))
    assert not (tmp_path / "q.json").exists()


def test_snapshot_round_trip(spark, store, tmp_path):
    root, out = Path(store).parent, tmp_path / "out"
    (root / "c.toml").write_text("x = 1")
    plan = [{"path": "store.db", "snapshot_path": "store.db", "kind": "sqlite"}, {"path": "c.toml", "snapshot_path": "cfg/c.toml", "kind": "file"}]
    one, two = sinks.create_snapshot(root, plan, out, 1706659200), sinks.create_snapshot(root, plan, out, 1706659200)
    assert (one.name, two.name) == ("20240131T000000Z", "20240131T000000Z-2")
    entries = sidecars.manifest_entries(sidecars.manifests(spark, str(one / "manifest.json")))
    real = spark.createDataFrame([(p, (one / p).stat().st_size, sinks.file_sha256(one / p), "ok") for p in ("store.db", "cfg/c.toml")], "path string, size long, sha256 string, integrity string")
    assert snapshots.verified(snapshots.entry_status(entries, real)).first().ok
    bad = real.withColumn("sha256", F.when(F.col("path") == "store.db", "0").otherwise(F.col("sha256")))
    assert {r.path: r.status for r in snapshots.entry_status(entries, bad).collect()} == {"store.db": "sha256-mismatch", "c.toml": "ok"}
    target = tmp_path / "target"
    assert sinks.restore(one, target) == [("store.db", "would_write"), ("c.toml", "would_write")] and not target.exists()
    sinks.restore(one, target, dry_run=False)
    (target / "c.toml").write_text("changed")
    with pytest.raises(ValueError):
        sinks.restore(one, target, dry_run=False, backup=False)
    sinks.restore(one, target, dry_run=False)
    assert (target / "c.toml").read_text() == "x = 1" and any(p.name == "c.toml" for p in out.glob("pre-restore-*/*"))
    copy = sinks.copy_to(one, tmp_path / "second")
    assert (copy / "manifest.json").exists()
    assert sinks.rotate(out, ["20240131T000000Z", "pre-restore-1"]) == ["20240131T000000Z"]
    with pytest.raises(ValueError):
        sinks.inside(tmp_path, "../x")


def test_swap_and_logs(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(3).write.parquet(path)
    sinks.swap_in(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(path + ".bak").count() == 3
    actions = spark.createDataFrame([("a", "delete"), ("b", "keep")], "id string, action string")
    for _ in range(2):
        sinks.append_log(sinks.audit_entry(actions, "none", {"vacuumed": 0}), str(tmp_path / "log"))
    assert [r.deleted for r in spark.read.json(str(tmp_path / "log")).collect()] == [1, 1]


def test_export_index(spark):
    none = spark.createDataFrame([], "text string")
    listing = spark.createDataFrame([("index.json",), ("a.md",), ("b.json",), ("c.txt",)], "file string")
    by_json = spark.createDataFrame([('{"sessions": [{"file": "x.md", "title": "T"}, {"title": "no file"}]}',)], "text string")
    by_md = spark.createDataFrame([("[[2024-01-01_s|Title]] and [[t.json]]",)], "text string")
    rows = lambda df: sorted((r.file, r.title) for r in df.collect())
    assert rows(publish.index_entries(by_json, by_md, listing)) == [("x.md", "T")]
    assert sorted(r.file for r in publish.index_entries(none, by_md, listing).collect()) == ["2024-01-01_s.md", "t.json"]
    assert sorted(r.file for r in publish.index_entries(none, none, listing).collect()) == ["a.md", "b.json"]


def test_rules_from_json():
    rules = inventory.Rules.load('{"max_delete": 7, "unknown": 1}')
    assert rules.max_delete == 7 and rules.grace_hours == 48.0


def test_keep_patterns_are_all_read(spark):
    raw = spark.createDataFrame([(json.dumps({"title_patterns": [f"p{i}" for i in range(1500)]}),)], "text string")
    assert len(sidecars.keep_patterns(raw)) == 1500


def test_walk_prunes_below_the_given_path_and_sees_every_file(spark, tmp_path):
    base = tmp_path / "venv" / "d"
    for name, data in {"a.txt": b"x", "empty.txt": b"", ".env": b"A=1", "_x/y.txt": b"z", "node_modules/no.txt": b"x", "s/venv/no.txt": b"x", "s/with space.txt": b"q", ".cfg/deep.txt": b"r"}.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(data)
    names = lambda *p: sorted(r.path.split("/venv/d/", 1)[1] for r in files.walk(spark, *p).select("path").collect())
    every = [".cfg/deep.txt", ".env", "_x/y.txt", "a.txt", "empty.txt", "s/with space.txt"]
    assert names(str(base)) == every and names(str(base), str(base / "s"), str(base) + "/") == every
    assert names(str(base / ".env")) == [".env"] and names(str(base / "a.txt"), str(base / "empty.txt")) == ["a.txt", "empty.txt"]


def test_schema_versions(tmp_path):
    def made(name, *sql):
        con = sqlite3.connect(tmp_path / name)
        for s in sql:
            con.execute(s)
        con.commit()
        con.close()
        return str(tmp_path / name)

    assert sqlite.schema_version(made("a.db", "CREATE TABLE schema_version (version INTEGER)", "INSERT INTO schema_version VALUES (3), (12)")) == 12
    assert sqlite.schema_version(made("b.db", "PRAGMA user_version = 7")) == 7 and sqlite.schema_version(made("c.db", "CREATE TABLE t (x)")) is None
    (tmp_path / "d.db").write_bytes(b"no database at all, but long enough")
    assert sqlite.schema_version(str(tmp_path / "d.db")) is None and sqlite.schema_version(str(tmp_path / "none.db")) is None


def test_pending_files_are_retried(tmp_path):
    store, folder = tmp_path / "s.db", tmp_path / "m"
    folder.mkdir()
    con = sqlite3.connect(store)
    con.execute("CREATE TABLE sessions (id TEXT)")
    con.execute("INSERT INTO sessions VALUES ('a'), ('b')")
    con.commit()
    con.close()
    for n in ("a.db", "a.db-wal", "a.lock", "ab.db", "old.db"):
        (folder / n).write_bytes(b"x")
    (folder / "b.db").mkdir()  # cannot be unlinked, and is no file of a session
    queue = {"old": 5}
    assert sinks.apply_deletions(str(store), folder, [("a", "cli"), ("b", "gui")], queue, 9) == {"cli_rows": 2, "gui_sessions": 2, "still_locked": 0}
    assert sorted(p.name for p in folder.iterdir()) == ["ab.db", "b.db"] and queue == {}
    assert sinks.retry_pending(folder, {}, 9) == {}
