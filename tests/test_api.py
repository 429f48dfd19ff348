import hashlib
import json
import sqlite3

import pytest

from lanternfish import api
from lanternfish.functions.detect import TAG

KEY = "AK" + "IA" + "QWER" * 4
MAIL = "me@example.org"
DAY = 86_400_000
NOW = 1_706_659_200


@pytest.fixture
def tree(tmp_path):
    """A store as an agent leaves it: a session of work, an old noisy one, a sensitive read, a key split over two turns."""
    root = tmp_path / "data"
    root.mkdir()
    con = sqlite3.connect(root / "store.db")
    con.executescript(
        """CREATE TABLE sessions (id TEXT, title TEXT, working_directory TEXT, created_at INTEGER, last_activity_at INTEGER);
        CREATE TABLE message_nodes (row_id INTEGER PRIMARY KEY, session_id TEXT, chat_message TEXT);
        CREATE TABLE tool_call_state (session_id TEXT, tool_call_id TEXT, tool_call_json TEXT, tool_call_update_json TEXT);"""
    )
    con.executemany("INSERT INTO sessions VALUES (?, ?, ?, ?, ?)", [("work", "Refactor", "/w/proj", NOW * 1000 - 9 * DAY, NOW * 1000), ("noise", "heartbeat-probe", "/w/x", NOW * 1000 - 9 * DAY, NOW * 1000 - 8 * DAY), ("empty", "", "", 1, NOW * 1000 - 8 * DAY)])
    say = lambda t: json.dumps({"role": "user", "text": t})
    con.executemany("INSERT INTO message_nodes VALUES (?, ?, ?)", [(1, "work", say("use " + KEY[:8])), (2, "work", say(KEY[8:] + " please")), (3, "noise", say("ping")), (4, "work", say("mail " + MAIL))])
    update = json.dumps({"content": [{"type": "text", "text": "plain words"}]})
    con.executemany("INSERT INTO tool_call_state VALUES (?, ?, ?, ?)", [("work", "1", json.dumps({"kind": "execute", "rawInput": {"command": "cat .env"}}), update), ("work", "2", json.dumps({"kind": "execute", "rawInput": {"command": "ls"}}), update)])
    con.commit()
    con.close()
    (root / "notes.md").write_text(f"hello\n{MAIL}\n")
    (root / "fine.txt").write_text("nothing here\n")
    return root


def test_scan_gate_redact(spark, tree):
    store = str(tree / "store.db")
    before = hashlib.sha256((tree / "store.db").read_bytes()).hexdigest()
    _, findings = api.scan_paths(spark, str(tree))
    got = {(r.file.rsplit("/", 1)[1], r.category, r.kind) for r in findings.collect()}
    assert got == {
        ("notes.md", "email", "pattern"), ("store.db", "email", "pattern"), ("store.db", "api_key", "cross-chunk"),
        ("store.db", "sensitive_tool_output", "semantic-context"), ("store.db", "project_name", "metadata"),
    }
    assert hashlib.sha256((tree / "store.db").read_bytes()).hexdigest() == before
    assert api.gate(spark, str(tree)) == 1 and api.verify(spark, str(tree)) == 1
    assert api.gate(spark, str(tree / "fine.txt")) == 0 and api.verify(spark, str(tree / "fine.txt")) == 0 and api.gate(spark, str(tree / "notes.md")) == 0
    texts, cells = api.plan_redaction(spark, str(tree))
    assert api.apply_redaction(texts.cache(), cells.cache()) == 2
    assert TAG in (tree / "notes.md").read_text() and MAIL in (tree / "notes.md.bak").read_text()
    con = sqlite3.connect(store)
    outputs = [json.loads(r[0])["content"][0]["text"] for r in con.execute("SELECT tool_call_update_json FROM tool_call_state ORDER BY tool_call_id")]
    assert outputs[0].startswith(TAG) and outputs[1] == "plain words"
    assert not con.execute("SELECT 1 FROM message_nodes WHERE chat_message LIKE ?", (f"%{MAIL}%",)).fetchone()
    con.close()


def test_hook(spark, tree, tmp_path):
    store = str(tree / "store.db")
    verdict = api.session_end(spark, store, "work", str(tmp_path / "v/work.json"))
    assert verdict["publication_status"] == "BLOCKED" and json.loads((tmp_path / "v/work.json").read_text()) == verdict
    assert api.session_end(spark, store, "noise", str(tmp_path / "v/n.json"))["publication_status"] == "CLEAN"
    assert api.session_end(spark, store, "nobody", str(tmp_path / "v/x.json"))["publication_status"] == "SKIPPED"
    assert api.latest_session(spark, store) == "work"
    later = lambda: "late"
    assert api.which_session("f", '{"session_id": "s"}', {}, later) == ("f", "flag") and api.which_session(None, '{"session_id": "s"}', {"SESSION_ID": "e"}, later) == ("s", "stdin")
    assert api.which_session(None, "junk", {"SESSION_ID": "e"}, later) == ("e", "environment") and api.which_session(None, "", {}, later) == ("late", "latest")


def test_clean_up(spark, tree):
    store = str(tree / "store.db")
    fates, plan = api.cleanup_plan(spark, store, NOW)
    assert {r.id: r.reason for r in fates.collect()} == {"work": "grace window", "noise": "automation/eval noise", "empty": "empty"}
    assert api.plan_summary(fates, plan, False).startswith("dry run: 2 auto_delete, 1 keep")

    def fails(ids):
        raise RuntimeError("no export")

    with pytest.raises(RuntimeError):
        api.clean_up(plan, store, fails)
    assert api.session_exists(spark, store, "noise") and api.clean_up(plan, store)["cli_rows"] == 2 and api.session_exists(spark, store, "noise") is False


def test_snapshots(spark, tree, tmp_path):
    made = api.snapshot(spark, str(tree), str(tmp_path / "out"), now=NOW)
    assert api.verify_snapshot(spark, str(made)).first().asDict() == {"checked": 1, "failed": 0, "ok": True}
    (made / "store.db").write_bytes(b"broken")
    assert api.verify_snapshot(spark, str(made)).first().failed == 1


def test_publish(spark, tmp_path):
    exports, verdicts = tmp_path / "e", tmp_path / "v"
    exports.mkdir()
    verdicts.mkdir()
    (exports / "2024-01-01_a.md").write_text(f"session_id: a\n{MAIL}")
    (exports / "2024-01-02_b.md").write_text("fine")
    (exports / "index.md").write_text("[[2024-01-01_a]] [[2024-01-02_b|B]] [[2024-01-03_c]]")
    (verdicts / "b.json").write_text('{"publication_status": "BLOCKED"}')
    rows, overall = api.verify_publish(spark, str(exports), str(verdicts))
    assert [(r.session_id, r.publication_status, r.hook_status) for r in rows.collect()] == [("a", "REVIEW", None), ("b", "CLEAN", "BLOCKED"), ("c", "MISSING", None)]
    one = overall.first()
    assert (one.publication_status, one.warnings, one.sessions_missing) == ("REVIEW", 2, 1)


def test_command_line(spark, tree, capsys):
    from lanternfish.__main__ import main

    assert main(["verify", str(tree / "fine.txt")]) == 0 and main(["gate", str(tree / "store.db")]) == 1
    assert main(["scan", str(tree / "notes.md")]) == 0 and "REVIEW" in capsys.readouterr().out


def test_no_store_with_a_key_reads_clean(spark, tmp_path):
    """A key in a column declared INTEGER, one in a table WITHOUT ROWID, and a table that cannot be read."""
    for name, sql in {
        "typed.db": ["CREATE TABLE t (n INTEGER, d REAL)", f"INSERT INTO t VALUES ('{KEY}', 1.5)"],
        "keyed.db": ["CREATE TABLE t (k TEXT, i INT, v BLOB, PRIMARY KEY (k, i)) WITHOUT ROWID", f"INSERT INTO t VALUES ('a', 1, '{KEY}')"],
    }.items():
        con = sqlite3.connect(tmp_path / name)
        for s in sql:
            con.execute(s)
        con.commit()
        con.close()
    _, findings = api.scan_paths(spark, str(tmp_path))
    assert {(r.file.rsplit("/", 1)[1], r.category, r.location) for r in findings.collect()} == {("typed.db", "api_key", "t.n#rowid=1:line 1"), ("keyed.db", "api_key", "t.v#key=a/1:line 1")}
    assert api.gate(spark, str(tmp_path)) == 1
    broken = tmp_path / "b" / "broken.db"
    broken.parent.mkdir()
    con = sqlite3.connect(broken)
    con.execute("CREATE TABLE fine (x TEXT)")
    con.execute("PRAGMA writable_schema = ON")
    con.execute("INSERT INTO sqlite_master VALUES ('table', 'gone', 'gone', 0, 'CREATE VIRTUAL TABLE gone USING nothing_like_it(x)')")
    con.commit()
    con.close()
    listed, findings = api.scan_paths(spark, str(broken.parent))
    assert "gone" in listed.first().error and findings.count() == 0 and api.gate(spark, str(broken.parent)) == 2


def test_judge_by_command(spark):
    rows = spark.createDataFrame([("a", "T", "T\n\np"), ("b", "drop", "drop")], "id string, title string, summary string")
    said = lambda spec: {r.id: r.answer for r in api.make_judge(spec, "kept?")(rows).collect()}
    assert json.loads(said("command:cat")["a"]) == {"statement": "kept?", "session_id": "a", "title": "T", "text": "T\n\np"}
    assert said("command:exit 3") == {"a": None, "b": None} == said("command:no-such-program-anywhere")
    assert {r.answer for r in api.command_judge("sleep 5", "s", timeout=0.2)(rows).collect()} == {None}
    assert api.make_judge(None, "s") is None
    with pytest.raises(ValueError):
        api.make_judge("oracle", "s")


def test_clean_leftovers_and_state(spark, tree, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    for n in ("work.lock", "live.db", "live.db-wal", "dead.db-wal", "dead.lock", "waits.lock", "notes.txt"):
        (folder / n).write_bytes(b"xyz")
    con = sqlite3.connect(tree / "store.db")
    con.execute("INSERT INTO message_nodes VALUES (9, 'nobody', 'x')")
    con.commit()
    con.close()
    assert api.clean_leftovers(spark, str(tree / "store.db"), str(folder), {"waits": 1}) == {"orphan_rows": 1, "leftover_files": 2, "leftover_bytes": 6}
    assert sorted(p.name for p in folder.iterdir()) == ["live.db", "live.db-wal", "notes.txt", "waits.lock", "work.lock"]
    db = tmp_path / "state.db"
    con = sqlite3.connect(db)
    con.execute("CREATE TABLE ItemTable (key TEXT, value TEXT)")
    con.execute("INSERT INTO ItemTable VALUES ('a', '1'), ('b', '2')")
    con.commit()
    con.close()
    state = spark.createDataFrame([("a", 2, True), ("b", 2, False)], "key string, bytes long, stale boolean")
    gate = lambda ok: spark.createDataFrame([(ok, None if ok else "too old")], "ok boolean, reason string")
    for refused in (lambda: api.clean_state(state, gate(False), str(db), False), lambda: api.clean_state(state, gate(True), str(db), True), lambda: api.clean_state(state, gate(True).limit(0), str(db), False)):
        with pytest.raises(PermissionError):
            refused()
    assert api.clean_state(state, gate(True), str(db), False) == {"keys": 1, "bytes": 2}
    con = sqlite3.connect(db)
    assert con.execute("SELECT key FROM ItemTable").fetchall() == [("b",)]
    con.close()


def test_tables_in_words(spark):
    from lanternfish.operators import inventory

    one = spark.createDataFrame([(2048, -5)], "bytes long, recoverable_bytes long")
    shown = api.space_table(inventory.space_report({"sessions": one, "locks": "database is locked"}))
    assert "error: database is locked" in shown and "0 B" in shown and shown.splitlines()[-1].startswith("total")
    diff = spark.createDataFrame([(f"p{i:03}", "same") for i in range(12)], "path string, status string")
    assert api.diff_table(diff, 10).splitlines()[-1] == "and 2 more"
