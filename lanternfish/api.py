"""What a user calls: scan, redact, gate, inventory, clean up, snapshot.

Every function builds plans from the operators; what touches single files does so
in the driver, after the plan is made and only if asked to apply it.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import subprocess
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import chunks, inventory, publish, redact, scan, snapshots
from .sources import files, sidecars, sinks, sqlite

UNIT_TABLES = {"tool_call_state": ["tool_call_json", "tool_call_update_json"], "message_nodes": ["chat_message"]}


def store_findings(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """All findings of one store: cells, metadata, sensitive reads, and values split over payloads."""
    sqlite.register(spark)
    have = set(sqlite.tables(spark, path))
    found = scan.cell_findings(sqlite.cells(spark, path, session_id).select("file", "location", "value"))
    known = found
    if "sessions" in have and session_id is None:
        rows = sqlite.table(spark, path, "sessions")
        if "working_directory" in rows.columns:
            found = found.unionByName(scan.metadata_findings(rows.withColumn("file", F.lit(path))))
    for name, columns in UNIT_TABLES.items():
        if name not in have:
            continue
        rows = sqlite.table(spark, path, name, session_id).withColumns({"file": F.lit(path), "tab": F.lit(name)})
        if not {*columns, "session_id"} <= set(rows.columns):
            continue
        if name == "tool_call_state":
            found = found.unionByName(scan.semantic_findings(rows))
        made = chunks.units(rows, columns)
        found = found.unionByName(chunks.inside_units(made, known)).unionByName(chunks.across_rows(made, known, scoped=session_id is not None))
    return found


def scan_paths(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(files with type and error, by name; findings) of files and folders.

    A store with a table that cannot be read has an error, so it never passes the
    gate as clean.  Findings come in no order; ``scan.ordered`` is for printing.
    """
    found = files.targets(files.walk(spark, *paths))
    listed = found.select("file", "type", F.when(F.col("type") == "binary", "skipped: binary file").alias("error")).cache()  # narrow
    rows = scan.text_findings(files.texts(found))
    errors = {}
    for r in listed.where("type = 'sqlite'").select("file").collect():  # stores are opened one by one
        try:
            rows = rows.unionByName(store_findings(spark, r["file"]))
            broken = sqlite.unreadable(r["file"])
            if broken:
                errors[r["file"]] = "tables not read: " + "; ".join(f"{t} ({why})" for t, why in broken.items())
        except sqlite3.Error as problem:
            errors[r["file"]] = str(problem)
    for file, problem in errors.items():
        listed = listed.withColumn("error", F.when(F.col("file") == file, problem).otherwise(F.col("error")))
    return listed.orderBy(F.lower("file")), rows


def scan_report(spark: SparkSession, *paths: str) -> DataFrame:
    listed, findings = scan_paths(spark, *paths)
    return scan.report(listed, findings)


def verify(spark: SparkSession, *paths: str) -> int:
    """0 if everything is clean, else 1; errors do not count."""
    return 0 if scan_report(spark, *paths).first()["publication_status"] == "CLEAN" else 1


def gate(spark: SparkSession, *paths: str) -> int:
    """2 on a hard error, 1 if something is blocked, else 0."""
    listed, findings = scan_paths(spark, *paths)
    return scan.file_verdicts(listed, findings).agg(F.max("gate_code")).first()[0] or 0


def latest_session(spark: SparkSession, store: str) -> str | None:
    sqlite.register(spark)
    row = sqlite.table(spark, store, "sessions").orderBy(F.desc_nulls_last("last_activity_at"), F.desc("id")).select("id").limit(1).first()
    return row["id"] if row else None


def session_exists(spark: SparkSession, store: str, session_id: str) -> bool | None:
    """True, false, or None if the store cannot be read."""
    sqlite.register(spark)
    try:
        return not sqlite.table(spark, store, "sessions", session_id).isEmpty()
    except (sqlite3.Error, OSError):
        return None


def which_session(flag: str | None, stdin: str, env: dict[str, str], latest: Callable[[], str | None], variable: str = "SESSION_ID") -> tuple[str | None, str]:
    """The session a hook is about, and where that came from: flag, payload, environment, latest."""
    if flag:
        return flag, "flag"
    try:
        told = json.loads(stdin[: 1 << 20]) if stdin.strip() else None
    except ValueError:
        told = None
    if isinstance(told, dict) and isinstance(told.get("session_id"), str) and told["session_id"]:
        return told["session_id"], "stdin"
    if env.get(variable):
        return env[variable], "environment"
    return latest(), "latest"


def session_end(spark: SparkSession, store: str, session_id: str | None, out: str) -> dict:
    """Scan one session and write its verdict beside; a store that cannot be read is SKIPPED, never CLEAN."""
    verdict = {"session_id": session_id, "publication_status": "SKIPPED", "findings": 0, "secrets": 0}
    if session_id and session_exists(spark, store, session_id):
        found = store_findings(spark, store, session_id)
        n, bad = found.agg(F.count(F.lit(1)), F.count_if(scan.secrets(F.col("category")))).first()
        verdict |= {"publication_status": "BLOCKED" if bad else "REVIEW" if n else "CLEAN", "findings": n, "secrets": bad}
    try:
        Path(out).parent.mkdir(parents=True, exist_ok=True)
        Path(out).write_text(json.dumps(verdict, sort_keys=True))
    except OSError as problem:
        verdict["write_error"] = str(problem)
    return verdict


def verify_publish(spark: SparkSession, export_dir: str, verdicts_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row an export, one row overall) of an export folder."""
    base = Path(export_dir)
    none = spark.createDataFrame([], "text string")
    index = lambda n: sidecars.read_text(spark, str(base / n)) if (base / n).is_file() else none
    found = files.walk(spark, export_dir)
    name = F.substring_index("path", "/", -1)
    entries = publish.index_entries(index("index.json"), index("index.md"), found.select(name.alias("file")))
    texts = files.texts(files.targets(found)).select(F.substring_index("file", "/", -1).alias("file"), "text")
    texts = texts.join(entries.select("file").distinct(), "file", "left_semi")
    has = verdicts_dir and any(Path(verdicts_dir).glob("*.json"))
    hooks = sidecars.hook_verdicts(spark, verdicts_dir) if has else spark.createDataFrame([], "session_id string, hook_status string")
    gated = publish.gate(entries, texts, hooks)
    return publish.ordered(gated), publish.overall(gated)


def plan_redaction(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(new texts of files, new values of cells), each with its edits; nothing is changed."""
    sqlite.register(spark)
    found = files.targets(files.walk(spark, *paths))
    strict = files.strict_texts(found).where("error IS NULL").select("file", "text")
    texts = redact.redact_texts(strict).where(F.size("edits") > 0)
    cells = None
    for r in found.where("type = 'sqlite'").select("file").collect():
        path = r["file"]
        rows = sqlite.cells(spark, path).where("rowid IS NOT NULL")  # values located by a key are found, not rewritten
        if "tool_call_state" in sqlite.tables(spark, path):
            calls = sqlite.table(spark, path, "tool_call_state").select(F.col("rowid").alias("__r"), scan.tool_call_flag(F.col("tool_call_json")).isNotNull().alias("semantic"))
            rows = rows.join(calls, (F.col("tab") == "tool_call_state") & (F.col("col") == "tool_call_update_json") & (F.col("rowid") == F.col("__r")), "left")
        else:
            rows = rows.withColumn("semantic", F.lit(False))
        part = redact.redact_cells(rows.select("file", "location", "value", "semantic"))
        cells = part if cells is None else cells.unionByName(part)
    if cells is None:
        cells = spark.createDataFrame([], "file string, location string, new_value string, edits array<struct<category:string,line:int,fingerprint:string>>")
    return texts, cells


def apply_redaction(texts: DataFrame, cells: DataFrame) -> int:
    """Carry out a plan: a ``.bak`` beside each file first, one transaction a store; returns the files changed."""
    changed = 0
    for r in texts.select("file", "new_text").toLocalIterator():
        path = Path(r["file"])
        shutil.copy2(path, f"{path}.bak")
        part = path.with_name(path.name + ".part")
        part.write_bytes(r["new_text"].encode())
        os.replace(part, path)
        changed += 1
    edits = cells.select("file", F.regexp_extract("location", r"^(.*)\.([^.#]+)#rowid=(\d+)$", 1).alias("tab"), F.regexp_extract("location", r"^(.*)\.([^.#]+)#rowid=(\d+)$", 2).alias("col"), F.regexp_extract("location", r"#rowid=(\d+)$", 1).cast("bigint").alias("rowid"), "new_value")
    for r in edits.select("file").distinct().collect():
        path = r["file"]
        backup = f"{path}.bak"
        shutil.copy2(path, backup)
        con = sqlite3.connect(path, timeout=30)
        try:
            with con:
                for e in edits.where(F.col("file") == path).toLocalIterator():
                    con.execute(f"UPDATE {sqlite.quoted(e['tab'])} SET {sqlite.quoted(e['col'])} = ? WHERE rowid = ?", (e["new_value"], e["rowid"]))
                if con.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
                    raise sqlite3.DatabaseError("integrity check failed")
        except sqlite3.Error:
            con.close()
            shutil.copy2(backup, path)
            raise
        con.close()
        changed += 1
    return changed


def store_inventory(spark: SparkSession, store: str) -> DataFrame:
    """The session inventory of a store; times in milliseconds become seconds."""
    sqlite.register(spark)
    seconds = lambda c: F.nullif(F.col(c), F.lit(0)) / 1000.0
    sessions = sqlite.table(spark, store, "sessions").select("id", "title", F.col("working_directory").alias("project"), seconds("created_at").alias("created"), seconds("last_activity_at").alias("last_activity"))
    have = sqlite.tables(spark, store)
    messages = sqlite.table(spark, store, "message_nodes") if "message_nodes" in have else spark.createDataFrame([], "session_id string, rowid long, chat_message string")
    tools = sqlite.table(spark, store, "tool_call_state") if "tool_call_state" in have else spark.createDataFrame([], "session_id string, tool_call_json string, tool_call_update_json string")
    return inventory.inventory(sessions, messages, tools)


def cleanup_plan(spark: SparkSession, store: str, now: float, rules: inventory.Rules | None = None, judge: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(every session with its fate, the sessions to delete).

    ``judge`` maps rows (id, title, summary) to (id, answer); without one, undecided sessions stay.
    """
    rules = rules or inventory.Rules()
    rows = inventory.classify(store_inventory(spark, store), rules, now)
    asked = rows.where("tier = 'judge'").select("id", "title", scalars.session_summary(F.col("title"), F.col("prompt")).alias("summary"))
    answers = judge(asked) if judge else spark.createDataFrame([], "id string, answer string")
    fates = inventory.judged(rows, answers)
    return fates, inventory.delete_plan(fates, rules)


def command_judge(command: str, statement: str, timeout: float = 60.0) -> Callable[[DataFrame], DataFrame]:
    """A judge that asks a program: one JSON object on its input, an answer on its output.

    A program that fails, is not there or takes longer than ``timeout`` seconds
    gives no answer, and a session without an answer stays.
    """

    def answer(row) -> str | None:
        asked = {"statement": statement, "session_id": row["id"], "title": row["title"], "text": row["summary"]}
        try:
            done = subprocess.run(command, input=json.dumps(asked), capture_output=True, text=True, shell=True, check=False, timeout=timeout)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout if done.returncode == 0 else None

    def judge(rows: DataFrame) -> DataFrame:
        answers = [(r["id"], answer(r)) for r in rows.toLocalIterator()]  # one program at a time, on this machine
        return rows.sparkSession.createDataFrame(answers, "id string, answer string")

    return judge


def make_judge(spec: str | None, statement: str) -> Callable[[DataFrame], DataFrame] | None:
    """``none`` or ``command:<program>``."""
    spec = (spec or "none").strip()
    if spec == "none":
        return None
    if spec.startswith("command:"):
        return command_judge(spec.removeprefix("command:"), statement)
    raise ValueError(f"unknown judge {spec!r}; none or command:<program>")


def clean_up(plan: DataFrame, store: str, export: Callable[[list[str]], None] | None = None, folder: str | None = None, queue: dict[str, int] | None = None, now: float | None = None) -> dict[str, int]:
    """Delete the planned sessions, their files in ``folder``, and what waits in ``queue``.

    An export that fails stops everything before the first change.
    """
    ids = [r["id"] for r in plan.select("id").collect()]  # capped by the rules
    if export:
        export(ids)
    if folder is None:
        return {"cli_rows": sinks.delete_session_rows(store, ids), "gui_sessions": 0, "still_locked": 0}
    return sinks.apply_deletions(store, Path(folder), [(i, "cli") for i in ids], queue if queue is not None else {}, int(time.time() if now is None else now))


def clean_leftovers(spark: SparkSession, store: str, folder: str, queue: dict[str, int] | None = None) -> dict[str, int]:
    """Tier 1: rows without a session, and sidecars and locks of sessions that are gone and do not wait."""
    sqlite.register(spark)
    base = Path(folder)
    names = [(p.name, p.stat().st_size) for p in sorted(base.iterdir()) if p.is_file()] if base.is_dir() else []
    listed = spark.createDataFrame(names, "name string, bytes bigint")
    dbs = listed.where(F.endswith("name", F.lit(".db"))).select(F.expr("left(name, length(name) - 3)").alias("id"))
    waiting = spark.createDataFrame([(i,) for i in queue or {}], "id string")
    plan = inventory.leftovers(listed, dbs, sqlite.live_ids(spark, store), waiting)
    files, size = sinks.unlink_planned(base, [r["name"] for r in plan.select("name").collect()])
    return {"orphan_rows": sinks.delete_orphans(store), "leftover_files": files, "leftover_bytes": size}


def clean_state(state: DataFrame, gate: DataFrame, db: str, running: bool) -> dict[str, int]:
    """Tier 3: stale state keys, only behind a snapshot that passes the gate and only if nothing runs."""
    told = gate.limit(1).first()
    if running or not told or not told["ok"]:
        raise PermissionError("something is running" if running else f"no snapshot that allows it: {told['reason'] if told else 'none'}")
    keys = inventory.stale_keys(state, gate, running).select("key", "bytes").collect()
    return {"keys": sinks.delete_keys(db, [r["key"] for r in keys]), "bytes": sum(r["bytes"] for r in keys)}


def plan_summary(fates: DataFrame, plan: DataFrame, apply: bool) -> str:
    """A plan in words."""
    counts = {r["tier"]: r["sessions"] for r in inventory.tier_counts(fates).collect()}
    lines = [f"{'apply' if apply else 'dry run'}: " + ", ".join(f"{n} {t}" for t, n in sorted(counts.items()))]
    return "\n".join(lines + [f"  {r['rank']:>3} {r['id']}  {r['tier']}: {r['reason']}" for r in plan.orderBy("rank").collect()])


def space_table(report: DataFrame, labelled: DataFrame | None = None) -> str:
    """A space report as a table, an error where a store has one, and the first labelled sessions."""
    lines = [f"{'store':<16}{'bytes':>16}{'recoverable':>16}"]
    for r in report.orderBy(F.col("name") == "total", "name").collect():  # a row a store
        lines.append(f"{r['name']:<16}{r['bytes']:>16}{r['shown']:>16}" + (f"  error: {r['error']}" if r["error"] else ""))
    if labelled is not None:
        count = labelled.count()
        lines += [f"labelled sessions: {count}"] if count else []
        lines += [f"  [{r['label']}] {r['id']}  {r['day']}  {r['title']}" for r in inventory.first_labelled(labelled).collect()]
        lines += [f"  and {count - 10} more"] if count > 10 else []
    return "\n".join(lines)


def diff_table(changes: DataFrame, limit: int = 1000) -> str:
    """A snapshot difference (path, status) as lines; what is beyond ``limit`` is counted."""
    rows = changes.orderBy("path").limit(limit + 1).collect()
    lines = [f"{r['status']:<10} {r['path']}" for r in rows[:limit]]
    return "\n".join(lines + ([f"and {changes.count() - limit} more"] if len(rows) > limit else []))


def discover(spark: SparkSession, root: str, name: str = "data", excluded_dirs: list[str] | None = None) -> DataFrame:
    """Stores under a root with size and digest."""
    base = str(Path(root).resolve())
    found = files.walk(spark, base).select(F.lit(name).alias("root"), F.substr(F.regexp_replace("path", "^file:(//)?", ""), F.lit(len(base) + 2)).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return snapshots.discover(found, excluded_dirs=excluded_dirs)


def snapshot(spark: SparkSession, root: str, out: str, exclude: list[str] | None = None, now: float | None = None) -> Path:
    entries = snapshots.manifest_files(discover(spark, root), exclude).where("NOT excluded").select("root", "path", "snapshot_path", "kind").collect()
    return sinks.create_snapshot(Path(root), [r.asDict() for r in entries], Path(out), now)


def verify_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(checked, failed, ok) of a snapshot, with SQLite's own integrity check of its databases."""
    base = Path(folder)
    entries = sidecars.manifest_entries(sidecars.manifests(spark, str(base / "manifest.json")))
    found = files.walk(spark, str(base.resolve())).select(F.substr(F.regexp_replace("path", "^file:(//)?", ""), F.lit(len(str(base.resolve())) + 2)).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    checks = []
    for r in entries.where("kind = 'sqlite'").select("snapshot_path").collect():
        try:
            with sqlite.connect(str(sinks.inside(base, r["snapshot_path"]))) as con:
                checks.append((r["snapshot_path"], con.execute("PRAGMA integrity_check").fetchone()[0]))
        except (sqlite3.Error, ValueError) as problem:
            checks.append((r["snapshot_path"], str(problem)))
    integrity = spark.createDataFrame(checks, "path string, integrity string")
    return snapshots.verified(snapshots.entry_status(entries, found.join(integrity, "path", "left")))
