"""What is written: reports, verdicts, logs, rewritten datasets and snapshots.

Data goes through Spark's writers; the few actions on single files (copying a
store, removing a folder) are driver functions that act on a plan already made.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import sqlite3
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.snapshots import NAME, PRE_RESTORE
from .sqlite import connect, quoted, schema_version


# The tables whose rows belong to a session.
SESSION_TABLES = ("message_nodes", "tool_call_state", "prompt_history", "rendered_commits", "subagent_heads")


def write_report(report: DataFrame, path: str) -> None:
    """One-row report as JSON."""
    report.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_log(entries: DataFrame, path: str) -> None:
    """Audit entries, appended as JSON lines."""
    entries.write.mode("append").json(path)


def audit_entry(actions: DataFrame, judge: str, extra: dict[str, int] | None = None) -> DataFrame:
    """One row: when, who judged, and how many sessions met which fate."""
    n = lambda a: F.count_if(F.col("action") == a)
    more = [F.lit(v).alias(k) for k, v in (extra or {}).items()]
    return actions.agg(n("delete").alias("deleted"), n("keep").alias("kept"), n("judge-down").alias("judge_down")).select(F.current_timestamp().alias("ts"), F.lit(judge).alias("judge"), "*", *more)


def swap_in(df: DataFrame, path: str) -> None:
    """Replace a dataset by a new one: written beside it first, the old one kept as ``.bak``."""
    new, old = f"{path}.new", f"{path}.bak"
    df.write.mode("overwrite").parquet(new)
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(old), True)
    if fs.exists(hadoop(path)) and not fs.rename(hadoop(path), hadoop(old)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(hadoop(new), hadoop(path)):
        fs.rename(hadoop(old), hadoop(path))
        raise OSError(f"cannot put {new} in place; the old data are back")


def save_pending(queue: dict[str, int], path: str) -> None:
    """A pending queue as JSON; an empty one has no file."""
    if queue:
        Path(path).write_text(json.dumps(queue, sort_keys=True))
    else:
        Path(path).unlink(missing_ok=True)


def file_sha256(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def create_snapshot(root: Path, entries: list[dict], out: Path, now: float | None = None) -> Path:
    """Copy planned stores (path, snapshot_path, kind) into a new dated folder with a manifest.

    Databases are copied by SQLite's own backup, others as files.  A failure
    removes the folder.
    """
    name = datetime.fromtimestamp(time.time() if now is None else now, UTC).strftime("%Y%m%dT%H%M%SZ")
    target, n = out / name, 1
    while target.exists():
        n += 1
        target = out / f"{name}-{n}"
    target.mkdir(parents=True, mode=0o700)
    try:
        files = []
        for e in entries:
            src, dst = root / e["path"], target / e["snapshot_path"]
            dst.parent.mkdir(parents=True, exist_ok=True)
            how = "copy"
            if e["kind"] == "sqlite":
                try:
                    with connect(str(src)) as a, sqlite3.connect(dst) as b:
                        a.backup(b)
                    how = "backup"
                except sqlite3.Error:
                    shutil.copy2(src, dst)
            else:
                shutil.copy2(src, dst)
            os.chmod(dst, 0o600)
            version = schema_version(str(dst)) if e["kind"] == "sqlite" else None
            files.append({**e, "root": e.get("root", "data"), "copied_via": how, "size": dst.stat().st_size, "sha256": file_sha256(dst), "schema_version": version})
        stamp = datetime.fromtimestamp(time.time() if now is None else now, UTC).isoformat().replace("+00:00", "Z")
        versions = {f["snapshot_path"]: f["schema_version"] for f in files if f["schema_version"] is not None}
        (target / "manifest.json").write_text(json.dumps({"manifest_version": 2, "created_at": stamp, "files": files, "schema_versions": versions}, indent=1))
    except BaseException:
        shutil.rmtree(target, ignore_errors=True)
        raise
    return target


def inside(base: Path, rel: str) -> Path:
    """``rel`` under ``base``; anything that climbs out is refused."""
    full = (base / rel).resolve()
    if full == base.resolve() or not full.is_relative_to(base.resolve()):
        raise ValueError(f"{rel!r} is not inside {base}")
    return full


def restore(snapshot: Path, target: Path, dry_run: bool = True, backup: bool = True) -> list[tuple[str, str]]:
    """(path, action) of a restore; what would be overwritten is kept in a folder of its own first."""
    entries = json.loads((snapshot / "manifest.json").read_text())["files"]
    plan = [(inside(snapshot, e.get("snapshot_path") or e["path"]), inside(target, e["path"]), e["path"]) for e in entries]
    there = [d for _, d, _ in plan if d.exists()]
    if not dry_run:
        if there and not backup:
            raise ValueError("would overwrite files without a backup")
        if there:
            safe = snapshot.parent / f"{PRE_RESTORE}{int(time.time() * 1000)}"
            for d in there:
                kept = safe / d.relative_to(target.resolve())
                kept.parent.mkdir(parents=True, exist_ok=True)
                shutil.copy2(d, kept)
        for src, dst, _ in plan:
            dst.parent.mkdir(parents=True, exist_ok=True)
            part = dst.with_name(dst.name + ".part")
            shutil.copy2(src, part)
            os.replace(part, dst)
    return [(rel, ("would_overwrite" if d in there else "would_write") if dry_run else "written") for _, d, rel in plan]


def copy_to(snapshot: Path, parent: Path) -> Path:
    """A verified copy of a snapshot; a copy that differs is removed."""
    target = parent / snapshot.name
    if target.exists():
        raise FileExistsError(target)
    shutil.copytree(snapshot, target)
    for e in json.loads((target / "manifest.json").read_text())["files"]:
        if file_sha256(inside(target, e.get("snapshot_path") or e["path"])) != e["sha256"]:
            shutil.rmtree(target)
            raise ValueError(f"copy of {e['path']} differs")
    return target


def rotate(folder: Path, names: list[str]) -> list[str]:
    """Remove the planned snapshots; only folders with a snapshot's name and a manifest go."""
    gone = []
    for n in names:
        p = folder / n
        if re.match(NAME, n) and (p / "manifest.json").is_file():
            shutil.rmtree(p)
            gone.append(n)
    return gone


def delete_files(paths: list[Path], queue: dict[str, int], session_id: str, now: int) -> bool:
    """Remove a session's files; if one cannot go, the session waits in the queue."""
    try:
        for p in paths:
            p.unlink(missing_ok=True)
    except OSError:
        queue.setdefault(session_id, now)
        return False
    queue.pop(session_id, None)
    return True


def session_files(folder: Path, session_id: str) -> list[Path]:
    """The database, sidecars and lock of a session; its id is no pattern."""
    own = [p for p in sorted(folder.iterdir()) if p.is_file()] if folder.is_dir() else []
    return [p for p in own if p.name.startswith(f"{session_id}.db") or p.name == f"{session_id}.lock"]


def retry_pending(folder: Path, queue: dict[str, int], now: int) -> dict[str, int]:
    """Try every waiting session again; those whose files went leave the queue, the others keep their first time."""
    for session_id in list(queue):
        delete_files(session_files(folder, session_id), queue, session_id, now)
    return queue


def apply_deletions(db: str, folder: Path, targets: list[tuple[str, str]], queue: dict[str, int], now: int) -> dict[str, int]:
    """Delete the rows and files of (id, origin) sessions, then retry what waits; counts of what went and what still waits."""
    rows = delete_session_rows(db, [i for i, _ in targets])
    gone = 0
    for session_id, origin in targets:
        files = session_files(folder, session_id)
        if files or origin == "gui":
            gone += delete_files(files, queue, session_id, now)
    return {"cli_rows": rows, "gui_sessions": gone, "still_locked": len(retry_pending(folder, queue, now))}


def unlink_planned(folder: Path, names: list[str]) -> tuple[int, int]:
    """Remove leftovers or locks by name; (files, bytes) that went.  What cannot go stays for the next run."""
    files = size = 0
    for n in names:
        path = inside(folder, n)
        try:
            own = path.stat().st_size
            path.unlink()
        except OSError:
            continue
        files, size = files + 1, size + own
    return files, size


def delete_orphans(db: str, tables: tuple[str, ...] = SESSION_TABLES) -> int:
    """Delete rows whose session is not there, in one transaction; tables that are absent are skipped."""
    con = sqlite3.connect(db, timeout=30)
    try:
        with con:
            have = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
            return sum(con.execute(f"DELETE FROM {quoted(t)} WHERE session_id NOT IN (SELECT id FROM sessions)").rowcount for t in tables if t in have)
    finally:
        con.close()


def delete_keys(db: str, keys: list[str], table: str = "ItemTable") -> int:
    """Delete planned state keys in one transaction and compact the store, if that can be done."""
    con = sqlite3.connect(db, timeout=30)
    try:
        with con:
            gone = sum(con.execute(f"DELETE FROM {quoted(table)} WHERE key = ?", (k,)).rowcount for k in keys)
        try:
            con.execute("PRAGMA wal_checkpoint(TRUNCATE)")
            con.execute("VACUUM")
        except sqlite3.Error:
            pass  # the keys are gone; the space can wait
        return gone
    finally:
        con.close()


def delete_session_rows(db: str, session_ids: list[str], tables: tuple[str, ...] = SESSION_TABLES) -> int:
    """Delete sessions and their rows from a store in one transaction; tables that are absent are skipped."""
    con = sqlite3.connect(db, timeout=30)
    try:
        with con:
            have = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
            gone = 0
            for sid in session_ids:
                for t in tables:
                    if t in have:
                        con.execute(f'DELETE FROM "{t}" WHERE session_id = ?', (sid,))
                gone += con.execute("DELETE FROM sessions WHERE id = ?", (sid,)).rowcount
        return gone
    finally:
        con.close()


def vacuum(db: str, running: bool, locked: bool, version: int | None, supported: tuple[int, ...]) -> bool:
    """Compact a store, only if nothing runs, nothing is locked and its version is known."""
    if running or locked or version not in supported:
        return False
    con = sqlite3.connect(db, timeout=30)
    try:
        con.execute("PRAGMA wal_checkpoint(TRUNCATE)")
        con.execute("VACUUM")
    finally:
        con.close()
    return True
