"""Queries for snapshots, publication and the small functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import publish, snapshots
from ..sources import files
from .detection import SECRET, _found
from .seeds import FILES, NOW, view

#: A manifest of documents as stores; some entries are damaged on purpose.
ENTRY = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'config' ELSE 'data' END AS root,
  CASE WHEN doc_id % 97 = 1 THEN '../out/' ELSE 'd/' END || CAST(doc_id AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '.db' ELSE '.md' END AS path,
  CASE WHEN doc_id % 97 = 1 THEN '../out/' ELSE 's/' END || CAST(doc_id AS STRING) AS snapshot_path, CASE WHEN doc_id % 3 = 0 THEN 'sqlite' ELSE 'file' END AS kind,
  CAST(length(coalesce(text, '')) AS BIGINT) AS size, md5(coalesce(text, '')) AS sha256 FROM documents"""
MANIFEST = f"SELECT * FROM ({ENTRY}) WHERE doc_id % 4 <> 0"
IN_SNAPSHOT = f"""SELECT doc_id, root, path AS entry, 's/' || CAST(doc_id AS STRING) AS path, CASE WHEN doc_id % 13 = 2 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 11 = 3 THEN 'x' ELSE sha256 END AS sha256,
  CASE WHEN doc_id % 17 = 5 THEN 'corrupt' ELSE 'ok' END AS integrity, CASE WHEN doc_id % 3 = 0 THEN sha256 END AS content FROM ({ENTRY}) WHERE doc_id % 7 <> 6"""
LIVE = f"SELECT root, path, CASE WHEN doc_id % 8 = 1 THEN size + 10 ELSE size END AS size, CASE WHEN doc_id % 8 = 1 THEN 'y' ELSE sha256 END AS sha256, CASE WHEN doc_id % 3 = 0 THEN sha256 END AS content FROM ({ENTRY}) WHERE doc_id % 9 <> 4"
SHOWN = "CASE WHEN root = 'config' THEN 'config/' ELSE '' END || path"


def snapshot_verify(spark, sf):
    return snapshots.entry_status(view(spark, sf, MANIFEST), view(spark, sf, IN_SNAPSHOT).select("path", "size", "sha256", "integrity"))


VERIFY = f"""SELECT CASE WHEN m.root = 'config' THEN 'config/' ELSE '' END || m.path AS path, CASE WHEN m.doc_id % 97 = 1 THEN 'invalid-path' WHEN s.doc_id IS NULL THEN 'missing' WHEN s.sha256 <> m.sha256 THEN 'sha256-mismatch'
  WHEN s.size <> m.size THEN 'size-mismatch' WHEN m.kind = 'sqlite' AND s.integrity <> 'ok' THEN 'integrity-failed' ELSE 'ok' END AS status FROM ({MANIFEST}) m LEFT JOIN ({IN_SNAPSHOT}) s ON m.doc_id = s.doc_id"""


def snapshot_verified(spark, sf):
    return snapshots.verified(snapshot_verify(spark, sf))


HEADERS = f"""SELECT 'snap-' || CAST(n_nationkey AS STRING) AS name, CASE WHEN n_nationkey % 6 = 5 THEN 9 ELSE 2 END AS manifest_version,
  CASE n_nationkey % 5 WHEN 0 THEN '2024-01-30T12:00:00Z' WHEN 1 THEN CAST({NOW} - 3600 AS STRING) WHEN 2 THEN '2024-01-28T00:00:00' WHEN 3 THEN '2024-01-31T02:00:00+02:00' ELSE 'yesterday' END AS created_at FROM nation"""
GATE_ENTRIES = """SELECT 'snap-' || CAST(s_nationkey AS STRING) AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'g/state.vscdb' WHEN s_suppkey % 3 = 1 THEN 'g/state.vscdb.old' ELSE 'x.db' END AS path, 'f' || CAST(s_suppkey AS STRING) AS snapshot_path,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey END AS size, CAST(s_suppkey AS STRING) AS sha256 FROM supplier"""
GATE_FILES = "SELECT 'snap-' || CAST(s_nationkey AS STRING) AS name, 'f' || CAST(s_suppkey AS STRING) AS path, CASE WHEN s_suppkey % 16 = 7 THEN 0 ELSE s_suppkey END AS size, CAST(s_suppkey AS STRING) AS sha256 FROM supplier"


def deletion_gate(spark, sf):
    return snapshots.deletion_gate(view(spark, sf, HEADERS), view(spark, sf, GATE_ENTRIES), view(spark, sf, GATE_FILES), NOW)


GATE = f"""WITH h AS ({HEADERS}), e AS ({GATE_ENTRIES}), f AS ({GATE_FILES}),
per AS (SELECT e.name, count(*) AS checked, count(*) FILTER (NOT (f.path IS NOT NULL AND coalesce(e.size = f.size, true) AND coalesce(e.sha256 = f.sha256, true))) AS failed,
  bool_or(e.path = 'state.vscdb' OR ends_with(e.path, '/state.vscdb')) AS covered FROM e LEFT JOIN f ON e.name = f.name AND e.snapshot_path = f.path GROUP BY e.name),
a AS (SELECT h.name, manifest_version, {NOW} - CASE created_at WHEN '2024-01-30T12:00:00Z' THEN 1706616000 WHEN '2024-01-28T00:00:00' THEN 1706400000 WHEN '2024-01-31T02:00:00+02:00' THEN 1706659200 WHEN 'yesterday' THEN NULL ELSE {NOW} - 3600 END AS age,
  coalesce(checked, 0) AS checked, coalesce(failed, 0) AS failed, coalesce(covered, false) AS covered FROM h LEFT JOIN per USING (name)),
r AS (SELECT *, CASE WHEN manifest_version NOT IN (1, 2) THEN 'unsupported manifest version' WHEN age IS NULL THEN 'no usable created_at' WHEN age > 86400 THEN 'too old' WHEN NOT covered THEN 'not covered' WHEN failed > 0 THEN 'files failed' END AS reason FROM a)
SELECT name, reason IS NULL AS ok, reason, checked, failed FROM r"""


def snapshot_diff(spark, sf):
    snap = view(spark, sf, IN_SNAPSHOT).select("root", F.col("entry").alias("path"), "content")
    return snapshots.compare(view(spark, sf, MANIFEST), snap, view(spark, sf, LIVE))


DIFF = f"""WITH m AS (SELECT m.*, s.doc_id IS NOT NULL AS in_snap, s.content AS sc FROM ({MANIFEST}) m LEFT JOIN ({IN_SNAPSHOT}) s ON m.doc_id = s.doc_id),
j AS (SELECT coalesce(m.root, l.root) AS root, coalesce(m.path, l.path) AS path, m.path IS NOT NULL AS listed, in_snap, l.path IS NOT NULL AS in_live, m.kind, m.size, m.sha256, l.size AS ls, l.sha256 AS lsha, sc, l.content AS lc
  FROM m FULL OUTER JOIN ({LIVE}) l ON m.root = l.root AND m.path = l.path),
t AS (SELECT *, CASE WHEN NOT listed THEN 'live-only' WHEN NOT in_snap THEN 'snapshot-missing' WHEN NOT in_live THEN 'snapshot-only' WHEN CASE WHEN kind = 'sqlite' AND sc IS NOT NULL AND lc IS NOT NULL THEN sc = lc ELSE lsha IS NOT DISTINCT FROM sha256 END THEN 'same' ELSE 'different' END AS status FROM j)
SELECT {SHOWN} AS path, status, CASE WHEN status IN ('same', 'different') THEN ls - size END AS size_delta, CASE WHEN status IN ('same', 'different') THEN lsha IS NOT DISTINCT FROM sha256 END AS bytes_equal FROM t"""


def drift_summary(spark, sf):
    return snapshots.drift(snapshot_diff(spark, sf))


def table_count_diff(spark, sf):
    a = view(spark, sf, "SELECT source AS tab, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY source")
    b = view(spark, sf, "SELECT source AS tab, count(*) AS n FROM documents WHERE doc_id % 50 <> 7 AND source <> 'src5' GROUP BY source")
    return snapshots.compare_counts(a, b)


COUNTS = """SELECT coalesce(a.tab, b.tab) AS tab, a.n AS snapshot_n, b.n AS live_n FROM (SELECT source AS tab, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY source) a
FULL OUTER JOIN (SELECT source AS tab, count(*) AS n FROM documents WHERE doc_id % 50 <> 7 AND source <> 'src5' GROUP BY source) b ON a.tab = b.tab WHERE a.n IS DISTINCT FROM b.n"""


def content_digest(spark, sf):
    return snapshots.content_digest(view(spark, sf, "SELECT o_orderstatus, o_orderkey, o_custkey, o_orderpriority FROM orders"), "o_orderstatus")


DIGEST = """SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT o_orderstatus,
  CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority), 1, 15) AS BIGINT) AS h FROM orders) GROUP BY o_orderstatus"""


def file_digests(spark, sf):
    return view(spark, sf, "SELECT doc_id, encode(coalesce(text, ''), 'UTF-8') AS content FROM documents").select("doc_id", F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("bytes"))


SNAPS = """SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'pre-restore-' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 9 = 1 THEN 'copy-' || CAST(o_orderkey AS STRING) ELSE '202401' || lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0') || 'T' || lpad(CAST(o_orderkey AS STRING), 6, '0') || 'Z' || CASE WHEN o_orderkey % 9 = 2 THEN '-2' ELSE '' END END AS name,
  CASE WHEN o_orderkey % 9 = 3 THEN 'pre-restore' END AS kind, CAST(o_orderdate AS DATE) AS created_at, o_orderkey, o_custkey FROM orders"""


def snapshot_listing(spark, sf):
    made = view(spark, sf, SNAPS).withColumn("sizes", F.array("o_orderkey", "o_custkey", F.lit(None).cast("bigint")))
    return snapshots.listing(made).select("name", "kind", "files", "size")


KIND = "CASE WHEN starts_with(name, 'pre-restore-') OR coalesce(kind = 'pre-restore', false) THEN 'pre-restore' WHEN regexp_matches(name, '^\\d{8}T\\d{6}Z(-\\d+)?$') THEN 'snapshot' ELSE 'unknown' END"


def rotation_plan(spark, sf):
    return snapshots.rotation(snapshot_listing(spark, sf), 10)


def restore_plan(spark, sf):
    made = view(spark, sf, MANIFEST).withColumn("schema_version", F.when(F.col("kind") == "sqlite", F.lit(3)))
    current = view(spark, sf, f"SELECT path, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 4 END AS schema_version FROM ({ENTRY}) WHERE kind = 'sqlite'")
    return snapshots.restore_plan(made, view(spark, sf, LIVE), current)


RESTORE = f"""SELECT CASE WHEN m.root = 'config' THEN 'config/' ELSE '' END || m.path AS path, CASE WHEN m.doc_id % 97 = 1 THEN 'refused' WHEN l.path IS NOT NULL THEN 'would_overwrite' ELSE 'would_write' END AS action,
  CASE WHEN m.kind = 'sqlite' AND m.doc_id % 2 = 1 THEN 'schema version differs' END AS warning FROM ({MANIFEST}) m LEFT JOIN ({LIVE}) l ON m.root = l.root AND m.path = l.path"""
TREE = """SELECT CASE WHEN page_id % 4 = 0 THEN 'config' ELSE 'data' END AS root, CASE page_id % 8 WHEN 0 THEN 'a/x' || CAST(page_id AS STRING) || '.db' WHEN 1 THEN 'a/x.db-wal' WHEN 2 THEN '.agent/c' || CAST(page_id AS STRING) || '.toml' WHEN 3 THEN 'globalStorage/state.vscdb'
  WHEN 4 THEN 'notes/n.md' WHEN 5 THEN 'backups/y' || CAST(page_id AS STRING) || '.db' WHEN 6 THEN 'k/server' || CAST(page_id AS STRING) || '.DB' ELSE '.agent/id.pem' END AS path FROM pages"""


def store_discovery(spark, sf):
    found = snapshots.discover(view(spark, sf, TREE), excluded_dirs=["backups"]).withColumns({"size": F.lit(0), "sha256": F.lit("")})
    return snapshots.manifest_files(found, snapshots.SENSITIVE).select("root", "path", "snapshot_path", "kind", "excluded")


DISCOVERY = f"""SELECT DISTINCT root, path, CASE WHEN root = 'config' THEN 'config/' ELSE '' END || path AS snapshot_path, CASE WHEN lower(path) LIKE '%.db' OR path LIKE '%.vscdb' THEN 'sqlite' ELSE 'file' END AS kind,
  path = 'globalStorage/state.vscdb' OR path LIKE '%.pem' AS excluded FROM ({TREE}) WHERE path NOT LIKE '%-wal' AND path NOT LIKE 'backups/%' AND path <> 'notes/n.md'"""

EXPORTS = """SELECT doc_id, 'e/2024-01-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || '_h' || CAST(doc_id AS STRING) || '.md' AS file, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'session_id: s' || CAST(doc_id AS STRING) || chr(10) END AS front FROM documents"""
HOOKS = "SELECT CASE WHEN doc_id % 4 = 0 THEN 'h' ELSE 's' END || CAST(doc_id AS STRING) AS session_id, CASE WHEN quality = 0 THEN 'BLOCKED' WHEN toxic = 1 THEN 'REVIEW' ELSE 'CLEAN' END AS hook_status FROM labels"


def gated(spark, sf):
    entries = view(spark, sf, EXPORTS)
    texts = view(spark, sf, FILES).select("doc_id", F.col("text").alias("body")).join(entries, "doc_id").where("doc_id % 31 <> 9").select("file", F.concat("front", "body").alias("text"))
    return publish.gate(entries.select("file", F.lit(None).cast("string").alias("title")), texts, view(spark, sf, HOOKS))


def publish_gate(spark, sf):
    return gated(spark, sf).select("session_id", "file", "publication_status", "findings", "secrets", "hook_status", "warning")


GATED = f"""WITH {_found(FILES)}, e AS ({EXPORTS}), hooks AS ({HOOKS}),
counts AS (SELECT file, count(*) AS findings, count(*) FILTER ({SECRET}) AS secrets FROM found GROUP BY file),
g AS (SELECT CASE WHEN e.doc_id % 4 = 0 OR e.doc_id % 31 = 9 THEN 'h' ELSE 's' END || CAST(e.doc_id AS VARCHAR) AS session_id, e.file, e.doc_id % 31 = 9 AS missing, CASE WHEN e.doc_id % 31 = 9 THEN 0 ELSE coalesce(findings, 0) END AS findings, CASE WHEN e.doc_id % 31 = 9 THEN 0 ELSE coalesce(secrets, 0) END AS secrets
  FROM e JOIN files f USING (doc_id) LEFT JOIN counts c ON c.file = f.file),
s AS (SELECT *, CASE WHEN missing THEN 'MISSING' WHEN secrets > 0 THEN 'BLOCKED' WHEN findings > 0 THEN 'REVIEW' ELSE 'CLEAN' END AS publication_status FROM g),
gated AS (SELECT s.session_id, s.file, publication_status, findings, secrets, hook_status, CASE WHEN missing THEN 'listed but missing' WHEN hook_status = 'BLOCKED' AND publication_status = 'CLEAN' THEN 'blocked by the hook but scans clean' END AS warning FROM s LEFT JOIN hooks USING (session_id))"""


def publish_overall(spark, sf):
    return publish.overall(gated(spark, sf))


OVERALL = f"""{GATED}, n AS (SELECT count(*) AS sessions_total, count(*) FILTER (publication_status = 'BLOCKED') AS sessions_blocked, count(*) FILTER (publication_status = 'REVIEW') AS sessions_review, count(*) FILTER (publication_status = 'MISSING') AS sessions_missing, count(warning) AS warnings FROM gated)
SELECT *, sessions_total - sessions_blocked - sessions_review AS sessions_clean, CASE WHEN sessions_blocked > 0 THEN 'BLOCKED' WHEN sessions_review > 0 OR warnings > 0 THEN 'REVIEW' ELSE 'CLEAN' END AS publication_status FROM n"""


def scalar_functions(spark, sf):
    """Sizes in units up to GB, as the SQL has them."""
    rows = view(spark, sf, "SELECT o_orderkey, o_custkey, o_orderdate, CAST(CASE WHEN o_orderkey % 10 = 3 THEN -1 ELSE 1 END * o_orderkey * o_custkey AS BIGINT) AS n FROM orders")
    return rows.select("o_orderkey", scalars.fmt_bytes(F.col("n"), "GB").alias("shown"), scalars.snapshot_name(F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 3).alias("name"), scalars.norm_title(F.concat(F.lit("A-"), F.col("o_orderkey").cast("string"), F.lit(" é!"))).alias("title"))


SCALARS = """WITH r AS (SELECT o_orderkey, o_orderdate, greatest(CASE WHEN o_orderkey % 10 = 3 THEN -1 ELSE 1 END * o_orderkey * o_custkey, 0) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS shown,
  strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || CASE WHEN o_orderkey % 3 > 0 THEN '-' || CAST(o_orderkey % 3 AS VARCHAR) ELSE '' END AS name, 'a' || CAST(o_orderkey AS VARCHAR) AS title FROM r"""

NAMED = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a/' || CAST(doc_id AS STRING) || '.DB' WHEN 1 THEN 'a.d/' || CAST(doc_id AS STRING) WHEN 2 THEN 'b/x.sqlite3' ELSE 'c/' || CAST(doc_id AS STRING) || '.md' END AS path,
  CASE doc_id % 5 WHEN 0 THEN 'SQLite format 3' || chr(0) WHEN 1 THEN 'x' || chr(0) ELSE '' END || coalesce(text, '') AS body FROM documents"""


def target_dispatch(spark, sf):
    rows = view(spark, sf, NAMED.replace("chr(0)", "'~NUL~'")).withColumn("body", F.replace("body", F.lit("~NUL~"), F.lit("\0")))
    return rows.select("doc_id", files.target_type(F.col("path"), F.encode("body", "UTF-8")).alias("type"))


DISPATCH = f"""SELECT doc_id, CASE WHEN regexp_matches(lower(path), '[^/]\\.(db|sqlite|sqlite3)$') OR starts_with(body, 'SQLite format 3~NUL~') THEN 'sqlite' WHEN contains(substr(body, 1, 8192), '~NUL~') THEN 'binary' ELSE 'text' END AS type FROM ({NAMED.replace("chr(0)", "'~NUL~'")})"""
NAMES = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2024-01-01_d' || CAST(doc_id AS STRING) || '.md' WHEN 1 THEN 'j' || CAST(doc_id AS STRING) || '.json' ELSE 'n.md' END AS name,
  CASE doc_id % 3 WHEN 1 THEN '{"session_id": "q' || CAST(doc_id AS STRING) || '"}' WHEN 2 THEN 'title' || chr(10) || 'session_id: m' || CAST(doc_id AS STRING) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS body FROM documents"""


def export_ids(spark, sf):
    return view(spark, sf, NAMES).select("doc_id", scalars.export_session_id(F.col("name"), F.col("body")).alias("session_id"))


EXPORT_IDS = f"""SELECT doc_id, coalesce(CASE WHEN lower(name) LIKE '%.json' AND json_valid(body) THEN nullif(json_extract_string(body, '$.session_id'), '') WHEN lower(name) LIKE '%.md' THEN nullif(regexp_extract(substr(body, 1, 4096), '(?m)^session_id:\\s*(\\S+)\\s*$', 1), '') END,
  nullif(regexp_extract(regexp_replace(name, '\\.[^./]+$', ''), '^\\d{{4}}-\\d{{2}}-\\d{{2}}_(.+)$', 1), '')) AS session_id FROM ({NAMES})"""

QUERIES = {
    "target_dispatch": target_dispatch,
    "export_ids": export_ids,
    "snapshot_verify": snapshot_verify,
    "snapshot_verified": snapshot_verified,
    "deletion_gate": deletion_gate,
    "snapshot_diff": snapshot_diff,
    "drift_summary": drift_summary,
    "table_count_diff": table_count_diff,
    "content_digest": content_digest,
    "file_digests": file_digests,
    "snapshot_listing": snapshot_listing,
    "rotation_plan": rotation_plan,
    "restore_plan": restore_plan,
    "store_discovery": store_discovery,
    "publish_gate": publish_gate,
    "publish_overall": publish_overall,
    "scalar_functions": scalar_functions,
}
ORACLES = {
    "target_dispatch": DISPATCH,
    "export_ids": EXPORT_IDS,
    "snapshot_verify": VERIFY,
    "snapshot_verified": f"SELECT count(*) AS checked, count(*) FILTER (status <> 'ok') AS failed, coalesce(bool_and(status = 'ok'), true) AS ok FROM ({VERIFY})",
    "deletion_gate": GATE,
    "snapshot_diff": DIFF,
    "drift_summary": f"WITH d AS ({DIFF}) SELECT status, count(*) AS files, (SELECT bool_and(status = 'same') FROM d) AS identical FROM d GROUP BY status",
    "table_count_diff": COUNTS,
    "content_digest": DIGEST,
    "file_digests": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents",
    "snapshot_listing": f"SELECT name, {KIND} AS kind, CAST(3 AS BIGINT) AS files, o_orderkey + o_custkey AS size FROM ({SNAPS})",
    "rotation_plan": f"SELECT name FROM (SELECT name, row_number() OVER (ORDER BY name DESC) AS n FROM ({SNAPS}) WHERE {KIND} = 'snapshot') WHERE n > 10",
    "restore_plan": RESTORE,
    "store_discovery": DISCOVERY,
    "publish_gate": f"{GATED} SELECT * FROM gated",
    "publish_overall": OVERALL,
    "scalar_functions": SCALARS,
}
