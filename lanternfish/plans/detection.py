"""Queries for scanning, verdicts, redaction and publication, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detect
from ..operators import chunks, redact, scan
from .seeds import FILES, PLAIN, TOOL_CALLS, view

EMAIL = detect.PATTERNS[13].regex
MASK = "CASE WHEN length({v}) <= 6 THEN repeat('*', length({v})) ELSE substr({v}, 1, 4) || '...' || right({v}, 4) END"
FP = "substr(sha256({v}), 1, 16)"


def _mask(v: str) -> str:
    one = f"split_part({v}, chr(10), 1)"
    return MASK.format(v=one)


def _re2(p: detect.Pattern) -> tuple[str, int]:
    """The pattern for DuckDB, and the group of the value."""
    if p.name == "posix_home_path":
        return r"(?:^|[^\w/.-])(/(?:home|Users)/[^\s\"'<>|]+)", 1
    return ("(?s)" if p.dotall else "") + p.regex, p.group


def _found(files: str, patterns=detect.PATTERNS) -> str:
    """CTEs ending in ``found``: file, category, pattern, value, line."""
    parts = []
    for p in patterns:
        rx, group = _re2(p)
        q = rx.replace("'", "''")
        if p.dotall:
            parts.append(
                f"""SELECT file, '{p.category}' AS category, '{p.name}' AS pattern, value, len(string_split(substr(text, 1, instr(text, value) - 1), chr(10))) AS line
  FROM (SELECT file, text, unnest(regexp_extract_all(text, '{q}', {group})) AS value FROM files)"""
            )
        else:
            parts.append(f"SELECT file, '{p.category}' AS category, '{p.name}' AS pattern, unnest(regexp_extract_all(l, '{q}', {group})) AS value, n AS line FROM lines")
    return f"""files AS ({files}),
lines AS (SELECT file, ls[n] AS l, n FROM (SELECT file, string_split(text, chr(10)) AS ls FROM files), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS n)),
found AS ({" UNION ALL ".join(parts)})"""


def _findings(files: str, patterns=detect.PATTERNS) -> str:
    return f"""WITH {_found(files, patterns)}
SELECT file, category, pattern, 'pattern' AS kind, 'text:line ' || CAST(line AS VARCHAR) AS location, {FP.format(v="value")} AS fingerprint, {_mask("value")} AS preview FROM found"""


COLUMNS = ["file", "category", "pattern", "kind", "location", "fingerprint", "preview"]
SECRET = "category IN (" + ", ".join(f"'{c}'" for c in detect.BLOCKING) + ")"


def scan_email(spark, sf):
    files = view(spark, sf, PLAIN)
    return scan.text_findings(files).where("pattern = 'email'").select(*COLUMNS)


def scan_all(spark, sf):
    return scan.text_findings(view(spark, sf, FILES)).select(*COLUMNS)


def verdict_summary(spark, sf):
    files = view(spark, sf, FILES)
    return scan.file_verdicts(files.select("file"), scan.text_findings(files))


VERDICTS = f"""WITH {_found(FILES)},
counts AS (SELECT file, count(*) AS findings, count(*) FILTER ({SECRET}) AS secrets FROM found GROUP BY file),
met AS (SELECT f.file, coalesce(c.findings, 0) AS findings, coalesce(c.secrets, 0) AS secrets FROM files f LEFT JOIN counts c USING (file))
SELECT file, findings, secrets, CASE WHEN secrets > 0 THEN 'BLOCKED' WHEN findings > 0 THEN 'REVIEW' ELSE 'CLEAN' END AS status,
  CASE WHEN findings = 0 THEN 0 ELSE 1 END AS verify_code, CASE WHEN secrets > 0 THEN 1 ELSE 0 END AS gate_code FROM met"""


def category_counts(spark, sf):
    return scan.by_category(scan.text_findings(view(spark, sf, FILES)))


def scan_report(spark, sf):
    files = view(spark, sf, FILES)
    typed = files.select("file", F.when(F.col("doc_id") % 10 == 9, "binary").otherwise("text").alias("type"), "text")
    made = scan.report(typed, scan.text_findings(typed.where("type = 'text'")))
    return made.withColumn("by_category", F.to_json("by_category"))


REPORT = f"""WITH {_found(FILES)}, kept AS (SELECT * FROM found WHERE file IN (SELECT file FROM files WHERE doc_id % 10 <> 9)),
counts AS (SELECT category, count(*) AS n FROM kept GROUP BY category)
SELECT (SELECT count(*) FROM files WHERE doc_id % 10 <> 9) AS files_scanned, (SELECT count(*) FROM files WHERE doc_id % 10 = 9) AS binaries,
  CAST((SELECT sum(n) FROM counts) AS BIGINT) AS findings, CAST((SELECT sum(n) FROM counts WHERE {SECRET}) AS BIGINT) AS secrets,
  (SELECT '{{' || string_agg('"' || category || '":' || CAST(n AS VARCHAR), ',' ORDER BY category) || '}}' FROM counts) AS by_category, 'BLOCKED' AS publication_status"""


def redact_email(spark, sf):
    """Whole texts are rewritten; their digest stands for them."""
    made = redact.redact_texts(view(spark, sf, PLAIN))
    return made.select("file", F.sha2("new_text", 256).alias("new_sha256"), F.size("edits").cast("bigint").alias("n_edits"))


REDACT_EMAIL = f"""WITH files AS ({PLAIN}),
cut AS (SELECT file, text, regexp_extract_all(text, '{EMAIL}') AS ms, string_split_regex(text, '{EMAIL}') AS ps FROM files)
SELECT file, sha256(array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || CASE WHEN i <= len(ms) THEN '<REDACTED:' || substr(sha256(ms[i]), 1, 16) || '>' ELSE '' END), '')) AS new_sha256,
  CAST(len(ms) AS BIGINT) AS n_edits FROM cut"""


def redact_edits(spark, sf):
    """Edits of all patterns over the seeded files, one a row."""
    return redact.edit_rows(redact.redact_texts(view(spark, sf, FILES)))


REDACT_EDITS = f"""WITH {_found(FILES)}
SELECT file, 'text' AS location, category, CAST(line AS INTEGER) AS line, {FP.format(v="value")} AS fingerprint FROM found"""


def semantic_reads(spark, sf):
    calls = view(spark, sf, TOOL_CALLS).withColumn("file", F.lit("store.db"))
    return scan.semantic_findings(calls).select("location", "fingerprint", "preview", "reason", "target")


SEMANTIC = f"""SELECT 'tool_call_state.tool_call_update_json#rowid=' || CAST(rowid AS VARCHAR) AS location, {FP.format(v="tool_call_update_json")} AS fingerprint, {_mask("tool_call_update_json")} AS preview,
  CASE rowid % 7 WHEN 2 THEN 'tool input ''path'' targets a sensitive file' WHEN 4 THEN 'tool input ''query'' targets a sensitive file' ELSE 'shell command reads a sensitive file' END AS reason,
  CASE rowid % 7 WHEN 0 THEN '/srv/app/.env' WHEN 2 THEN '/home/u/.ssh/config' WHEN 4 THEN 'deploy/server.pem' ELSE 'my_secrets.txt' END AS target
FROM ({TOOL_CALLS}) WHERE rowid % 7 IN (0, 2, 4, 5) AND tool_call_update_json IS NOT NULL AND tool_call_update_json NOT LIKE '%<REDACTED:%'"""

WORKDIRS = """SELECT 'store.db' AS file, o_orderkey AS rowid, CASE o_orderkey % 4 WHEN 0 THEN '/work/' || lower(o_orderpriority) || '/p' || CAST(o_custkey AS STRING) WHEN 1 THEN 'C:' || chr(92) || 'src' || chr(92) || 'q' || CAST(o_custkey AS STRING) || chr(92)
  WHEN 2 THEN '/work/<REDACTED:x>' ELSE NULL END AS working_directory FROM orders"""


def project_names(spark, sf):
    return scan.metadata_findings(view(spark, sf, WORKDIRS)).select("category", "pattern", "kind", "location", "fingerprint", "preview")


PROJECTS = f"""WITH v AS (SELECT rowid, regexp_extract(regexp_replace(replace(working_directory, chr(92), '/'), '/+$', ''), '([^/]*)$', 1) AS v FROM ({WORKDIRS}) WHERE working_directory IS NOT NULL AND NOT contains(working_directory, '<REDACTED:'))
SELECT 'project_name' AS category, 'working_directory' AS pattern, 'metadata' AS kind, 'sessions.working_directory#rowid=' || CAST(rowid AS VARCHAR) AS location, {FP.format(v="v")} AS fingerprint, {MASK.format(v="v")} AS preview FROM v WHERE v <> ''"""

CELLS = f"""SELECT 'store.db' AS file, 'message_nodes.chat_message#rowid=' || CAST(doc_id AS STRING) AS location,
  '{{"z":"' || CASE WHEN doc_id % 3 = 0 THEN 'mail m' || CAST(doc_id AS STRING) || '@example.org now' ELSE 'none' END || '","a":["m' || CAST(doc_id AS STRING) || '@example.org","x",{{"n":' || CAST(doc_id AS STRING) || '}}],"k@example.org":1}}' AS value, doc_id FROM documents"""


def json_cells(spark, sf):
    """One finding a cell: the first leaf that holds the address; keys are not scanned."""
    return scan.cell_findings(view(spark, sf, CELLS)).select(*COLUMNS)


JSON_CELLS = f"""SELECT file, 'email' AS category, 'email' AS pattern, 'pattern' AS kind, location || ':line 1' AS location, {FP.format(v="v")} AS fingerprint, {MASK.format(v="v")} AS preview
FROM (SELECT file, location, 'm' || CAST(doc_id AS VARCHAR) || '@example.org' AS v FROM ({CELLS}))"""

SPLITS = """SELECT 'store.db' AS file, 'message_nodes' AS tab, conv_id * 1000 + turn AS rowid, CAST(conv_id AS STRING) AS session_id,
  CASE WHEN turn % 2 = 0 THEN coalesce(text, '') || ' use AK' || 'IA' || upper(substr(md5(CAST(conv_id AS STRING)), 1, 6)) ELSE upper(substr(md5(CAST(conv_id AS STRING)), 7, 10)) || ' then ' || coalesce(text, '') END AS chat_message FROM conversations"""


def cross_rows(spark, sf):
    """A key split over two turns of a conversation is found in neither, but across them."""
    made = chunks.units(view(spark, sf, SPLITS), ["chat_message"])
    return chunks.across_rows(made).where("category = 'api_key'").select("file", "category", "pattern", "kind", "location", "fingerprint", "combined_with")


CROSS = f"""WITH r AS ({SPLITS}), n AS (SELECT rowid, session_id, lead(rowid) OVER w AS nxt, lead(session_id) OVER w AS nxt_session FROM r WINDOW w AS (ORDER BY rowid))
SELECT 'store.db' AS file, 'api_key' AS category, 'aws_access_key_id' AS pattern, 'cross-chunk' AS kind, 'message_nodes.chat_message#rowid=' || CAST(rowid AS VARCHAR) AS location,
  substr(sha256('AK' || 'IA' || upper(substr(md5(session_id), 1, 16))), 1, 16) AS fingerprint, 'message_nodes.chat_message#rowid=' || CAST(nxt AS VARCHAR) AS combined_with
FROM n WHERE nxt_session = session_id AND rowid % 2 = 0"""

def cross_rows_scoped(spark, sf):
    """The same for each session by itself: its rows are neighbours whatever lies between."""
    rows = view(spark, sf, SPLITS.replace("conv_id * 1000 + turn AS rowid", "turn * CAST(1000000 AS BIGINT) + conv_id AS rowid"))
    return chunks.across_rows(chunks.units(rows, ["chat_message"]), scoped=True).where("category = 'api_key'").select("location", "fingerprint", "combined_with")


SCOPED = f"""WITH r AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT 'message_nodes.chat_message#rowid=' || CAST(turn * CAST(1000000 AS BIGINT) + conv_id AS VARCHAR) AS location, substr(sha256('AK' || 'IA' || upper(substr(md5(CAST(conv_id AS VARCHAR)), 1, 16))), 1, 16) AS fingerprint,
  'message_nodes.chat_message#rowid=' || CAST(nxt * CAST(1000000 AS BIGINT) + conv_id AS VARCHAR) AS combined_with FROM r WHERE turn % 2 = 0 AND nxt IS NOT NULL"""

LEAVES = """SELECT 'store.db' AS file, 'tool_call_state' AS tab, event_id AS rowid, CAST(user_id AS STRING) AS session_id,
  '{"type":"text","parts":["start gh' || 'p_' || substr(md5(CAST(event_id AS STRING)), 1, 12) || '","' || substr(md5(CAST(event_id AS STRING)), 13, 16) || ' end"]}' AS tool_call_json, CAST(NULL AS STRING) AS tool_call_update_json FROM events"""


def cross_leaves(spark, sf):
    """A token split over two leaves of one payload."""
    made = chunks.units(view(spark, sf, LEAVES), ["tool_call_json", "tool_call_update_json"])
    return chunks.inside_units(made).where("category = 'github_token'").select("category", "pattern", "kind", "location", "fingerprint")


CROSS_LEAVES = f"""SELECT 'github_token' AS category, 'github_token' AS pattern, 'cross-chunk' AS kind, 'tool_call_state.tool_call_json+tool_call_update_json#rowid=' || CAST(rowid AS VARCHAR) AS location,
  substr(sha256('gh' || 'p_' || substr(md5(CAST(rowid AS VARCHAR)), 1, 28)), 1, 16) AS fingerprint FROM ({LEAVES})"""


def sarif(spark, sf):
    made = scan.sarif_results(scan.text_findings(view(spark, sf, FILES)))
    return made.select("file", "fingerprint", "level", F.col("start_line").cast("int"), F.get_json_object("result", "$.ruleId").alias("rule"), F.get_json_object("result", "$.message.text").alias("message"))


SARIF = f"""WITH {_found(FILES)}
SELECT file, {FP.format(v="value")} AS fingerprint, CASE WHEN {SECRET} THEN 'error' ELSE 'warning' END AS level, CAST(line AS INTEGER) AS start_line, category AS rule, 'match: ' || replace(pattern, '_', ' ') AS message FROM found"""

QUERIES = {
    "scan_email": scan_email,
    "scan_all_detectors": scan_all,
    "verdict_summary": verdict_summary,
    "category_counts": category_counts,
    "scan_report": scan_report,
    "redact_email": redact_email,
    "redact_edits": redact_edits,
    "semantic_reads": semantic_reads,
    "project_names": project_names,
    "json_cells": json_cells,
    "cross_chunk_rows": cross_rows,
    "cross_chunk_scoped": cross_rows_scoped,
    "cross_chunk_leaves": cross_leaves,
    "sarif_results": sarif,
}
ORACLES = {
    "scan_email": _findings(PLAIN, (detect.PATTERNS[13],)),
    "scan_all_detectors": _findings(FILES),
    "verdict_summary": VERDICTS,
    "category_counts": f"WITH {_found(FILES)} SELECT category, count(*) AS findings FROM found GROUP BY category",
    "scan_report": REPORT,
    "redact_email": REDACT_EMAIL,
    "redact_edits": REDACT_EDITS,
    "semantic_reads": SEMANTIC,
    "project_names": PROJECTS,
    "json_cells": JSON_CELLS,
    "cross_chunk_rows": CROSS,
    "cross_chunk_scoped": SCOPED,
    "cross_chunk_leaves": CROSS_LEAVES,
    "sarif_results": SARIF,
}
