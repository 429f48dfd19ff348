"""Queries for side files, stores, decoding and rewriting, with their SQL.

The SQL reads what the rows hold (with DuckDB's own JSON and pattern functions)
rather than repeat the cases by which they were made.
"""

from __future__ import annotations

import os
import sqlite3
import uuid

from pyspark.sql import functions as F

from ..api import store_findings
from ..functions import detect, scalars
from ..operators import chunks, inventory, publish, redact, scan
from ..session import shared_dir
from ..sources import files, sidecars, sqlite
from . import sessions
from .detection import CELLS, FP, MASK, SECRET, _found
from .seeds import FILES, H, TOOL_CALLS, view

# ---- files ---------------------------------------------------------------------

RAW = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a/' ELSE 'b/' END || CAST(doc_id AS STRING) || '.md' AS path, coalesce(text, '') AS body FROM documents"
BYTES = {0: "ff", 1: "00", 2: "c3a9"}


def text_decoding(spark, sf):
    """Files with a byte in front that is not UTF-8, a NUL, or a letter of two bytes: read leniently and strictly."""
    lead = F.unhex(F.element_at(F.create_map(*[F.lit(x) for kv in BYTES.items() for x in kv]), (F.col("doc_id") % 3).cast("int")))
    found = view(spark, sf, RAW).select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.concat(lead, F.encode("body", "UTF-8")).alias("content"))
    found = files.targets(found)
    lenient = files.texts(found).select("file", F.sha2("text", 256).alias("lenient_sha256"))
    strict = files.strict_texts(found).select("file", "error", F.sha2("text", 256).alias("strict_sha256"))
    return strict.join(lenient, "file", "left")


DECODED = f"""SELECT path AS file, CASE doc_id % 3 WHEN 0 THEN 'not valid UTF-8' WHEN 1 THEN 'skipped: binary file' END AS error, CASE doc_id % 3 WHEN 2 THEN sha256(chr(233) || body) END AS strict_sha256,
  CASE doc_id % 3 WHEN 0 THEN sha256(chr(65533) || body) WHEN 2 THEN sha256(chr(233) || body) END AS lenient_sha256 FROM ({RAW})"""

PATHS = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'k/server' WHEN 1 THEN 'a/deep/er/' WHEN 2 THEN 'Notes/' WHEN 3 THEN 'x-' ELSE 'k/' END || CAST(page_id AS STRING)
  || CASE page_id % 7 WHEN 0 THEN '.db' WHEN 1 THEN '.dc' WHEN 2 THEN '.dd' WHEN 3 THEN '.pem' WHEN 4 THEN '.p^m' ELSE '.md' END AS path FROM pages"""
EXCLUDES = ["*.d[bc]", "k/[!1-4]*.pem", "notes/1", "x-?5.md"]


def exclude_patterns(spark, sf):
    """Paths by shell patterns with classes, and by parts of any case."""
    return view(spark, sf, PATHS).select("page_id", scalars.excluded(F.col("path"), EXCLUDES).alias("excluded"))


EXCLUDED = "SELECT page_id, " + " OR ".join(f"path GLOB '{p}' OR contains(lower(path), '{p}')" for p in EXCLUDES) + f" AS excluded FROM ({PATHS})"

# ---- side files ----------------------------------------------------------------

LABEL_FILES = """SELECT doc_id, CASE WHEN doc_id % 13 = 5 THEN '{"sessions": [' WHEN doc_id % 13 = 6 THEN '[]' ELSE '{"version":1,"sessions":{"s' || CAST(doc_id AS STRING) || '":' || CASE doc_id % 6 WHEN 0 THEN '"text"' WHEN 1 THEN '{"label":"L' || CAST(quality AS STRING) || '"}'
  WHEN 2 THEN '{"origin":"bot","purpose":"probe"}' WHEN 3 THEN '{"origin":"bot"}' WHEN 4 THEN '{"purpose":"probe","label":""}' ELSE '{}' END || ',"t' || CAST(doc_id AS STRING) || '":{"label":"x","origin":"o' || CAST(toxic AS STRING) || '"}}}' END AS text FROM labels"""


def label_files(spark, sf):
    """A label file a row; damaged ones give none."""
    return sidecars.labels(view(spark, sf, LABEL_FILES))


LABELS = f"""WITH e AS (SELECT k.key AS id, k.value AS v FROM (SELECT * FROM ({LABEL_FILES}) WHERE json_valid(text)) f, json_each(CASE WHEN json_type(f.text) = 'OBJECT' THEN f.text ELSE '{{}}' END, '$.sessions') k WHERE json_type(k.value) = 'OBJECT'),
g AS (SELECT id, json_extract_string(v, '$.label') AS label, json_extract_string(v, '$.origin') AS origin, json_extract_string(v, '$.purpose') AS purpose FROM e)
SELECT id, coalesce(nullif(label, ''), CASE WHEN origin IS NOT NULL OR purpose IS NOT NULL THEN coalesce(origin, '?') || ':' || coalesce(purpose, 'unlabeled') END, '') AS label, coalesce(origin, '') AS origin, coalesce(purpose, '') AS purpose FROM g"""

KEEP_FILES = """SELECT CASE WHEN n_nationkey % 5 = 3 THEN '{"ids": ["broken"' ELSE '{"ids":["' || n_name || '","r' || CAST(n_regionkey AS STRING) || '"]' || CASE WHEN n_nationkey % 2 = 0 THEN ',"title_patterns":["^' || n_name || '","plan ' || CAST(n_regionkey AS STRING) || '"]}' ELSE '}' END END AS text FROM nation"""


def keep_files(spark, sf):
    """Ids and title patterns of keep files; the patterns are read to the driver, as they become one expression."""
    raw = view(spark, sf, KEEP_FILES)
    patterns = spark.createDataFrame([(p,) for p in sidecars.keep_patterns(raw)], "value string")
    return sidecars.keep_ids(raw).select(F.lit("id").alias("kind"), F.col("id").alias("value")).unionByName(patterns.select(F.lit("pattern").alias("kind"), "value"))


KEPT = f"""WITH f AS (SELECT text FROM ({KEEP_FILES}) WHERE json_valid(text))
SELECT DISTINCT 'id' AS kind, unnest(CAST(json_extract(text, '$.ids') AS VARCHAR[])) AS value FROM f UNION ALL SELECT 'pattern', unnest(CAST(json_extract(text, '$.title_patterns') AS VARCHAR[])) FROM f"""

QUEUES = """SELECT CASE WHEN c_custkey % 11 = 4 THEN 'broken {' WHEN c_custkey % 11 = 5 THEN '[1]' ELSE '{"s' || CAST(c_custkey AS STRING) || '":' || CAST(c_custkey * 7 AS STRING) || ',"u' || CAST(c_custkey AS STRING) || '":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '5' END || '}' END AS text FROM customer"""


def pending_queues(spark, sf):
    return sidecars.pending(view(spark, sf, QUEUES))


PENDING = f"""SELECT k.key AS id, CAST(k.value AS BIGINT) AS first_seen FROM (SELECT * FROM ({QUEUES}) WHERE json_valid(text)) f, json_each(CASE WHEN json_type(f.text) = 'OBJECT' THEN f.text ELSE '{{}}' END) k WHERE json_type(k.value) <> 'NULL'"""


def manifest_files(spark, sf):
    """Manifests are written, one a folder, and read back: entries with their defaults, and whether the version is supported."""
    out = f"{shared_dir(spark)}/lanternfish/manifests-{uuid.uuid4().hex}"
    rows = view(spark, sf, "SELECT n_nationkey, n_regionkey, n_name FROM nation")
    entry = F.struct(F.concat("n_name", F.lit(".db")).alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "config").alias("root"), (F.col("n_nationkey") * 10).cast("bigint").alias("size"))
    second = F.struct(F.lit("b.md").alias("path"), F.lit("data").alias("root"), F.lit(1).cast("bigint").alias("size"))
    made = rows.select(F.col("n_nationkey").alias("tag"), (F.col("n_nationkey") % 4).alias("manifest_version"), F.when(F.col("n_regionkey") != 3, F.array(entry, second)).alias("files"))
    made.repartition(8, "tag").write.partitionBy("tag").json(out)
    read = sidecars.manifests(spark, f"{out}/*")
    entries = sidecars.manifest_entries(read).select("name", "path", "root", "size")
    return read.select("name", "manifest_version", "supported").join(entries, "name", "left")


MANIFESTS = """SELECT 'tag=' || CAST(n_nationkey AS VARCHAR) AS name, CAST(n_nationkey % 4 AS INTEGER) AS manifest_version, n_nationkey % 4 IN (1, 2) AND n_regionkey <> 3 AS supported, e.path, e.root, e.size
FROM nation LEFT JOIN (SELECT n_nationkey AS k, n_name || '.db' AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'config' ELSE 'data' END AS root, CAST(n_nationkey * 10 AS BIGINT) AS size FROM nation UNION ALL SELECT n_nationkey, 'b.md', 'data', 1 FROM nation) e ON e.k = n_nationkey AND n_regionkey <> 3"""

LINKS = "SELECT page_id, '[[p' || CAST(page_id AS STRING) || CASE WHEN page_id % 3 = 0 THEN '.md' WHEN page_id % 3 = 1 THEN '.json' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN '|Page ' || CAST(page_id AS STRING) WHEN page_id % 4 = 1 THEN '|' ELSE '' END || ']]' AS link FROM pages"
LISTED = "SELECT doc_id, 'd' || CAST(doc_id AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.JSON' WHEN 2 THEN '.txt' ELSE '' END AS file FROM documents"


def index_files(spark, sf):
    """Exports by index.json, by the links of index.md without it, and by file names without both."""
    none = view(spark, sf, "SELECT CAST(NULL AS STRING) AS text FROM region WHERE false")
    listed = view(spark, sf, f"SELECT file FROM ({LISTED}) UNION ALL SELECT 'index.md' UNION ALL SELECT 'index.json'")
    md = view(spark, sf, f"SELECT '# Index' || chr(10) || string_agg('- ' || link, chr(10)) AS text FROM ({LINKS})")
    js = view(spark, sf, """SELECT '{"sessions":[' || string_agg('{"file":' || CASE WHEN n_nationkey % 4 = 0 THEN 'null' ELSE '"' || n_name || '.md"' END || ',"title":"' || n_name || '"}', ',') || ']}' AS text FROM nation""")
    ways = (("json", js, md), ("links", none, md), ("names", none, none))
    parts = [publish.index_entries(j, m, listed).select(F.lit(way).alias("way"), "file", "title") for way, j, m in ways]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


INDEXED = f"""WITH l AS (SELECT regexp_extract(link, '\\[\\[([^\\]|]+)', 1) AS n, nullif(regexp_extract(link, '\\|([^\\]]*)\\]', 1), '') AS title FROM ({LINKS}))
SELECT 'json' AS way, n_name || '.md' AS file, n_name AS title FROM nation WHERE n_nationkey % 4 <> 0
UNION ALL SELECT 'links', CASE WHEN regexp_matches(n, '\\.(md|json)$') THEN n ELSE n || '.md' END, title FROM l
UNION ALL SELECT 'names', file, NULL FROM ({LISTED}) WHERE regexp_matches(lower(file), '\\.(md|json)$')"""

# ---- stores --------------------------------------------------------------------

KEY = "'AK' || 'IA' || upper(substr(md5(n_name), 1, 16))"
STORE_ROWS = f"SELECT n_nationkey AS k, n_regionkey AS r, n_name AS name, {KEY} AS secret, lower(n_name) || '@example.org' AS mail FROM nation"


def made_store(spark, sf) -> str:
    """A store of the nations in the shared folder: a key in a column declared INTEGER, in a table without row ids, and addresses in JSON."""
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:") + "/lanternfish"
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/store-{uuid.uuid4().hex}.db"
    rows = [tuple(r) for r in view(spark, sf, STORE_ROWS).collect()]
    con = sqlite3.connect(path)
    with con:
        con.execute("CREATE TABLE sessions (id TEXT PRIMARY KEY, title TEXT, working_directory TEXT)")
        con.execute("CREATE TABLE numbers (row_id INTEGER PRIMARY KEY, n INTEGER, session_id TEXT)")
        con.execute("CREATE TABLE docs (name TEXT, part INTEGER, body, PRIMARY KEY (name, part)) WITHOUT ROWID")
        con.execute("CREATE TABLE message_nodes (row_id INTEGER PRIMARY KEY, session_id TEXT, chat_message TEXT)")
        con.execute("CREATE TABLE refinery_migrations (version INTEGER, name TEXT)")
        for k, r, name, secret, mail in rows:
            con.execute("INSERT INTO sessions VALUES (?, ?, ?)", (f"s{r}-{k}", "t", f"/work/{name}/"))
            con.execute("INSERT INTO numbers VALUES (?, ?, ?)", (k + 1, secret if k % 2 else k, f"s{r}"))
            con.execute("INSERT INTO docs VALUES (?, ?, ?)", (name, r, f"use {secret} now" if k % 3 == 0 else b"\x00\x01"))
            con.execute("INSERT INTO message_nodes VALUES (?, ?, ?)", (k + 1, f"s{r}", f'{{"role":"user","text":"write to {mail} today"}}'))
            con.execute("INSERT INTO refinery_migrations VALUES (?, ?)", (k * 2, name))
    con.close()
    return path


def store_scan(spark, sf):
    """Every finding of a whole store, whatever the type and key of the tables."""
    return store_findings(spark, made_store(spark, sf)).select("category", "kind", "location", "fingerprint", "preview")


STORE = f"""WITH s AS ({STORE_ROWS}), f AS (
  SELECT 'api_key' AS category, 'pattern' AS kind, 'numbers.n#rowid=' || CAST(k + 1 AS VARCHAR) || ':line 1' AS location, secret AS v FROM s WHERE k % 2 = 1
  UNION ALL SELECT 'api_key', 'pattern', 'docs.body#key=' || name || '/' || CAST(r AS VARCHAR) || ':line 1', secret FROM s WHERE k % 3 = 0
  UNION ALL SELECT 'email', 'pattern', 'message_nodes.chat_message#rowid=' || CAST(k + 1 AS VARCHAR) || ':line 1', regexp_extract(mail, '[a-z0-9._%+-]+@.*') FROM s
  UNION ALL SELECT 'project_name', 'metadata', 'sessions.working_directory#rowid=' || CAST(row_number() OVER (ORDER BY k) AS VARCHAR), name FROM s)
SELECT category, kind, location, {FP.format(v="v")} AS fingerprint, {MASK.format(v="v")} AS preview FROM f"""


def store_session_scan(spark, sf):
    """The findings of each session by itself, for every session that the store's child tables name."""
    path = made_store(spark, sf)
    names = [r["s"] for r in view(spark, sf, "SELECT 's' || CAST(r_regionkey AS STRING) AS s FROM region").collect()]
    parts = [store_findings(spark, path, s).select(F.lit(s).alias("session_id"), "category", "location", "fingerprint") for s in names]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


STORE_SESSIONS = f"""WITH s AS ({STORE_ROWS}), f AS (
  SELECT 's' || CAST(r AS VARCHAR) AS session_id, 'api_key' AS category, 'numbers.n#rowid=' || CAST(k + 1 AS VARCHAR) || ':line 1' AS location, secret AS v FROM s WHERE k % 2 = 1
  UNION ALL SELECT 's' || CAST(r AS VARCHAR), 'email', 'message_nodes.chat_message#rowid=' || CAST(k + 1 AS VARCHAR) || ':line 1', regexp_extract(mail, '[a-z0-9._%+-]+@.*') FROM s)
SELECT session_id, category, location, {FP.format(v="v")} AS fingerprint FROM f"""


def store_ids(spark, sf):
    """All live sessions of a store, with the version that its ledger of migrations names; a missing store has none."""
    path = made_store(spark, sf)
    sqlite.register(spark)
    both = sqlite.live_ids(spark, path).unionByName(sqlite.live_ids(spark, path + ".missing"))
    return both.withColumn("schema_version", F.lit(sqlite.schema_version(path)))


# ---- scanning and rewriting ----------------------------------------------------


def session_reads(spark, sf):
    """Sensitive reads of one session; rows that name no session give none."""
    calls = view(spark, sf, TOOL_CALLS).withColumn("file", F.lit("store.db"))
    anonymous = scan.for_session(calls.drop("session_id"), "7").withColumn("session_id", F.lit("none"))
    return scan.semantic_findings(scan.for_session(calls, "7").unionByName(anonymous)).select("location", "fingerprint", "target")


READS = f"""SELECT 'tool_call_state.tool_call_update_json#rowid=' || CAST(rowid AS VARCHAR) AS location, {FP.format(v="tool_call_update_json")} AS fingerprint,
  coalesce(json_extract_string(tool_call_json, '$.rawInput.path'), json_extract_string(tool_call_json, '$.rawInput.query'), regexp_extract(coalesce(json_extract_string(tool_call_json, '$.rawInput.command'), json_extract_string(tool_call_json, '$.title')), '^(?:cat|grep x) (\\S+)', 1)) AS target
FROM ({TOOL_CALLS}) WHERE session_id = '7' AND tool_call_update_json IS NOT NULL AND NOT contains(tool_call_update_json, '<REDACTED:')
  AND regexp_matches(tool_call_json, '"command":"cat [^"]*\\.env|"path":"[^"]*/\\.ssh/|"query":"[^"]*\\.pem"|"title":"grep [^"]*secret')"""

KNOWN = """SELECT 'store.db' AS file, 'message_nodes' AS tab, conv_id * 1000 + turn AS rowid, CAST(conv_id AS STRING) AS session_id, conv_id, turn, 'AK' || 'IA' || upper(substr(md5(CAST(conv_id AS STRING)), 1, 16)) AS whole,
  CASE WHEN turn % 2 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'AK' || 'IA' || upper(substr(md5(CAST(conv_id AS STRING)), 1, 16)) || ' and ' ELSE '' END || 'use AK' || 'IA' || upper(substr(md5(CAST(conv_id AS STRING)), 1, 6)) ELSE upper(substr(md5(CAST(conv_id AS STRING)), 7, 10)) || ' then' END AS chat_message FROM conversations"""


def cross_chunk_new(spark, sf):
    """Split keys that the plain scan has not found already in either of their rows."""
    rows = view(spark, sf, KNOWN)
    place = F.concat(F.lit("message_nodes.chat_message#rowid="), F.col("rowid").cast("string"))
    plain = scan.cell_findings(rows.select("file", place.alias("location"), F.col("chat_message").alias("value")))
    found = chunks.across_rows(chunks.units(rows.select("file", "tab", "rowid", "session_id", "chat_message"), ["chat_message"]), plain)
    return found.where("category = 'api_key'").select("location", "fingerprint", "combined_with")


CROSS_NEW = f"""WITH r AS (SELECT *, lead(rowid) OVER w AS nxt, lead(session_id) OVER w AS nxt_session, lead(chat_message) OVER w AS nxt_text FROM ({KNOWN}) WINDOW w AS (ORDER BY rowid))
SELECT 'message_nodes.chat_message#rowid=' || CAST(rowid AS VARCHAR) AS location, {FP.format(v="whole")} AS fingerprint, 'message_nodes.chat_message#rowid=' || CAST(nxt AS VARCHAR) AS combined_with
FROM r WHERE nxt_session = session_id AND contains(chat_message || nxt_text, whole) AND NOT contains(chat_message, whole) AND NOT contains(nxt_text, whole)"""

OUTPUTS = f"""SELECT 'store.db' AS file, 'o#' || CAST(doc_id AS STRING) AS location, doc_id, {H} AS h, CASE doc_id % 4 WHEN 0 THEN '{{"status":"completed","content":[{{"type":"content","content":{{"type":"text","text":"' || {H} || '"}}}}],"note":"n"}}'
  WHEN 1 THEN 'plain ' || {H} WHEN 2 THEN '[1, "' || {H} || '"]' ELSE '<REDACTED:0>' END AS value, true AS semantic FROM documents"""


def redact_json_cells(spark, sf):
    """New texts of JSON cells by pattern, and of the outputs of sensitive reads as a whole."""
    cells = view(spark, sf, CELLS).select("file", "location", "value", F.lit(False).alias("semantic"))
    both = cells.unionByName(view(spark, sf, OUTPUTS).select("file", "location", "value", "semantic"))
    return redact.redact_cells(both).select("location", "new_value", F.size("edits").cast("bigint").alias("n_edits"))


def _tag(v: str) -> str:
    return f"'<REDACTED:' || {FP.format(v=v)} || '>'"


REDACTED_CELLS = f"""WITH c AS (SELECT location, replace(replace(value, ':', ': '), ',', ', ') AS shown, 'm' || CAST(doc_id AS VARCHAR) || '@example.org' AS mail FROM ({CELLS})),
n AS (SELECT location, replace(shown, mail, {_tag("mail")}) AS t, len(string_split(shown, mail)) - 1 AS n FROM c)
SELECT location, replace(t, 'REDACTED: ', 'REDACTED:') AS new_value, CAST(n AS BIGINT) AS n_edits FROM n
UNION ALL SELECT location, CASE doc_id % 4 WHEN 0 THEN replace(replace(replace(value, ':', ': '), ',', ', '), h, {_tag("h")}) ELSE {_tag("value")} END, 1 FROM ({OUTPUTS}) WHERE doc_id % 4 IN (0, 1)"""


def redact_all(spark, sf):
    """Whole texts rewritten by all patterns; their digest stands for them."""
    made = redact.redact_texts(view(spark, sf, FILES))
    return made.select("file", F.sha2("new_text", 256).alias("new_sha256"))


REDACT_ALL = f"""WITH {_found(FILES)},
v AS (SELECT file, list(DISTINCT {{'v': value, 't': CASE WHEN category = 'env_assignment' THEN split_part(value, '=', 1) || '=' ELSE '' END || {_tag("value")}}}) AS vs FROM found GROUP BY file)
SELECT file, sha256(CASE WHEN vs IS NULL THEN text ELSE list_reduce(vs, lambda a, x: {{'v': replace(a.v, x.v, x.t), 't': ''}}, {{'v': text, 't': ''}}).v END) AS new_sha256 FROM files LEFT JOIN v USING (file)"""


def sarif_logs(spark, sf):
    """Whole SARIF logs, one a file: the version, rules, results, and errors among them."""
    made = scan.sarif_log(scan.text_findings(view(spark, sf, FILES)))
    at = lambda p: F.get_json_object("log", p)
    n = lambda p: F.coalesce(F.json_array_length(at(p)), F.lit(0)).cast("bigint")
    level = F.regexp_count("log", F.lit('"level":"error"')).cast("bigint")
    return made.select("file", at("$.version").alias("version"), n("$.runs[0].tool.driver.rules").alias("rules"), n("$.runs[0].results").alias("results"), level.alias("errors"))


SARIF_LOGS = f"""WITH {_found(FILES)} SELECT file, '2.1.0' AS version, CAST({len({p.category for p in detect.PATTERNS}) + 2} AS BIGINT) AS rules, count(*) AS results, count(*) FILTER ({SECRET}) AS errors FROM found GROUP BY file"""

# ---- rules and tiers -----------------------------------------------------------

OVERLAY = '{"noise_patterns": ["^inbox", "parser"], "grace_hours": 240, "noise_max_tool_calls": 1000000, "keep_title_patterns": [], "no_such_key": 1}'


def overlaid_rules(spark, sf):
    """Classification under rules that a JSON text changes in part."""
    made = inventory.classify(sessions.rows(spark, sf), inventory.Rules.load(OVERLAY), sessions.NOW)
    return made.select("id", "tier", "reason")


OVERLAID = f"""WITH {sessions.ROWS_SQL},
d AS (SELECT *, 3 * user_msgs + tool_calls AS score, {sessions.NORM} <> '' AND row_number() OVER (PARTITION BY project, {sessions.NORM} ORDER BY 3 * user_msgs + tool_calls DESC, origin, id) > 1 AS dup FROM inv),
c AS (SELECT id, CASE WHEN coalesce(last_activity <> 0 AND last_activity > {sessions.NOW} - 864000.0, false) THEN 'keep/grace window' WHEN user_msgs = 0 AND assistant_msgs = 0 AND tool_calls = 0 THEN 'auto_delete/empty' WHEN dup THEN 'auto_delete/duplicate'
  WHEN starts_with(lower(title), 'inbox') OR contains(lower(title), 'parser') THEN 'auto_delete/automation/eval noise'
  WHEN regexp_matches(title, '{sessions._rx(sessions.RULES.ephemeral_patterns)}') AND user_msgs <= 75 AND tool_calls <= 60 THEN 'auto_delete/ephemeral heartbeat/mailbox cycle'
  WHEN user_msgs <= 6 AND tool_calls <= 15 AND files_touched = 0 AND score < 20 THEN 'judge/unresolved' ELSE 'keep/substantive work' END AS v FROM d)
SELECT id, split_part(v, '/', 1) AS tier, substr(v, length(split_part(v, '/', 1)) + 2) AS reason FROM c"""


def chosen_tiers(spark, sf):
    """What the tiers named by a setting would free."""
    named = [f"tier{t}" for t in sorted(scalars.parse_tiers("tier3, 1"))]
    return sessions.cleanup_tiers(spark, sf).where(F.col("tier").isin(*named))


QUERIES = {
    "text_decoding": text_decoding,
    "exclude_patterns": exclude_patterns,
    "label_files": label_files,
    "keep_files": keep_files,
    "pending_queues": pending_queues,
    "manifest_files": manifest_files,
    "index_files": index_files,
    "store_scan": store_scan,
    "store_session_scan": store_session_scan,
    "store_ids": store_ids,
    "session_reads": session_reads,
    "cross_chunk_new": cross_chunk_new,
    "redact_json_cells": redact_json_cells,
    "redact_all": redact_all,
    "sarif_logs": sarif_logs,
    "overlaid_rules": overlaid_rules,
    "chosen_tiers": chosen_tiers,
}
ORACLES = {
    "text_decoding": DECODED,
    "exclude_patterns": EXCLUDED,
    "label_files": LABELS,
    "keep_files": KEPT,
    "pending_queues": PENDING,
    "manifest_files": MANIFESTS,
    "index_files": INDEXED,
    "store_scan": STORE,
    "store_session_scan": STORE_SESSIONS,
    "store_ids": "SELECT 's' || CAST(n_regionkey AS VARCHAR) || '-' || CAST(n_nationkey AS VARCHAR) AS id, CAST((SELECT max(n_nationkey) * 2 FROM nation) AS INTEGER) AS schema_version FROM nation",
    "session_reads": READS,
    "cross_chunk_new": CROSS_NEW,
    "redact_json_cells": REDACTED_CELLS,
    "redact_all": REDACT_ALL,
    "sarif_logs": SARIF_LOGS,
    "overlaid_rules": OVERLAID,
    "chosen_tiers": f"SELECT * FROM ({sessions.CLEANUP}) WHERE tier IN ('tier1', 'tier3')",
}
