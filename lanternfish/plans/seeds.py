"""Relations of the agent-session domain made from the driver's tables.

Every expression is SQL that Spark and DuckDB read alike, so a query and its
oracle start from the same rows.  Secret-shaped values are put together at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import reachable

H = "md5(CAST(doc_id AS STRING))"
SEEDS = [
    f"'sk-' || 'proj-' || {H}",
    f"'sk_' || 'live_' || {H}",
    f"'rk_' || 'live_' || {H}",
    f"'AK' || 'IA' || upper(substr({H}, 1, 16))",
    f"'AI' || 'za' || substr({H} || {H}, 1, 35)",
    f"'xo' || 'xb-' || substr({H}, 1, 12)",
    f"'Authorization: Bearer ' || {H}",
    f"'ey' || 'J' || substr({H}, 1, 10) || '.' || substr({H}, 5, 10) || '.' || substr({H}, 9, 12)",
    f"'gh' || 'p_' || {H}",
    f"'github' || '_pat_' || {H}",
    f"'-----BEGIN RSA PRIVATE ' || 'KEY-----' || chr(10) || {H} || chr(10) || '-----END RSA PRIVATE ' || 'KEY-----'",
    f"'APP_API_' || 'KEY=' || {H}",
    f"'pairing code: ' || upper(substr({H}, 1, 4)) || '-' || upper(substr({H}, 5, 4))",
    f"'user.' || substr({H}, 1, 6) || '@example.com'",
    f"'C:' || chr(92) || 'Users' || chr(92) || substr({H}, 1, 8) || chr(92) || 'x.txt'",
    f"'see /home/' || substr({H}, 1, 8) || '/notes.md'",
    "'nothing to see'",
]
CASE = "CASE doc_id % 17 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(SEEDS)) + " END"

#: Every document with one seeded line at its end, as a text file.
FILES = f"SELECT doc_id, 'doc/' || CAST(doc_id AS STRING) || '.md' AS file, coalesce(text, '') || chr(10) || {CASE} AS text FROM documents"
#: Documents as they are.
PLAIN = "SELECT doc_id, 'doc/' || CAST(doc_id AS STRING) || '.md' AS file, coalesce(text, '') AS text FROM documents"

NOW = 1706659200  # 2024-01-31

#: Sessions: one per conversation, with titles, projects and times made of the id.
SESSIONS = f"""SELECT CAST(c AS STRING) AS id, 'cli' AS origin,
  CASE c % 9 WHEN 0 THEN 'heartbeat-probe ' || CAST(c AS STRING) WHEN 1 THEN 'Inbox sweep' WHEN 2 THEN 'Fix the parser' WHEN 3 THEN '' WHEN 4 THEN 'billing'
    WHEN 5 THEN 'não apagar: notes' WHEN 6 THEN 'Refactor module ' || CAST(c % 4 AS STRING) WHEN 7 THEN 'Judge tool run' ELSE 'Plan ' || CAST(c AS STRING) END AS title,
  '/work/p' || CAST(c % 5 AS STRING) AS project,
  CAST({NOW} - 86400.0 * (c % 20) - 7200 AS DOUBLE) AS created, CAST(CASE WHEN c % 11 = 0 THEN NULL ELSE {NOW} - 86400.0 * (c % 20) END AS DOUBLE) AS last_activity
FROM (SELECT DISTINCT conv_id AS c FROM conversations)"""
#: Message rows: a JSON cell a turn.
MESSAGES = """SELECT CAST(conv_id AS STRING) AS session_id, conv_id * 1000 + turn AS rowid, turn, role, text,
  '{"role":"' || role || '","text":"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"}' AS chat_message FROM conversations"""
#: Tool calls made of events: one in seven reads a sensitive file.
TOOL_CALLS = """SELECT event_id AS rowid, CAST(user_id AS STRING) AS session_id, CASE event_id % 7
    WHEN 0 THEN '{"kind":"execute","title":"run","rawInput":{"command":"cat /srv/app/.env | head -3"}}'
    WHEN 1 THEN '{"kind":"execute","title":"run","rawInput":{"command":"ls -la /srv/app"}}'
    WHEN 2 THEN '{"kind":"read","title":"open","rawInput":{"path":"/home/u/.ssh/config"}}'
    WHEN 3 THEN '{"kind":"read","title":"open","rawInput":{"path":"/srv/src/main.rs"}}'
    WHEN 4 THEN '{"kind":"search","title":"find","rawInput":{"query":"deploy/server.pem"}}'
    WHEN 5 THEN '{"kind":"execute","title":"grep x my_secrets.txt","rawInput":{}}'
    ELSE '{"kind":"execute","title":"run","rawInput":{"command":"touch .env.local"}}' END AS tool_call_json,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 13 = 1 THEN '<REDACTED:00>' ELSE props END AS tool_call_update_json FROM events"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the driver's tables of one folder; views are named for the run."""
    reachable(spark)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql}
    for t, df in tables.items():
        df.createOrReplaceTempView(t)
    return spark.sql(sql)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Turns of conversations with a key cut over each even turn and the next, as columns of a stream.
SPLITS = [
    "CAST(conv_id AS STRING) AS session_id",
    "turn AS seq",
    """CASE WHEN turn % 2 = 0 THEN coalesce(text, '') || ' use AK' || 'IA' || upper(substr(md5(CAST(conv_id AS STRING)), 1, 6)) ELSE upper(substr(md5(CAST(conv_id AS STRING)), 7, 10)) || ' then ' || coalesce(text, '') END AS text""",
]
