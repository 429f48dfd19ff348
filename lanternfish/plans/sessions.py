"""Queries for inventory, classification, plans and space, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import inventory as inv
from .seeds import MESSAGES, NOW, SESSIONS, view

RULES = inv.Rules()
TOOLS = """SELECT CASE WHEN event_id % 3 = 0 THEN '' ELSE 'gone' END || CAST(event_id % 150 AS STRING) AS session_id, event_id AS rowid,
  '{"n":1,"file_path":"/src/f' || CAST(event_id % 9 AS STRING) || '.py","cmd":"/not/a/key"}' AS tool_call_json, CASE WHEN event_id % 2 = 0 THEN props ELSE NULL END AS tool_call_update_json FROM events"""
ROWS_SQL = f"""sessions AS ({SESSIONS}), messages AS ({MESSAGES}), tools AS ({TOOLS}),
m AS (SELECT session_id, count(*) FILTER (role = 'user') AS user_msgs, count(*) FILTER (role IS DISTINCT FROM 'user') AS assistant_msgs,
  coalesce(arg_min(text, rowid) FILTER (role = 'user' AND text <> ''), '') AS prompt FROM messages GROUP BY session_id),
t AS (SELECT session_id, count(*) AS tool_calls, count(DISTINCT rowid % 9) AS files_touched FROM tools GROUP BY session_id),
inv AS (SELECT s.id, s.origin, s.title, s.project, s.created, s.last_activity, coalesce(user_msgs, 0) AS user_msgs, coalesce(assistant_msgs, 0) AS assistant_msgs,
  coalesce(tool_calls, 0) AS tool_calls, coalesce(files_touched, 0) AS files_touched, coalesce(prompt, '') AS prompt
  FROM sessions s LEFT JOIN m ON s.id = m.session_id LEFT JOIN t ON s.id = t.session_id)"""


def rows(spark, sf):
    return inv.inventory(view(spark, sf, SESSIONS), view(spark, sf, MESSAGES), view(spark, sf, TOOLS))


def session_inventory(spark, sf):
    return rows(spark, sf).drop("empty_flag")


KEEP_IDS = "SELECT DISTINCT CAST(conv_id AS STRING) AS id FROM conversations WHERE conv_id % 23 = 1"
NORM = "substr(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 60)"


def _rx(patterns: list[str]) -> str:
    return "(?i)" + "|".join(patterns).replace("'", "''")


CLASSIFIED = f"""WITH {ROWS_SQL},
d AS (SELECT *, 3 * user_msgs + tool_calls AS score, {NORM} <> '' AND row_number() OVER (PARTITION BY project, {NORM} ORDER BY 3 * user_msgs + tool_calls DESC, origin, id) > 1 AS dup FROM inv),
c AS (SELECT *, CASE WHEN id IN ({KEEP_IDS}) OR regexp_matches(title, '{_rx(RULES.keep_title_patterns)}') THEN 'keep/allowlist/marked'
  WHEN coalesce(last_activity <> 0 AND last_activity > {NOW} - 172800.0, false) THEN 'keep/grace window'
  WHEN user_msgs = 0 AND assistant_msgs = 0 AND tool_calls = 0 THEN 'auto_delete/empty' WHEN dup THEN 'auto_delete/duplicate'
  WHEN regexp_matches(title, '{_rx(RULES.noise_patterns)}') AND tool_calls <= 5 THEN 'auto_delete/automation/eval noise'
  WHEN regexp_matches(title, '{_rx(RULES.ephemeral_patterns)}') AND user_msgs <= 75 AND tool_calls <= 60 THEN 'auto_delete/ephemeral heartbeat/mailbox cycle'
  WHEN user_msgs <= 6 AND tool_calls <= 15 AND files_touched = 0 AND score < 20 THEN 'judge/unresolved' ELSE 'keep/substantive work' END AS v FROM d),
classified AS (SELECT id, title, project, created, score, split_part(v, '/', 1) AS tier, substr(v, length(split_part(v, '/', 1)) + 2) AS reason FROM c)"""


def classified(spark, sf):
    return inv.classify(rows(spark, sf), RULES, NOW, view(spark, sf, KEEP_IDS))


def classify_sessions(spark, sf):
    return classified(spark, sf).select("id", "title", "project", "score", "tier", "reason")


def classification_summary(spark, sf):
    return inv.tier_counts(classified(spark, sf))


def classification_preview(spark, sf):
    return inv.preview(classified(spark, sf))


ANSWERS = """SELECT DISTINCT CAST(conv_id AS STRING) AS id, CASE conv_id % 6 WHEN 0 THEN 'keep' WHEN 1 THEN '{"keep": false}' WHEN 2 THEN 'This is noise, delete it' WHEN 3 THEN '{"abstained": 1}' WHEN 4 THEN '{"verdict": "Durable."}' ELSE 'hm' END AS answer FROM conversations"""
SAYS = f"SELECT id, CASE CAST(id AS BIGINT) % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 4 THEN true END AS says FROM ({ANSWERS})"
ACTED = f"""{CLASSIFIED}, says AS ({SAYS}),
acted AS (SELECT c.*, CASE WHEN tier = 'auto_delete' THEN 'delete' WHEN tier = 'judge' AND NOT says THEN 'delete' WHEN tier = 'judge' AND says IS NULL THEN 'judge-down' ELSE 'keep' END AS action
  FROM classified c LEFT JOIN says USING (id))"""


def judge_step(spark, sf):
    return inv.judged(classified(spark, sf), view(spark, sf, ANSWERS)).select("id", "tier", "action")


def delete_plan(spark, sf):
    return inv.delete_plan(inv.judged(classified(spark, sf), view(spark, sf, ANSWERS)), RULES).withColumn("rank", F.col("rank").cast("bigint"))


ORDER = "ORDER BY CASE WHEN tier = 'auto_delete' THEN 0 ELSE 1 END, id"
GUI_META = """SELECT 'acp/' || CAST(event_id % 120 AS STRING) || '.db' AS file, event_id AS position, CASE event_id % 4 WHEN 0 THEN 'Title' WHEN 1 THEN 'createdAt' WHEN 2 THEN 'cwd' ELSE 'other' END AS key,
  CASE event_id % 4 WHEN 0 THEN 'gui ' || CAST(event_id AS STRING) WHEN 1 THEN CAST(1700000000000 + event_id AS STRING) WHEN 2 THEN '/work/g' ELSE 'x' END AS value FROM events"""
GUI_MESSAGES = """SELECT 'acp/' || CAST(event_id % 120 AS STRING) || '.db' AS file, CASE event_id % 3 WHEN 0 THEN 'user.prompt' WHEN 1 THEN 'agent.delta' ELSE 'tool_call' END AS kind FROM events"""
GUI_FILES = f"SELECT DISTINCT 'acp/' || CAST(event_id % 120 AS STRING) || '.db' AS file, CAST({NOW} AS DOUBLE) AS mtime FROM events"


def inventory_union(spark, sf):
    gui = inv.gui_inventory(view(spark, sf, GUI_META), view(spark, sf, GUI_MESSAGES), view(spark, sf, GUI_FILES))
    return inv.merged(rows(spark, sf), gui).select("id", "origin", "title", "project", "created", "last_activity", "user_msgs", "assistant_msgs", "tool_calls")


INVENTORY_UNION = f"""WITH {ROWS_SQL},
meta AS ({GUI_META}), gm AS ({GUI_MESSAGES}), gf AS ({GUI_FILES}),
told AS (SELECT file, arg_min(value, position) FILTER (key = 'Title') AS title, arg_min(TRY_CAST(value AS DOUBLE), position) FILTER (key = 'createdAt') AS created, max(value) FILTER (key = 'cwd') AS project FROM meta GROUP BY file),
counts AS (SELECT file, count(*) FILTER (contains(kind, 'user')) AS user_msgs, count(*) FILTER (NOT contains(kind, 'user')) AS assistant_msgs, count(*) FILTER (contains(kind, 'tool')) AS tool_calls FROM gm GROUP BY file),
gui AS (SELECT regexp_extract(file, '([^/]*)[.]db$', 1) AS id, 'gui' AS origin, coalesce(title, '') AS title, coalesce(project, '') AS project, coalesce(created / 1000, mtime) AS created, mtime AS last_activity,
  coalesce(user_msgs, 0) AS user_msgs, coalesce(assistant_msgs, 0) AS assistant_msgs, coalesce(tool_calls, 0) AS tool_calls FROM gf LEFT JOIN told USING (file) LEFT JOIN counts USING (file))
SELECT id, origin, title, project, created, last_activity, user_msgs, assistant_msgs, tool_calls FROM inv UNION ALL SELECT * FROM gui WHERE id NOT IN (SELECT id FROM inv)"""

PAYLOADS = "SELECT CAST(conv_id AS STRING) AS session_id, CASE WHEN turn = 3 THEN NULL ELSE length(text) END AS n FROM conversations UNION ALL SELECT CAST(user_id AS STRING) AS session_id, length(props) AS n FROM events"


def byte_estimates(spark, sf):
    return inv.byte_estimates(view(spark, sf, SESSIONS).select("id"), view(spark, sf, PAYLOADS))


ESTIMATES = f"SELECT id, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT id, 256 AS n FROM ({SESSIONS}) UNION ALL SELECT session_id, coalesce(sum(n), 0) FROM ({PAYLOADS}) GROUP BY session_id) GROUP BY id"


def tier_bytes(spark, sf):
    return inv.tier_bytes(byte_estimates(spark, sf), classified(spark, sf))


def orphan_rows(spark, sf):
    parents = view(spark, sf, "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3")
    children = view(spark, sf, "SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS l_orderkey, l_linenumber, length(l_returnflag || l_linestatus) AS n FROM lineitem")
    return inv.orphan_totals(inv.orphans(children, parents, "l_orderkey", "o_orderkey"), "n")


ORPHANS = """SELECT count(*) AS orphan_rows, CAST(coalesce(sum(length(l_returnflag || l_linestatus)), 0) AS BIGINT) AS orphan_bytes
FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS k, * FROM lineitem) WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3)"""
LEFT_FILES = "SELECT CAST(o_orderkey AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN '.db-wal' WHEN 1 THEN '.lock' WHEN 2 THEN '.db' ELSE '.db-shm' END AS name, o_custkey AS bytes FROM orders"


def leftovers(spark, sf):
    ids = lambda where: view(spark, sf, f"SELECT CAST(o_orderkey AS STRING) AS id FROM orders WHERE {where}")
    return inv.leftovers(view(spark, sf, LEFT_FILES), ids("o_orderkey % 3 = 0"), ids("o_orderkey % 5 = 0"), ids("o_orderkey % 7 = 0"))


LEFTOVERS = "SELECT CAST(o_orderkey AS VARCHAR) || CASE o_orderkey % 4 WHEN 0 THEN '.db-wal' WHEN 1 THEN '.lock' ELSE '.db-shm' END AS name, CAST(o_orderkey AS VARCHAR) AS sid, o_custkey AS bytes FROM orders WHERE o_orderkey % 4 <> 2 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0"


def orphan_locks(spark, sf):
    locks = view(spark, sf, "SELECT CAST(user_id AS STRING) || '.lock' AS name, CAST(count(*) AS BIGINT) AS bytes FROM events GROUP BY user_id")
    none = view(spark, sf, "SELECT CAST(conv_id AS STRING) AS id FROM conversations WHERE false")
    return inv.leftovers(locks, none, view(spark, sf, SESSIONS).select("id"), none)


LOCKS = f"SELECT CAST(user_id AS VARCHAR) || '.lock' AS name, CAST(user_id AS VARCHAR) AS sid, count(*) AS bytes FROM events WHERE CAST(user_id AS VARCHAR) NOT IN (SELECT id FROM ({SESSIONS})) GROUP BY user_id"
LABELS = "SELECT CAST(doc_id AS STRING) AS id, 'auto:' || CAST(quality AS STRING) AS label, CASE WHEN doc_id % 2 = 0 THEN 'automation' ELSE 'human' END AS origin, 'p' || CAST(toxic AS STRING) AS purpose FROM labels"


def labelled_sessions(spark, sf):
    return inv.labelled(rows(spark, sf), view(spark, sf, LABELS), ["automation", "heartbeat"])


LABELLED = f"WITH {ROWS_SQL} SELECT i.id, i.title, i.origin AS session_origin, i.last_activity, l.label, l.origin AS label_origin, l.purpose FROM inv i JOIN ({LABELS}) l USING (id) WHERE l.origin IN ('automation', 'heartbeat')"


def deletable_bytes(spark, sf):
    """Estimates of the sessions that go, without labelled ones."""
    gone = inv.judged(classified(spark, sf), view(spark, sf, ANSWERS)).where("action = 'delete'").select("id")
    gone = gone.join(view(spark, sf, LABELS).select("id"), "id", "left_anti")
    return byte_estimates(spark, sf).join(gone, "id", "left_semi").agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


DELETABLE = f"{ACTED} SELECT count(*) AS sessions, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM ({ESTIMATES}) WHERE id IN (SELECT id FROM acted WHERE action = 'delete') AND id NOT IN (SELECT id FROM ({LABELS}))"

PREFIX = "Space.sessionWorkspace/"
ITEMS = f"""SELECT CASE WHEN event_id % 5 = 4 THEN 'other/' ELSE CASE WHEN event_id % 2 = 0 THEN '{PREFIX}' ELSE lower('{PREFIX}') END END || event_type || CASE WHEN event_id % 6 = 5 THEN '' ELSE '/s' || CAST(event_id AS STRING) END AS key,
  CASE event_id % 7 WHEN 0 THEN 'not json' WHEN 1 THEN '{{"lastUpdated": "soon"}}' ELSE '{{"lastUpdated": ' || CAST({NOW} * CAST(1000 AS BIGINT) - event_id * 3600000 AS STRING) || '}}' END AS value, event_id FROM events"""


def gui_state(spark, sf):
    found = inv.gui_state(view(spark, sf, ITEMS), PREFIX, NOW - 172800.0)
    return found.select("key", "backend", "slug", "bytes", "stale")


GUI = f"""WITH i AS (SELECT * FROM ({ITEMS}) WHERE lower(key) LIKE lower('{PREFIX}') || '%'), r AS (SELECT *, substr(key, {len(PREFIX) + 1}) AS rest FROM i)
SELECT key, CASE WHEN contains(rest, '/') THEN regexp_extract(rest, '^(.*)/([^/]*)$', 1) ELSE '' END AS backend, CASE WHEN contains(rest, '/') THEN regexp_extract(rest, '^(.*)/([^/]*)$', 2) ELSE '' END AS slug,
  CAST(strlen(key) + strlen(value) AS BIGINT) AS bytes, NOT (event_id % 7 > 1 AND ({NOW} * CAST(1000 AS BIGINT) - event_id * 3600000) / 1000.0 >= {NOW} - 172800.0) AS stale FROM r"""


def cleanup_tiers(spark, sf):
    n = lambda df, b: df.agg(F.coalesce(F.sum(b), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("items"))
    side = inv.sidecar_total(view(spark, sf, LEFT_FILES), "4.db").withColumn("items", F.lit(0))
    orphan = orphan_rows(spark, sf).select(F.col("orphan_bytes").alias("bytes"), F.col("orphan_rows").alias("items"))
    return inv.cleanup_tiers(side, orphan, n(leftovers(spark, sf), "bytes"), n(orphan_locks(spark, sf), "bytes"), deletable_bytes(spark, sf).select("bytes", F.col("sessions").alias("items")), n(gui_state(spark, sf).where("stale"), "bytes"))


CLEANUP = f"""SELECT tier, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(items) AS BIGINT) AS items FROM (
  SELECT 'tier1' AS tier, coalesce(sum(bytes), 0) AS bytes, 0 AS items FROM ({LEFT_FILES}) WHERE starts_with(name, '4.db-')
  UNION ALL SELECT 'tier1', orphan_bytes, orphan_rows FROM ({ORPHANS}) UNION ALL SELECT 'tier1', sum(bytes), count(*) FROM ({LEFTOVERS}) UNION ALL SELECT 'tier1', coalesce(sum(bytes), 0), count(*) FROM ({LOCKS})
  UNION ALL SELECT 'tier2', bytes, sessions FROM ({DELETABLE}) UNION ALL SELECT 'tier3', sum(bytes), count(*) FROM ({GUI}) WHERE stale) GROUP BY tier"""


def space_report(spark, sf):
    """Sizes in units up to GB, as the SQL has them."""
    est, state = byte_estimates(spark, sf), gui_state(spark, sf)
    freed = deletable_bytes(spark, sf).select(F.col("bytes").alias("recoverable_bytes"))
    store = est.agg(F.sum("bytes").alias("bytes")).join(freed)
    locks = view(spark, sf, LEFT_FILES).agg(F.sum("bytes").alias("bytes")).join(leftovers(spark, sf).agg(F.sum("bytes").alias("recoverable_bytes")))
    gui = state.agg(F.sum("bytes").alias("bytes"), F.lit(0).alias("recoverable_bytes"))
    return inv.space_report({"sessions": store, "locks": locks, "gui state": gui, "messages": "database is locked"}, "GB")


SPACE = f"""WITH s AS (SELECT 'sessions' AS name, (SELECT sum(bytes) FROM ({ESTIMATES})) AS bytes, (SELECT bytes FROM ({DELETABLE})) AS recoverable_bytes
  UNION ALL SELECT 'locks', (SELECT sum(bytes) FROM ({LEFT_FILES})), (SELECT sum(bytes) FROM ({LEFTOVERS})) UNION ALL SELECT 'gui state', (SELECT sum(bytes) FROM ({GUI})), 0 UNION ALL SELECT 'messages', 0, 0),
a AS (SELECT * FROM s UNION ALL SELECT 'total', sum(bytes), sum(recoverable_bytes) FROM s)
SELECT name, CAST(bytes AS BIGINT) AS bytes, CAST(recoverable_bytes AS BIGINT) AS recoverable_bytes, CASE WHEN recoverable_bytes < 1024 THEN CAST(CAST(recoverable_bytes AS BIGINT) AS VARCHAR) || ' B'
  WHEN recoverable_bytes < 1048576 THEN printf('%.1f KB', recoverable_bytes / 1024.0) WHEN recoverable_bytes < 1073741824 THEN printf('%.1f MB', recoverable_bytes / 1048576.0) ELSE printf('%.1f GB', recoverable_bytes / 1073741824.0) END AS shown, CASE name WHEN 'messages' THEN 'database is locked' END AS error FROM a"""


def session_summaries(spark, sf):
    """What a judge would read of every session."""
    return rows(spark, sf).select("id", scalars.session_summary(F.col("title"), F.col("prompt")).alias("summary"))


SUMMARIES = f"WITH {ROWS_SQL} SELECT id, substr(title || CASE WHEN prompt <> '' THEN chr(10) || chr(10) || substr(prompt, 1, 1500) ELSE '' END, 1, 4000) AS summary FROM inv"
GATES = "SELECT CASE WHEN count(*) >= 0 THEN true END AS ok FROM region"


def stale_keys(spark, sf):
    """State keys that go behind a gate that is open; behind a closed one, or while something runs, none do."""
    state, gate = gui_state(spark, sf), view(spark, sf, GATES)
    shut = inv.stale_keys(state, gate.select(F.lit(False).alias("ok"))).unionByName(inv.stale_keys(state, gate, running=True))
    return inv.stale_keys(state, gate).select("key", "bytes").unionByName(shut.select("key", "bytes"))


def deletable_ids(spark, sf):
    """Planned sessions, waiting ones and orphaned ones, once each."""
    waiting = view(spark, sf, "SELECT CAST(user_id AS STRING) AS id FROM events WHERE user_id % 9 = 0")
    return inv.deletable(delete_plan(spark, sf), waiting, leftovers(spark, sf).select(F.col("sid").alias("id")))


def first_labelled(spark, sf):
    return inv.first_labelled(labelled_sessions(spark, sf))


def span_days(spark, sf):
    return inv.span_shown(activity_span(spark, sf))


def activity_span(spark, sf):
    return inv.span(rows(spark, sf), "created", "last_activity")


def latest_session(spark, sf):
    """Ties go to the larger id."""
    return view(spark, sf, SESSIONS).select("id", "last_activity").orderBy(F.desc_nulls_last("last_activity"), F.desc("id")).limit(1)


def delete_rows(spark, sf):
    """Message rows that stay once the planned sessions are gone."""
    gone = inv.judged(classified(spark, sf), view(spark, sf, ANSWERS)).where("action = 'delete'").select("id")
    return inv.without(view(spark, sf, MESSAGES), gone).groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))


def tier_lookup(spark, sf):
    """Tiers of the users of all events; those without a session read as ``judge``."""
    return inv.tier_of(view(spark, sf, "SELECT DISTINCT CAST(user_id AS STRING) AS id FROM events"), classified(spark, sf))


QUERIES = {
    "tier_lookup": tier_lookup,
    "session_summaries": session_summaries,
    "stale_keys": stale_keys,
    "deletable_ids": deletable_ids,
    "first_labelled": first_labelled,
    "span_days": span_days,
    "session_inventory": session_inventory,
    "inventory_union": inventory_union,
    "classify_sessions": classify_sessions,
    "classification_summary": classification_summary,
    "classification_preview": classification_preview,
    "judge_step": judge_step,
    "delete_plan": delete_plan,
    "delete_rows": delete_rows,
    "byte_estimates": byte_estimates,
    "tier_bytes": tier_bytes,
    "orphan_rows": orphan_rows,
    "leftovers": leftovers,
    "orphan_locks": orphan_locks,
    "labelled_sessions": labelled_sessions,
    "deletable_bytes": deletable_bytes,
    "gui_state": gui_state,
    "cleanup_tiers": cleanup_tiers,
    "space_report": space_report,
    "activity_span": activity_span,
    "latest_session": latest_session,
}
PLAN_SQL = f"{ACTED}, plan AS (SELECT id, tier, reason, row_number() OVER ({ORDER}) AS rank FROM acted WHERE action = 'delete' {ORDER} LIMIT {RULES.max_delete})"
ORACLES = {
    "session_summaries": SUMMARIES,
    "stale_keys": f"SELECT key, bytes FROM ({GUI}) WHERE stale",
    "deletable_ids": f"{PLAN_SQL} SELECT id FROM plan UNION SELECT CAST(user_id AS VARCHAR) FROM events WHERE user_id % 9 = 0 UNION SELECT sid FROM ({LEFTOVERS})",
    "first_labelled": f"SELECT id, label, title, coalesce(strftime(make_timestamp(CAST(last_activity * 1000000 AS BIGINT)), '%Y-%m-%d'), '-') AS day FROM ({LABELLED}) ORDER BY id LIMIT 10",
    "span_days": f"SELECT strftime(make_timestamp(CAST(min(least(created, last_activity)) * 1000000 AS BIGINT)), '%Y-%m-%d') || ' → ' || strftime(make_timestamp(CAST(max(greatest(created, last_activity)) * 1000000 AS BIGINT)), '%Y-%m-%d') AS span FROM ({SESSIONS})",
    "tier_lookup": f"{CLASSIFIED} SELECT id, coalesce(tier, 'judge') AS tier FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events) LEFT JOIN classified USING (id)",
    "session_inventory": f"WITH {ROWS_SQL} SELECT * FROM inv",
    "inventory_union": INVENTORY_UNION,
    "classify_sessions": f"{CLASSIFIED} SELECT id, title, project, score, tier, reason FROM classified",
    "classification_summary": f"{CLASSIFIED} SELECT tier, count(*) AS sessions FROM classified GROUP BY tier",
    "classification_preview": f"{CLASSIFIED} SELECT tier, reason, count(*) OVER (PARTITION BY tier, reason) AS sessions, id FROM classified",
    "judge_step": f"{ACTED} SELECT id, tier, action FROM acted",
    "delete_plan": f"{ACTED} SELECT id, tier, reason, row_number() OVER ({ORDER}) AS rank FROM acted WHERE action = 'delete' {ORDER} LIMIT {RULES.max_delete}",
    "delete_rows": f"{ACTED} SELECT session_id, count(*) AS messages FROM messages WHERE session_id NOT IN (SELECT id FROM acted WHERE action = 'delete') GROUP BY session_id",
    "byte_estimates": ESTIMATES,
    "tier_bytes": f"{CLASSIFIED} SELECT coalesce(tier, 'keep') AS tier, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS sessions FROM ({ESTIMATES}) LEFT JOIN classified USING (id) GROUP BY 1",
    "orphan_rows": ORPHANS,
    "leftovers": LEFTOVERS,
    "orphan_locks": LOCKS,
    "labelled_sessions": LABELLED,
    "deletable_bytes": DELETABLE,
    "gui_state": GUI,
    "cleanup_tiers": CLEANUP,
    "space_report": SPACE,
    "activity_span": f"SELECT min(least(created, last_activity)) AS oldest, max(greatest(created, last_activity)) AS newest FROM ({SESSIONS})",
    "latest_session": f"SELECT id, last_activity FROM ({SESSIONS}) ORDER BY last_activity DESC NULLS LAST, id DESC LIMIT 1",
}
