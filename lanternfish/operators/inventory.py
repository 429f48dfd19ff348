"""Sessions: inventory, classification into tiers, plans, and reclaimable space."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.jsontext import path_leaves

ROW = ["id", "origin", "title", "project", "created", "last_activity", "user_msgs", "assistant_msgs", "tool_calls", "files_touched", "prompt", "empty_flag"]


@dataclass
class Rules:
    """Thresholds and title patterns of the classification."""

    # Default patterns and thresholds.
    noise_patterns: list[str] = field(
        default_factory=lambda: [
            r"judge tool|classif|support_triage|entailment|^\[\d+\]$|^\{\"items\"|^billing$|^BLOCKED$|SESSION_OK|echo.*test|sentinel|safe test command|heartbeat-probe"
        ]
    )
    ephemeral_patterns: list[str] = field(default_factory=lambda: [r"inbox|slack-bridge|slack bridge|Tarefa Slack|Processamento|Processar ficheiros|timeout ACP|heartbeat"])
    keep_title_patterns: list[str] = field(default_factory=lambda: [r"n[ãa]o apagar", "SLACK-BRAIN"])
    grace_hours: float = 48.0
    max_delete: int = 100
    noise_max_tool_calls: int = 5
    ephemeral_max_user_msgs: int = 75
    ephemeral_max_tool_calls: int = 60
    judge_max_user_msgs: int = 6
    judge_max_tool_calls: int = 15
    judge_max_score: int = 20
    judge_statement: str = "The session holds knowledge that later work can use again: decisions, conventions, fixes or context of the project."

    @classmethod
    def load(cls, text: str | None) -> Rules:
        """Defaults overlaid with a JSON object; unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        given = json.loads(text) if text else {}
        return cls(**{k: v for k, v in given.items() if k in known})


def message_counts(messages: DataFrame) -> DataFrame:
    """session_id, user_msgs, assistant_msgs, prompt of rows (session_id, rowid, chat_message)."""
    told = messages.select("session_id", "rowid", scalars.role_of(F.col("chat_message")).alias("role"), scalars.text_of(F.col("chat_message")).alias("body"))
    first = F.min_by("body", F.when((F.col("role") == "user") & (F.col("body") != ""), F.col("rowid")))
    return told.groupBy("session_id").agg(
        F.count_if(F.col("role") == "user").alias("user_msgs"),
        F.count_if(~F.col("role").eqNullSafe(F.lit("user"))).alias("assistant_msgs"),
        F.coalesce(first, F.lit("")).alias("prompt"),
    )


def tool_counts(tool_calls: DataFrame) -> DataFrame:
    """session_id, tool_calls, files_touched of rows (session_id, tool_call_json, tool_call_update_json)."""
    counts = tool_calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("tool_calls"))
    cells = tool_calls.select("session_id", F.explode(F.array("tool_call_json", "tool_call_update_json")).alias("cell")).where("cell IS NOT NULL")
    paths = cells.select("session_id", F.explode(path_leaves(F.col("cell"))).alias("path")).distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("files_touched"))
    return counts.join(paths, "session_id", "left").select("session_id", "tool_calls", F.coalesce("files_touched", F.lit(0)).alias("files_touched"))


def inventory(sessions: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """A row a session of the command-line store; each child table is aggregated before it is joined."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    m, t = message_counts(messages), tool_counts(tool_calls)
    met = sessions.join(m, sessions["id"] == m["session_id"], "left").drop("session_id").join(t, sessions["id"] == t["session_id"], "left")
    return met.select(
        "id", F.lit("cli").alias("origin"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("project", F.lit("")).alias("project"), "created", "last_activity",
        zero("user_msgs"), zero("assistant_msgs"), zero("tool_calls"), zero("files_touched"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.lit(False).alias("empty_flag"),
    )


def gui_inventory(meta: DataFrame, messages: DataFrame, files: DataFrame) -> DataFrame:
    """A row a file of the GUI store: meta (file, position, key, value), messages (file, kind), files (file, mtime)."""
    low = F.lower("key")
    number = F.col("value").try_cast("double")
    told = meta.groupBy("file").agg(
        F.min_by("value", F.when(F.contains(low, F.lit("title")) & (F.col("value") != ""), F.col("position"))).alias("title"),
        F.min_by(number, F.when((F.contains(low, F.lit("created")) | F.contains(low, F.lit("ts"))) & number.isNotNull(), F.col("position"))).alias("created"),
        F.max(F.when(F.col("key") == "cwd", F.col("value"))).alias("project"),
    )
    has = lambda x: F.contains(F.lower("kind"), F.lit(x))
    counts = messages.groupBy("file").agg(F.count_if(has("user")).alias("user_msgs"), F.count_if(~has("user")).alias("assistant_msgs"), F.count_if(has("tool")).alias("tool_calls"))
    met = files.join(told, "file", "left").join(counts, "file", "left")
    seconds = F.when(F.col("created") > 1e12, F.col("created") / 1000).otherwise(F.nullif(F.col("created"), F.lit(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return met.select(
        F.substring_index(F.substring_index("file", "/", -1), ".db", 1).alias("id"), F.lit("gui").alias("origin"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("project", F.lit("")).alias("project"),
        F.coalesce(seconds, F.col("mtime")).alias("created"), F.col("mtime").alias("last_activity"), zero("user_msgs"), zero("assistant_msgs"), zero("tool_calls"), F.lit(0).cast("bigint").alias("files_touched"),
        F.lit("").alias("prompt"), F.lit(False).alias("empty_flag"),
    )


def merged(cli: DataFrame, gui: DataFrame) -> DataFrame:
    """Both stores; a GUI row whose id the other store has is left out."""
    return cli.unionByName(gui.join(cli.select("id"), "id", "left_anti"))


def duplicates(rows: DataFrame) -> DataFrame:
    """Rows with ``duplicate``: another row of equal project and normalised title has a higher score (or comes first)."""
    title, points = scalars.norm_title(F.col("title")), scalars.score(F.col("user_msgs"), F.col("tool_calls"))
    named = rows.select("project", title.alias("norm"), F.struct((-points).alias("p"), "origin", "id").alias("rank")).where("norm <> ''")
    # One row a title by partial aggregation, so the untitled and a frequent title meet in no task.
    best = named.groupBy("project", "norm").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("project").alias("__p"), "norm", "best")
    met = rows.withColumn("__t", title).join(best, F.col("project").eqNullSafe(F.col("__p")) & (F.col("__t") == F.col("norm")), "left")
    other = (F.col("best.id") != F.col("id")) | (F.col("best.origin") != F.col("origin"))
    return met.withColumn("duplicate", F.coalesce(other, F.lit(False))).drop("__p", "__t", "norm", "best")


def classify(rows: DataFrame, rules: Rules, now: float, keep_ids: DataFrame | None = None, keep_patterns: list[str] | None = None) -> DataFrame:
    """Rows with tier (keep, auto_delete, judge) and reason; the first rule that fits decides."""
    rows = duplicates(rows)
    if keep_ids is not None:
        rows = rows.join(keep_ids.select(F.col("id"), F.lit(True).alias("listed")).distinct(), "id", "left")
    else:
        rows = rows.withColumn("listed", F.lit(False))
    c, points = F.col, scalars.score(F.col("user_msgs"), F.col("tool_calls"))
    title = c("title")
    empty = c("empty_flag") | ((c("user_msgs") == 0) & (c("assistant_msgs") == 0) & (c("tool_calls") == 0))
    grace = F.coalesce((c("last_activity") != 0) & (c("last_activity") > now - rules.grace_hours * 3600), F.lit(False))
    noise = scalars.any_pattern(title, rules.noise_patterns) & (c("tool_calls") <= rules.noise_max_tool_calls)
    short_lived = scalars.any_pattern(title, rules.ephemeral_patterns) & (c("user_msgs") <= rules.ephemeral_max_user_msgs) & (c("tool_calls") <= rules.ephemeral_max_tool_calls)
    unsure = (c("user_msgs") <= rules.judge_max_user_msgs) & (c("tool_calls") <= rules.judge_max_tool_calls) & (c("files_touched") == 0) & (points < rules.judge_max_score)
    says = lambda tier, reason: F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"))
    verdict = (
        F.when(F.coalesce(c("listed"), F.lit(False)) | scalars.any_pattern(title, rules.keep_title_patterns + (keep_patterns or [])), says("keep", "allowlist/marked"))
        .when(grace, says("keep", "grace window"))
        .when(empty, says("auto_delete", "empty"))
        .when(c("duplicate"), says("auto_delete", "duplicate"))
        .when(noise, says("auto_delete", "automation/eval noise"))
        .when(short_lived, says("auto_delete", "ephemeral heartbeat/mailbox cycle"))
        .when(unsure, says("judge", "unresolved"))
        .otherwise(says("keep", "substantive work"))
    )
    return rows.withColumn("v", verdict).select(*ROW, points.alias("score"), "v.tier", "v.reason")


def tier_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("tier").agg(F.count(F.lit(1)).alias("sessions"))


def tier_of(ids: DataFrame, classified: DataFrame) -> DataFrame:
    """(id, tier); ids that are not classified read as ``judge``."""
    return ids.join(classified.select("id", "tier"), "id", "left").select("id", F.coalesce("tier", F.lit("judge")).alias("tier"))


def preview(classified: DataFrame) -> DataFrame:
    """A row a session: tier, reason, the sessions under that reason, id."""
    counts = classified.groupBy("tier", "reason").agg(F.count(F.lit(1)).alias("sessions"))
    return classified.select("tier", "reason", "id").join(F.broadcast(counts), ["tier", "reason"]).select("tier", "reason", "sessions", "id")  # as many counts as rules


def judged(classified: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Classified rows with ``action``: delete, keep, or kept because the judge gave no answer.

    ``verdicts``: id, answer (text).
    """
    says = verdicts.select("id", scalars.parse_verdict(F.col("answer")).alias("says"))
    met = classified.join(says, "id", "left")
    action = F.when(F.col("tier") == "auto_delete", "delete").when((F.col("tier") == "judge") & ~F.col("says"), "delete").when((F.col("tier") == "judge") & F.col("says").isNull(), "judge-down").otherwise("keep")
    return met.withColumn("action", action).drop("says")


def delete_plan(actions: DataFrame, rules: Rules) -> DataFrame:
    """(id, tier, reason, rank) of at most ``max_delete`` sessions: automatic ones first, then judged ones."""
    gone = actions.where("action = 'delete'").select("id", "tier", "reason", "created")
    order = [F.when(F.col("tier") == "auto_delete", 0).otherwise(1), F.col("id")]
    top = gone.orderBy(*order).limit(rules.max_delete)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", "tier", "reason", "rank")


# ---- what refers to sessions --------------------------------------------------

SESSION_BYTES = 256


def byte_estimates(sessions: DataFrame, payloads: DataFrame) -> DataFrame:
    """(id, bytes): SESSION_BYTES for a session's row and all its payload characters.

    ``payloads``: session_id, n (characters, null counts nothing).
    """
    own = sessions.select("id", F.lit(SESSION_BYTES).cast("bigint").alias("n"))
    rest = payloads.groupBy(F.col("session_id").alias("id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return own.unionByName(rest).groupBy("id").agg(F.sum("n").alias("bytes"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is NOT IN the parents', as SQL has it.

    A null key, or any null parent, is never an orphan; without parents every
    row is one.  SQL's own NOT IN broadcasts all parents; this is a shuffled anti
    join and one row of counts.
    """
    keys = parents.select(F.col(parent_key).alias("__key"))
    counts = keys.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__key").isNull()).alias("__nulls"))
    lone = children.join(keys.distinct(), F.col(child_key) == F.col("__key"), "left_anti").join(F.broadcast(counts))
    return lone.where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(child_key).isNotNull())).drop("__n", "__nulls")


def orphan_totals(rows: DataFrame, n: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("orphan_rows"), F.coalesce(F.sum(n), F.lit(0)).alias("orphan_bytes"))


def leftovers(files: DataFrame, live_dbs: DataFrame, live_ids: DataFrame, pending: DataFrame) -> DataFrame:
    """Sidecars and locks (name, bytes) of sessions that are in none of three id lists."""
    found = files.withColumn("sid", scalars.leftover_sid(F.col("name"))).where("sid IS NOT NULL")
    for ids in (live_dbs, live_ids, pending):
        found = found.join(ids.select(F.col("id").alias("sid")), "sid", "left_anti")
    return found.select("name", "sid", "bytes")


def labelled(rows: DataFrame, labels: DataFrame, origins: list[str]) -> DataFrame:
    """Inventory rows whose label's origin is one of ``origins`` (labels: id, label, origin, purpose)."""
    found = labels.where(F.col("origin").isin(*origins)).select("id", "label", F.col("origin").alias("label_origin"), "purpose")
    return rows.join(found, "id").select("id", "title", F.col("origin").alias("session_origin"), "last_activity", "label", "label_origin", "purpose")


def tier_bytes(estimates: DataFrame, classified: DataFrame) -> DataFrame:
    """(tier, bytes, sessions): estimates by tier; ids that are not classified count as kept."""
    met = estimates.join(classified.select("id", "tier"), "id", "left").withColumn("tier", F.coalesce("tier", F.lit("keep")))
    return met.groupBy("tier").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("sessions"))


def gui_state(items: DataFrame, prefix: str, stale_before: float) -> DataFrame:
    """State keys under a prefix (SQLite's case-insensitive LIKE) with size and staleness.

    A value without a numeric ``lastUpdated`` is stale.
    """
    found = items.where(F.lower(F.substring("key", 1, len(prefix))) == prefix.lower())
    backend, slug = scalars.gui_key(F.col("key"), prefix)
    v = F.try_variant_get(F.try_parse_json("value"), "$.lastUpdated", "variant")
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    updated = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(F.try_parse_json("value"), "$.lastUpdated", "double"))
    fresh = F.coalesce(updated / 1000 >= stale_before, F.lit(False))
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return found.select("key", backend.alias("backend"), slug.alias("slug"), size.cast("bigint").alias("bytes"), (~fresh).alias("stale"), updated.alias("last_updated"))


def span(rows: DataFrame, *columns: str) -> DataFrame:
    """(oldest, newest) over several columns; zero and null do not count."""
    real = [F.when(F.col(c) != 0, F.col(c)) for c in columns]
    return rows.agg(F.min(F.least(*real)).alias("oldest"), F.max(F.greatest(*real)).alias("newest")) if len(real) > 1 else rows.agg(F.min(real[0]).alias("oldest"), F.max(real[0]).alias("newest"))


def store_totals(stores: DataFrame, largest: str = "TB") -> DataFrame:
    """One more row than ``stores`` (name, bytes, recoverable_bytes): the total; ``largest`` is the last unit shown."""
    total = stores.agg(F.lit("total").alias("name"), F.sum("bytes").alias("bytes"), F.sum("recoverable_bytes").alias("recoverable_bytes"))
    both = stores.select("name", "bytes", "recoverable_bytes").unionByName(total)
    return both.withColumn("shown", scalars.fmt_bytes(F.col("recoverable_bytes"), largest))


def space_report(stores: dict[str, DataFrame | str], largest: str = "TB") -> DataFrame:
    """A row a store of (bytes, recoverable_bytes) frames of one row; the total last.

    A store that could not be read is given by its error, and is a row of no bytes with it.
    ``largest`` is the last unit shown.
    """
    rows, errors = None, {n: s for n, s in stores.items() if isinstance(s, str)}
    for name, one in stores.items():
        if not isinstance(one, str):
            row = one.select(F.lit(name).alias("name"), F.col("bytes").cast("bigint").alias("bytes"), F.col("recoverable_bytes").cast("bigint").alias("recoverable_bytes"))
            rows = row if rows is None else rows.unionByName(row)
    if errors:
        spark = SparkSession.getActiveSession()
        broken = spark.createDataFrame([(n, 0, 0) for n in errors], "name string, bytes bigint, recoverable_bytes bigint")
        rows = broken if rows is None else rows.unionByName(broken)
    why = F.lit(None).cast("string")
    for name, problem in errors.items():
        why = F.when(F.col("name") == name, problem).otherwise(why)
    return store_totals(rows, largest).withColumn("error", why)


def deletable(*ids: DataFrame) -> DataFrame:
    """(id): every id of several lists, once."""
    every = ids[0].select("id")
    for more in ids[1:]:
        every = every.union(more.select("id"))
    return every.distinct()


def stale_keys(state: DataFrame, gate: DataFrame, running: bool = False) -> DataFrame:
    """Keys of ``gui_state`` that may be deleted: the stale ones, if the snapshot passes the gate and nothing runs.

    ``gate``: one row (ok), as ``snapshots.deletion_gate`` makes it.
    """
    open_ = gate.select(F.coalesce("ok", F.lit(False)).alias("__ok")).limit(1)
    return state.where("stale").join(F.broadcast(open_)).where(F.col("__ok") & F.lit(not running)).drop("__ok")


def first_labelled(rows: DataFrame, n: int = 10) -> DataFrame:
    """The first sessions of ``labelled`` that a text report shows, by id, and the day they were active in the session's time zone (``-`` if that is not known)."""
    day = F.date_format(F.timestamp_seconds("last_activity"), "yyyy-MM-dd")
    return rows.orderBy("id", "label", "title").limit(n).select("id", "label", "title", F.coalesce(day, F.lit("-")).alias("day"))


def span_shown(spans: DataFrame) -> DataFrame:
    """``span`` as text: two days in the session's time zone, one if they are equal, ``-`` if there is none."""
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    a, b = day("oldest"), day("newest")
    both = F.when(a.isNull() | (a == b), F.coalesce(b, a)).otherwise(F.concat(a, F.lit(" → "), F.coalesce(b, F.lit(""))))
    return spans.select(F.coalesce(both, F.lit("-")).alias("span"))


def cleanup_tiers(sidecar_bytes: DataFrame, orphan: DataFrame, leftover: DataFrame, locks: DataFrame, stale_sessions: DataFrame, stale_gui: DataFrame) -> DataFrame:
    """(tier, bytes, items) of what each clean-up tier would free; every argument is one row (bytes, items)."""
    tiers = [("tier1", sidecar_bytes), ("tier1", orphan), ("tier1", leftover), ("tier1", locks), ("tier2", stale_sessions), ("tier3", stale_gui)]
    rows = None
    for name, one in tiers:
        row = one.select(F.lit(name).alias("tier"), F.col("bytes").cast("bigint").alias("bytes"), F.col("items").cast("bigint").alias("items"))
        rows = row if rows is None else rows.unionByName(row)
    return rows.groupBy("tier").agg(F.sum("bytes").alias("bytes"), F.sum("items").alias("items"))


def sidecar_total(files: DataFrame, db: str) -> DataFrame:
    """(bytes, items) of the files named ``<db>-*``."""
    return files.where(F.startswith("name", F.lit(db + "-"))).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("items"))


def without(rows: DataFrame, ids: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows of sessions that are not in ``ids``: a deletion, as a new table."""
    return rows.join(ids.select(F.col("id").alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")
