"""Chat formatting: collapse cumulative snapshots, then render what is left.

Loggers often store a conversation after every turn, so one conversation is a
prefix of the next.  Every turn gets a rolling hash of all turns up to it; a
conversation whose last hash is an inner hash of a longer one is covered by it.
Of conversations with equal turns the one with the smallest id stays.

The hash of a prefix is the XOR of hashes of (position, role, text), in two
independent 64-bit halves.  XOR is associative, so a conversation may be split
over range partitions: positions and prefixes are first taken in each part and
then shifted by the parts before it.  No conversation, whatever its length, has
to fit one task, and rendering gives one row for every CHUNK turns.  Hashes are
taken once, when the turns are ordered; from there on only narrow rows move,
and the texts of the conversations that stay are joined in at the end.

Defined results: turns go by (turn, role, text), nulls first; rows equal in all
four columns count once; two rows of one turn that differ both count.  A null
role renders as ``unknown``, a null text as empty.  Null conversation ids form
one conversation.  An empty table gives no rows.  Only the four named columns
are read, so extra ones cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

CHUNK = 1000
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _quoted(text: Column) -> Column:
    """Text in which no marker can be mistaken for a real one."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The distinct turns in order: conv_id, part (a range of them), seq (rising), role, text, and hashes x1 and x2."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    half = lambda salt: F.xxhash64(F.lit(salt), F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), "role", "text", half(1).alias("x1"), half(2).alias("x2"))
    return store.cut(rows, "turns")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """A row a turn: conv_id, seq, pos (from 1), n_turns, h1 and h2 of the turns so far."""
    inner = Window.partitionBy("part", "conv_id").orderBy("seq")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    rows = turns.select("conv_id", "part", "seq", "x1", "x2")
    counts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"), F.sum("n").over(whole).alias("n_turns"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["part"] == b["part"])
    local = rows.withColumn("at", F.row_number().over(inner))
    placed = local.join(counts, same(local, counts)).select(local["conv_id"], local["part"], "seq", (F.col("at") + F.col("shift")).alias("pos"), "n_turns", "x1", "x2")
    placed = placed.withColumns({"t1": F.xxhash64("pos", "x1"), "t2": F.xxhash64(F.lit(2), "pos", "x2")}).drop("x1", "x2")
    sums = placed.groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    sums = sums.select("conv_id", "part", F.coalesce(F.bit_xor("s1").over(before), F.lit(0)).alias("b1"), F.coalesce(F.bit_xor("s2").over(before), F.lit(0)).alias("b2"))
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumns({"r1": F.bit_xor("t1").over(running), "r2": F.bit_xor("t2").over(running)})
    return inside.join(sums, same(inside, sums)).select(inside["conv_id"], "seq", "pos", "n_turns", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2"))


def collapse(prefixes: DataFrame) -> DataFrame:
    """A row a conversation: conv_id, n_turns, kept, covered_by (the one kept instead)."""
    keys = ["h1", "h2", "n_turns"]
    last = prefixes.where("pos = n_turns").select("conv_id", *keys)
    equal = last.groupBy(*keys).agg(F.min("conv_id").alias("first_id"))
    inner = prefixes.where("pos < n_turns").groupBy("h1", "h2", F.col("pos").alias("n_turns")).agg(F.min(F.struct((-F.col("n_turns")).alias("n"), "conv_id")).alias("longest"))
    fate = equal.join(inner, keys, "left").select(*keys, "first_id", F.col("longest.conv_id").alias("cover"), F.col("longest").isNotNull().alias("inner_of"))
    kept = ~F.col("inner_of") & F.col("conv_id").eqNullSafe(F.col("first_id"))
    return last.join(fate, keys).select("conv_id", "n_turns", kept.alias("kept"), F.when(~kept, F.when(F.col("inner_of"), F.col("cover")).otherwise(F.col("first_id"))).alias("covered_by"))


def render(turns: DataFrame, prefixes: DataFrame, fates: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The conversations that stay, as marked-up text: a row for every ``chunk`` turns."""
    kept = fates.where("kept").select(F.col("conv_id").alias("id"))
    places = prefixes.select("conv_id", "seq", "pos").join(kept, F.col("conv_id").eqNullSafe(F.col("id")), "left_semi")
    piece = F.concat(F.lit(OPEN), _quoted(F.coalesce("role", F.lit("unknown"))), F.lit("\n"), _quoted(F.col("text")), F.lit(CLOSE + "\n"))
    pieces = places.join(turns.select("seq", piece.alias("piece")), "seq")
    grouped = pieces.select("conv_id", F.floor((F.col("pos") - 1) / chunk).alias("chunk"), F.struct("pos", "piece").alias("x")).groupBy("conv_id", "chunk")
    return grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "").alias("rendered"))


def format_chats(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, n_turns, kept, covered_by, chunk, rendered; one row a conversation that goes."""
    turns = ordered_turns(conversations)
    prefixes = store.cut(prefix_hashes(turns), "prefixes")
    fates = store.cut(collapse(prefixes), "fates")
    texts = render(turns, prefixes, fates, chunk).select(F.col("conv_id").alias("id"), "chunk", "rendered")
    return fates.join(texts, F.col("conv_id").eqNullSafe(F.col("id")), "left").select("conv_id", "n_turns", "kept", "covered_by", F.coalesce("chunk", F.lit(0)).alias("chunk"), "rendered")


def oracle() -> str:
    """The same rows by comparing lists of turns."""
    return f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
lists AS (
  SELECT conv_id, count(*) AS n_turns, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS all_turns
  FROM turns GROUP BY conv_id),
inner_ones AS (
  SELECT conv_id, n_turns, k AS depth, all_turns[1:k] AS head FROM lists, LATERAL (SELECT unnest(range(1, n_turns)) AS k)),
covers AS (SELECT head, depth, arg_min(conv_id, (-n_turns, conv_id)) AS cover FROM inner_ones GROUP BY head, depth),
firsts AS (SELECT all_turns, min(conv_id) AS first_id FROM lists GROUP BY all_turns),
fates AS (
  SELECT l.conv_id, l.n_turns, l.all_turns, c.cover IS NULL AND l.conv_id = f.first_id AS kept,
    CASE WHEN c.cover IS NOT NULL THEN c.cover WHEN l.conv_id <> f.first_id THEN f.first_id END AS covered_by
  FROM lists l LEFT JOIN covers c ON l.all_turns = c.head LEFT JOIN firsts f ON l.all_turns = f.all_turns)
SELECT conv_id, n_turns, kept, covered_by, c AS chunk,
  CASE WHEN kept THEN list_aggregate(list_transform(all_turns[{CHUNK} * c + 1:{CHUNK} * (c + 1)], lambda x: '{OPEN}' || replace(coalesce(x.r, 'unknown'), '<|', '< |') || chr(10)
    || replace(coalesce(x.t, ''), '<|', '< |') || '{CLOSE}' || chr(10)), 'string_agg', '') END AS rendered
FROM fates, LATERAL (SELECT unnest(CASE WHEN kept THEN range(CAST((n_turns - 1) // {CHUNK} + 1 AS BIGINT)) ELSE [CAST(0 AS BIGINT)] END) AS c)"""
