"""Values split over neighbouring payloads.

Edges of payloads are described by a few numbers; only where they say that a
value may go on across the border are the two texts joined and scanned.  The
window that pairs neighbours carries descriptors only, so one giant session
costs a sort of narrow rows; texts are joined in for the pairs that pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detect
from ..functions.binding import let
from ..functions.jsontext import cell_texts
from .scan import FINDING

# How the cheap test looks at an edge.
EDGE_LEAVES = 8
TAIL_WINDOW = 160
RUN_MIN = 12
#: Row ids of one range; the rows at its end find the next range's first by a join.
RANGE = 100_000
RUN = "[A-Za-z0-9_+/.~=-]+"
MARKERS = ["AKIA", "ASIA", "sk-", "sk_live_", "rk_live_", "AIza", "xox", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "eyJ", "-----BEGIN"]
CONTEXTS = [
    r"[Bb]earer(?:\s+[A-Za-z0-9._~+/=-]*)?$",
    r"[A-Za-z_][A-Za-z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD|PASSWD|CREDENTIAL)[A-Za-z0-9_]*\s*=\s*\S*$",
    r"(?i)(?:pairing|pair)[ -]?code\s*[:=]?\s*[A-Z0-9-]{0,}$",
]


def edge(text: Column) -> Column:
    """struct(head_len, tail_len, suspicious) of a payload."""
    context = F.lit(False)
    for c in CONTEXTS:
        context = context | F.right(text, F.lit(TAIL_WINDOW)).rlike(detect.port_regex(c))
    head = F.length(F.regexp_extract(text, f"^{RUN}", 0))

    def described(tail: Column) -> Column:
        marked = F.exists(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(tail, m) | F.startswith(m, tail))
        return F.struct(head.alias("head_len"), F.length(tail).alias("tail_len"), ((tail != "") & marked | context).alias("suspicious"))

    return let(F.regexp_extract(text, f"(?d){RUN}$", 0), described)


def maybe_split(a: Column, b: Column) -> Column:
    """Whether a value may begin in a payload with edge ``a`` and go on in one with edge ``b``."""
    return (b["head_len"] > 0) & ((a["tail_len"] > 0) & (a["tail_len"] + b["head_len"] >= RUN_MIN) | a["suspicious"])


def units(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per row: leaves (of the columns in turn), text (all joined), and both edges' candidates.

    ``rows``: file, tab, rowid, session_id and the columns.
    """
    empty = F.array().cast("array<string>")
    leaves = F.concat(*[F.when(F.col(c).isNotNull() & (F.col(c) != ""), cell_texts(F.col(c))).otherwise(empty) for c in columns])
    made = rows.select("file", "tab", "rowid", "session_id", leaves.alias("leaves")).withColumn("text", F.array_join("leaves", ""))
    first, last = F.slice("leaves", 1, EDGE_LEAVES), F.slice(F.reverse("leaves"), 1, EDGE_LEAVES)
    label = F.concat("tab", F.lit("." + "+".join(columns) + "#rowid="), F.col("rowid").cast("string"))
    return made.withColumns({"head_texts": F.concat(F.array("text"), first), "tail_texts": F.concat(F.array("text"), F.reverse(last)), "label": label})


def _scan(candidates: DataFrame) -> DataFrame:
    """Distinct findings in candidate texts (file, location, combined_with, candidate)."""
    found = detect.each_hit(candidates.withColumnRenamed("candidate", "text"), "file", "location", "combined_with")
    found = found.select("file", "location", "combined_with", F.col("h.category").alias("category"), F.col("h.pattern").alias("pattern"), F.col("h.idx").alias("idx"), F.col("h.value").alias("value"))
    one = found.groupBy("file", "location", "combined_with", "category", detect.fingerprint(F.col("value")).alias("fingerprint")).agg(F.min(F.struct("idx", "pattern", "value")).alias("m"))
    none = F.lit(None).cast("string")
    return one.select("file", "category", F.col("m.pattern").alias("pattern"), F.lit("cross-chunk").alias("kind"), "location", "fingerprint", detect.mask(F.col("m.value")).alias("preview"), none.alias("reason"), none.alias("target"), "combined_with").select(*FINDING)


def _unknown(found: DataFrame, known: DataFrame | None, *places: str) -> DataFrame:
    """Findings that the plain scan has not made at any of their places (lines left out)."""
    if known is None:
        return found
    k = known.select(F.col("file").alias("kf"), F.regexp_replace("location", r":line \d+$", "").alias("kl"), F.col("category").alias("kc"), F.col("fingerprint").alias("kp")).distinct()
    for p in places:
        found = found.join(k, (F.col("file") == F.col("kf")) & (F.col(p) == F.col("kl")) & (F.col("category") == F.col("kc")) & (F.col("fingerprint") == F.col("kp")), "left_anti")
    return found


def inside_units(made: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Values split over the leaves of one payload: leaves up to EDGE_LEAVES apart, or the whole text."""
    with_edges = made.where(F.size("leaves") > 1).select("file", "label", "text", "leaves", F.transform("leaves", edge).alias("edges"))
    n = F.size("leaves")
    near = lambda i: F.when(i + 1 < n, F.sequence(i + 1, F.least(i + EDGE_LEAVES, n - 1))).otherwise(F.array().cast("array<int>"))
    split = lambda i, j: maybe_split(F.get("edges", i), F.get("edges", j))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.filter(near(i), lambda j: split(i, j)), lambda j: F.concat(F.get("leaves", i), F.get("leaves", j)))))
    whole = F.when(F.exists(F.sequence(F.lit(0), n - 2), lambda i: split(i, i + 1)), F.array("text")).otherwise(F.array().cast("array<string>"))
    texts = with_edges.select("file", F.col("label").alias("location"), F.lit(None).cast("string").alias("combined_with"), F.explode(F.array_distinct(F.concat(whole, pairs))).alias("candidate"))
    return _unknown(_scan(texts), known, "location")


def with_next(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows with ``nxt``, a struct of the next row's id and columns in the order of ids within ``by``."""
    nxt = F.struct("rowid", *columns)
    ranged = rows.withColumn("__range", F.floor(F.col("rowid") / RANGE))
    inside = ranged.withColumn("__inside", F.lead(nxt).over(Window.partitionBy(*by, "__range").orderBy("rowid")))
    firsts = ranged.groupBy(*by, "__range").agg(F.min_by(nxt, "rowid").alias("__first"))
    after = firsts.select(*by, "__range", F.lead("__first").over(Window.partitionBy(*by).orderBy("__range")).alias("__after")).where("__after IS NOT NULL")
    after = after.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__at"), "__after")
    met = [inside[c].eqNullSafe(after[f"__{c}"]) for c in by]
    ends = inside.join(after, [*met, F.col("__inside").isNull(), F.col("__range") == F.col("__at")], "left")
    return ends.select(*rows.columns, F.coalesce("__inside", "__after").alias("nxt"))


def across_rows(made: DataFrame, known: DataFrame | None = None, scoped: bool = False) -> DataFrame:
    """Values split over neighbouring rows of a table, in the order of their row ids.

    Rows are neighbours in the whole table and count only if their sessions are
    equal; ``scoped`` pairs neighbours within each session instead.
    """
    by = ["file", "tab", "session_id"] if scoped else ["file", "tab"]
    narrow = made.select("file", "tab", "rowid", "session_id", "label", F.transform("head_texts", edge).alias("heads"), F.transform("tail_texts", edge).alias("tails"))
    pairs = with_next(narrow, by, ["session_id", "label", "heads"])
    pairs = pairs.where(F.col("nxt").isNotNull() & (F.col("session_id") != "") & (F.col("session_id") == F.col("nxt.session_id")))
    open_ = F.exists("tails", lambda a: F.exists("nxt.heads", lambda b: maybe_split(a, b)))
    pairs = pairs.where(open_).select("file", "tab", "rowid", "tails", F.col("nxt.heads").alias("heads"), F.col("nxt.rowid").alias("next_rowid"), F.col("label").alias("location"), F.col("nxt.label").alias("combined_with"))
    left = made.select("file", "tab", "rowid", "tail_texts")
    right = made.select("file", "tab", F.col("rowid").alias("next_rowid"), "head_texts")
    met = pairs.join(left, ["file", "tab", "rowid"]).join(right, ["file", "tab", "next_rowid"])
    a, b = F.arrays_zip("tail_texts", "tails"), F.arrays_zip("head_texts", "heads")
    candidates = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: maybe_split(x["tails"], y["heads"])), lambda y: F.concat(x["tail_texts"], y["head_texts"]))))
    return _unknown(_scan(met.select("file", "location", "combined_with", F.explode(F.array_distinct(candidates)).alias("candidate"))), known, "location", "combined_with")
