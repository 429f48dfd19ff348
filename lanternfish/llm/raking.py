"""Mix sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic) classes.  The token mass
of the cells is raked in turn to the target marginals of each dimension until
they hold together; the ratio of raked to present mass is the probability with
which a document of the cell is drawn.  A draw compares the probability with a
hash of the id, so a rerun draws the same documents.

No probability can exceed 1, so masses are raked under that bound: after every
step a cell is cut to the tokens it has, and the steps behind it make up for that
in its neighbours.  How much of all tokens can be kept with the targets met is
not known beforehand.  At most it is KEEP, or what the scarcest class allows by
itself; from there GRID smaller shares are raked side by side, and the largest
one is taken whose marginals are within NEAR of their targets after ROUNDS
rounds.  Where none is (classes that only occur together), the one is taken that
comes nearest, and ``missed`` names the classes that are off by more than TOLD.

A topic is what a text is about as far as its own content words say: the subject
whose vocabulary (``TOPICS``, a parameter of the module) begins most words of the
whole text, ``general`` for a text with words but none of these.

Classes are the values named in the targets, and ``other`` for the rest, so the
number of cells is bounded by the parameters (at most 500 by default) and not by
the data: the fit runs in one small partition and its result is broadcast.
Documents are only counted by partial aggregation and never shuffled.  DataFrame
functions only.

Defined results: a null source or language, or one without a target, is
``other``, which keeps its natural share while the named ones share the rest as
their targets say.  A class without tokens hands its target to the others of
its dimension in proportion.  A text that is null or has no words has no tokens,
the topic ``other`` and its cell's probability; a cell without tokens has
probability 1.  Repeated rows are drawn alike, and so are all rows with a null
id.  Extra columns are ignored by ``plan_mix`` and kept by ``mix``.  An empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

OTHER, GENERAL = "other", "general"
KEEP = 0.5
GRID = 16
ROUNDS = 12
NEAR = 0.005
TOLD = 0.01
DIMENSIONS = ("source", "lang", "topic")

# How words of a subject begin, in four languages, by subject in order of preference.
TOPICS = {
    "legal": ["licen[cs]", "copyright", "all rights reserved", "warrant[iy]", "lizenz", "urheber", "gewährleist", "droits d.auteur", "garantie", "derechos de autor", "garantía"],
    "contact": ["[a-z0-9._%+-]{1,64}@[a-z0-9-]+[.]", "https?://", "[+]?[0-9][0-9() -]{7,20}[0-9]", "e-?mail", "telefon", "tél[eé]phone", "teléfono"],
}


@dataclass(frozen=True)
class Targets:
    """Shares of token mass by dimension; each dimension's values are scaled to 1."""

    source: dict[str, float] = field(default_factory=lambda: {"src0": 4.0} | {f"src{i}": 1.0 for i in range(1, 20)})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14})
    topic: dict[str, float] = field(default_factory=lambda: {"general": 0.96, "legal": 0.015, "contact": 0.025})


def _class(name: str, targets: dict[str, float]) -> Column:
    return F.when(F.col(name).isin(*targets), F.col(name)).otherwise(F.lit(OTHER)) if targets else F.lit(OTHER)


def _vocabulary(beginnings: list[str]) -> str:
    return rf"(?i)[\x20\x09-\x0D](?:{'|'.join(beginnings)})"


def counted(documents: DataFrame, targets: Targets, prefix: str = "") -> DataFrame:
    """``documents`` with source, lang, topic and n_tokens under ``prefix``; every pattern goes over a text once."""
    text, p = F.coalesce(F.col("text"), F.lit("")), prefix
    hits = {t: F.regexp_count(F.concat(F.lit(" "), text), F.lit(_vocabulary(words))).alias(f"h{i}") for i, (t, words) in enumerate(TOPICS.items())}
    counts = F.struct(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n"), *hits.values())
    rows = documents.withColumn(f"{p}counts", counts)
    at = lambda name: F.col(f"{p}counts.{name}")
    best = F.greatest(*[at(f"h{i}") for i in range(len(TOPICS))], F.lit(0))
    topic = F.coalesce(*[F.when((at(f"h{i}") == best) & (best > 0), F.lit(t)) for i, t in enumerate(TOPICS)], F.when(at("n") > 0, F.lit(GENERAL)), F.lit(OTHER))
    named = F.when(topic.isin(*targets.topic), topic).otherwise(F.lit(OTHER)) if targets.topic else F.lit(OTHER)
    classes = {f"{p}source": _class("source", targets.source), f"{p}lang": _class("lang", targets.lang), f"{p}topic": named, f"{p}n_tokens": at("n")}
    return rows.withColumns(classes).drop(f"{p}counts")


def _share(name: str, targets: dict[str, float]) -> Column:
    """The unscaled target of a cell's class; null for ``other``."""
    share = F.lit(None).cast("double")
    for value, weight in targets.items():
        share = F.when(F.col(name) == value, F.lit(float(weight))).otherwise(share)
    return share


def rake(slim: DataFrame, targets: Targets, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """A row a cell: source, lang, topic, tokens, probability, keep (the share of all tokens kept),
    the expected share of each of its classes among them (``*_share``), and ``missed``."""
    cells = slim.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens")).coalesce(1)
    everything = Window.partitionBy(F.lit(1))
    cells = cells.withColumn("total", F.sum("tokens").over(everything))
    for d in DIMENSIONS:
        own = Window.partitionBy(d)
        first = F.row_number().over(own.orderBy(*[x for x in DIMENSIONS if x != d])) == 1
        cells = cells.withColumns({"mass": F.sum("tokens").over(own), "goal": _share(d, getattr(targets, d)), "first": first})
        named = F.sum(F.when(F.col("first") & (F.col("mass") > 0), F.col("goal"))).over(everything)
        rest = F.sum(F.when(F.col("goal").isNull(), F.col("tokens"))).over(everything)
        aim = F.coalesce(F.col("goal") / F.nullif(named, F.lit(0.0)) * (F.col("total") - F.coalesce(rest, F.lit(0.0))), F.col("mass"))
        cells = cells.withColumns({f"aim_{d}": F.when(F.col("mass") > 0, aim).otherwise(0.0), f"room_{d}": F.col("mass") / F.nullif(aim, F.lit(0.0))})
    most = F.least(F.lit(keep), F.min(F.least(*[F.col(f"room_{d}") for d in DIMENSIONS])).over(everything))
    cells = cells.withColumn("most", F.coalesce(most, F.lit(keep))).select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("try"))
    cells = cells.withColumn("keep", F.col("most") * (1 - F.col("try") / GRID)).withColumn("w", F.col("tokens") * F.col("keep"))
    cells = cells.select(*DIMENSIONS, "tokens", "total", *[f"aim_{d}" for d in DIMENSIONS], "try", "keep", "w")

    def mass(d: str) -> Column:
        """The raked mass of a cell's class, added up in one order always."""
        ordered = Window.partitionBy("try", d).orderBy(*[x for x in DIMENSIONS if x != d])
        return F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    for _ in range(rounds):
        for d in DIMENSIONS:
            step = F.col("w") * (F.col(f"aim_{d}") * F.col("keep")) / F.nullif(mass(d), F.lit(0.0))
            cells = cells.withColumn("w", F.least(F.col("tokens"), F.coalesce(step, F.lit(0.0))))
    each = Window.partitionBy("try")
    cells = cells.withColumn("drawn", F.nullif(F.sum("w").over(each), F.lit(0.0)))
    for d in DIMENSIONS:
        cells = cells.withColumn(f"{d}_share", F.coalesce(mass(d) / F.col("drawn"), F.lit(0.0)))
    off = {d: F.abs(F.col(f"{d}_share") / F.nullif(F.col(f"aim_{d}") / F.col("total"), F.lit(0.0)) - 1) for d in DIMENSIONS}
    cells = cells.withColumn("error", F.coalesce(F.max(F.greatest(F.lit(0.0), *off.values())).over(each), F.lit(0.0)))
    rank = F.struct(F.when(F.col("error") <= NEAR, 0.0).otherwise(F.col("error")).alias("error"), F.col("try").alias("try"))
    cells = cells.withColumn("best", F.min(rank).over(everything)["try"]).where(F.col("try") == F.col("best"))
    names = F.flatten(F.collect_set(F.array_compact(F.array(*[F.when(off[d] > TOLD, F.concat(F.lit(f"{d}="), F.col(d))) for d in DIMENSIONS]))).over(everything))
    probability = F.coalesce(F.col("w") / F.nullif(F.col("tokens"), F.lit(0.0)), F.lit(1.0))
    shares = [F.col(f"{d}_share") for d in DIMENSIONS]
    kept = F.coalesce(F.col("drawn") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(1.0))
    return cells.select(*DIMENSIONS, "tokens", probability.alias("probability"), kept.alias("keep"), *shares, F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("missed"))


def chance(key: Column) -> Column:
    """A number from 0 up to 1, of 52 bits, that only depends on the id."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def plan_mix(documents: DataFrame, targets: Targets | None = None, key: str = "doc_id") -> DataFrame:
    """A row a document: id, classes, n_tokens, probability, kept, and what the mixture reaches: keep, a share for each class, missed."""
    targets = targets or Targets()
    slim = store.cut(counted(documents.select(F.col(key), "text", "source", "lang"), targets).drop("text"), "mix")
    cells = rake(slim, targets).drop("tokens").select(*[F.col(d).alias(f"c_{d}") for d in DIMENSIONS], "probability", "keep", *[f"{d}_share" for d in DIMENSIONS], "missed")
    met = slim.join(F.broadcast(cells), [slim[d] == cells[f"c_{d}"] for d in DIMENSIONS])
    shown = [F.round(c, 9).alias(c) for c in ("probability", "keep", *[f"{d}_share" for d in DIMENSIONS])]
    return met.select(key, *DIMENSIONS, "n_tokens", (chance(F.col(key)) < F.col("probability")).alias("kept"), *shown, "missed")


def mix(documents: DataFrame, targets: Targets | None = None, key: str = "doc_id") -> DataFrame:
    """The documents drawn, with all their columns."""
    targets, p = targets or Targets(), store.free_prefix(documents)
    wide = store.cut(counted(documents, targets, p), "mix")
    cells = rake(wide.select(*[F.col(p + c).alias(c) for c in (*DIMENSIONS, "n_tokens")]), targets)
    cells = cells.select(*[F.col(d).alias(f"{p}c_{d}") for d in DIMENSIONS], F.col("probability").alias(f"{p}probability"))
    met = wide.join(F.broadcast(cells), [F.col(f"{p}{d}") == F.col(f"{p}c_{d}") for d in DIMENSIONS])
    return met.where(chance(F.col(key)) < F.col(f"{p}probability")).select(*documents.columns)


def oracle(targets: Targets | None = None) -> str:
    targets = targets or Targets()
    quoted = lambda d: ", ".join(f"'{v}'" for v in getattr(targets, d))
    hits = {t: f"len(regexp_extract_all(' ' || coalesce(text, ''), '{_vocabulary(w)}'))" for t, w in TOPICS.items()}
    best = f"greatest({', '.join(hits.values())})"
    topic = "CASE " + " ".join(f"WHEN {c} = {best} AND {c} > 0 THEN '{t}'" for t, c in hits.items()) + f" WHEN n_tokens > 0 THEN '{GENERAL}' ELSE '{OTHER}' END"
    goal = lambda d: "CASE " + " ".join(f"WHEN {d} = '{v}' THEN {float(w)}" for v, w in getattr(targets, d).items()) + " END"
    ctes = [
        "raw AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)",
        f"""docs AS MATERIALIZED (SELECT doc_id, CASE WHEN source IN ({quoted("source")}) THEN source ELSE '{OTHER}' END AS source,
  CASE WHEN lang IN ({quoted("lang")}) THEN lang ELSE '{OTHER}' END AS lang, {topic} AS topic, n_tokens FROM raw)""",
        "sums AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, sum(sum(n_tokens)) OVER () AS total FROM docs GROUP BY source, lang, topic)",
    ]
    for d in DIMENSIONS:
        ctes.append(f"m_{d} AS MATERIALIZED (SELECT {d}, sum(tokens) AS mass, {goal(d)} AS goal FROM sums GROUP BY {d})")
        ctes.append(
            f"""a_{d} AS MATERIALIZED (SELECT {d}, mass, CASE WHEN mass > 0 THEN coalesce(goal / (SELECT nullif(sum(goal), 0) FROM m_{d} WHERE mass > 0)
  * ((SELECT sum(mass) FROM m_{d}) - coalesce((SELECT sum(mass) FROM m_{d} WHERE goal IS NULL), 0)), mass) ELSE 0 END AS aim_{d} FROM m_{d})"""
        )
    rooms = " UNION ALL ".join(f"SELECT min(mass / nullif(aim_{d}, 0)) AS room FROM a_{d}" for d in DIMENSIONS)
    mass = lambda d: f"sum(w) OVER (PARTITION BY try, {d})"
    step = "it WHERE n < " + str(ROUNDS)
    for d in DIMENSIONS:
        step = f"(SELECT * REPLACE (least(tokens, coalesce(w * (aim_{d} * keep) / nullif({mass(d)}, 0), 0)) AS w) FROM {step})"
    off = lambda d: f"abs({d}_share / nullif(aim_{d} / total, 0) - 1)"
    ctes += [
        f"most AS MATERIALIZED (SELECT coalesce(least({KEEP}, min(room)), {KEEP}) AS most FROM ({rooms}))",
        f"""it AS (SELECT 0 AS n, source, lang, topic, tokens, total, {", ".join(f"aim_{d}" for d in DIMENSIONS)}, try, most * (1 - try / {GRID}) AS keep, tokens * (most * (1 - try / {GRID})) AS w
  FROM sums JOIN a_source USING (source) JOIN a_lang USING (lang) JOIN a_topic USING (topic), most, (SELECT unnest(range({GRID})) AS try)
  UNION ALL SELECT * REPLACE (n + 1 AS n) FROM {step})""",
        f"s AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY try) AS drawn, {', '.join(f'coalesce({mass(d)} / nullif(sum(w) OVER (PARTITION BY try), 0), 0) AS {d}_share' for d in DIMENSIONS)} FROM it WHERE n = {ROUNDS})",
        f"e AS MATERIALIZED (SELECT try, coalesce(max(greatest(0, {', '.join(off(d) for d in DIMENSIONS)})), 0) AS error FROM s GROUP BY try)",
        f"best AS MATERIALIZED (SELECT try FROM e ORDER BY CASE WHEN error <= {NEAR} THEN 0 ELSE error END, try LIMIT 1)",
        "taken AS MATERIALIZED (SELECT * FROM s JOIN best USING (try))",
        "misses AS MATERIALIZED (SELECT coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '') AS missed FROM (" + " UNION ALL ".join(f"SELECT '{d}=' || {d} AS x FROM taken WHERE {off(d)} > {TOLD}" for d in DIMENSIONS) + "))",
    ]
    return f"""WITH RECURSIVE {", ".join(ctes)}
SELECT doc_id, source, lang, topic, n_tokens, missed, round(coalesce(w / nullif(tokens, 0), 1), 9) AS probability, round(coalesce(drawn / nullif(total, 0), 1), 9) AS keep,
  {", ".join(f"round({d}_share, 9) AS {d}_share" for d in DIMENSIONS)},
  CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 < coalesce(w / nullif(tokens, 0), 1) AS kept
FROM docs JOIN taken USING (source, lang, topic), misses"""
