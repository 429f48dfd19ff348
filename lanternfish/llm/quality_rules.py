"""Line-first quality rules, in DataFrame functions only.

Every line with a word is judged by itself: it fails if it does not end in a
terminal mark, is dense in symbols, repeats shouted marks, reads as a navigation
bar, or holds a boilerplate phrase.  Failing lines go, and a document that loses
more than half of its characters is rejected.  Before that two document rules
apply: at least MIN_WORDS words, and at most REPEAT_PERCENT of them in 8-word
windows found twice or more in the text.

Everything of a document is computed inside its row, so nothing is shuffled and
no group of documents can make a task large.  Windows are compared by 64-bit
hashes within one document.

Defined results: a null text has no words and fails; so does an empty one.
Repeated rows give repeated rows.  Only the id and the text are read, so extra
columns cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
LOST_PERCENT = 50

# What a word is, and what counts as a symbol.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

# The line rules.  Both Java's and RE2's dialect read them alike.
TERMINAL = "[.!?…\"”’)。！？]" + SPACE + r"*\z"
SHOUTED = r"!![^!]+!![^!]+!!"
NAVIGATION = "(?:[|›•·»>][^|›•·»>]*){3}"
BOILERPLATE = (
    r"(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|"
    r"subscribe to our|sign up for|log in to|click here|share this|read more|back to top|lorem ipsum|"
    r"alle rechte vorbehalten|datenschutzerkl|nutzungsbedingungen|hier klicken|"
    r"tous droits r[^a-z ]serv|politique de confidentialit|conditions d.utilisation|cliquez ici|"
    r"todos los derechos reservados|pol[^a-z ]tica de privacidad|condiciones de uso|haz clic"
)
SYMBOL_PERCENT = 10


def symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_fails(line: Column) -> Column:
    dense = symbols(line) * 100 > F.length(line) * SYMBOL_PERCENT
    return ~line.rlike(TERMINAL) | dense | line.rlike(SHOUTED) | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)


def repeated_words(words: Column) -> Column:
    """Words covered by a window that occurs at least twice in ``words``."""
    count = F.size(words)
    at = F.sequence(F.lit(0), count - WINDOW)
    keys = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    pair_up = lambda keys: F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    same = lambda s, x, j: (F.get(s, j - 1)["k"].eqNullSafe(x["k"])) | (F.get(s, j + 1)["k"].eqNullSafe(x["k"]))
    places = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, x, j)), lambda x: x["i"]))
    step = lambda p, x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, j: step(p, x, j)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    twice = lambda s: F.exists(F.transform(s, lambda x, j: (j > 0) & (F.get(s, j - 1) == x)), lambda hit: hit)
    found = lambda keys: F.when(let(F.sort_array(keys), twice), let(let(pair_up(keys), places), covered)).otherwise(F.lit(0).cast("bigint"))
    return F.when(count > WINDOW, let(keys, found)).otherwise(F.lit(0).cast("bigint"))


def measures(text: Column) -> Column:
    """All counts of one text as a struct; ``text`` must not be null."""
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    of_lines = let(
        lines,
        lambda xs: F.struct(
            F.size(xs).cast("bigint").alias("n_lines"),
            (F.size(xs) - F.size(F.array_distinct(xs))).cast("bigint").alias("n_dup_lines"),
            chars(xs).alias("line_chars"),
            F.filter(xs, lambda x: ~line_fails(x)).alias("good"),
        ),
    )
    return F.struct(of_words.alias("w"), of_lines.alias("l"))


def apply_rules(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: the counts, base_failed, kept, lines and characters lost, and the cleaned text."""
    body = F.coalesce(F.col(text), F.lit(""))
    m = documents.select(F.col(key), F.length(F.translate(body, SPACES, "")).cast("bigint").alias("word_chars"), symbols(body).cast("bigint").alias("n_symbols"), measures(body).alias("m"))
    m = m.select(key, "word_chars", "n_symbols", "m.w.*", "m.l.*")
    left = F.aggregate("good", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    m = m.withColumns({"lines_lost": F.col("n_lines") - F.size("good"), "chars_lost": F.col("line_chars") - left, "clean_text": F.array_join("good", "\n")})
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    kept = ~failed & (F.col("chars_lost") * 100 <= F.col("line_chars") * LOST_PERCENT)
    return m.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "lines_lost", "chars_lost", "clean_text")


def oracle() -> str:
    q = lambda s: s.replace("'", "''")
    sym = lambda c: f"(length({c}) - length(translate({c}, '{SYMBOLS}', '')))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, list_filter(string_split_regex(text, '{SPACE}+'), lambda x: x <> '') AS w FROM docs),
windows AS (SELECT r, i, w[i:i + {WINDOW - 1}] AS g FROM words, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
lines AS (SELECT r, i, ls[i] AS line FROM (SELECT r, string_split(text, chr(10)) AS ls FROM docs), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
judged AS (
  SELECT r, i, line, NOT regexp_matches(line, '{q(TERMINAL)}') OR {sym("line")} * 100 > length(line) * {SYMBOL_PERCENT} OR regexp_matches(line, '{SHOUTED}')
    OR regexp_matches(line, '{NAVIGATION}') OR regexp_matches(line, '{BOILERPLATE}') AS bad
  FROM lines WHERE regexp_matches(line, '{NOT_SPACE}')),
per_line AS (SELECT r, count(*) - count(DISTINCT line) AS dups, sum(length(line)) AS chars, count(*) FILTER (bad) AS lost, coalesce(sum(length(line)) FILTER (bad), 0) AS chars_lost,
  string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS clean FROM judged GROUP BY r),
counts AS (
  SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST({sym("d.text")} AS BIGINT) AS n_symbols, CAST(coalesce(l.dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(l.lost, 0) AS BIGINT) AS lines_lost, CAST(coalesce(l.chars_lost, 0) AS BIGINT) AS chars_lost, coalesce(l.chars, 0) AS chars,
    sha256(coalesce(l.clean, '')) AS clean_sha256
  FROM docs d JOIN words w USING (r) LEFT JOIN covered c USING (r) LEFT JOIN per_line l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_PERCENT} AS base_failed,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_PERCENT}) AND chars_lost * 100 <= chars * {LOST_PERCENT} AS kept, lines_lost, chars_lost, clean_sha256
FROM counts"""
