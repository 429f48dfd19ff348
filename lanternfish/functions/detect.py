"""Detectors for secrets and personal data, as native column expressions.

The pattern table is data.  Every pattern is ported from Python's dialect to
Java's (``port_regex``), and its matches are extracted with their offsets by
marking them with sentinels and folding over the pieces in between.  A cheap
literal test keeps a pattern's expression from running on texts that cannot match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


@dataclass(frozen=True)
class Pattern:
    category: str
    name: str
    regex: str
    group: int = 0
    needles: tuple[str, ...] = ()
    dotall: bool = False


# Categories, names and regular expressions (Python's dialect);
# needles are literals of which a match holds at least one.
PATTERNS = (
    Pattern("api_key", "openai_key", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{16,}\b", needles=("sk-",)),
    Pattern("api_key", "stripe_live_key", r"\bsk_live_[A-Za-z0-9]{16,}\b", needles=("sk_live_",)),
    Pattern("api_key", "stripe_restricted_key", r"\brk_live_[A-Za-z0-9]{16,}\b", needles=("rk_live_",)),
    Pattern("api_key", "aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", needles=("AKIA", "ASIA")),
    Pattern("api_key", "google_api_key", r"\bAIza[0-9A-Za-z_-]{35}\b", needles=("AIza",)),
    Pattern("api_key", "slack_token", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b", needles=("xox",)),
    Pattern("bearer_token", "bearer_header", r"[Bb]earer\s+([A-Za-z0-9._~+/=-]{16,})", 1, ("earer",)),
    Pattern("bearer_token", "jwt", r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})\b", 1, ("eyJ",)),
    Pattern("github_token", "github_token", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", needles=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Pattern("github_token", "github_fine_grained_pat", r"\bgithub_pat_[A-Za-z0-9_]{22,}\b", needles=("github_pat_",)),
    Pattern("private_key", "pem_private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", needles=("PRIVATE KEY-----",), dotall=True),
    Pattern(
        "env_assignment",
        "env_assignment",
        r"(?m)^\s*(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD|PASSWD|CREDENTIAL)[A-Za-z0-9_]*\s*=\s*\S[^\n]*",
        needles=("KEY", "SECRET", "TOKEN", "PASSWORD", "PASSWD", "CREDENTIAL"),
    ),
    Pattern("pairing_code", "pairing_code", r"(?i)(?:pairing|pair)[ -]?code\s*[:=]?\s*([A-Z0-9]{4}(?:-[A-Z0-9]{4}){1,3})", 1, ()),
    Pattern("email", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", needles=("@",)),
    Pattern("absolute_path", "windows_user_path", r"\b[A-Za-z]:\\Users\\[^\s\"'<>|]+", needles=(":\\Users\\",)),
    Pattern("absolute_path", "posix_home_path", r"(?<![\w/.-])/(?:home|Users)/[^\s\"'<>|]+", needles=("/home/", "/Users/")),
)
SEMANTIC, PROJECT = "sensitive_tool_output", "project_name"
SECRET_CATEGORIES = ("api_key", "bearer_token", "github_token", "private_key", "env_assignment", "pairing_code")
BLOCKING = (*SECRET_CATEGORIES, SEMANTIC)
TAG = "<REDACTED:"

OPEN, CLOSE = "\ue000", "\ue001"  # sentinels of the private use area


def pattern_name(category: str, index: int) -> str:
    """The name of a category's pattern, or ``category[index]`` beyond the table."""
    names = [p.name for p in PATTERNS if p.category == category]
    return names[index] if 0 <= index < len(names) else f"{category}[{index}]"


@lru_cache
def port_regex(regex: str, dotall: bool = False) -> str:
    """A Python pattern for Java: Unicode classes and word boundaries mean the same."""
    word, space = r"\p{L}\p{N}_", r"\s\x1c-\x1f"
    bound = rf"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"
    out, inside, i = [], False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\" and i + 1 < len(regex):
            x = regex[i + 1]
            one = {"w": word, "s": space}.get(x)
            if inside:
                out.append(one or c + x)
            else:
                out.append({"b": bound, "w": f"[{word}]", "s": f"[{space}]", "S": f"[^{space}]", "W": f"[^{word}]"}.get(x, c + x))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(c)
        i += 1
    return "(?Ud)" + ("(?s)" if dotall else "") + "".join(out)


@lru_cache
def python_regex(p: Pattern) -> re.Pattern[str]:
    return re.compile(p.regex, re.DOTALL if p.dotall else 0)


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def spans(text: Column, p: Pattern) -> Column:
    """All matches of one pattern: array of struct(start from 0, line from 1, match)."""
    piece = "struct<start:int,line:int,hit:string>"
    parts = F.split(F.regexp_replace(text, F.lit(port_regex(p.regex, p.dotall)), F.lit(f"{OPEN}$0{CLOSE}")), OPEN)
    state = lambda pos, nl, out: F.struct(pos.cast("int").alias("pos"), nl.cast("int").alias("nl"), out.alias("out"))
    hit = lambda x: F.substring_index(x, CLOSE, 1)
    step = lambda a, x: state(
        a["pos"] + F.length(x) - 1,
        a["nl"] + _newlines(x),
        F.concat(a["out"], F.array(F.struct(a["pos"].alias("start"), (a["nl"] + 1).alias("line"), hit(x).alias("hit")))),
    )
    first = lambda xs: state(F.length(F.get(xs, F.lit(0))), _newlines(F.get(xs, F.lit(0))), F.array().cast(f"array<{piece}>"))
    return let(parts, lambda xs: F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), first(xs), step, lambda a: a["out"]))


def _possible(text: Column, p: Pattern) -> Column:
    if not p.needles:
        return text.rlike("(?i)pair")
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in p.needles])


def each_hit(rows, *keep: str):
    """One row a hit of ``text``: the columns kept and ``h``.

    An outer explode, as for an inner one Spark first filters by the size of the
    array, which means to match every text twice.
    """
    cleaned = rows.select(*keep, clean(F.col("text")).alias("text"))
    return cleaned.select(*keep, F.explode_outer(hits(F.col("text"))).alias("h")).where(F.col("h").isNotNull())


HIT = "array<struct<category:string,pattern:string,idx:int,start:int,line:int,hit:string,value:string,value_start:int>>"


def _as_hit(idx: int, p: Pattern):
    """A lambda that makes a row of HIT of a span of one pattern."""

    def row(x: Column) -> Column:
        value = F.regexp_extract(x["hit"], port_regex(p.regex, p.dotall), p.group) if p.group else x["hit"]
        value_start = x["start"] + F.instr(x["hit"], value) - 1 if p.group else x["start"]
        made = {"category": F.lit(p.category), "pattern": F.lit(p.name), "idx": F.lit(idx), "start": x["start"], "line": x["line"], "hit": x["hit"], "value": value, "value_start": value_start.cast("int")}
        return F.struct(*[c.alias(n) for n, c in made.items()])

    return row


def clean(text: Column) -> Column:
    """Text without the sentinels that mark matches."""
    return F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")


def hits(text: Column, patterns: tuple[Pattern, ...] = PATTERNS) -> Column:
    """All matches of all patterns in a ``clean`` text, in table order and then by offset.

    Matches that hold a redaction tag are left out.  ``value`` is the sensitive
    part: group 1 of patterns that have one, else the whole match.
    """
    found = []
    for idx, p in enumerate(patterns):
        untagged = F.filter(spans(text, p), lambda x: ~F.contains(x["hit"], F.lit(TAG)))
        found.append(F.when(_possible(text, p), F.transform(untagged, _as_hit(idx, p))).otherwise(F.array().cast(HIT)))
    return F.concat(*found)


def fingerprint(value: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a value."""
    return F.substring(F.sha2(value, 256), 1, 16)


def tag(value: Column) -> Column:
    return F.concat(F.lit(TAG), fingerprint(value), F.lit(">"))


def mask(value: Column) -> Column:
    """A lossy preview: the ends of the first line, or stars for a short one."""
    line = F.substring_index(value, "\n", 1)
    n = F.length(line)
    return F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(line, 1, 4), F.lit("..."), F.right(line, F.lit(4))))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of an offset from 0."""
    return _newlines(F.substring(text, F.lit(1), offset)) + 1


def redact(text: Column) -> Column:
    """struct(text, edits): every accepted span replaced by its tag.

    Spans go by (start, longer first); one is accepted if it does not begin
    inside the one before.  Assignments keep their name up to the equals sign.
    """
    edit = "array<struct<category:string,line:int,fingerprint:string>>"
    env = lambda x: x["category"] == "env_assignment"
    start = lambda x: F.when(env(x), x["start"]).otherwise(x["value_start"])
    new = lambda x: F.concat(F.when(env(x), F.concat(F.substring_index(x["hit"], "=", 1), F.lit("="))).otherwise(F.lit("")), tag(x["value"]))
    skip = lambda x: F.when(env(x), F.lit(0)).otherwise(_newlines(F.substring(x["hit"], F.lit(1), x["value_start"] - x["start"])))
    candidate = lambda x: F.struct(
        start(x).alias("start"), (-F.length(x["value"])).alias("longer"), x["idx"].alias("idx"), new(x).alias("new"), x["category"].alias("category"),
        (x["line"] + skip(x)).cast("int").alias("line"), fingerprint(x["value"]).alias("fp"),
    )
    state = lambda at, out, edits: F.struct(at.cast("int").alias("at"), out.alias("out"), edits.alias("edits"))

    def whole(t: Column) -> Column:
        take = lambda a, c: state(
            c["start"] - c["longer"],
            F.concat(a["out"], F.substring(t, a["at"] + 1, c["start"] - a["at"]), c["new"]),
            F.concat(a["edits"], F.array(F.struct(c["category"].alias("category"), c["line"].alias("line"), c["fp"].alias("fingerprint")))),
        )
        done = lambda a: F.struct(F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))).alias("text"), a["edits"].alias("edits"))
        none = state(F.lit(0), F.lit(""), F.array().cast(edit))
        return F.aggregate(F.array_sort(F.transform(let(clean(t), lambda c: hits(c)), candidate)), none, lambda a, c: F.when(c["start"] >= a["at"], take(a, c)).otherwise(a), done)

    return let(text, whole)
