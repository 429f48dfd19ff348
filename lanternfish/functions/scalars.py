"""Small scalar functions of the session domain, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import port_regex

SIDECARS = ["-wal", "-shm", "-journal"]


def norm_title(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""), 1, 60)


def any_pattern(text: Column, patterns: list[str]) -> Column:
    """Case-insensitive search for any of the patterns; no pattern matches nothing."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(text.rlike("(?i)" + port_regex("|".join(patterns))), F.lit(False))


def json_string(raw: Column, key: str) -> Column:
    """A string member of a JSON object; null for members of any other type."""
    v = F.try_parse_json(raw)
    return F.try_variant_get(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", v), f"$.{key}", "string")


def role_of(raw: Column) -> Column:
    """``user``, ``assistant`` or null, from the first telling one of four keys."""
    told = []
    for key in ("role", "type", "kind", "author"):
        v = F.lower(json_string(raw, key))
        has = lambda *xs, v=v: reduce(lambda a, b: a | b, [F.contains(v, F.lit(x)) for x in xs])
        told.append(F.when(has("user", "human"), "user").when(has("assistant", "agent", "model", "ai"), "assistant"))
    return F.coalesce(*told)


def text_of(raw: Column) -> Column:
    """The first string among four keys that is not blank, else an empty one."""
    found = [F.when(F.trim(json_string(raw, k)) != "", json_string(raw, k)) for k in ("text", "content", "prompt", "message")]
    return F.coalesce(*found, F.lit(""))


def score(user_msgs: Column, tool_calls: Column) -> Column:
    return user_msgs * 3 + tool_calls


def session_summary(title: Column, prompt: Column) -> Column:
    """What a judge reads: the title and, below an empty line, the first prompt if there is one, bounded."""
    return F.substring(F.concat_ws("\n\n", F.coalesce(title, F.lit("")), F.nullif(F.substring(prompt, 1, 1500), F.lit(""))), 1, 4000)


# Words that decide a verdict.
TRUE_TOKENS = ["keep", "true", "yes", "durable", "preserve"]
FALSE_TOKENS = ["delete", "false", "no", "noise", "ephemeral"]


def _verdict_words(t: Column) -> Column:
    token = F.substring(F.regexp_replace(t, "[^a-z]", ""), 1, 16)
    words = F.split(t, r"\s+")
    some = lambda xs: F.arrays_overlap(words, F.array(*[F.lit(x) for x in xs]))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False).when(some(FALSE_TOKENS), False).when(some(TRUE_TOKENS), True)


def parse_verdict(text: Column) -> Column:
    """True to keep, false to delete, null if unclear: a JSON answer or free text."""
    t = F.lower(F.trim(text))
    answer = F.coalesce(*[F.get_json_object(t, f"$.{k}") for k in ("keep", "value", "verdict")])
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False))
    abstained = F.coalesce(F.get_json_object(t, "$.abstained").isin("true", "1"), F.lit(False))
    return F.when(is_object & answer.isNotNull(), _verdict_words(F.lower(F.trim(answer)))).when(is_object & abstained, F.lit(None).cast("boolean")).otherwise(_verdict_words(t))


UNITS = ["KB", "MB", "GB", "TB"]


def fmt_bytes(n: Column, largest: str = "TB") -> Column:
    """A byte count with a unit up to ``largest``: whole bytes, else one decimal of the exact value, ties to even; a negative one is none."""
    n = F.greatest(n, F.lit(0))
    x, shown = n.cast("double"), F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS[: UNITS.index(largest) + 1], 1):
        size = x / 1024.0**i
        whole = F.floor(size)
        tenths = F.rint((size - whole) * 10)  # exact below rint; bround and %.1f round the shortest decimals instead
        shown = F.when(x >= 1024.0**i, F.format_string(f"%d.%d {unit}", whole + F.floor(tenths / 10), (tenths % 10).cast("int"))).otherwise(shown)
    return shown


def snapshot_name(ts: Column, clash: Column | None = None) -> Column:
    """``yyyymmddThhmmssZ``, with ``-N`` where names clash."""
    name = F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
    return name if clash is None else F.when(clash > 0, F.concat(name, F.lit("-"), clash.cast("string"))).otherwise(name)


def created_at(value: Column) -> Column:
    """Epoch seconds of an ISO time (UTC where it names no zone) or of a number."""
    iso = F.try_to_timestamp(F.replace(value, F.lit("Z"), F.lit("+00:00")))
    return F.coalesce(value.try_cast("double"), F.unix_micros(iso) / 1e6)


def leftover_sid(name: Column) -> Column:
    """The session id of a sidecar or lock file's name, else null."""
    return F.nullif(F.regexp_extract(name, r"^(.*)(?:\.db(?:-wal|-shm|-journal)|\.lock)$", 1), F.lit(""))


def gui_key(key: Column, prefix: str) -> tuple[Column, Column]:
    """Backend and slug of a state key; both empty without a separator."""
    rest = F.substr(key, F.lit(len(prefix) + 1))
    return F.regexp_extract(rest, "(?s)^(.*)/([^/]*)$", 1), F.regexp_extract(rest, "(?s)^(.*)/([^/]*)$", 2)


def display_path(path: Column, root: Column) -> Column:
    return F.when(F.coalesce(root, F.lit("data")) == "config", F.concat(F.lit("config/"), path)).otherwise(path)


def export_session_id(name: Column, text: Column) -> Column:
    """The session id of an exported file: its JSON field, its frontmatter, else its dated name."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    field = F.nullif(json_string(text, "session_id"), F.lit(""))
    front = F.nullif(F.regexp_extract(F.left(text, F.lit(4096)), r"(?m)^session_id:\s*(\S+)\s*$", 1), F.lit(""))
    dated = F.nullif(F.regexp_extract(F.regexp_replace(name, r"\.[^./]+$", ""), r"^\d{4}-\d{2}-\d{2}_(.+)$", 1), F.lit(""))
    return F.coalesce(F.when(suffix == ".json", field).when(suffix == ".md", front), dated)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; ``*`` crosses slashes, ``[...]`` is a class, ``[!...]`` its opposite."""
    out, at = "", 0
    plain = lambda c: "\\" + c if c in r".^$+{}()|\[]*?-&~" else c
    while at < len(pattern):
        c, at = pattern[at], at + 1
        end = pattern.find("]", at + (2 if pattern[at : at + 1] == "!" else 1)) if c == "[" else -1
        if end > 0:
            inside, negated = pattern[at:end], pattern[at] == "!"
            inside = inside[1:] if negated else inside
            out += "[" + "^" * negated + "".join("\\" + x if x in r"\[]^&~" else x for x in inside) + "]"
            at = end + 1
        else:
            out += ".*" if c == "*" else "." if c == "?" else plain(c)
    return rf"(?s)^{out}\z"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches a shell pattern or holds it as a case-insensitive part."""
    flat, hit = F.replace(path, F.lit("\\"), F.lit("/")), F.lit(False)
    for p in patterns:
        hit = hit | flat.rlike(glob_regex(p)) | F.contains(F.lower(flat), F.lit(p.lower()))
    return hit


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and ``..``; null if it climbs out."""
    step = lambda a, x: (
        F.when(a.isNull() | x.isin("", "."), a).when(x == "..", F.when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1))).otherwise(F.concat(a, F.array(x)))
    )
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.startswith("/"), None).otherwise(F.array_join(walked, "/"))


def parse_tiers(spec: str | None) -> set[int]:
    """``"1,2"``, ``"tier3"`` or ``"all"`` as a set of tiers; 1 and 2 by default."""
    if not spec or not spec.strip():
        return {1, 2}
    found: set[int] = set()
    for word in spec.lower().replace(",", " ").split():
        if word == "all":
            return {1, 2, 3}
        number = word.removeprefix("tier")
        if number not in ("1", "2", "3"):
            raise ValueError(f"unknown tier {word!r}")
        found.add(int(number))
    return found or {1, 2}
