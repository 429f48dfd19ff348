"""What needs a JSON parser that keeps key order and duplicates: leaves and rewriting.

These run as Arrow UDFs on cells that look like JSON; all other cells stay native.
Lone surrogates become U+FFFD, as a column cannot hold them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .detect import PATTERNS, SEMANTIC, TAG, python_regex

# Keys of a content subtree that carry structure, not payload.
STRUCTURAL = frozenset({"type", "mimeType", "toolCallId", "status", "kind"})


def looks_json(value: Column) -> Column:
    return value.rlike(r"(?Ud)^[\s\x1c-\x1f]*[{\[]")


def _clean(x: str) -> str:
    return x.encode("utf-8", "replace").decode() if not x.isascii() and any("\ud800" <= c <= "\udfff" for c in x) else x


def _load(raw: str):
    try:
        return json.loads(raw)
    except (ValueError, RecursionError):
        return None


def leaves_of(node) -> list[str]:
    """String values of a JSON document in document order; keys are not leaves."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(_clean(x))
        elif isinstance(x, dict):
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _json_leaves(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: None if r is None else ([r] if (node := _load(r)) is None else leaves_of(node)))


def cell_texts(value: Column) -> Column:
    """The texts of a cell: the leaves of JSON, else the cell itself."""
    return F.coalesce(_json_leaves(F.when(looks_json(value), value)), F.array(value))


# Keys under which a value is taken for a path, and what a path looks like.
PATH_KEY = re.compile(r"path|file", re.IGNORECASE)
PATH_VALUE = re.compile(r"[/\\][^/\\\s]+|^[A-Za-z]:[/\\]")


def paths_under(node, inside: bool = False) -> list[str]:
    """String values that look like paths, under path-like keys at any depth."""
    if isinstance(node, dict):
        return [x for k, v in node.items() for x in paths_under(v, inside or bool(PATH_KEY.search(str(k))))]
    if isinstance(node, list):
        return [x for v in node for x in paths_under(v, inside)]
    return [_clean(node)] if inside and isinstance(node, str) and PATH_VALUE.search(node) else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def path_leaves(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: paths_under(_load(r)) if r else [])


def fp(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def redact_plain(text: str) -> tuple[str, list[tuple[str, int, str]]]:
    """``detect.redact`` for one string, for leaves inside JSON."""
    spans = []
    for p in PATTERNS:
        for m in python_regex(p).finditer(text):
            if TAG in m[0]:
                continue
            value = m[p.group]
            name = m[0][: m[0].index("=") + 1] if p.category == "env_assignment" else ""
            spans.append((m.start(p.group), -len(value), f"{name}{TAG}{fp(value)}>", p.category, fp(value)))
    out, edits, at = [], [], 0
    for start, longer, new, category, f in sorted(spans, key=lambda s: s[:2]):
        if start >= at:
            out += [text[at:start], new]
            edits.append((category, text.count("\n", 0, start) + 1, f))
            at = start - longer
    return "".join([*out, text[at:]]), edits


def rewrite(node, leaf: Callable[[str], str], inside: Callable[[str], Callable[[str], str] | None] | None = None, keep: frozenset[str] = frozenset()):
    """A copy of a JSON document with its string leaves changed by ``leaf``."""
    if isinstance(node, str):
        return leaf(node)
    if isinstance(node, dict):
        return {k: v if k in keep and isinstance(v, str) else rewrite(v, leaf, inside, keep) for k, v in node.items()}
    return [rewrite(v, leaf, inside, keep) for v in node] if isinstance(node, list) else node


def redact_json(raw: str, semantic: bool) -> tuple[str | None, list[tuple[str, int | None, str]]]:
    """A cell's new text (null if unchanged) and edits.

    Semantic cells have every payload leaf below a ``content`` key tagged whole;
    others have the patterns applied leaf by leaf.
    """
    node, edits = _load(raw), []

    def by_pattern(text: str) -> str:
        new, found = redact_plain(text)
        edits.extend(found)
        return new

    def whole(text: str) -> str:
        if TAG in text:
            return text
        edits.append((SEMANTIC, None, fp(text)))
        return f"{TAG}{fp(text)}>"

    def content_only(x):
        if isinstance(x, dict):
            return {k: rewrite(v, whole, keep=STRUCTURAL) if k == "content" else content_only(v) for k, v in x.items()}
        return [content_only(v) for v in x] if isinstance(x, list) else x

    if node is None or isinstance(node, (int, float, bool)):
        new = by_pattern(raw)
        return (new if edits else None), edits
    new = content_only(node) if semantic else rewrite(node, by_pattern)
    return (_clean(json.dumps(new, ensure_ascii=False)) if edits else None), edits


def redact_cell(value: Column, semantic: Column) -> Column:
    """struct(text, edits) of a JSON cell; text is null where nothing changes."""

    @F.pandas_udf("text string, edits array<struct<category:string,line:int,fingerprint:string>>")
    def run(raw: pd.Series, sem: pd.Series) -> pd.DataFrame:
        rows = [(None, []) if r is None else redact_json(r, bool(s)) for r, s in zip(raw, sem, strict=True)]
        return pd.DataFrame({"text": [t for t, _ in rows], "edits": [[{"category": c, "line": n, "fingerprint": f} for c, n, f in e] for _, e in rows]})

    return run(value, semantic)
