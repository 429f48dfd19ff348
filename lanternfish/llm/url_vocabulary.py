"""URL filter: host/path rules first, then a weighted vocabulary.

One Aho-Corasick automaton finds every vocabulary term of a URL in one walk; a
hit counts only where both neighbours are no ASCII letter or digit.  A strict
term weighs as much as the threshold, a soft one less, and each term counts
once, so one strict or several distinct soft terms reject a URL.

Defined results: a null URL, or one without ``://``, has an empty host and path
and its verdict follows the vocabulary (a null one is allowed).  Repeated rows
give repeated rows; columns other than the two named are ignored, so extra
columns cannot clash.  Hosts lower A-Z only; paths keep their case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Rules as (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

# Terms that reject a URL alone, and terms that reject together.
STRICT = ["porn", "porno", "xxx", "adult", "casino", "hentai", "spam", "viagra", "escort", "phishing", "warez"]
SOFT = ["free", "bets", "bet", "win", "sex", "cams", "dating", "poker", "loans", "pills", "torrent", "crack", "jackpot", "nude"]
STRICT_WEIGHT = 2
SOFT_WEIGHT = 1
THRESHOLD = 2

ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
LOWER = {c: c + 32 for c in range(65, 91)}
PARTS = re.compile(r"://([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path by the first ``://``; both empty without one."""
    m = PARTS.search(url) if url else None
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


class RuleBook:
    """Rules by host; the longest rule whose host and path fit wins."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, verdict, at = None, None, 0
        while host:
            suffix = host[at:]
            for start, says in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best is None or len(suffix) + len(start) > len(best)):
                    best, verdict = suffix + start, says
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return best, verdict


class Vocabulary:
    """An Aho-Corasick automaton over weighted terms."""

    def __init__(self, weights: dict[str, int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (term, weight))
        if weights:
            self.automaton.make_automaton()
        self.empty = not weights

    def weigh(self, url: str) -> tuple[int, list[str]]:
        """The summed weight of the distinct terms found, and the terms."""
        if self.empty:
            return 0, []
        low, hits = url.translate(LOWER), {}
        for end, (term, weight) in self.automaton.iter(low):
            start = end - len(term)
            if (start < 0 or low[start] not in ALNUM) and (end + 1 == len(low) or low[end + 1] not in ALNUM):
                hits[term] = weight
        return sum(hits.values()), sorted(hits)


def default_weights() -> dict[str, int]:
    return {**dict.fromkeys(SOFT, SOFT_WEIGHT), **dict.fromkeys(STRICT, STRICT_WEIGHT)}


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=None, weights=None, threshold: int = THRESHOLD) -> DataFrame:
    """One row a page: key, host, path, rule, verdict, weight, terms.

    Only the key and the URL are read; nothing is shuffled.
    """
    rules, weights = RULES if rules is None else rules, default_weights() if weights is None else weights

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, words = RuleBook(rules), Vocabulary(weights)
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                host, path = split_url(x)
                rule, verdict = book.find(host, path)
                weight, terms = words.weigh(x or "")
                rows.append((host, path, rule, verdict or ("block" if weight >= threshold else "allow"), weight, terms))
            host, path, rule, verdict, weight, terms = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(weight, pa.int64()), pa.array(terms, pa.list_(pa.string()))],
                names=[key, "host", "path", "rule", "verdict", "weight", "terms"],
            )

    kind = dict(pages.dtypes)[key]
    return pages.select(key, url).mapInArrow(judged, f"`{key}` {kind}, host string, path string, rule string, verdict string, weight bigint, terms array<string>")


def oracle() -> str:
    """The same rows in SQL (terms joined by commas)."""
    low = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda t: f"regexp_matches(coalesce({low}, ''), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    weights = default_weights()
    weight = " + ".join(f"CASE WHEN {hit(t)} THEN {w} ELSE 0 END" for t, w in weights.items())
    fits = " UNION ALL ".join(
        f"SELECT page_id, '{h}{p}' AS rule, '{v}' AS says FROM parts WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, v in RULES
    )
    return f"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS ({fits}),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM fits GROUP BY page_id),
weighed AS (SELECT page_id, host, path, CAST({weight} AS BIGINT) AS weight FROM parts)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN weight >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, weight
FROM weighed LEFT JOIN best USING (page_id)"""
