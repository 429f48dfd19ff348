"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton.  A
text is parsed greedily against each automaton: the longest piece that occurs in
the language's sample is a phrase, and parsing goes on behind it.  The language
that needs the fewest phrases per letter wins; the score is the share of the
runner-up's phrases that the winner saves.

Texts are reduced to lower-case letters with single separators, so symbols and
digits neither help nor hurt.  Whole texts are parsed: they are cut into
stretches of SEGMENT characters that are parsed side by side as lanes of
vectorised automaton steps, which adds at most one phrase a stretch, to every
language alike.

The sample: of the rows that qualify, the SAMPLE_DOCS of each language with the
smallest hash of their id, SAMPLE_CHARS characters of each at most.  It is the
only part that does not cover all rows, and its size does not depend on them.

``reject`` also drops texts in none of the languages: those that need more than
FOREIGN times the phrases per letter that the winner's own documents usually need:
the median over all documents that are labelled with it and judged to be in it, so
that a few very long or repetitive ones do not count for more, and at least USUAL,
as a small table's documents are their own sample and need hardly any.  As a short
text's rate says little, PRIOR letters at the usual rate are added to it.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text if nothing can be learned.  With one learned language its score
is 1.  Ties go to the language that sorts first.  A null id counts as learnable.
Repeated rows give repeated rows.  Extra columns are ignored by ``identify`` and
kept by ``reject``.  ``reject`` drops ``und`` documents; a language that no
document is both labelled with and judged to be in has no usual rate and keeps its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, texthash

SAMPLE_DOCS = 48
SAMPLE_CHARS = 800
ALPHABET = 96
SHARED = 16
SEGMENT = 256
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
FOREIGN = 2.2
PRIOR = 16
USUAL = 0.125


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point its lower-case letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()[0])
    return out


def normalise(text: str) -> str:
    """Lower-case letters, one separator for each run of anything else, none in front."""
    marked = "".join(x.lower()[0] if x.isalpha() else " " for x in text)
    return " ".join(marked.split()) + (" " if marked.strip() and marked[-1] == " " else "")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton of ``codes``; 0 is the start."""
    out: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(out)
        out.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in out[p]:
            out[p][c] = new
            p = link[p]
        if p >= 0:
            q = out[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(out)
                out.append(dict(out[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and out[p].get(c) == q:
                    out[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return out


class Model:
    """The automata of all languages as one table of transitions.

    State 0 is the failure state, state 1 a dead end behind a letter that the
    language's sample lacks (a phrase of its own); codes: 0 separator, then the most frequent
    letters, then SHARED codes among which all other letters are hashed.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        texts = [normalise(t) for _, t in samples]
        common = [c for c, _ in Counter("".join(texts).replace(" ", "")).most_common(ALPHABET)]
        code = np.zeros(0x110000, np.uint8)
        low = letters()
        spread = (len(common) + 1 + low % SHARED).astype(np.uint8)
        code[low > 0] = spread[low > 0]
        of_letter = {c: i + 1 for i, c in enumerate(common)}
        place = np.zeros(0x110000, np.uint8)
        for c, i in of_letter.items():
            place[ord(c)] = i
        known = place[low] > 0
        code[known] = place[low[known]]
        self.code, self.width = code, len(common) + 1 + SHARED
        parts, roots, size = [np.zeros((2, self.width), np.int32)], [], 2
        for t in texts:  # one automaton at a time, as dictionaries take more room than the table
            machine = suffix_automaton(code[np.frombuffer(t.encode("utf-32-le"), np.uint32)].tolist() if t else [])
            part = np.zeros((len(machine), self.width), np.int32)
            for i, row in enumerate(machine):
                for c, to in row.items():
                    part[i, c] = size + to
            parts.append(part)
            roots.append(size)
            size += len(machine)
        self.roots, self.table = np.array(roots, np.int32), np.concatenate(parts)
        self.table *= self.width  # states are row offsets into the flat table
        self.flat = self.table.ravel()

    def phrases(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) for each language, and letters and separators of each text."""
        n = len(offsets) - 1
        points = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.zeros(len(body) + 1, np.int64)
        np.cumsum((body & 0xC0) != 0x80, out=at[1:])
        at = at[offsets]
        c = self.code[points]
        keep = np.ones(len(c), bool)
        if len(c):
            keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
            heads = at[:-1][at[:-1] < len(c)]
            keep[heads] = c[heads] > 0
        total = np.zeros(len(c) + 1, np.int64)
        np.cumsum(keep, out=total[1:])
        c, at = c[keep], total[at]
        size = np.diff(at)
        counts = np.zeros((n, len(self.langs)), np.int64)
        lanes = -(-size // SEGMENT)
        doc = np.repeat(np.arange(n), lanes)
        if not len(doc) or not self.langs:
            return counts, size
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = at[:-1][doc] + nth * SEGMENT
        length = np.minimum(SEGMENT, at[1:][doc] - start)
        by_length = np.argsort(-length, kind="stable")
        doc, start, length = doc[by_length], start[by_length], length[by_length]
        open_until = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), "right")
        first = self.flat.reshape(-1, self.width)[self.roots]  # where each letter leads from the start
        for k in range(len(self.langs)):
            fresh = np.where(first[k] > 0, first[k], np.int32(self.width))
            state = np.full(len(doc), self.roots[k] * self.width, np.int32)
            ended = np.where(first[k][c[start]] > 0, 1, 0).astype(np.int32)  # the last phrase, unless the first letter counts twice
            for step in range(int(length[0])):
                m = open_until[step]
                now = c[start[:m] + step]
                to = self.flat[state[:m] + now]
                lost = to == 0
                ended[:m] += lost
                np.copyto(to, fresh[now], where=lost)
                state[:m] = to
            counts[:, k] = np.bincount(doc, ended, n)
        return counts, size


@lru_cache(maxsize=1)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


def judge(samples: tuple[tuple[str, str], ...], column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, the winner's phrases, and letters of every text."""
    model = _model(samples)
    body, off = texthash.utf8(column)
    langs, scores, fewest, sizes = [], [], [np.zeros(0)], [np.zeros(0, np.int64)]
    for a, b in texthash.slices(off, SLICE_BYTES):
        counts, size = model.phrases(body[off[a] : off[b]], off[a : b + 1] - off[a])
        sizes.append(size)
        if not model.langs:
            langs += [UNKNOWN] * (b - a)
            scores.append(np.zeros(b - a))
            fewest.append(np.zeros(b - a))
            continue
        best = counts.argmin(axis=1)
        least = counts[np.arange(b - a), best].astype(float)
        second = np.partition(counts, 1, axis=1)[:, 1].astype(float) if counts.shape[1] > 1 else np.full(b - a, np.inf)
        some = size > 0
        score = np.where(some, np.where(np.isinf(second), 1.0, (second - least) / np.maximum(second, 1)), 0.0)
        langs += [model.langs[i] if s else UNKNOWN for i, s in zip(best.tolist(), some.tolist(), strict=True)]
        scores.append(np.clip(score, 0.0, 1.0))
        fewest.append(least)
    return langs, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(fewest), np.concatenate(sizes)


def learn(documents: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """The bounded sample: (language, text) pairs.

    Rows are first chosen by their ids alone; only the chosen ones' texts are read.
    """
    order = [F.xxhash64(F.col(key)), F.col(key)]
    top = Window.partitionBy("lang").orderBy(*order)
    store.small_batches(documents.sparkSession)
    rows = documents.where(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = rows.select(F.col(key), F.col(lang).alias("lang")).withColumn("n", F.row_number().over(top)).where(F.col("n") <= SAMPLE_DOCS)
    chosen = ids.select(F.col(key).alias("chosen"), F.col("lang").alias("chosen_lang")).distinct()
    texts = rows.select(F.col(key), F.col(lang).alias("lang"), F.substring(F.col(text), 1, SAMPLE_CHARS).alias("text"))
    texts = texts.join(F.broadcast(chosen), F.col(key).eqNullSafe(F.col("chosen")) & (F.col("lang") == F.col("chosen_lang")), "left_semi")
    texts = texts.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "text"))).where(F.col("n") <= SAMPLE_DOCS)
    joined = texts.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return tuple(sorted((r["lang"], r["text"]) for r in joined.collect()))


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4


def identify(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row a document: id, held_out, lang_pred, score; held-out rows are not learned from."""
    held_out = F.coalesce(remainder(F.col(key)) == 2, F.lit(False))
    samples = learn(documents, ~held_out, key, text, lang)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, *_ = judge(samples, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[key, "held_out", "lang_pred", "score"])
        texthash.give_back()

    rows = documents.select(F.col(key), held_out.alias("held_out"), F.col(text))
    return rows.mapInArrow(predicted, f"`{key}` {dict(documents.dtypes)[key]}, held_out boolean, lang_pred string, score double")


def reject(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in a learned language: not ``und``, and not foreign to the one that wins."""
    samples = learn(documents, F.lit(True), key, text, lang)
    p, at = store.free_prefix(documents), documents.columns.index(text)
    added = [f"{p}won", f"{p}phrases", f"{p}letters"]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, fewest, sizes = judge(samples, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(fewest, pa.float64()), pa.array(sizes, pa.int64())], names=[*batch.schema.names, *added])
        texthash.give_back()

    schema = T.StructType([*documents.schema.fields, *[T.StructField(c, t) for c, t in zip(added, (T.StringType(), T.DoubleType(), T.LongType()), strict=True)]])
    rows = store.cut(documents.mapInArrow(parsed, schema), "parsed")
    won, phrases, size = (F.col(c) for c in added)
    # A row a learned language.
    usual = rows.where(F.col(lang) == won).groupBy(won.alias(f"{p}of")).agg(F.greatest(F.percentile_approx(phrases / size, 0.5), F.lit(USUAL)).alias(f"{p}usual"))
    met = rows.where(won != UNKNOWN).join(F.broadcast(usual), won == F.col(f"{p}of"), "left")
    mean = F.col(f"{p}usual")
    native = (phrases + PRIOR * mean) / (size + PRIOR) <= FOREIGN * mean
    return met.where(F.coalesce(native, F.lit(True))).select(*documents.columns)
