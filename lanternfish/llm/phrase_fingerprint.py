"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases into phrases of phrases, and so on.
On each level equal neighbours are first merged into runs.  Deterministic coin
tossing then labels every symbol by the lowest bit in which its name differs from
its left neighbour's, and that bit; a few tosses bring any names down to a
handful of labels that still differ between neighbours.  Local maxima of the
labels, and minima far from them, start phrases.  All of that looks at a few
neighbours only, so equal substrings are cut alike wherever they lie, but for a
few phrases at their ends.  A phrase's name is a hash of its symbols' names.

The fingerprint is a one-permutation minhash of the set of phrase names on level
LEVEL (phrases of about 15 characters): BINS bins, two hex digits each, ``--``
where no phrase falls.  Likeness estimates the Jaccard similarity of two sets.

Documents are paired with the next one in descending order of id by one range
shuffle of the texts; what meets at the borders of the ranges is two rows each,
which are paired in a small second step.

Defined results: a null text is an empty one; an empty text has no phrases, is
like another empty one and unlike anything else.  Rows of equal ids go by their
text; null ids come last.  A single document is its own next one.  Repeated rows
give repeated rows.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .texthash import mix

LEVEL = 3
BINS = 128
TOSSES = 3
SLICE_CHARS = 1 << 20
U = np.uint64
K1, K2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
DIGITS = np.array([f"{i:02x}" for i in range(256)] + ["--"], "S2")
EMPTY = 256
BIN_BITS = BINS.bit_length() - 1


def toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of at most 8 bits from labels that differ between neighbours."""
    d = np.empty_like(labels)
    d[1:] = labels[1:] ^ labels[:-1]
    d[first] = 1
    one = labels.dtype.type(1)
    place = np.bitwise_count((d & (~d + one)) - one)
    return (place << np.uint8(1)) | ((labels >> place.astype(labels.dtype)) & one).astype(np.uint8)


def parse(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of each sequence, and their offsets."""
    n = len(names)
    if not n:
        return names, at
    firsts = at[:-1][np.diff(at) > 0]
    new = np.ones(n, bool)
    new[1:] = names[1:] != names[:-1]
    new[firsts] = True
    runs = np.flatnonzero(new)
    length = np.diff(np.append(runs, n))
    y = names[runs]
    many = length > 1
    y[many] = mix(y[many] * K1 + length[many].astype(np.uint64))
    at = np.searchsorted(runs, at)
    firsts = at[:-1][np.diff(at) > 0]
    lasts = at[1:][np.diff(at) > 0] - 1
    labels = toss(y, firsts)
    for _ in range(TOSSES):
        labels = toss(labels, firsts)
    m = len(y)
    over_left, over_right = np.ones(m, bool), np.ones(m, bool)
    over_left[1:] = labels[1:] > labels[:-1]
    over_right[:-1] = labels[:-1] > labels[1:]
    over_left[firsts], over_right[lasts] = True, True
    top = over_left & over_right
    low = ~over_left & ~over_right
    low[1:] &= ~top[:-1]
    low[:-1] &= ~top[1:]
    start = top | low
    start[firsts] = True
    p = np.flatnonzero(start)
    size = np.diff(np.append(p, m))
    within = np.arange(m) - np.repeat(p, size)
    terms = mix(y ^ ((within + 1).astype(np.uint64) * K2))
    return mix(np.add.reduceat(terms, p) + size.astype(np.uint64) * K1), np.searchsorted(p, at)


def phrases(texts: list[str], level: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of all texts on a level, and the offsets of each text's."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    names = mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + U(1))
    for _ in range(level):
        names, at = parse(names, at)
    return names, at


def sketch(texts: list[str], level: int = LEVEL) -> np.ndarray:
    """A row of BINS codes (0-255, or EMPTY) for every text."""
    np.seterr(over="ignore")
    out = np.full((len(texts), BINS), EMPTY, np.int16)
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (last == first or chars + len(texts[last]) <= SLICE_CHARS):
            chars += len(texts[last])
            last += 1
        names, at = phrases(texts[first:last], level)
        h = mix(names ^ K2)
        least = np.full((last - first) * BINS, np.iinfo(np.uint64).max, np.uint64)
        place = np.repeat(np.arange(last - first), np.diff(at)) * BINS + (h >> U(64 - BIN_BITS)).astype(np.int64)
        np.minimum.at(least, place, h & U((1 << (64 - BIN_BITS)) - 1))
        full = least != np.iinfo(np.uint64).max
        codes = np.full(len(least), EMPTY, np.int16)
        codes[full] = (mix(least[full]) & U(255)).astype(np.int16)
        out[first:last] = codes.reshape(-1, BINS)
        first = last
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity, 0 to 1, of rows of codes; agreement by chance is taken off."""
    used = (a != EMPTY) | (b != EMPTY)
    n = used.sum(axis=1)
    share = ((a == b) & used).sum(axis=1) / np.maximum(n, 1)
    return np.where(n == 0, 1.0, np.clip((share - 1 / 256) / (1 - 1 / 256), 0.0, 1.0))


def write_out(codes: np.ndarray) -> list[str]:
    return [x.decode() for x in np.ascontiguousarray(DIGITS[codes]).view(f"S{2 * BINS}").ravel().tolist()]


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


OUT = "kind int, part int, doc {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _rows(schema: pa.Schema, kind: int, part: int, docs: list, texts: list[str], following: list[str] | None, codes: np.ndarray, next_codes: np.ndarray | None) -> pa.RecordBatch:
    n = len(docs)
    none = [None] * n
    columns = [[kind] * n, [part] * n, docs, [len(t) for t in texts], none, write_out(codes), none, none, none, texts if kind else none]
    if following is not None:
        edited = [edit(t, f) for t, f in zip(texts, following, strict=True)]
        theirs = sketch(edited)
        columns[4] = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
        columns[6:9] = write_out(theirs), likeness(codes, theirs), likeness(codes, next_codes)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(doc: pa.DataType) -> pa.Schema:
    s, d, i = pa.string(), pa.float64(), pa.int32()
    return pa.schema([("kind", i), ("part", i), ("doc", doc), ("n_chars", pa.int64()), ("edited_sha256", s), ("fingerprint", s), ("edited_fingerprint", s), ("near_edited", d), ("near_next", d), ("text", s)])


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a bounded number of rows, so few texts are decoded at once."""
    for i in range(0, batch.num_rows, 512):
        yield batch.slice(i, 512)


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: id, n_chars, edited_sha256, both fingerprints and both likenesses."""
    spark = documents.sparkSession
    store.small_batches(spark)
    kind = dict(documents.dtypes)[key]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Rows of one id, or without one, follow each other by a hash, so ranges can cut through them.
    order = [F.desc_nulls_last("doc"), F.xxhash64("text"), F.col("text")]
    rows = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).select("doc", "text", F.spark_partition_id().alias("part"))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema, part = None, None, 0
        for batch in batches:
            for chunk in _chunks(batch):
                schema = schema or _schema(chunk.column(0).type)
                docs, texts = chunk.column(0).to_pylist(), chunk.column(1).to_pylist()
                if not docs:
                    continue
                codes = sketch(texts)
                if held is None:
                    part = chunk.column(2)[0].as_py()
                    yield _rows(schema, 2, part, docs[:1], texts[:1], None, codes[:1], None)
                else:
                    docs, texts, codes = [held[0], *docs], [held[1], *texts], np.concatenate([held[2], codes])
                if len(docs) > 1:
                    yield _rows(schema, 0, part, docs[:-1], texts[:-1], texts[1:], codes[:-1], codes[1:])
                held = docs[-1], texts[-1], codes[-1:]
        if held is not None:
            yield _rows(schema, 1, part, [held[0]], [held[1]], None, held[2], None)

    done = store.cut(rows.mapInArrow(paired, OUT.format(kind=kind)), "paired")

    # The last row of each range and the first of the next range that has any.
    heads = done.where("kind = 2").select(F.col("part").alias("head_part"), F.col("text").alias("following"))
    ranges = done.where("kind = 2").select("part", F.lead("part").over(Window.orderBy("part")).alias("then"), F.min("part").over(Window.partitionBy(F.lit(1))).alias("top"))
    ranges = ranges.select("part", F.coalesce("then", "top").alias("head_part"))
    borders = done.where("kind = 1").select("part", "doc", "text").join(ranges, "part").join(heads, "head_part").select("doc", "text", "following")

    def bordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch):
                texts, following = chunk.column(1).to_pylist(), chunk.column(2).to_pylist()
                if texts:
                    yield _rows(_schema(chunk.column(0).type), 0, 0, chunk.column(0).to_pylist(), texts, following, sketch(texts), sketch(following))

    whole = done.where("kind = 0").unionByName(borders.mapInArrow(bordered, OUT.format(kind=kind)))
    return whole.select(F.col("doc").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
