"""Pack token sequences by patterns fitted with non-negative least squares.

1. Texts become token ids.  Where the merges of the tokenizer file are ranked by
   id, as in byte-level BPE, the file's vocabulary is handed to a faster encoder
   that applies the same merges; the tests hold its ids equal to the tokenizer's.
   Other files, and texts with a special token's own string or with more white
   space in a row than that encoder's pattern can take, go to the tokenizer, as
   does any text on which that encoder fails.
   A document longer than the capacity is cut into pieces, the first of which
   may be shorter.
2. The histogram of piece lengths (at most ``capacity`` counts, whatever the
   input) goes to the driver.  Patterns of one to three lengths that fill a
   sequence exactly are enumerated, and the number of times to use each is
   fitted to the histogram by non-negative least squares, rounded, and cut to
   what is there.  The residual lengths are packed best-fit decreasing, by
   groups of equal lengths and gaps rather than piece by piece.
3. The result is a table of slots: (length, first rank, count, first sequence,
   offset).  Pieces are ranked within their length - over hashed shares of it,
   shifted by the counts of the shares before, so one frequent length does not
   meet in one task - and look up their slot.

Defined results: a null text is an empty one; an empty text is the closing id
alone.  A text may be of any length and of one character repeated.  Repeated rows are packed as often as they occur.  Extra columns are
ignored.  An empty table gives no rows.  The tokenizer file must be readable at
the same path on every executor.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

CAPACITY = 2048
CLOSING_ID = 0
SWEEPS = 40
PARTNERS = 6

# Fixed value: how byte-level BPE splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in a row that the faster encoder is not given; its pattern looks ahead behind each run.
LONG_RUN = 20_000
PIECES = "doc bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class IdEncoder:
    """Token ids of whole texts as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.long_run = re.compile(r"\s{%d}" % LONG_RUN)
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        """An encoder with the file's own vocabulary, if its merges are ranked by id."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix"))
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        merged = ["".join(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        if ids != sorted(ids):
            return None
        import tiktoken

        byte, special = _byte_of(), set(self.special)
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.fast is not None and not any(s in text for s in self.special) and not (len(text) >= LONG_RUN and self.long_run.search(text)):
            try:
                return np.array(array("I", self.fast.encode_ordinary(text)), "<u4").tobytes()
            except (KeyboardInterrupt, SystemExit, GeneratorExit):
                raise
            except BaseException:  # noqa: BLE001 - a panic of the encoder is no Exception; the tokenizer has the last word
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a piece: doc, piece, start, length, ids_crc32."""
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(body.as_py() or "") + closing
                view = memoryview(ids)
                rows += [(doc, i, s, n, zlib.crc32(view[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut_points(len(ids) // 4, capacity))]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(made, PIECES)


def patterns(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Patterns of one to three present lengths that fill a sequence exactly.

    For every length: itself, its complement, and triples with each of the most
    frequent partners in a few ranges of the room left.
    """
    capacity = len(histogram) - 1
    found = {(capacity,)} if histogram[capacity] else set()
    present = np.flatnonzero(histogram)
    for a in present[present < capacity]:
        room = capacity - int(a)
        if room >= a and histogram[room]:
            found.add((room, int(a)))
        second = np.arange(1, room)
        worth = np.minimum(histogram[second], histogram[room - second])
        if not len(worth) or not worth.any():
            continue
        for part in np.array_split(np.arange(len(second)), PARTNERS):
            if len(part) and worth[part].any():
                b = int(second[part[np.argmax(worth[part])]])
                found.add(tuple(sorted((int(a), b, room - b), reverse=True)))
    return sorted(found, reverse=True)


def fit(histogram: np.ndarray, choices: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares by coordinate descent: how often to use each pattern."""
    x, left = np.zeros(len(choices)), histogram.astype(float)
    columns = [np.unique(c, return_counts=True) for c in choices]
    norms = [float((n * n).sum()) for _, n in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, n) in enumerate(columns):
            step = max(-x[j], float((left[at] * n).sum()) / norms[j])
            if step:
                x[j] += step
                left[at] -= step * n
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


class Slots:
    """Where the next pieces of each length go."""

    def __init__(self, capacity: int):
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.used = np.zeros(capacity + 1, np.int64)
        self.sequences = 0

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.used[length]), count, sequence, offset))
        self.used[length] += count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count


def plan(histogram: np.ndarray) -> Slots:
    """Slots for all pieces counted in ``histogram`` (by length, up to the capacity)."""
    capacity = len(histogram) - 1
    slots, left = Slots(capacity), histogram.astype(np.int64).copy()
    choices = patterns(left)
    wanted = np.rint(fit(left, choices)).astype(np.int64) if choices else np.zeros(0, np.int64)
    for j in np.argsort(-wanted, kind="stable"):
        lengths, n = np.unique(choices[j], return_counts=True)
        times = int(min(wanted[j], (left[lengths] // n).min()))
        if times > 0:
            first, offset = slots.open(times), 0
            for length in choices[j]:
                slots.put(length, times, first, offset)
                offset += length
            left[lengths] -= times * n
    gaps: dict[int, list[tuple[int, int]]] = {}
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            gap = min((g for g in gaps if g >= length), default=0)
            if gap:
                first, bins = gaps[gap].pop()
                take = min(count, bins)
                if bins > take:
                    gaps[gap].append((first + take, bins - take))
                elif not gaps[gap]:
                    del gaps[gap]
                slots.put(length, take, first, capacity - gap)
                if gap > length:
                    gaps.setdefault(gap - length, []).append((first, take))
                count -= take
            else:
                each = min(capacity // length, count)
                bins = count // each
                first = slots.open(bins)
                for i in range(each):
                    slots.put(length, bins, first, i * length)
                if capacity > each * length:
                    gaps.setdefault(capacity - each * length, []).append((first, bins))
                count -= bins * each
    return slots


def place(cut: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # one row a length at most
        histogram[length] = n
    slots = np.array(sorted(plan(histogram).rows), np.int64).reshape(-1, 5)
    starts = slots[:, 0] << 44 | slots[:, 1]
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut.withColumn("share", F.pmod(F.xxhash64("doc", "piece"), F.lit(shares)))
    counts = rows.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc", "piece", "start", "ids_crc32")) - 1)
    ranked = rows.join(counts, ["length", "share"]).select("doc", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("shift")).cast("bigint").alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            slot = slots[np.searchsorted(starts, length << 44 | rank, "right") - 1]
            columns = [*batch.columns[:5], pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(placed, f"`{key}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset."""
    store.small_batches(documents.sparkSession)
    return place(store.cut(pieces(documents, path, capacity, key, text), "pieces"), capacity, key)
