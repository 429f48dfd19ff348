"""Ended sessions as a stream: scan each, write a verdict, carry split values over.

``scan_ended`` runs the batch operators on every micro-batch; ``split_over``
keeps, for each session, its last payload and whatever before it is not finished,
so a value cut between payloads is found whole even if they arrive in different
batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.detect import PATTERNS, TAG, python_regex
from ..functions.jsontext import fp
from ..operators import scan

#: Characters in front of a word that may belong to it, as a header's name does.
CONTEXT = 400
BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY-----")
ASSIGNMENT = next(python_regex(p) for p in PATTERNS if p.name == "env_assignment")


def unfinished(joined: str, border: int) -> int:
    """Where the part of ``joined`` starts that the next payload may go on with.

    At most ``border``, where its last payload starts; before that, an open private
    key, an assignment on the last line, and the last word with CONTEXT in front.
    """
    starts = [border, max(0, len(joined) - CONTEXT)]
    closed = max((m.end() for m in END.finditer(joined)), default=0)
    opened = BEGIN.search(joined, closed)
    if opened:
        starts.append(opened.start())
    starts += [m.start() for m in ASSIGNMENT.finditer(joined) if m.end() == len(joined)]
    gap = next((i for i in range(len(joined) - 1, -1, -1) if joined[i].isspace()), -1)
    starts.append(max(0, gap + 1 - CONTEXT))
    return min(starts)


def session_verdicts(payloads: DataFrame) -> DataFrame:
    """session_id, findings, secrets, status of payload rows (session_id, text)."""
    files = payloads.groupBy(F.col("session_id").alias("file")).agg(F.count(F.lit(1)).alias("payloads"))
    found = scan.text_findings(payloads.select(F.col("session_id").alias("file"), "text"))
    return scan.file_verdicts(files, found).select(F.col("file").alias("session_id"), "findings", "secrets", "status")


def scan_ended(ended: DataFrame, payloads: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """For every batch of ended session ids, scan their payloads and append verdicts as JSON."""

    def run(batch: DataFrame, number: int) -> None:
        ids = batch.select("session_id").distinct()
        verdicts = session_verdicts(payloads.join(ids, "session_id", "left_semi"))
        known = ids.join(verdicts, "session_id", "left")
        # A session without any readable payload is skipped, never clean.
        known = known.withColumn("status", F.coalesce("status", F.lit("SKIPPED"))).withColumn("batch", F.lit(number))
        known.write.mode("append").json(out)

    return ended.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_over(payloads: DataFrame) -> DataFrame:
    """session_id, category, fingerprint of values that lie across two payloads in a row.

    ``payloads`` is a stream of (session_id, seq, text), in order within a session.
    """

    def carry(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(chunks).sort_values("seq")
        before = state.get[0] if state.exists else ""
        found = []
        for text in rows["text"].fillna(""):
            border, joined = len(before), before + text
            for p in PATTERNS:
                for m in python_regex(p).finditer(joined):
                    if m.start() < border < m.end() and TAG not in m[0]:
                        found.append((key[0], p.category, fp(m[p.group])))
            before = joined[unfinished(joined, border) :]
        state.update((before,))
        yield pd.DataFrame(found, columns=["session_id", "category", "fingerprint"])

    keyed = payloads.groupBy("session_id")
    return keyed.applyInPandasWithState(carry, "session_id string, category string, fingerprint string", "tail string", "append", GroupStateTimeout.NoTimeout)


def activity_windows(events: DataFrame, lateness: str = "48 hours", width: str = "1 hour") -> DataFrame:
    """Events by user and hour; what is later than the grace window is dropped by the watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "user_id").agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), "user_id", "events")
