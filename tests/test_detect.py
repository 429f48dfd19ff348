import random

import pytest
from pyspark.sql import functions as F

from lanternfish.functions import detect
from lanternfish.functions.jsontext import redact_plain

FAKE = ["sk-" + "a1" * 12, "sk_" + "live_" + "b2" * 10, "AK" + "IA" + "A1B2" * 4, "xo" + "xb-" + "1a" * 8, "Bearer " + "t" * 20, "ey" + "J" + "a" * 9 + ".bbbbbbbbb.ccccccccc", "gh" + "p_" + "c3" * 12,
        "\nAPI_" + "KEY = v\nx", "pairing code: AB12-CD34", "me@example.org", "C:" + "\\Users\\me\\f", " /home/me/x", "-----BEGIN X PRIVATE " + "KEY-----\nz\n-----END X PRIVATE " + "KEY-----"]
FILL = [list("abc XYZ.,-_/\n\t"), list("éüñß½ \u00a0\u2028\x1c\r\x85ſK日"), list("019@<>'\"|")]


def texts(n: int) -> list[str]:
    r = random.Random(5)
    return ["".join(x for _ in range(r.randint(0, 6)) for x in (r.choice(FAKE) if r.random() < 0.5 else "", "".join(r.choices(r.choice(FILL), k=r.randint(0, 8))))) for _ in range(n)]


def reference(text):
    return sorted((p.category, p.name, m.start(), text.count("\n", 0, m.start()) + 1, m[p.group]) for p in detect.PATTERNS for m in detect.python_regex(p).finditer(text) if detect.TAG not in m[0])


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(texts(600))), "id int, text string").cache()


def test_hits_equal_python(frame):
    for r in frame.select("text", detect.hits(detect.clean(F.col("text"))).alias("h")).collect():
        assert sorted((h.category, h.pattern, h.start, h.line, h.value) for h in r.h) == reference(r.text), repr(r.text)


def test_redaction_equals_python(frame):
    once = frame.select("text", detect.redact(F.col("text")).alias("r")).cache()
    for r in once.collect():
        new, edits = redact_plain(r.text)
        assert r.r.text == new
        assert [(e.category, e.line, e.fingerprint) for e in r.r.edits] == edits


def test_redaction_is_idempotent(spark):
    df = spark.createDataFrame([(f"note\n{x}\nend",) for x in FAKE], "text string").select(detect.redact(F.col("text"))["text"].alias("a"))
    for r in df.select("a", detect.redact(F.col("a")).alias("b")).collect():
        assert detect.TAG in r.a
        assert r.b.text == r.a or "KEY" in r.a


def test_mask_and_line(spark):
    df = spark.createDataFrame([("abcdef",), ("abcdefghij",), ("ab\nsecond",), ("",)], "v string")
    assert [r[0] for r in df.select(detect.mask(F.col("v"))).collect()] == ["******", "abcd...ghij", "**", ""]
    assert df.select(detect.line_of(F.lit("a\nb\nc"), F.lit(2))).first()[0] == 2


def test_pattern_names():
    assert detect.pattern_name("api_key", 3) == "aws_access_key_id"
    assert detect.pattern_name("email", 7) == "email[7]"
    assert len(detect.PATTERNS) == 16
