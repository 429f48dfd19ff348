import json
import os

from lanternfish.functions.jsontext import fp
from lanternfish.streaming import sessions


def test_ended_sessions_get_verdicts(spark, tmp_path):
    payloads = spark.createDataFrame([("a", "mail me@example.org"), ("b", "key " + "AK" + "IA" + "QWER" * 4), ("c", "fine")], "session_id string, text string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"session_id": s}) for s in "abcz"))
    ended = spark.readStream.schema("session_id string").json(str(tmp_path / "in"))
    sessions.scan_ended(ended, payloads, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.session_id: r.status for r in spark.read.json(str(tmp_path / "out")).collect()} == {"a": "REVIEW", "b": "BLOCKED", "c": "CLEAN", "z": "SKIPPED"}


def test_a_value_is_carried_over_batches(spark, tmp_path):
    key = "AK" + "IA" + "QWER" * 4
    (tmp_path / "in").mkdir()
    for i, rows in enumerate([[("s", 1, "take " + key[:7])], [("s", 2, key[7:] + " now"), ("t", 1, key[7:])]]):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps(dict(zip(("session_id", "seq", "text"), r, strict=True))) for r in rows))
        os.utime(tmp_path / f"in/{i}.json", (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
    stream = spark.readStream.schema("session_id string, seq long, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = sessions.split_over(stream).writeStream.format("memory").queryName("split").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.session_id, r.category) for r in spark.table("split").collect()] == [("s", "api_key")]


def test_long_values_are_carried_whole(spark, tmp_path):
    dashes = "-" * 5
    pem = f"{dashes}BEGIN RSA PRIVATE KEY{dashes}\n" + "\n".join("Qx7" * 20 for _ in range(40)) + f"\n{dashes}END RSA PRIVATE KEY{dashes}"
    jwt = "ey" + "J" + "a1" * 400 + "." + "b2" * 600 + "." + "c3" * 300
    turns = [
        [("p", 1, "mine: " + pem[:1200]), ("j", 1, "see " + jwt[:900])],
        [("p", 2, pem[1200:] + " bye"), ("j", 2, jwt[900:] + " bye")],
        [("q", 1, pem[:700])],
        [("q", 2, pem[700:1500])],
        [("q", 3, pem[1500:])],
    ]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(turns):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps(dict(zip(("session_id", "seq", "text"), r, strict=True))) for r in rows))
        os.utime(tmp_path / f"in/{i}.json", (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
    stream = spark.readStream.schema("session_id string, seq long, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = sessions.split_over(stream).writeStream.format("memory").queryName("long").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {(r.session_id, r.category, r.fingerprint) for r in spark.table("long").collect()}
    assert {("p", "private_key", fp(pem)), ("j", "bearer_token", fp(jwt)), ("q", "private_key", fp(pem))} <= found


def test_windows_have_a_watermark(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1), ("2024-01-01 00:50:00", 1), ("2024-01-01 01:10:00", 1)], "t string, user_id long").selectExpr("CAST(t AS TIMESTAMP) AS ts", "user_id")
    assert sorted(r.events for r in sessions.activity_windows(rows).collect()) == [1, 2]
