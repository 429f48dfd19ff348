import json

from pyspark.sql import functions as F

from lanternfish.functions import detect
from lanternfish.operators import chunks, redact, scan

MAIL = "me@example.org"


def test_json_cells_keep_order_and_skip_keys(spark):
    cell = json.dumps({"z": f"x\n{MAIL}", MAIL: "k", "a": [MAIL, {"b": "other@example.org"}]})
    rows = spark.createDataFrame([("f", "t.c#rowid=1", cell), ("f", "t.c#rowid=2", "{broken " + MAIL), ("f", "t.c#rowid=3", None)], "file string, location string, value string")
    got = {(r.location, r.preview) for r in scan.cell_findings(rows).collect()}
    assert got == {("t.c#rowid=1:line 2", "me@e....org"), ("t.c#rowid=1:line 1", "othe....org"), ("t.c#rowid=2:line 1", "me@e....org")}


def test_redact_cells(spark):
    output = json.dumps({"type": "x", "content": [{"type": "text", "text": "secret stuff"}], "note": MAIL})
    rows = spark.createDataFrame(
        [("f", "1", output, True), ("f", "2", output, False), ("f", "3", "plain " + MAIL, False), ("f", "4", "nothing", False), ("f", "5", "whole", True)], "file string, location string, value string, semantic boolean"
    )
    got = {r.location: (r.new_value, [e.category for e in r.edits]) for r in redact.redact_cells(rows).collect()}
    one = json.loads(got["1"][0])
    assert one["content"][0]["text"].startswith(detect.TAG) and one["content"][0]["type"] == "text" and one["note"] == MAIL
    two = json.loads(got["2"][0])
    assert two["content"][0]["text"] == "secret stuff" and two["note"].startswith(detect.TAG)
    assert got["3"][0].startswith("plain " + detect.TAG) and "4" not in got and got["5"][1] == [detect.SEMANTIC]
    new = redact.apply_cells(rows, redact.redact_cells(rows), "value")
    assert new.count() == 5 and new.where(F.contains("value", F.lit(detect.TAG))).count() == 4
    again = redact.redact_cells(new)
    assert again.where("location <> '2'").count() == 0


def pair(spark, a, b, same=True):
    rows = [("f", "m", 1, "s", a), ("f", "m", 2, "s" if same else "other", b)]
    made = chunks.units(spark.createDataFrame(rows, "file string, tab string, rowid long, session_id string, v string"), ["v"])
    return [r.fingerprint for r in chunks.across_rows(made).where("category = 'api_key'").collect()]


def test_a_key_is_found_at_every_cut(spark):
    key = "AK" + "IA" + "QWER" * 4
    rows, n = [], 0
    for cut in range(1, len(key)):
        rows += [("f", "m", n, f"s{cut}", "take " + key[:cut]), ("f", "m", n + 1, f"s{cut}", key[cut:] + " now")]
        n += 2
    made = chunks.units(spark.createDataFrame(rows, "file string, tab string, rowid long, session_id string, v string"), ["v"])
    found = chunks.across_rows(made).where("category = 'api_key'").collect()
    assert len(found) == len(key) - 1 and len({r.fingerprint for r in found}) == 1


def test_sessions_are_not_joined(spark):
    key = "AK" + "IA" + "QWER" * 4
    assert pair(spark, "x " + key[:9], key[9:]) and not pair(spark, "x " + key[:9], key[9:], same=False)
    assert not pair(spark, "x " + key[:9] + " ", "- " + key[9:])


def test_known_findings_are_not_repeated(spark):
    key = "AK" + "IA" + "QWER" * 4
    rows = spark.createDataFrame([("f", "m", 1, "s", "aaaaaaaaaaaaa"), ("f", "m", 2, "s", key)], "file string, tab string, rowid long, session_id string, v string")
    made = chunks.units(rows, ["v"])
    cells = rows.select("file", F.concat("tab", F.lit(".v#rowid="), F.col("rowid").cast("string")).alias("location"), F.col("v").alias("value"))
    known = scan.cell_findings(cells)
    assert known.count() == 1 and chunks.across_rows(made, known).count() == 0


def test_sensitive_paths(spark):
    yes = [".env", "/a/.ENV.local", "x/id_rsa", "'c/secrets.yaml'", "C:\\k\\a.PEM", "my_secret_plan", "~/.aws/config", "prod.env"]
    no = ["", "main.rs", "environment", "/a/pem", "ssh/config", "key"]
    df = spark.createDataFrame([(x,) for x in yes + no], "p string").select(scan.sensitive_path(F.col("p")))
    assert [r[0] for r in df.collect()] == [True] * len(yes) + [False] * len(no)


def test_sarif_log_holds_no_secret(spark):
    files = spark.createDataFrame([("a\\b.md", f"x\nmail {MAIL}")], "file string, text string")
    log = json.loads(scan.sarif_log(scan.text_findings(files)).first().log)
    result = log["runs"][0]["results"][0]
    assert log["version"] == "2.1.0" and result["level"] == "warning" and result["locations"][0]["physicalLocation"]["region"]["startLine"] == 2
    assert MAIL not in json.dumps(log) and result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a/b.md"


def test_neighbours_across_ranges(spark):
    ids = [1, 2, 99_999, 100_000, 350_000, 350_001]
    rows = spark.createDataFrame([("f", "m", i, "s") for i in ids] + [("f", "n", 5, "s")], "file string, tab string, rowid long, session_id string")
    got = {(r.tab, r.rowid): r.nxt and r.nxt.rowid for r in chunks.with_next(rows, ["file", "tab"], ["session_id"]).collect()}
    assert got == {("m", a): b for a, b in zip(ids, [*ids[1:], None], strict=True)} | {("n", 5): None}
