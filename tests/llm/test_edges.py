"""Every operator and pipeline stage over nulls, empty and long texts, ties, repeats, clashing names and no rows."""

import random

import public_tokenizers
import pytest

import corpus_pipeline
from lanternfish.llm import arc_warc, chat_format, cross_parse, kneser_ney, lsh_forest, pattern_packing, phrase_fingerprint, quality_rules, raking, url_vocabulary

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
OVER_DOCUMENTS = {
    "op1": lambda d, lb: quality_rules.apply_rules(d),
    "op2": lambda d, lb: lsh_forest.near_duplicates(d, 3, 85),
    "op5": lambda d, lb: phrase_fingerprint.fingerprints(d),
    "op7": lambda d, lb: cross_parse.identify(d),
    "op8": lambda d, lb: raking.plan_mix(d),
    "op10": lambda d, lb: kneser_ney.judge(d, lb),
}


@pytest.mark.parametrize("name", OVER_DOCUMENTS)
def test_one_row_a_row(nasty, nothing, labels, name):
    run = OVER_DOCUMENTS[name]
    assert len(run(nasty, labels).collect()) == nasty.count()
    empty = run(nothing, labels)
    assert empty.collect() == [] and "doc_id" in empty.columns


def test_no_labels(nasty, labels):
    rows = kneser_ney.judge(nasty, labels.limit(0)).collect()
    assert len(rows) == nasty.count() and all(r.kept and r.perplexity is None for r in rows)


def test_packing_edges(nasty, nothing):
    rows = pattern_packing.pack(nasty, TOKENIZER).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in nasty.collect()}
    one = {r.doc_id: r for r in rows if r.doc_id in (0, 1)}
    assert [(r.piece, r.start, r.length) for r in one.values()] == [(0, 0, 1)] * 2
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 8)
    assert len(long) > 20 and all(n == 2048 for _, _, n in long[1:]) and long[1][1] == long[0][2]
    assert pattern_packing.pack(nothing, TOKENIZER).collect() == []


def test_defined_results(nasty):
    r1 = {r.doc_id: r for r in quality_rules.apply_rules(nasty).collect()}
    assert r1[0].n_words == 0 and r1[0].base_failed and not r1[0].kept and r1[8].n_repeat_words == r1[8].n_words
    r2 = {r.doc_id: r for r in lsh_forest.near_duplicates(nasty, 3, 85).collect()}
    assert [r2[i].n_shingles for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1] and r2[0].component_id == 0 and r2[1].kept
    assert r2[10].component_id == 9 and not r2[10].kept
    r7 = {r.doc_id: r for r in cross_parse.identify(nasty).collect()}
    assert [(r7[i].lang_pred, r7[i].score) for i in (0, 1, 2)] == [("und", 0.0)] * 3
    r5 = {r.doc_id: r for r in phrase_fingerprint.fingerprints(nasty).collect()}
    assert r5[0].n_chars == 0 and r5[0].fingerprint == r5[1].fingerprint and r5[9].fingerprint == r5[10].fingerprint and r5[10].near_next == 1.0 and r5[0].near_edited == 1.0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, nasty, nothing, labels, tmp_path, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    made = stage(spark, nasty, str(tmp_path))
    rows = made.collect()
    if name != "packing":
        assert made.columns == nasty.columns and len(rows) <= nasty.count()
    assert stage(spark, nothing, str(tmp_path)).collect() == []


def test_what_stages_keep(spark, nasty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda name: [r.doc_id for r in stages[name](spark, nasty, str(tmp_path)).collect()]
    spoken = ids("language_id")
    assert not {0, 1, 2} & set(spoken) and spoken.count(9) == 3 and 10 in spoken
    good = ids("quality")
    assert {0, 1, 2, 5} <= set(good) and good.count(9) in (0, 3)
    left = ids("near_dedup")
    assert 10 not in left and left.count(9) == 3 and left.count(None) == 1 and {0, 1, 2, 3, 4} <= set(left)
    drawn = ids("mixture")
    assert drawn.count(9) in (0, 3)
    packed = ids("packing")
    assert {None, 0, 1, 10} <= set(packed) and packed.count(9) == 3


def test_pages(spark):
    kind = "page_id long, url string, html string, host string, rule string, record_type string"
    rows = [(1, None, None, "h", "r", "x"), (2, "no scheme", "", None, None, None), (3, "http://A.Example.ORG/es/x?y#z", "<p>é</p>", "", "", ""), (4, "http://e.com", "<p>é</p>", "", "", ""), (None, "http://x y.com/ a", "<p>é</p>", "", "", ""), (3, "http://A.Example.ORG/es/x?y#z", "<p>é</p>", "", "", ""), (7, "http://" + "a/" * 50_000, "b" * 300_000 + "\r\n\r\nWARC/1.0\r\n", "", "", "")]
    pages = spark.createDataFrame(rows, kind)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in arc_warc.archive_round_trip(pages).collect())
    assert got == sorted([("1", 0, "response", None), ("2", 0, "revisit", 1), ("3", 9, "response", None), ("3", 9, "response", None), ("4", 9, "revisit", 3), ("None", 9, "revisit", 3), ("7", 300_014, "response", None)])
    judged = {str(r.page_id): r for r in url_vocabulary.judge_urls(pages).collect()}
    assert (judged["1"].host, judged["1"].path, judged["1"].verdict) == ("", "", "allow") and judged["3"].host == "a.example.org" and judged["3"].rule == "example.org/es/" and judged["3"].verdict == "block"
    none = pages.limit(0)
    assert arc_warc.archive_round_trip(none).collect() == [] and url_vocabulary.judge_urls(none).collect() == []


def test_conversations(spark):
    kind = "conv_id long, turn long, role string, text string, pos string, n_turns string"
    rows = [(1, 0, "user", "a", "", ""), (1, 0, "user", "a", "", ""), (2, 0, "user", "a", "", ""), (2, 1, None, None, "", ""), (3, 0, "user", "a", "", ""), (3, 1, None, None, "", ""), (4, None, "user", "<|im_end|>", "", ""), (None, 0, "user", "x", "", ""), (5, 0, "user", "a", "", ""), (5, 0, "user", "b", "", ""), (6, 0, "user", "", "", "")]
    got = {str(r.conv_id): r for r in chat_format.format_chats(spark.createDataFrame(rows, kind)).collect()}
    assert (got["1"].n_turns, got["1"].kept, got["1"].covered_by) == (1, False, 2)
    assert got["2"].kept and not got["3"].kept and got["3"].covered_by == 2 and got["2"].rendered.count("<|im_start|>") == 2 and "unknown" in got["2"].rendered
    assert got["4"].rendered.count("<|im_end|>") == 1 and got["None"].kept and got["5"].n_turns == 2 and got["6"].kept
    assert chat_format.format_chats(spark.createDataFrame([], kind)).collect() == []


def test_long_conversations_render_in_chunks(spark):
    rows = spark.range(2500).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "CAST(id AS STRING) AS text")
    more = spark.range(1200).selectExpr("2L AS conv_id", "id AS turn", "'user' AS role", "CAST(id AS STRING) AS text")
    got = chat_format.format_chats(rows.unionByName(more)).collect()
    assert sorted((r.conv_id, r.chunk, r.kept) for r in got) == [(1, 0, True), (1, 1, True), (1, 2, True), (2, 0, False)]
    assert sum(r.rendered.count("<|im_start|>") for r in got if r.kept) == 2500


def test_archives_are_cut_by_bytes_and_compressed_by_record(spark, tmp_path, monkeypatch):
    import io
    import zlib

    monkeypatch.setattr(arc_warc, "IMAGE_BYTES", 100_000)
    rng = random.Random(1)
    rows = [(i, f"http://e.com/{i}", "".join(rng.choices("abcdefghij0123456789", k=30_000))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/warc"
    arc_warc.write_warc(arc_warc.record_text(arc_warc.mark_revisits(arc_warc.convert(arc_warc.pages_to_arc(pages)))), path, images_per_file=2)
    records = 0
    for file in (tmp_path / "warc").glob("part-*"):
        left = file.read_bytes()
        assert len(left) <= 2 * 100_000 + 2 * 40_000
        while left:
            member = zlib.decompressobj(31)
            whole = member.decompress(left)
            left = member.unused_data
            if whole:
                assert len(list(arc_warc.parse_warc(io.BytesIO(whole)))) == 1
                records += 1
    assert records == 60 and {r.page_key for r in arc_warc.read_warc(spark, path).collect()} == {str(i) for i in range(60)}
