"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read
from . import arc_warc, chat_format, cross_parse, kneser_ney, lsh_forest, pattern_packing, phrase_fingerprint, quality_rules, raking, url_vocabulary


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents")).withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(read(spark, sf_dir, "conversations"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.archive_round_trip(read(spark, sf_dir, "pages"))


def op5_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pattern_packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parse.identify(read(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.plan_mix(read(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_vocabulary.judge_urls(read(spark, sf_dir, "pages")).drop("terms")


def op10_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.oracle(),
        "op2_near_duplicates": lsh_forest.oracle(3, 85),
        "op3_chat_formatting": chat_format.oracle(),
        "op4_warc_round_trip": arc_warc.oracle(),
        "op8_mix_sources": raking.oracle(),
        "op9_url_filter": url_vocabulary.oracle(),
    }
