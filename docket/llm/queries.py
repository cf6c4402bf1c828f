"""Registered queries of the training-data operators: ``op<N>_<name>(spark, sf_dir)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm import (ctw, langid, licences, lines, merkle, mixture, phrases, rules, secrets, segment, shards, simhash,
                        spans)
from docket.llm.common import documents
from docket.llm.sql import MERKLE_MANIFEST, PHRASE_COLLOCATIONS
from docket.sinks.tables import materialize


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id")
    found = secrets.scan(documents(spark, sf_dir, "doc_id", "text", "source"), secrets.named_or_well_formed(),
                         labelled_ids=labelled)
    return found.select("doc_id", "word_no", "run_no", F.crc32(F.col("run").cast("binary")).alias("finding_crc32"),
                        *secrets.FEATURES[:5], "label", "probability", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    back = segment.decode(segment.encode(docs, samples=2, keep=("text_hash",)))
    return back.select("doc_id", "rank", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob",
                       "log_inclusion", (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir, "doc_id", "text"), similarity=0.8)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(rules.statistics(documents(spark, sf_dir, "doc_id", "text")), "quality-stats")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    known = materialize(rules.labelled_statistics(stats, labels), "quality-labelled")
    return rules.judge(stats, rules.learn(known)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_no")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(documents(spark, sf_dir, "doc_id", "text"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.fingerprints(documents(spark, sf_dir, "doc_id", "text"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), shingle=3, bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(documents(spark, sf_dir, "doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir, "doc_id", "text"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir, "doc_id", "text"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(documents(spark, sf_dir, "lang", "text"), min_count=30, top=2000, percent=80)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir, "doc_id", "lang", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(documents(spark, sf_dir, *merkle.COLUMNS)).drop("n_siblings")


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_fingerprints": op6_fingerprints,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_license_scans": op9_license_scans,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_language_id": op12_language_id,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE: dict[str, str] = {
    "op11_phrase_collocations": PHRASE_COLLOCATIONS,
    "op13_merkle_manifest": MERKLE_MANIFEST,
}
