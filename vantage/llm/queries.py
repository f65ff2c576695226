"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, licences, lines, mixing, quality, rules, sharding, simhash, toxicity, warc
from .common import read

#: Target shares of the tokens by domain of the table labels.
MIX_WEIGHTS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_deleted", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(read(spark, sf_dir, "labels"))
    out, domains = mixing.mix(read(spark, sf_dir, "documents"), labelled, MIX_WEIGHTS)
    shares = [F.round(f"p{i}", 9).alias(f"p_{d}") for i, d in enumerate(domains)]
    return out.select(F.col("id").alias("doc_id"), F.col("tokens").alias("n_tokens"), *shares, F.round("rate", 9).alias("rate"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan(read(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"].alias("dice"), (-m["first_line"]).alias("at"), m["licence"].alias("licence"))))
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("matches").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",").alias("licences"),
        best["licence"].alias("best_licence"),
        F.round(best["dice"], 9).alias("best_dice"),
        (-best["at"]).alias("best_line"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_line_dedup, op2_simhash, op3_mixing, op4_licences, op5_quality_rules, op6_sharding, op7_toxicity, op8_quality, op9_warc, op10_decontamination)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": lines.ORACLE_SQL,
        "op2_simhash": simhash.ORACLE_SQL,
        "op5_quality_rules": rules.ORACLE_SQL,
        "op6_sharding": sharding.ORACLE_SQL,
        "op9_warc": warc.ORACLE_SQL,
        "op10_decontamination": contamination.ORACLE_SQL,
    }
