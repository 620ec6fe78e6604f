"""Registered queries of the operators: each applies one to its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroseries.llm import (
    decontamination, html_extraction, importance, language_id, language_model, merkle, packing, quality_rules,
    sharding, simhash, substring_dedup, url_filters, warc,
)

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = [f"shard-{i:02d}" for i in range(16)]
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; Python workers of this session find the package where the driver does."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS)
    return placed.select("doc_id", F.col("slot").cast("bigint").alias("slot"), F.col("shard").cast("bigint").alias("shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.measure(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    pages = table(spark, sf_dir, "pages")
    index = warc.build_index(warc.write_archives(pages, folder))
    return warc.lookup(index, folder, pages).drop("key")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.explode(F.array(*(F.struct(*map(F.lit, rule)) for rule in RULES))).alias("rule")
    listed = spark.range(1).select(entries).select("rule.*").toDF("host", "path", "verdict")
    return url_filters.judge(table(spark, sf_dir, "pages"), listed)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    named = [
        op1_packing, op2_sharding, op3_language_id, op4_substring_dedup, op5_html_extraction, op6_quality_rules, op7_simhash,
        op8_warc, op9_decontamination, op10_url_filters, op11_merkle_manifest, op12_importance_resampling,
        op13_lm_scoring,
    ]
    return {query.__name__: query for query in named}
