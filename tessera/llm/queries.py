"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .decontamination import find_contamination
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .language_id import identify_language
from .line_dedup import line_report
from .lm_score import lm_scores
from .mixing import mix_sources
from .secret_scan import scan_secrets
from .suffix_dedup import suffix_dedup
from .token_count import count_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs).drop("row")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents")).drop("row")


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_token_counts,
        op3_line_dedup,
        op4_decontamination,
        op5_jaccard_join,
        op6_suffix_dedup,
        op7_secret_scan,
        op8_exact_dedup,
        op9_lm_score,
        op10_language_id,
    )
}
ORACLES = {k: v for k, v in oracles.SQL.items() if k in QUERIES}
