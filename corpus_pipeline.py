"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialise, packed_row, row_hash
from tessera.llm.decontamination import find_contamination
from tessera.llm.jaccard_join import jaccard_groups
from tessera.llm.language_id import UNKNOWN, identify_language
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix_sources

#: Below this mean probability no language is accepted.
LEAST_LANGUAGE_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those no learned language explains."""
    found = identify_language(docs, carry=True)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; text and n_chars follow."""
    kept = line_dedup(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    untouched = (F.col("n_dropped") == 0) | F.col("row.text").isNull()
    return kept.select(
        *[(F.when(untouched, F.col(f"row.{c}")).otherwise(new[c]) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle Jaccard the smallest id stays, once; of rows that repeat id and text one stays."""
    stay = jaccard_groups(docs).where("stays").select(F.col("doc_id").alias("stay_id"), F.col("print").alias("stay_print")).distinct()
    rows = docs.select(packed_row(docs).alias("row"), F.col("doc_id").alias("id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), row_hash(docs).alias("tie"))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("print") == F.col("stay_print")), "left_semi")
    place = F.row_number().over(Window.partitionBy("id", "text").orderBy("tie"))
    return kept.withColumn("place", place).where("place = 1").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows without id go together, as hits name ids."""
    hits = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("hit_id")).distinct()
    rows = docs.select(packed_row(docs).alias("row"), F.col("doc_id").alias("id"))
    return rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")), "left_anti").select("row.*")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the Pfair mixture; sort by mix_order.

    The places come in columns mix_*, with underscores before a name that the documents have already.
    """
    taken, extra = {c.lower() for c in docs.columns}, []
    for c in ("block", "slot", "release", "deadline", "mix_order"):
        name = c if c.startswith("mix_") else f"mix_{c}"
        while name in taken:
            name = f"_{name}"
        extra.append(F.col(c).alias(name))
    return mix_sources(docs).select("row.*", *extra)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mix_sources", mix_to_weights),
]

#: Language identification and the mixing of its survivors are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
