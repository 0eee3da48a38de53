"""Exact duplicates by skew-safe combining of salted digest groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Three combining steps, each of which groups by the digest *and* the whole
    normalised text: inside each task (map-side partial aggregation), per
    (digest, salt), and globally over at most ``salts`` winners of a digest.
    So a group that holds a third of all rows is spread over ``salts`` tasks
    after it has already shrunk to one row per task and salt.

    Null text counts as the empty text. Of equal texts the largest id stays
    (null ids rank lowest); of rows that repeat id and text, one stays. An
    empty table gives an empty result. Texts travel whole through both
    exchanges, so their length has Spark's bound of 2 GB. The last step joins
    rows to winners by digest, length and a second hash of the text, since the
    winners' whole texts were compared before: two texts with one SHA-256 stay
    apart and would differ in these as well.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"),
    ).select("doc_id", "norm", F.sha2("norm", 256).alias("digest"), F.struct(F.length("norm"), F.xxhash64("norm")).alias("check"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))

    salted = base.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "norm").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    by_digest = (
        winners.where("group_size > 1")
        .select("digest", F.struct(F.length("norm"), F.xxhash64("norm")).alias("check"), "keep_id", "group_size")
        .withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    )
    # Texts of one row need no partner: the left join leaves them alone. The
    # salted key spreads the rows of a large group over several tasks.
    rows = base.select("doc_id", "digest", "check", "salt")
    rank = F.row_number().over(Window.partitionBy("digest", "check", "doc_id").orderBy("digest"))
    joined = rows.withColumn("rank", rank).join(by_digest, ["digest", "check", "salt"], "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("rank") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
