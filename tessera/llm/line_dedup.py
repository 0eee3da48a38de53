"""Corpus-wide line deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, packed_row


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    salts: int = 16,
) -> DataFrame:
    """The input rows as ``row`` (a struct) with doc_id, n_lines, n_dropped and kept_text.

    A line's key is the line stripped of blanks at both ends with A-Z
    lower-cased. Keys of ``min_chars`` code points or more that occur in
    ``min_docs`` documents lose all their lines except those in the largest
    id that holds the key. Other lines stay and are joined again in order.

    Keys travel as two 64-bit hashes, never as text. Counting pre-aggregates
    in the map tasks; the join that finds the lines to drop is salted, so a
    line that a third of all documents share is spread over ``salts`` tasks.

    Texts and lines of any length up to Spark's 2 GB are taken whole. Null or
    empty text is one empty line; ids may repeat (a document is then
    all rows of the id, and rows of one id with equal text get equal results);
    null ids count as one document that ranks lowest. Empty tables give empty
    results.
    """
    source = docs.select(
        packed_row(docs).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("print", F.xxhash64("text"))
    line = (
        source.select("doc_id", "print", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("doc_id", "print", "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "print", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(29), "key").alias("h2"))
    )
    # count_distinct skips null ids, so the null document is counted apart.
    dropped = (
        line.groupBy("h1", "h2")
        .agg(
            (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n_docs"),
            F.max("doc_id").alias("keeper"),
        )
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"))
    )
    hits = (
        line.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .join(dropped, ["h1", "h2", "salt"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "print")
        .agg(F.collect_set("pos").alias("drop"))
        .select(F.col("doc_id").alias("hit_id"), F.col("print").alias("hit_print"), "drop")
    )
    joined = source.join(
        hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("print") == F.col("hit_print")), "left"
    )
    lines = _lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    )
    return joined.select(
        "row",
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept text."""
    return line_dedup(docs, **options).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )
