"""Column helpers and shared storage used by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words and are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII text takes the cheaper built-in."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and that no later plan reads."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(spark: SparkSession, docs: DataFrame | None = None, task_bytes: int = 16 << 20) -> int:
    """Partitions for a keyed exchange whose rows are packed arrays.

    Where the input's size is known to the planner, each stands for at most
    ``task_bytes`` of it, so what one task holds doesn't grow with the input.
    """
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if docs is None:
        return least
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    unknown = size > 1 << 55  # tables that are no files have no known size
    return least if unknown else max(least, -(-size // task_bytes))


def packed_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that added names can't clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed: an order among rows that agree in id and text."""
    plain = [f.name for f in docs.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])
