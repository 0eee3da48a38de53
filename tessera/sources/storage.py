"""Folders of tables through the file system that Spark uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, by name; none where there is no such folder."""
    where, system = _at(spark, path)
    if not system.exists(where):
        return []
    return sorted(str(f.getPath()) for f in system.listStatus(where) if f.isDirectory())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    where, system = _at(spark, f"{path}/_SUCCESS")
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, system = _at(spark, path)
    system.delete(where, True)
