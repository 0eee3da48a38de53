"""A Parquet cache of parsed rows by file key: one folder a run, complete or not there."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.extract import Extraction, parse_sources
from ..parse.extractors import Options
from ..schema import PARSED
from .files import build_header, file_keys, signature, split_by_cache
from .storage import delete, folders, is_complete

_KEYS = T.StructType([T.StructField("file_key", T.StringType())])
_ROWS = T.StructType([*_KEYS.fields, *PARSED.fields])
#: Runs that are kept apart before they are written as one.
MOST_RUNS = 16


@dataclass
class CachedRun:
    result: Extraction
    header: dict
    hits: int
    misses: int


def _readable(spark: SparkSession, run: str) -> bool:
    """Whether a run was written to its end (its keys come last) and can be read."""
    if not is_complete(spark, f"{run}/rows") or not is_complete(spark, f"{run}/files"):
        return False
    try:
        for part, schema in (("rows", _ROWS), ("files", _KEYS)):
            spark.read.schema(schema).parquet(f"{run}/{part}").agg(*[F.count(c) for c in schema.names[:1]]).first()
        return True
    except Exception as e:
        if "FAILED_READ_FILE" in str(e) or "CANNOT_READ_FILE_FOOTER" in str(e):
            return False
        raise


def _table(spark: SparkSession, runs: list[str], part: str, schema: T.StructType) -> DataFrame:
    paths = [f"{r}/{part}" for r in runs]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(rows: DataFrame, keys: DataFrame, path: str) -> str:
    run = f"{path}/runs/{uuid.uuid4().hex}"
    rows.select(_ROWS.names).write.parquet(f"{run}/rows")
    keys.select("file_key").write.parquet(f"{run}/files")
    return run


def extract_cached(sources: DataFrame, path: str, options: Options = Options(), configs: dict[str, str] | None = None) -> CachedRun:
    """Extract only files whose content or settings changed; add their rows to the cache.

    A run's rows are written before its keys, and only runs with both are
    read, so a crash leaves no half of a run behind and none twice. A damaged
    run is left out: its files are extracted again. Files given twice count
    once. Keys of concurrent runs may overlap; rows are then read from one.
    """
    spark = sources.sparkSession
    header = build_header(sources, options, configs)
    keyed = file_keys(sources, signature(header)).dropDuplicates(["file_key"])
    found = folders(spark, f"{path}/runs")
    runs = [r for r in found if _readable(spark, r)]
    hits, misses = split_by_cache(keyed, _table(spark, runs, "files", _KEYS))
    n_hits, n_misses = hits.count(), misses.count()
    if n_misses:
        runs.append(_write(parse_sources(misses, options, key_col="file_key"), misses, path))
    if len(runs) > MOST_RUNS:
        merged = _write(_table(spark, runs, "rows", _ROWS).distinct(), _table(spark, runs, "files", _KEYS).distinct(), path)
        for r in found + runs:
            delete(spark, r)
        runs = [merged]
    parsed = _table(spark, runs, "rows", _ROWS).join(keyed.select("file_key"), "file_key", "left_semi").drop("file_key")
    return CachedRun(Extraction.of(parsed), header, n_hits, n_misses)
