"""Beyond parity: facts of arriving files, upserted by fact_id for each micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.assemble import upsert
from ..operators.extract import extract
from ..parse.extractors import Options
from ..schema import FACT
from ..sources.storage import delete, folders, is_complete


class FactTable:
    """A folder of immutable fact versions; the newest complete one is current, also after a restart.

    A merge writes the whole table anew, so it suits tables that a batch can
    rewrite; the version before the current one is kept for its readers.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[str]:
        return [v for v in folders(self.spark, self.path) if is_complete(self.spark, v)]

    def read(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(FACT).parquet(found[-1]) if found else self.spark.createDataFrame([], FACT)

    def merge(self, newer: DataFrame) -> None:
        """Idempotent: a batch that is run again gives the same rows."""
        found = self.versions()
        number = int(found[-1].rsplit("/v", 1)[1].split("-")[0]) + 1 if found else 0
        upsert(self.read(), newer).write.parquet(f"{self.path}/v{number:012d}-{uuid.uuid4().hex[:8]}")
        for old in found[:-1]:
            delete(self.spark, old)


def stream_facts(sources: DataFrame, facts: FactTable, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Extract a streaming table of sources (path, code) into a fact table."""

    def batch(df: DataFrame, _: int) -> None:
        facts.merge(extract(df, options).facts)

    return sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
