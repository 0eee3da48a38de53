"""Extraction: tables of source text to observations, diagnostics and facts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

from ..parse.extractors import Options, chosen_extractors, extract_file
from ..schema import PARSED
from .assemble import assemble

#: Rows put out at a time.
BATCH = 2000
#: Tasks that parse, for each core.
WAVES = 4


def routed(path) -> Column:
    """The language that a path's extension names: sheet, program or null."""
    low = F.lower(path if isinstance(path, Column) else F.col(path))
    return F.when(low.endswith(".css"), "sheet").when(low.endswith(".tsx") | low.endswith(".ts"), "program")


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """Values of a type; the fields of structs are gathered one by one, several times faster than a conversion of dicts."""
    if not pa.types.is_struct(kind):
        return pa.array(values, kind)
    absent = pa.array([v is None for v in values], pa.bool_())
    return pa.StructArray.from_arrays([_array([None if v is None else v.get(f.name) for v in values], f.type) for f in kind], fields=list(kind), mask=absent)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def parse_sources(sources: DataFrame, options: Options = Options(), path_col: str = "path", code_col: str = "code", key_col: str | None = None) -> DataFrame:
    """One parse of each file by all chosen extractors (rows of schema.PARSED, after ``key_col`` where given).

    The files that no extractor reads are pruned before Python sees them. Files
    are dealt out by their paths, however the scan is split: parsing takes far
    longer than moving a text, and a few megabytes of table (one split) can
    make a million files. The extractors are sent to the workers with the plan,
    registered ones included.
    """
    extra = [key_col] if key_col else []
    fields = T.StructType([*(sources.schema[c] for c in extra), *PARSED.fields])
    schema, chosen = to_arrow_schema(fields), chosen_extractors(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            keys = batch.column(2).to_pylist() if extra else [None] * batch.num_rows
            for file, code, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), keys):
                rows = extract_file(file, code or "", options, chosen)
                held += [{**r, key_col: key} for r in rows] if extra else rows
                while len(held) >= BATCH:
                    yield _batch(held[:BATCH], schema)
                    held = held[BATCH:]
        if held:
            yield _batch(held, schema)

    read = sources.where(routed(path_col).isNotNull()).select(path_col, code_col, *extra)
    return read.repartition(WAVES * sources.sparkSession.sparkContext.defaultParallelism, path_col).mapInArrow(run, fields)


def register_udtf(spark: SparkSession, name: str = "extract_facts", options: Options = Options()) -> None:
    """Make ``SELECT ... FROM t, LATERAL extract_facts(path, code)`` available in SQL."""

    chosen = chosen_extractors(options)

    @udtf(returnType=PARSED)
    class Extract:
        def eval(self, file: str, code: str):
            for row in extract_file(file or "", code or "", options, chosen):
                yield tuple(row.values())

    spark.udtf.register(name, Extract)


@dataclass
class Extraction:
    facts: DataFrame
    diagnostics: DataFrame
    parsed: DataFrame

    @classmethod
    def of(cls, parsed: DataFrame) -> Extraction:
        """Facts and diagnostics of parsed rows."""
        side = parsed.where("rec = 'diag'").select("file", "producer", "reason", "message", "loc", "kind")
        return cls(assemble(parsed.where("rec = 'obs'")), side, parsed)


def extract(sources: DataFrame, options: Options = Options(), **columns: str) -> Extraction:
    """Facts and diagnostics of a table of sources (path, code)."""
    return Extraction.of(parse_sources(sources, options, **columns))
