"""Fact output: canonical JSON lines, object form, flat rows, summaries."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import small_escapes, written_json
from ..functions.text import built_once
from ..schema import FACT, LOC, SUBJECT_FIELDS
from .assemble import sort_facts


def _fields(**values: Column) -> Column:
    """"name":value,... of an object as the writer spells it, without its braces."""
    return F.regexp_replace(written_json(F.struct(*[v.alias(k) for k, v in values.items()])), r"(?s)^\{(.*)\}$", "$1")


@built_once
def fact_json() -> Column:
    """A fact as canonical JSON: keys in order, an absent diagnostic or value left out.

    Neighbouring keys that are always there are written together, and escapes
    are made small once, in the whole text.
    """
    plain = lambda *names: {c: F.col(c) for c in names}
    loc = F.struct(*[F.col(f"loc.{c}").alias(c) for c in sorted(LOC.names)])
    subject = F.lit(None).cast("string")
    for kind, fields in SUBJECT_FIELDS.items():
        made = F.struct(*[F.col(f"subject.{c}").alias(c) for c in sorted(fields)])
        subject = F.when(F.col("kind") == kind, _fields(subject=made)).otherwise(subject)
    value = F.struct(*[F.col(f"value.{c}").alias(c) for c in ("norm", "raw", "type")])
    parts = [
        _fields(**plain("certainty")),
        F.when(F.col("diagnostic").isNotNull(), _fields(**plain("diagnostic"))),
        _fields(**plain("fact_id", "file", "kind"), loc=loc, **plain("producer_v", "schema_v", "source")),
        subject,
        F.when(F.col("value").isNotNull(), _fields(value=value)),
    ]
    return small_escapes(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def facts_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Facts of a column of JSON texts, such as a file of NDJSON read as text; fields that are left out are null."""
    return lines.select(F.from_json(F.col(column), FACT).alias("fact")).select("fact.*")


def ndjson(facts: DataFrame) -> DataFrame:
    """One canonical JSON text a fact, in total order."""
    return sort_facts(facts).select(fact_json().alias("value"))


def write_ndjson(facts: DataFrame, path: str, single: bool = False) -> None:
    """Text files whose parts follow each other in total order."""
    lines = ndjson(facts)
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def object_text(header: dict, facts: DataFrame, pretty: bool = False) -> Iterator[str]:
    """The object form in pieces, one fact held at a time: canonical JSON, or indented with the header first."""
    lines = (r[0] for r in ndjson(facts).toLocalIterator())
    if pretty:
        made = json.dumps({"snapshot_header": header}, indent=2, ensure_ascii=False)
        yield made[: -len("\n}")] + ',\n  "facts": ['
        n = 0
        for n, x in enumerate(lines, 1):
            yield ("," if n > 1 else "") + "\n    " + json.dumps(json.loads(x), indent=2, ensure_ascii=False).replace("\n", "\n    ")
        yield "\n  ]\n}" if n else "]\n}"
        return
    yield '{"facts":['
    for n, x in enumerate(lines):
        yield ("," if n else "") + x
    yield '],"snapshot_header":' + json.dumps(header, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "}"


def to_object(header: dict, facts: DataFrame, pretty: bool = False) -> str:
    """The object form as one text, for results that fit the driver."""
    return "".join(object_text(header, facts, pretty))


def flat(facts: DataFrame) -> DataFrame:
    """The fifteen flat columns."""
    return facts.select(
        "fact_id", "kind", "schema_v", "file", *[F.col(f"loc.{c}").alias(c) for c in LOC.names], "source", "producer_v", "certainty", "diagnostic",
        F.col("value.raw").alias("raw"), F.col("value.norm").alias("norm"), F.col("value.type").alias("value_type"),
    )


def coverage(facts: DataFrame) -> DataFrame:
    """(section, key, n): counts by kind, certainty, source and reason, and totals, in one pass."""
    unresolved = F.col("certainty").isin("dynamic", "unknown")
    reason = F.coalesce("diagnostic", F.lit("unspecified"))
    entry = lambda section, key: F.struct(F.lit(section).alias("section"), key.alias("key"))
    sets = F.array(
        entry("kind", F.col("kind")),
        entry("certainty", F.col("certainty")),
        entry("source", F.col("source")),
        entry("total", F.lit("facts")),
        F.when(unresolved, entry("total", F.lit("unresolved"))),
        F.when(unresolved, entry("reason", reason)),
    )
    rows = facts.select(F.explode(F.filter(sets, lambda s: s.isNotNull())).alias("s")).select("s.section", "s.key")
    return rows.groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"))


def unresolved_rate(facts: DataFrame) -> DataFrame:
    n, u = F.count(F.lit(1)), F.count_if(F.col("certainty").isin("dynamic", "unknown"))
    return facts.agg(n.alias("facts"), u.alias("unresolved"), F.when(n == 0, 0.0).otherwise(u / n).alias("unresolved_rate"))


def format_coverage(report: DataFrame | list) -> str:
    """The summary as text, of a report or its rows; the counts are few."""
    found: dict[str, dict[str, int]] = {}
    for r in report.collect() if isinstance(report, DataFrame) else report:
        found.setdefault(r["section"], {})[r["key"]] = r["n"]
    total = found.get("total", {})
    n, u = total.get("facts", 0), total.get("unresolved", 0)
    lines = [f"facts: {n}", f"unresolved: {u} ({100 * u / n if n else 0:.1f}%)"]
    for section in ("kind", "certainty", "source", "reason"):
        lines.append(f"by {section}:")
        lines += [f"  {k.ljust(22)} {c}" for k, c in sorted(found.get(section, {}).items())]
    return "\n".join(lines)
