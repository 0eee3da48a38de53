"""Observations to facts: typing, normal forms, certainty and ids as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.classify import certainty, is_unitless, value_type
from ..functions.identity import element_fact_id, fact_id
from ..functions.normalize import normalize_property, normalize_value
from ..functions.text import built_once
from ..functions.utility import arbitrary_type, declared_value, parse_token, properties_of
from ..schema import SCHEMA_VERSION, SUBJECT, SUBJECT_COLUMNS

#: The columns that every step hands on.
_COMMON = ("file", "producer", "kind", "source", "loc", "element", *SUBJECT_COLUMNS, "raw", "type", "hint", "reason")


def typed(observations: DataFrame) -> DataFrame:
    """Give each value its type; class tokens are parsed and arbitrary ones also become declarations.

    One pass: every observation becomes an array of its own row and of the
    declarations that an arbitrary value makes, which is then exploded. The
    parser below is read once, and no join or shuffle is needed.
    """
    how, is_class = F.col("typed_as"), F.col("kind") == "css.class"
    content = F.col("parsed.arbitrary")
    plain = (
        F.when(how == "sheet", value_type("property", "raw", "sheet"))
        .when(how == "css-in-js", value_type("property", "raw", "css-in-js"))
        .when(how == "inline", value_type("property", "raw", "inline"))
        .when(how == "inline-number", F.when(is_unitless("property"), "number").otherwise("length"))
        .otherwise(how)
    )
    parsed = observations.withColumn("parsed", F.when(is_class, parse_token("token"))).withColumn(
        "declared", F.when(F.col("parsed.is_arbitrary"), declared_value("parsed.arbitrary"))
    )
    arbitrary = F.col("parsed.is_arbitrary")
    own = F.struct(
        F.col("kind"),
        F.col("token"),
        F.when(is_class, F.col("parsed.utility")).otherwise(F.col("utility")).alias("utility"),
        F.when(is_class, arbitrary).otherwise(F.col("is_arbitrary")).alias("is_arbitrary"),
        F.col("property"),
        F.when(arbitrary, content).otherwise(F.col("raw")).alias("raw"),
        F.when(is_class, F.when(arbitrary, arbitrary_type("parsed.arbitrary")).otherwise("keyword")).otherwise(plain).alias("type"),
    )
    text, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    declaration = lambda p: F.struct(
        F.lit("css.declaration").alias("kind"), text.alias("token"), text.alias("utility"), flag.alias("is_arbitrary"), p.alias("property"), F.col("declared.raw").alias("raw"), F.col("declared.type").alias("type")
    )
    properties = F.coalesce(properties_of("parsed.prefix", "declared.type"), F.array().cast("array<string>"))
    made = parsed.withColumn("made", F.explode(F.concat(F.array(own), F.transform(properties, declaration))))
    new = {f.name for f in made.schema["made"].dataType.fields}
    return made.select(*[F.col(f"made.{c}" if c in new else c).alias(c) for c in _COMMON])


@built_once
def _subject() -> Column:
    fields = [F.when(F.col("kind") == "css.declaration", normalize_property("property")).alias("property") if c == "property" else F.col(c) for c in SUBJECT_COLUMNS]
    return F.struct(*fields, F.col("element_id")).cast(SUBJECT)


def finish(rows: DataFrame) -> DataFrame:
    """Facts of typed rows: certainty, norm, diagnostic, subject and id."""
    sure = certainty("type", None, "hint")
    unresolved = F.col("certainty").isin("dynamic", "unknown")
    lost = F.col("type").isNotNull() & ~unresolved & F.col("norm").isNull() & ~F.col("type").isin("union", "dynamic")
    return (
        rows.withColumn("certainty", sure)
        .withColumn("norm", F.when(~unresolved, normalize_value("type", "raw")))
        .withColumn("lost", lost)
        .withColumn(
            "diagnostic",
            F.coalesce(
                "reason",
                F.when(F.col("type").isNotNull() & unresolved, F.concat("certainty", F.lit("-value"))),
                F.when(F.col("lost"), F.concat(F.lit("unnormalizable-"), "type")),
            ),
        )
        .withColumn("certainty", F.when(F.col("lost"), "unknown").otherwise(F.col("certainty")))
        .withColumn("element_id", _owner_id())
        .withColumn("subject", _subject())
        .select(
            fact_id("kind", "file", "loc", "subject", "norm").alias("fact_id"),
            "kind",
            F.lit(SCHEMA_VERSION).alias("schema_v"),
            "file",
            "loc",
            "source",
            F.col("producer").alias("producer_v"),
            "certainty",
            "diagnostic",
            "subject",
            F.when(F.col("type").isNotNull(), F.struct("raw", "norm", "type")).alias("value"),
        )
    )


@built_once
def _owner_id() -> Column:
    """The id of the element a row hangs on: computed from what the row carries, so no join."""
    return F.when(F.col("element").isNotNull(), element_fact_id("file", "element.loc", "element"))


def assemble(observations: DataFrame) -> DataFrame:
    return finish(typed(observations))


def sort_facts(facts: DataFrame) -> DataFrame:
    """The total order of a fact stream."""
    return facts.orderBy("file", "loc.line", "loc.col", "kind", "fact_id")


def numbered(facts: DataFrame) -> DataFrame:
    """Facts with their ``place`` (from 1) in the total order.

    The order begins with the file, so places are counted within files, which
    spread over the cluster, and only one row a file takes part in the running
    sum over files. Both sides read one exchange where only the columns of the
    order are asked for; the join's own test for nulls comes before it, as it
    would otherwise make one side differ and all files be parsed twice.
    """
    inside = Window.partitionBy("file").orderBy("loc.line", "loc.col", "kind", "fact_id")
    rows = facts.where("file is not null").repartition("file").withColumn("rank", F.row_number().over(inside)).withColumn("in_file", F.count(F.lit(1)).over(Window.partitionBy("file")))
    files = rows.where("rank = 1").select(F.col("file").alias("of_file"), "in_file")
    before = F.sum("in_file").over(Window.orderBy("of_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.select("of_file", F.coalesce(before, F.lit(0)).alias("before"))
    placed = rows.drop("in_file").join(offsets, F.col("file") == F.col("of_file"))
    return placed.select(*facts.columns, (F.col("before") + F.col("rank")).alias("place"))


def upsert(facts: DataFrame, newer: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """One row for each fact_id: of equal ids the row of the newer table, then the last by column ``order``, stays.

    Tables have no order of rows of their own; without ``order`` (which is not
    handed on) the greatest full text decides, so the result never depends on
    the partitioning. Equal ids agree in all that is hashed; they are reduced
    by a pre-aggregated maximum, not by a window, so repeated facts don't
    gather in one task.
    """
    columns = [c for c in facts.columns if c != order]

    def ranked(df: DataFrame, run: int) -> DataFrame:
        text = F.to_json(F.struct("producer_v", "source", "certainty", "diagnostic", "value.raw"))
        rank = F.struct(F.lit(run).alias("run"), (F.col(order) if order else F.lit(0)).alias("place"), text.alias("text"))
        return df.select(F.col("fact_id").alias("id"), rank.alias("rank"), F.struct(*columns).alias("row"))

    rows = ranked(facts, 0)
    if newer is not None:
        rows = rows.unionByName(ranked(newer, 1))
    return rows.groupBy("id").agg(F.max_by("row", "rank").alias("row")).select("row.*")


def listed(facts: DataFrame, allowed: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """The facts whose ``column`` is (or is not) in the one column of ``allowed``; null values are never in it.

    For an allow-list, say of norms or of tokens: a semi or an anti join.
    """
    names = allowed.select(F.col(allowed.columns[0]).alias("listed_value"))
    rows = facts.withColumn("listed_key", F.col(column))
    return rows.join(names, F.col("listed_key") == F.col("listed_value"), "left_semi" if inside else "left_anti").drop("listed_key")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fact_id, change): added and removed ids between two runs."""
    a = old.select("fact_id").distinct().withColumn("was", F.lit(True))
    b = new.select("fact_id").distinct().withColumn("is", F.lit(True))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed")
    return a.join(b, "fact_id", "full").select("fact_id", change.alias("change")).where("change is not null")


def owned_by(facts: DataFrame) -> DataFrame:
    """Facts that hang on an element with the element's name and import.

    Facts and elements meet by a window on the element's id: one exchange of
    one input instead of a join of the facts with themselves. A window holds
    what hangs on one element of one file.
    """
    is_element = F.col("kind") == "jsx.element"
    here = Window.partitionBy("element_id")
    element = F.max(F.when(is_element, F.struct("subject.name", "subject.imported_from"))).over(here)
    rows = facts.withColumn("element_id", F.when(is_element, F.col("fact_id")).otherwise(F.col("subject.element_id"))).where("element_id is not null")
    return (
        rows.withColumn("owner", element)
        .where(~is_element)
        .select("*", F.col("owner.name").alias("element_name"), F.col("owner.imported_from").alias("element_from"))
        .drop("owner")
    )
