"""Utility-class tokens as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .normalize import NUMBER
from .text import JS_SPACE, built_once, col, has, js_trim, let, part

#: The properties that an arbitrary value sets, by the prefix of its token and the type of the value.
ARBITRARY_PROPERTIES = {
    "color": """
bg background-color
text color
border border-color
border-x border-left-color border-right-color
border-y border-top-color border-bottom-color
border-t border-top-color
border-r border-right-color
border-b border-bottom-color
border-l border-left-color
outline outline-color
fill fill
stroke stroke
caret caret-color
accent accent-color
decoration text-decoration-color
""",
    "length": """
text font-size
border border-width
border-x border-left-width border-right-width
border-y border-top-width border-bottom-width
border-t border-top-width
border-r border-right-width
border-b border-bottom-width
border-l border-left-width
outline outline-width
stroke stroke-width
decoration text-decoration-thickness
w width
h height
min-w min-width
max-w max-width
min-h min-height
max-h max-height
size width height
basis flex-basis
gap gap
gap-x column-gap
gap-y row-gap
p padding
px padding-left padding-right
py padding-top padding-bottom
pt padding-top
pr padding-right
pb padding-bottom
pl padding-left
m margin
mx margin-left margin-right
my margin-top margin-bottom
mt margin-top
mr margin-right
mb margin-bottom
ml margin-left
inset top right bottom left
inset-x left right
inset-y top bottom
top top
right right
bottom bottom
left left
leading line-height
tracking letter-spacing
indent text-indent
rounded border-radius
""",
    "number": """
leading line-height
z z-index
opacity opacity
""",
}


def property_rules() -> list[tuple[str, str, str]]:
    """(prefix, type, property) of arbitrary values."""
    lines = [(kind, *line.split()) for kind, text in ARBITRARY_PROPERTIES.items() for line in text.strip().splitlines()]
    return [(prefix, kind, p) for kind, prefix, *properties in lines for p in properties]


@built_once
def properties_of(prefix, kind) -> Column:
    """The properties that a prefix sets for a type of value, or null: a lookup in one folded map."""
    found: dict[str, list[str]] = {}
    for name, type_, prop in property_rules():
        found.setdefault(f"{name}|{type_}", []).append(prop)
    table = F.map_from_arrays(F.split(F.lit(" ".join(found)), " "), F.split(F.lit(" ".join(",".join(v) for v in found.values())), " "))
    return F.split(F.try_element_at(table, F.concat_ws("|", col(prefix), col(kind))), ",")


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(property_rules(), "prefix string, type string, property string")


def split_classes(x) -> Column:
    return F.filter(F.split(col(x), f"{JS_SPACE}+"), lambda t: t != "")


@built_once
def strip_variants(token) -> Column:
    """What follows the last colon outside of brackets; brackets nest to any depth, a stray closing one counts for nothing."""
    token = col(token)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("colon"))

    def step(seen: Column, i: Column) -> Column:
        c = F.substr(token, i, F.lit(1))
        depth = F.when(c == "[", seen["depth"] + 1).when(c == "]", F.greatest(seen["depth"] - 1, F.lit(0))).otherwise(seen["depth"])
        return F.struct(depth.alias("depth"), F.when((c == ":") & (seen["depth"] == 0), i).otherwise(seen["colon"]).alias("colon"))

    places = F.sequence(F.lit(1), F.length(token))
    nested = F.aggregate(places, start, step, lambda seen: F.substr(token, seen["colon"] + 1))
    return F.when(token.contains("["), nested).otherwise(F.substring_index(token, ":", -1))


@built_once
def parse_token(token) -> Column:
    """struct(utility, prefix, arbitrary, is_arbitrary) of a class token."""

    def parsed(bare: Column) -> Column:
        head = F.substring_index(bare, "[", 1)
        first = part(head, "^-*([^-]+)")
        utility = F.when(first == "", F.lit(None)).otherwise(F.concat(F.when(head.startswith("-"), "-").otherwise(""), first))
        found = has(bare, r"\[[^\]]*\]")
        return F.struct(
            utility.alias("utility"),
            F.regexp_replace(head, "^-+|-+$", "").alias("prefix"),
            F.when(found, part(bare, r"\[([^\]]*)\]")).alias("arbitrary"),
            found.alias("is_arbitrary"),
        )

    return let(strip_variants(token), parsed)


@built_once
def arbitrary_type(content) -> Column:
    t = js_trim(F.replace(col(content), F.lit("_"), F.lit(" ")))
    return (
        F.when(has(t, r"(?i)^#[0-9a-f]{3,8}$|^(?:rgb|rgba|hsl|hsla)\("), "color")
        .when(has(t, f"(?i)^{NUMBER}[a-z%]+$"), "length")
        .when(has(t, f"^{NUMBER}$"), "number")
        .otherwise("keyword")
    )


@built_once
def declared_value(content) -> Column:
    """struct(type, raw) of the declaration that an arbitrary value makes; a type hint wins."""
    hint = part(content, "^(color|length|number):")
    value = F.when(hint != "", F.regexp_replace(col(content), "^(?:color|length|number):", "")).otherwise(col(content))
    return F.struct(
        F.when(hint != "", hint).otherwise(arbitrary_type(value)).alias("type"),
        F.replace(value, F.lit("_"), F.lit(" ")).alias("raw"),
    )


def looks_like_class(x) -> Column:
    return has(x, r"[-:/\[]")
