"""Schemas of observations, facts, diagnostics and headers, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import types as T

#: The versions that facts and headers carry.
SCHEMA_VERSION = "0.2.0"
NORMALIZER_VERSION = "0.2.0"
#: The enumerations, sorted.
KINDS = ("css.class", "css.declaration", "import", "jsx.attribute", "jsx.element", "jsx.prop")
SOURCES = ("babel-jsx", "css-in-js", "css-module", "inline", "plain-css", "tailwind")
CERTAINTIES = ("dynamic", "literal", "static-union", "unknown")
VALUE_TYPES = ("color", "dynamic", "keyword", "length", "module", "number", "shadow", "string", "union", "url")
IMPORT_KINDS = ("default", "named", "namespace", "side-effect")

LOC = T.StructType([T.StructField(c, T.IntegerType()) for c in ("line", "col", "endLine", "endCol")])
OWNER = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("imported_from", T.StringType()), T.StructField("is_dom", T.BooleanType()), T.StructField("loc", LOC)]
)
_SUBJECT = ("name", "imported_from", "is_dom", "component", "prop", "owner", "attribute", "specifier", "local", "import_kind", "property", "selector", "media", "owner_component", "token", "utility", "is_arbitrary")
SUBJECT = T.StructType([T.StructField(c, T.BooleanType() if c.startswith("is_") else T.StringType()) for c in (*_SUBJECT, "element_id")])
#: The fields of each kind's subject, in output order.
SUBJECT_FIELDS = {
    "jsx.element": ("name", "imported_from", "is_dom"),
    "jsx.prop": ("component", "prop", "element_id"),
    "jsx.attribute": ("owner", "attribute", "element_id"),
    "import": ("specifier", "local", "import_kind"),
    "css.declaration": ("property", "selector", "media", "owner_component", "element_id"),
    "css.class": ("token", "utility", "is_arbitrary", "element_id"),
}
VALUE = T.StructType([T.StructField(c, T.StringType()) for c in ("raw", "norm", "type")])

#: What a parser gives; one row type for observations and diagnostics.
PARSED = T.StructType(
    [
        T.StructField("rec", T.StringType()),  # obs or diag
        T.StructField("file", T.StringType()),
        T.StructField("producer", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("loc", LOC),
        *[T.StructField(c, T.BooleanType() if c.startswith("is_") else T.StringType()) for c in _SUBJECT],
        T.StructField("element", OWNER),
        T.StructField("raw", T.StringType()),
        T.StructField("typed_as", T.StringType()),
        T.StructField("hint", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
SUBJECT_COLUMNS = _SUBJECT

FACT = T.StructType(
    [
        T.StructField("fact_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("schema_v", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("loc", LOC),
        T.StructField("source", T.StringType()),
        T.StructField("producer_v", T.StringType()),
        T.StructField("certainty", T.StringType()),
        T.StructField("diagnostic", T.StringType()),
        T.StructField("subject", SUBJECT),
        T.StructField("value", VALUE),
    ]
)


def column_manifest() -> list[dict]:
    """The flat columns of a fact, derived from its schema."""
    out = []
    for field in FACT.fields:
        if field.name == "subject":
            continue
        nested = field.dataType.fields if isinstance(field.dataType, T.StructType) else [field]
        for f in nested:
            name = "value_type" if field.name == "value" and f.name == "type" else f.name
            kind = "integer" if isinstance(f.dataType, T.IntegerType) else "string"
            out.append({"name": name, "type": kind, "nullable": field.name in ("value", "diagnostic")})
    return out


def json_schema() -> dict:
    """A draft 2020-12 JSON Schema with one alternative for each kind."""
    text = {"type": "string"}
    nullable = {"type": ["string", "null"]}
    nullables = {"imported_from", "selector", "media", "owner_component", "utility", "element_id"}
    required_ids = {"jsx.prop", "jsx.attribute"}
    loc = {"type": "object", "properties": {c: {"type": "integer", "minimum": 0} for c in LOC.names}, "required": list(LOC.names)}
    value = {
        "type": "object",
        "properties": {"raw": text, "norm": nullable, "type": {"enum": list(VALUE_TYPES)}},
        "required": ["raw", "norm", "type"],
    }
    made = {}
    for kind, fields in SUBJECT_FIELDS.items():
        field = lambda c, k=kind: {"type": "boolean"} if c.startswith("is_") else nullable if c in nullables and not (c == "element_id" and k in required_ids) else text
        subject = {"type": "object", "properties": {c: field(c) for c in fields}, "required": list(fields)}
        properties = {
            "fact_id": {"type": "string", "pattern": "^[0-9a-f]{64}$"},
            "kind": {"const": kind},
            "schema_v": {"const": SCHEMA_VERSION},
            "file": text,
            "loc": loc,
            "source": {"enum": list(SOURCES)},
            "producer_v": text,
            "certainty": {"enum": list(CERTAINTIES)},
            "diagnostic": text,
            "subject": subject,
        }
        required = [c for c in properties if c != "diagnostic"]
        if kind != "jsx.element":
            properties["value"] = value
            required.append("value")
        made[kind] = {"type": "object", "properties": properties, "required": required}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "anyOf": [{"$ref": f"#/$defs/{k}"} for k in made],
        "$defs": made,
    }
