"""Canonical JSON and content-addressed ids as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import built_once, col, let

#: The identity fields of each kind's subject, in canonical order.
SUBJECT_KEYS = {
    "css.class": ("element_id", "is_arbitrary", "token", "utility"),
    "css.declaration": ("element_id", "media", "owner_component", "property", "selector"),
    "import": ("import_kind", "local", "specifier"),
    "jsx.attribute": ("attribute", "element_id", "owner"),
    "jsx.element": ("imported_from", "is_dom", "name"),
    "jsx.prop": ("component", "element_id", "prop"),
}
#: The JSON writer spells control characters with capital hex digits; JSON text here has small ones.
_CONTROLS = [0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)]


def canonical_json(value) -> Column:
    """JSON without blanks, nulls kept; the struct's fields must be in key order."""
    return small_escapes(written_json(value))


def written_json(value) -> Column:
    """JSON as the writer spells it; ``small_escapes`` makes it canonical."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def small_escapes(text: Column) -> Column:
    """Written JSON with small hex digits; the patterns, far slower than the writer, run only on texts with such an escape."""

    def small(t: Column) -> Column:
        for c in _CONTROLS:
            t = F.regexp_replace(t, rf"(?<!\\)((?:\\\\)*)\\u{c:04X}", rf"$1\\u{c:04x}")
        return t

    return let(text, lambda t: F.when(t.contains("\\u00"), small(t)).otherwise(t))


def sha256_hex(x) -> Column:
    return F.sha2(col(x), 256)


def identity(kind: str, file, loc, subject, norm) -> Column:
    """The struct that a fact's id is the hash of, in canonical key order."""
    loc, subject = col(loc), col(subject)
    return F.struct(
        col(file).alias("file"),
        F.lit(kind).alias("kind"),
        F.struct(*[loc[k].alias(k) for k in ("col", "endCol", "endLine", "line")]).alias("loc"),
        col(norm).alias("norm"),
        F.struct(*[subject[k].alias(k) for k in SUBJECT_KEYS[kind]]).alias("subject"),
    )


@built_once
def fact_id(kind, file, loc, subject, norm) -> Column:
    """The id of a fact of any kind."""
    text = F.lit(None).cast("string")
    for name in SUBJECT_KEYS:
        text = F.when(col(kind) == name, written_json(identity(name, file, loc, subject, norm))).otherwise(text)
    return sha256_hex(small_escapes(text))


@built_once
def element_fact_id(file, loc, owner) -> Column:
    """The id of the element fact that owns a row; null without an owner."""
    made = sha256_hex(canonical_json(identity("jsx.element", file, loc, owner, F.lit(None).cast("string"))))
    return F.when(col(owner).isNotNull(), made)
