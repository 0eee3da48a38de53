"""Value-type and certainty classifiers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import NUMBER, normalize_property
from .text import JS_SPACE, built_once, col, has, js_trim, let

#: The properties that take a colour, in stylesheets and elsewhere.
SHEET_COLORS = """color background background-color border-color border-top-color border-right-color border-bottom-color
border-left-color outline-color caret-color text-decoration-color column-rule-color fill stroke""".split()
INLINE_COLORS = "color background background-color border-color outline-color caret-color fill stroke".split()
#: The properties that take a shadow.
SHADOWS = "box-shadow text-shadow -webkit-box-shadow".split()
#: The style properties whose numbers have no unit.
UNITLESS = """animationIterationCount aspectRatio borderImageOutset borderImageSlice borderImageWidth boxFlex boxFlexGroup
boxOrdinalGroup columnCount columns flex flexGrow flexPositive flexShrink flexNegative flexOrder gridArea gridRow gridRowEnd
gridRowSpan gridRowStart gridColumn gridColumnEnd gridColumnSpan gridColumnStart fontWeight lineClamp lineHeight opacity order
orphans scale tabSize widows zIndex zoom fillOpacity floodOpacity stopOpacity strokeDasharray strokeDashoffset
strokeMiterlimit strokeOpacity strokeWidth""".split()


@built_once
def value_type(prop, raw, place: str = "sheet") -> Column:
    """The type of a declaration's value; place: sheet, inline or css-in-js."""
    name = normalize_property(prop) if place == "inline" else F.lower(js_trim(prop))
    colors = SHEET_COLORS if place == "sheet" else INLINE_COLORS
    shadow = name.isin(SHADOWS) if place != "inline" else F.lit(False)

    def kind(t: Column) -> Column:
        single = (t != "") & ~has(t, JS_SPACE)
        return (
            F.when(has(t, r"(?i)^url\("), "url")
            .when(has(t, r"(?i)^#[0-9a-f]{3,8}$|^(?:rgb|rgba|hsl|hsla|hwb|lab|lch|oklab|oklch|color)\("), "color")
            .when(shadow, "shadow")
            .when(single & has(t, f"(?i)^{NUMBER}[a-z%]+$"), "length")
            .when(single & has(t, f"^{NUMBER}$"), "number")
            .when(single & name.isin(colors) & has(t, "(?i)^[a-z][a-z-]*$"), "color")
            .otherwise("keyword")
        )

    return let(js_trim(raw), kind)


@built_once
def is_unitless(prop) -> Column:
    return F.lower(F.replace(col(prop), F.lit("-"), F.lit(""))).isin([p.lower() for p in UNITLESS])


@built_once
def certainty(kind, dynamic=None, hint=None) -> Column:
    """literal, static-union, dynamic or unknown; null kind: no value."""
    kind = col(kind)
    flag = F.coalesce(col(dynamic), F.lit(False)) if dynamic is not None else F.lit(False)
    given = col(hint) if hint is not None else F.lit(None).cast("string")
    return (
        F.when(flag | (kind == "dynamic"), "dynamic")
        .when(kind.isNull(), "literal")
        .when(kind == "union", "static-union")
        .otherwise(F.coalesce(given, F.lit("literal")))
    )
