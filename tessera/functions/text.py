"""Column helpers with the white-space rules of ECMAScript."""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ECMAScript counts as white space, as a Java character class.
JS_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def js_trim(x) -> Column:
    return F.regexp_replace(col(x), f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def has(x, pattern: str) -> Column:
    return col(x).rlike(pattern)


def part(x, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(col(x), pattern, group)


def let(x: Column, body) -> Column:
    """``body`` of a value that is computed once and used many times."""
    return F.element_at(F.transform(F.array(x), body), 1)


def built_once(function):
    """Keep the columns that a builder makes of names: building a large expression takes longer than planning it.

    A column of names is not bound to a table, so it can be used again for as
    long as the process talks to the same JVM.
    """
    kept: dict = {}

    @functools.wraps(function)
    def build(*names, **more):
        if any(isinstance(x, Column) for x in (*names, *more.values())):
            return function(*names, **more)
        jvm = SparkContext._gateway
        key = (names, tuple(sorted(more.items())))
        if key not in kept or kept[key][0] is not jvm:
            kept[key] = (jvm, function(*names, **more))
        return kept[key][1]

    return build
