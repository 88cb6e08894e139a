"""Text and truthiness with the semantics of the catalog's rules.

Empty strings, 0 and null are "unset" under the falsy helpers; only null is
under coalesce. Every predicate here gives true or false, never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import WHITE


def norm(c: Column) -> Column:
    """Lower case, ё as е, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), f"{WHITE}+", " "))


def strip(c: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def falsy(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def sure(c: Column) -> Column:
    """A boolean with null as false."""
    return F.coalesce(c, F.lit(False))


def has(array: Column, value) -> Column:
    """Array membership that is false for null arrays and null elements."""
    return sure(F.exists(array, lambda x: sure(x == value)))


def truthy(array: Column) -> Column:
    """The elements that are neither null nor empty, in order."""
    return F.filter(array, lambda x: x.isNotNull() & (x != ""))


def strings(values) -> Column:
    """A literal array of strings, empty ones included."""
    values = list(values)
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def lookup(mapping: dict, key: Column) -> Column:
    """The mapping's value for a key; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def capitalise(c: Column) -> Column:
    """The first letter in upper case; the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def js_number(c: Column) -> Column:
    """A string as a number: blank and missing are 0, other text that is no number is null."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(text == "", F.lit(0.0)).otherwise(F.when(text.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"), text.try_cast("double")))


def show_number(c: Column) -> Column:
    """A double without a trailing .0."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def ru(c: Column) -> Column:
    """A sort key in Russian collation."""
    return F.collate(c, "ru")
