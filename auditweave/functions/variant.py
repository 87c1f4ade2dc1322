"""JSON texts as VARIANT, parsed once: keys that exist, kinds, texts and elements.

A text that is no JSON has no keys. A key whose value is a JSON null exists, which text functions cannot tell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: str) -> Column:
    return F.try_parse_json(text)


def at(value: str | Column, path: str) -> Column:
    """The variant at `path` ($.a.b): null where the path is missing, a variant null where it holds a JSON null."""
    return F.try_variant_get(value, path, "variant")


def has(value: str | Column, path: str) -> Column:
    return F.coalesce(at(value, path).isNotNull(), F.lit(False))


def kind(value: str | Column, path: str = "$") -> Column:
    """object, array, null, or the scalar's type in lower case."""
    name = F.lower(F.regexp_extract(F.schema_of_variant(at(value, path)), "^[A-Za-z]+", 0))
    return F.when(name == "void", "null").otherwise(name)


def text(value: str | Column, path: str) -> Column:
    """A scalar as text; null for a JSON null, an object or an array."""
    return F.try_variant_get(value, path, "string")


def number(value: str | Column, path: str, to: str = "bigint") -> Column:
    return F.try_variant_get(value, path, to)


def elements(value: str | Column, path: str = "$", of: str = "variant") -> Column:
    """The elements of an array; null for anything else."""
    return F.when(kind(value, path) == "array", F.try_variant_get(value, path, f"array<{of}>"))


def flag(value: Column, key: str, missing: bool = True) -> Column:
    """Whether `key` of an object is true: `missing` where the key is missing, null where it is a JSON null."""
    return F.when(has(value, f"$.{key}"), F.try_variant_get(value, f"$.{key}", "boolean")).otherwise(F.lit(missing))
