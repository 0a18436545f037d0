"""Dynamic JSON documents: the expression shapes that policies use, as columns.

An expression is built from Python calls instead of a query text: ``field``,
``where``, ``select``, ``join`` and ``equals`` compile to JSON paths and
higher-order functions. A document that lacks a field yields null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(doc: Column, path: str) -> Column:
    """The scalar at a dotted path as text; null when absent or not a scalar's parent."""
    return F.get_json_object(doc, "$." + path)


def items(doc: Column, path: str, schema: str) -> Column:
    """The list at a path, as an array of ``schema``."""
    return F.from_json(F.get_json_object(doc, "$." + path if path else "$"), f"array<{schema}>")


def where(array: Column, test: Callable[[Column], Column], then: Callable[[Column], Column] = lambda x: x) -> Column:
    """Filter projection: ``then`` of the elements that pass ``test``; nulls drop out."""
    hits = F.filter(array, lambda x: F.coalesce(test(x), F.lit(False)))
    return F.filter(F.transform(hits, then), lambda x: x.isNotNull())


def select(**fields: Column) -> Column:
    """Multi-select: a JSON object of the given columns, nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def join(glue: str, *parts: Column) -> Column:
    """Text of all parts; null if one is null."""
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(glue), p)
    return out


def contains(array: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def allowed(expression: Column) -> Column:
    """A policy allows only what is exactly true; null and errors deny."""
    return expression.eqNullSafe(F.lit(True))


def headers(doc: Column) -> Column:
    """A JSON object of string lists as a map; null for other shapes."""
    return F.from_json(doc, "map<string,array<string>>", {"mode": "PERMISSIVE"})
