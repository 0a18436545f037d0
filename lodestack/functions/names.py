"""Instance names: slash-separated tenants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Components that resource paths reserve.
RESERVED = ("blobs", "uploads", "actions", "actionResults", "operations", "capabilities", "compressed-blobs")


def components(name: Column) -> Column:
    """The parts of a name; none for the root ``''``."""
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.split(name, "/"))


def is_valid(name: Column) -> Column:
    redundant = name.startswith("/") | name.endswith("/") | name.contains("//")
    return name.isNotNull() & ~redundant & ~F.arrays_overlap(F.split(name, "/"), F.array(*map(F.lit, RESERVED)))


def is_valid_or_root(name: Column) -> Column:
    return (name == "") | is_valid(name)


def ancestors(name: Column) -> Column:
    """All prefixes by component, from the root ``''`` to the name itself."""
    parts = components(name)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def depth(name: Column) -> Column:
    return F.size(components(name))


def has_prefix(name: Column, prefix: Column) -> Column:
    return (prefix == "") | (name == prefix) | name.startswith(F.concat(prefix, F.lit("/")))


def patch(name: Column, old: Column, new: Column) -> Column:
    """``name`` with its leading components ``old`` replaced by ``new``; null if it does not start with ``old``."""
    rest = F.when(old == "", name).otherwise(F.substr(name, F.length(old) + 2))
    return F.when(has_prefix(name, old), F.concat_ws("/", F.nullif(new, F.lit("")), F.nullif(rest, F.lit(""))))
