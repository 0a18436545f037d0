"""UNIX paths, normalised without a file system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column) -> Column:
    """Lexical form: repeated slashes and ``.`` vanish, ``..`` stays except at an
    absolute root (a component may be a link, so it is never cancelled). What
    must be a directory keeps a trailing slash, never after ``..``. NUL bytes and
    null give null."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    absolute = path.startswith("/")
    lead = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & (x == ".."), 1).otherwise(0)).alias("n"), (a["on"] & (x == "..")).alias("on")), lambda a: a["n"])
    kept = F.when(absolute, F.slice(parts, lead + 1, F.size(parts) + 1)).otherwise(parts)
    body = F.array_join(kept, "/")
    folder = path.rlike(r"(^|/)\.?$") & (F.size(kept) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), kept), -1) != "..")
    text = F.concat(F.when(absolute, "/").otherwise(""), body, F.when(folder, "/").otherwise(""))
    return F.when(path.contains("\0"), F.lit(None)).when(text == "", F.lit(".")).otherwise(text)


def is_component(name: Column) -> Column:
    """A file name: not empty, ``.`` or ``..``, without slash or NUL."""
    return name.isNotNull() & ~name.isin("", ".", "..") & ~name.contains("/") & ~name.contains("\0")
