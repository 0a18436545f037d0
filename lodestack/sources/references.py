"""Indirect references: bytes that live in another medium."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import binary, digests
from lodestack.functions.status import status


def expand(requests: DataFrame, references: DataFrame, media: DataFrame, function: str = "SHA256") -> DataFrame:
    """Requested rows with the bytes that their reference leads to, and a status.

    ``references``: ``hash, medium, location, offset_bytes, length, decompressor``
    (length 0: to the end); ``media``: ``medium, location, content``. The range is
    cut, decompressed and only then held against the digest. References meet
    media before any content moves to the requests.
    """
    wanted = references.join(requests.select("hash").distinct(), "hash", "left_semi")
    met = wanted.join(media, ["medium", "location"], "left")
    cut = binary.byte_range(F.col("content"), F.col("offset_bytes"), F.col("length"))
    data = met.select("hash", binary.decompress(cut, F.col("decompressor")).alias("data"), F.col("content").isNotNull().alias("__there"))
    out = requests.join(data, "hash", "left")
    sound = digests.integrity(F.col("data"), function, F.col("hash"), F.col("size_bytes"))
    s = (
        F.when(F.col("__there").isNull(), status("NOT_FOUND", "Reference not found"))
        .when(~F.col("__there"), status("NOT_FOUND", "Object not found"))
        .when(F.col("data").isNull(), status("INTERNAL", "Failed to decompress"))
        .otherwise(sound)
    )
    out = out.withColumn("status", s).drop("__there")
    return out.withColumn("data", F.when(F.col("status").isNull(), F.col("data")))


def is_identity(references: DataFrame) -> DataFrame:
    """References into the store itself without a decompressor pass the key through."""
    same = (F.col("medium") == "cas") & (F.col("location") == F.col("hash")) & (F.col("decompressor") == "identity")
    return references.withColumn("pass_through", same)
