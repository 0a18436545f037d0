"""ZIP archives as sources and sinks: members are named by packed key.

Archives are rows of bytes, so that any Spark reader or writer can carry them
(``binaryFile`` in, a binary column of Parquet out); packing and unpacking run
inside tasks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.session import release

#: Bytes of members after which a new archive begins.
ARCHIVE_BYTES = 16 << 20
#: Bytes of members that are read before they are passed on.
READ_BYTES = 4 << 20


def _archived(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    out, zf, names, size = None, None, set(), 0

    def close() -> pa.RecordBatch:
        zf.close()
        content, ends = pa.py_buffer(out.getbuffer()), pa.array([0, len(out.getbuffer())], pa.int32())
        made = pa.Array.from_buffers(pa.binary(), 1, [None, ends.buffers()[1], content])
        return pa.RecordBatch.from_arrays([made, pa.array([len(names)], pa.int64())], ["content", "members"])

    for b in batches:
        for k, d in zip(b.column("k"), b.column("d")):
            k, d = k.as_py(), d.as_buffer()
            if k is None or d is None or k in names:
                continue
            if zf is None:
                out = io.BytesIO()
                zf = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
            zf.writestr(zipfile.ZipInfo(k), memoryview(d))
            names.add(k)
            size += d.size
            if size >= most:
                yield close()
                out, zf, names, size = None, None, set(), 0
                release()
    if zf is not None:
        yield close()
        out = zf = None
    release()


def write_zip(rows: DataFrame, key: str = "key", data: str = "data", most: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of the rows' members: stored, not compressed; one row an archive.
    Keys name contents, so a key that an archive holds already is left out, as are
    rows with null data."""

    src = rows.select(F.col(key).cast("string").alias("k"), F.col(data).cast("binary").alias("d"))
    return src.mapInArrow(lambda batches: _archived(batches, most), "content binary, members long")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = lambda k, d: pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(d, pa.binary())], ["key", "data"])
    for b in batches:
        for c in b.column(0):
            keys, data, size = [], [], 0
            try:
                with zipfile.ZipFile(pa.BufferReader(c.as_buffer() or b"")) as zf:
                    for info in zf.infolist():
                        keys.append(info.filename), data.append(zf.read(info))
                        size += info.file_size
                        if size > READ_BYTES:
                            yield make(keys, data)
                            keys, data, size = [], [], 0
            except zipfile.BadZipFile:
                keys.append(None), data.append(None)
            if keys:
                yield make(keys, data)
            release()


def read_zip(archives: DataFrame, content: str = "content") -> DataFrame:
    """``key, data`` of every member, its checksum verified; bytes that are no
    archive give one row with a null key."""

    return archives.select(content).mapInArrow(_members, "key string, data binary")


def zip_files(spark: SparkSession, path: str) -> DataFrame:
    """Members of the archives under a path."""
    return read_zip(spark.read.format("binaryFile").load(path))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path: name, size, time and bytes; subfolders included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), "modificationTime", F.col("content").alias("data"))
