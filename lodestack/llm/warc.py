"""WARC: write captures as archives, read archives, assemble transactions.

Writing is a plain Spark job: a capture's records are strings built by column
functions, and the text writer stores them as they are (record separator
CRLF), so that a part file is a valid WARC/1.1 archive. Reading parses the
archives by content length inside tasks, one archive a row, and keeps archives
small. Assembly joins response or revisit, request and metadata records through
``WARC-Concurrent-To``; record ids are unique, so the join has no hot key.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm._shared import scratch, shared_dir, written
from lodestack.session import delete

#: Payloads below this many bytes never become revisits.
LEAST_PAYLOAD = 100
#: Bytes of an archive before compression at most, but for a single larger capture; bounds a reading task's memory.
ARCHIVE_BYTES = 8 << 20
#: Captures are written by size class, each of up to so many bytes of payload, so that a number of captures bounds an archive's bytes.
CLASSES = [1 << 12, 1 << 16, 1 << 20, ARCHIVE_BYTES]
#: Bytes of a capture besides payload and three times its url, at most.
HEADERS = 2_000
#: First captures of repeated payloads up to this many are broadcast (about 200 bytes each).
BROADCAST_ROWS = 200_000
#: Beyond that, rows of the table of first captures are repeated so often, to spread a hot payload.
SALTS = 16
CRLF = "\r\n"


def by_hot_key(rows: DataFrame, table: DataFrame, key: str, table_key: str, spread: str) -> DataFrame:
    """``rows`` left joined to a table with unique ``table_key``, whose rows a hot key may
    ask for: broadcast if its counted rows are few, else repeated and dealt by ``spread``."""
    if table.count() <= BROADCAST_ROWS:  # payloads stay where they are
        return rows.join(F.broadcast(table), F.col(key) == F.col(table_key), "left").drop(table_key)
    table = table.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    return rows.join(table, (F.col(key) == F.col(table_key)) & (salt == F.col("__s")), "left").drop(table_key, "__s")


def classify(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``pages`` plus ``place``, ``payload_bytes``, ``payload_digest``, ``first_id`` and ``first_place``.

    ``place`` numbers the rows. ``first_id`` is the smallest id among captures of an
    equal payload of at least ``LEAST_PAYLOAD`` bytes, where there are several ids, and
    ``first_place`` its row; both are null where the capture stands for itself. A null
    payload is an empty one. Repeated rows of the smallest id all stand for themselves.
    The rows are written first, so that their numbers stay what they are.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256), "place": F.monotonically_increasing_id()})
    rows = written(rows, "warc-pages")
    narrow = rows.where(F.col("payload_bytes") >= LEAST_PAYLOAD).where(F.col(id_col).isNotNull())
    firsts = narrow.groupBy(F.col("payload_digest").alias("__digest")).agg(F.min(F.struct(F.col(id_col).alias("id"), "place")).alias("f"), F.max(id_col).alias("last_id"))
    firsts = written(firsts.where("f.id < last_id").select("__digest", F.col("f.id").alias("first_id"), F.col("f.place").alias("first_place")), "warc-firsts")
    out = by_hot_key(rows, firsts, "payload_digest", "__digest", "place")
    again = F.col("first_id") < F.col(id_col)
    return out.withColumns({"first_id": F.when(again, F.col("first_id")), "first_place": F.when(again, F.col("first_place"))})


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record as text, without its last CRLF, which the writer's separator gives."""
    lines: list[Column] = [F.lit("WARC/1.1" + CRLF)]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit("")))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(*lines, length, block, F.lit(CRLF))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write each row's request, response (or revisit) and metadata records.

    The three records of a row are written by one task, next to each other. Ids
    of rows need not be unique: record ids come from the row's place. Archives
    are gzip files of ``ARCHIVE_BYTES`` at most, or of one larger capture.
    """
    rows = classify(pages.select(id_col, url_col, payload_col), id_col, payload_col)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    name = lambda kind, place="place": F.concat(F.lit(f"<urn:capture:{kind}:"), F.col(place).cast("string"), F.lit(">"))
    url = F.coalesce(F.regexp_replace(url_col, r"[\x00-\x20\x7f]", "%20"), F.lit("about:blank"))
    is_revisit = F.col("first_id").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"), F.when(is_revisit, F.lit("")).otherwise(payload))
    main = name("main")
    response = _record(
        [
            ("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")), ("WARC-Record-ID", main), ("WARC-Date", date), ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), ("WARC-Refers-To", F.when(is_revisit, name("main", "first_place"))),
            ("WARC-Profile", F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("Content-Type", "application/http;msgtype=response"),
        ],
        http,
    )
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", name("request")), ("WARC-Concurrent-To", main), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http;msgtype=request")],
        F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    meta = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", name("metadata")), ("WARC-Concurrent-To", main), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/warc-fields")],
        F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col(id_col).cast("string"), F.lit(CRLF)), F.lit("")), F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(CRLF)),
    )
    size = F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes")) + 9 * F.coalesce(F.octet_length(url_col), F.lit(0))
    level = F.lit(len(CLASSES))
    for i, most in reversed(list(enumerate(CLASSES))):
        level = F.when(size <= most, F.lit(i)).otherwise(level)
    for i in [r[0] for r in rows.select(level).distinct().collect()] or [0]:  # a few classes
        most = 3 * max(1, ARCHIVE_BYTES // (CLASSES[i] + HEADERS)) if i < len(CLASSES) else 3
        records = rows.where(level == i).select(F.explode(F.array(request, response, meta)).alias("value"))
        records.write.mode("append").option("lineSep", CRLF).option("maxRecordsPerFile", most).text(path, compression="gzip")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, plain or gzip."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        head = data.find(b"\r\n\r\n", at)
        if head < 0:
            return
        headers = {}
        for line in data[at:head].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            headers[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
        end = head + 4 + int(headers.get("content-length", 0))
        yield headers, data[head + 4 : end]
        at = end


RECORD = "type string, id string, concurrent_to string, url string, digest string, refers_to string, fields map<string,string>, payload_bytes long, payload_sha256 string, payload binary"
_ARROW = pa.schema(
    [(c, pa.string()) for c in ("type", "id", "concurrent_to", "url", "digest", "refers_to")]
    + [("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("payload", pa.binary())]
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``.

    ``payload`` is the HTTP body of responses (null without ``payloads``);
    ``fields`` holds a metadata record's lines.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for h, block in parse_warc(content.as_py()):
                    kind, body, fields = h.get("warc-type"), None, None
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                    elif kind == "metadata":
                        fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").splitlines() if ":" in line]
                    rows.append((kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"), fields,
                                 None if body is None else len(body), None if body is None else hashlib.sha256(body).hexdigest(), body if payloads else None))
                    size += len(body or b"") if payloads else 0
                    if len(rows) >= 4096 or size >= 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the request and
    the metadata that name it in ``WARC-Concurrent-To``. Captures without one of
    the two keep a null there; requests and metadata of no capture are left out."""
    main = records.where("type in ('response', 'revisit')").select(F.col("id").alias("capture_id"), F.struct("type", "url", "digest", "refers_to", "payload_bytes", "payload_sha256", "payload").alias("response"))
    side = records.where("type in ('request', 'metadata')").groupBy("concurrent_to").agg(
        F.max(F.when(F.col("type") == "request", F.struct("id", "url"))).alias("request"),
        F.first(F.when(F.col("type") == "metadata", F.struct("id", "fields")), ignorenulls=True).alias("metadata"),
    )
    return main.join(side, F.col("capture_id") == F.col("concurrent_to"), "left").drop("concurrent_to")


def referred(captures: DataFrame) -> DataFrame:
    """``captures`` plus ``original``, the metadata fields of the capture whose record id
    a revisit names; null where it names none of these."""
    asked = captures.where("response.type = 'revisit'").select(F.col("response.refers_to").alias("asked")).where("asked is not null").distinct()
    found = captures.join(asked, F.col("capture_id") == F.col("asked"), "left_semi").select(F.col("capture_id").alias("__id"), F.col("metadata.fields").alias("original"))
    rows = captures.withColumn("__asked", F.when(F.col("response.type") == "revisit", F.col("response.refers_to")))
    return by_hot_key(rows, written(found, "warc-originals"), "__asked", "__id", "capture_id").drop("__asked")


def roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and
    return the captures, with the originals of revisits. Bytes and digest of a revisit
    come from its metadata and header, those of a response from the payload as read."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/lodestack/warc-{uuid.uuid4().hex}"
    with scratch(spark):
        write_warc(pages, path, id_col, url_col, payload_col)
    with scratch(spark) as result:
        captures = written(assemble(read_warc(spark, path, payloads=False)), "warc-captures")
        delete(spark, path)
        return result(referred(captures), "warc-resolved")


def capture_columns(captures: DataFrame, id_col: str = "page_id") -> DataFrame:
    r, fields = F.col("response"), F.col("metadata.fields")
    return captures.select(
        fields["page-id"].cast("long").alias(id_col),
        F.coalesce(r["payload_bytes"], fields["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.coalesce(r["payload_sha256"], F.regexp_extract(r["digest"], "sha256:([0-9a-f]+)", 1)).alias("payload_digest"),
        r["type"].alias("record_type"),
        F.when(r["type"] == "revisit", F.col("original")["page-id"].cast("long")).alias("refers_to"),
    )
