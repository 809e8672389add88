"""WARC archives of pages, deduplicated by payload.

Only headers (page, digest, size) are shuffled by payload digest to find each payload's original; the answers, for
revisits alone, are brought to the pages (broadcast up to BROADCAST_HEADS of them), which are then written as
``response`` or ``revisit`` records with fresh headers.  Spark's text sink writes the archives: a record is valid UTF-8
and its terminator is the sink's line separator, so files are committed task by task, to any file system that Spark
reaches, and a lost executor leaves nothing half written.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.session import checkpointed, semi_by_size, shared_folder, tidy

#: Payloads of fewer bytes are always written in full.
LEAST_BYTES = 100
#: Records, and bytes of payloads, in a file at most, which bounds what a reader holds of one archive.
FILE_RECORDS = 5_000
FILE_BYTES = 256 << 20
#: Headers of revisits (about 100 bytes each) that may be broadcast.
BROADCAST_HEADS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def _keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))


def headers(pages: DataFrame) -> DataFrame:
    """``page_id, payload_digest, payload_bytes`` of every page, kept in the shared folder."""
    return checkpointed(_keyed(pages).select("page_id", "payload_digest", "payload_bytes"))


def resolved(pages: DataFrame, least: int = LEAST_BYTES, heads: DataFrame | None = None) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, copy, record_type, refers_to`` for every page.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id is ``response``, the
    others are ``revisit`` and refer to it; smaller payloads are all ``response``.

    - A null html is an empty payload.  A null url is written as ``urn:page:<page_id>``.
    - Rows with a null page_id are ``response``, and nothing refers to them.
    - Rows that repeat a page_id with the same payload: one of them (the first by url) is the response if that page
      is the original, the rest revisit it.  ``copy`` numbers them from 1.
    - An empty table gives no rows; other columns are ignored.
    """
    keyed, key = _keyed(pages), ["page_id", "payload_digest"]
    heads = headers(pages) if heads is None else heads
    named = heads.where(F.col("page_id").isNotNull())
    large = named.where(F.col("payload_bytes") >= least).select(*key)
    originals = large.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Pages that revisit another, and pages that stand in several rows: nothing else has to be told.
    others = large.distinct().join(originals, "payload_digest").where("page_id <> original")
    again = named.groupBy(*key).count().where("count > 1").select(*key, F.lit(True).alias("again"))
    told = checkpointed(others.join(again, key, "full").select(*key, "original", F.coalesce("again", F.lit(False)).alias("again")))
    full = semi_by_size(keyed, told, key, "left", BROADCAST_HEADS)
    as_record = lambda revisits, copy: [
        *["page_id", "url", "html", "payload_bytes", "payload_digest"],
        copy.alias("copy"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.coalesce("original", "page_id")).alias("refers_to"),
    ]
    repeated = F.coalesce("again", F.lit(False)) | F.col("page_id").isNull()
    once = full.where(~repeated).select(*as_record(F.col("original").isNotNull(), F.lit(1)))
    if not told.where("again").limit(1).count() and not heads.where(F.col("page_id").isNull()).limit(1).count():
        return once
    # Only rows that repeat a page and its payload, or have no page_id, are numbered, and these are dealt by both.
    copy = F.row_number().over(Window.partitionBy(*key).orderBy("url"))
    many = full.where(repeated).withColumn("copy", copy)
    is_copy = F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least) & (F.col("copy") > 1)
    return once.union(many.select(*as_record(F.col("original").isNotNull() | is_copy, F.col("copy"))))


def _record_id(page, copy):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), copy.cast("string"), F.lit(">"))


def records(pages: DataFrame, date: str) -> DataFrame:
    """``record``: each page of ``resolved`` as the text of a WARC record, without the last two line ends."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    url = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), page)), r"[\x00-\x20\x7F]+", "%20")
    is_response = F.col("record_type") == "response"
    # Rows with a null page_id may share a number: the digest tells them apart.
    own_id = F.when(F.col("page_id").isNull(), F.concat(F.lit("<urn:page:none:"), F.col("payload_digest"), F.lit(":"), F.col("copy").cast("string"), F.lit(">"))).otherwise(_record_id(F.col("page_id"), F.col("copy")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), own_id),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(~is_response, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.lit(1)))),
        F.when(~is_response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(is_response, F.col("payload_bytes")).otherwise(0).cast("string")),
    ]
    head = F.concat_ws(_END, *lines)  # leaves out nulls
    return pages.select(F.concat(head, F.lit(_END + _END), F.when(is_response, F.col("html")).otherwise("")).alias("record"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_BYTES) -> None:
    """Writes the pages as gzipped WARC files in the folder ``path``, which every executor must reach.

    A file has at most FILE_RECORDS records, and fewer where as many of the largest payload would pass FILE_BYTES.
    """
    heads = headers(pages)
    out = records(resolved(pages, least, heads), date)
    largest = heads.agg(F.max("payload_bytes")).first()[0] or 1
    most = max(1, min(FILE_RECORDS, FILE_BYTES // max(1, largest)))
    out.write.mode("errorifexists").option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of a gzipped archive, read by Content-Length."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)))
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} is cut off")
        yield head, block


def _page_of(record_id: str) -> int | None:
    page = record_id.strip("<>").split(":")[2]
    return None if page == "none" else int(page)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("block", pa.binary())])
    for batch in batches:
        for archive in batch.column(0):
            rows: list[list] = []
            size = 0
            for head, block in parsed(archive.as_py()):
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"record {head['warc-record-id']}: its payload differs from its digest")
                rows.append([head["warc-record-id"], _page_of(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], digest, head.get("warc-refers-to"), block])
                size += len(block)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in ``path``: ``record_id, page_id, url, record_type, digest, refers, block``.

    A response whose payload does not match its digest, or a record that is cut off, is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(tidy(_read), "record_id string, page_id long, url string, record_type string, digest string, refers string, block binary")


def with_originals(archived: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to``: revisits joined to their responses."""
    slim = archived.select("record_id", "page_id", "url", "record_type", F.col("digest").alias("payload_digest"), "refers", F.length("block").cast("long").alias("own_bytes"))
    responses = slim.where("record_type = 'response' and page_id is not null").select(F.col("record_id").alias("refers"), F.col("page_id").alias("of_page"), F.col("own_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest"))
    joined = slim.join(responses, "refers", "left")
    revisit = F.col("record_type") == "revisit"
    checked = F.when(F.col("of_digest") == F.col("payload_digest"), F.col("of_page")).otherwise(F.raise_error(F.concat(F.lit("no response with this payload for "), F.col("record_id"))).cast("long"))
    return joined.select("page_id", "url", F.when(revisit, F.col("of_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"), "payload_digest", "record_type", F.when(revisit, checked).alias("refers_to"))


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
