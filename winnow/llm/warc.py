"""WARC archives with a Zstandard dictionary.

A dictionary is trained on a bounded sample of the payloads to be archived. Each archive begins with it in a skippable
frame, and every record is a frame of its own, so records can be read one by one and an archive needs nothing beside
it. Payloads seen before become ``revisit`` records, which name the first one instead of repeating it.

Nulls: a null payload is empty; a row with a null ``page_id`` is archived without one, and is the response only where
no equal payload has an id. Rows that share the smallest ``page_id`` of equal payloads are all responses. An empty
table gives no archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import file_system, publish, shared_folder, written

# Fixed values of the format: the frame that holds the dictionary, and the start of any Zstandard frame.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
LEVEL = 6
ARCHIVE_BYTES = 64 << 20  # of records before compression
READ_BYTES = 1 << 20
RECORDS = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
           "archive string")


def train_dictionary(payloads: DataFrame, column: str, rows: int = 400, row_bytes: int = 16 << 10,
                     size: int = 64 << 10) -> bytes:
    """A dictionary from at most ``rows`` payloads, of which the first ``row_bytes`` count; chosen by hash.

    It changes how small archives get, never what is in them. Without enough material there is none (empty bytes, and
    a warning).
    """
    pieces = payloads.select(F.substring(F.col(column).cast("binary"), 1, row_bytes).alias("p")).filter(F.octet_length("p") > 0)
    different = pieces.agg(F.approx_count_distinct(F.xxhash64("p"))).head()[0]
    share = max(1, different // (4 * rows))  # so that tasks send few rows, not ``rows`` each
    picked = (pieces.filter(F.pmod(F.xxhash64("p"), F.lit(share)) == 0).distinct()
              .orderBy(F.xxhash64("p"), "p").limit(rows).collect())
    try:
        return zstandard.train_dictionary(size, [bytes(r["p"]) for r in picked]).as_bytes()
    except (zstandard.ZstdError, ValueError) as failure:
        logging.getLogger(__name__).warning("archives without a dictionary: %d sampled payloads, %s", len(picked), failure)
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed


def record_id(page_id: int | None, digest: str) -> str:
    """The id of a page's record, which a revisit can name without having seen it and a repeated task gives again. Repeated
    rows share it; rows without a page id, which nothing refers to, get random ones."""
    own = uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f"page {page_id} sha256:{digest}")
    return f"<urn:uuid:{own}>"


def record(row: dict) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n"
    revisit = row["refers_to"] is not None
    block = http.encode() if revisit else http.encode() + row["payload"]
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(row["page_id"], row["digest"]),
        "WARC-Date": DATE,
        "WARC-Target-URI": _one_line(row["url"]),
        "WARC-Payload-Digest": f"sha256:{row['digest']}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
        "Page-ID": row["page_id"],
    }
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(row["refers_to"], row["digest"]),
                 "Refers-To-Page-ID": row["refers_to"]}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _one_line(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record by lower-case name, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    return fields, rest[:size]


def frames(stream) -> Iterator[bytes]:
    """Records of an archive, one at a time, with the dictionary found in its first frame."""
    dictionary, buffer = None, stream.read(8)
    magic, size = struct.unpack("<II", buffer) if len(buffer) == 8 else (0, 0)
    if magic == DICTIONARY_FRAME:
        held, buffer = stream.read(size), b""
        if held[:4] == struct.pack("<I", ZSTD_FRAME):
            held = zstandard.ZstdDecompressor().decompress(held)
        dictionary = zstandard.ZstdCompressionDict(held)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    frame, parts = reader.decompressobj(), []
    while True:
        buffer = buffer or stream.read(READ_BYTES)
        if not buffer:
            break
        parts.append(frame.decompress(buffer))
        buffer = b""
        if frame.eof:
            yield b"".join(parts)
            buffer = frame.unused_data
            frame, parts = reader.decompressobj(), []
    if parts:
        raise ValueError("archive is cut off")


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive ``page_id, url, payload, bytes, digest, refers_to``; one row per archive: ``path, records, size``.

    An archive belongs to one task and appears whole under a name of its own. Write the result down before reading.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
        head = dictionary_frame(dictionary) if dictionary else b""
        rest = (row for batch in batches for at in range(0, batch.num_rows, 64)
                for row in batch.slice(at, 64).to_pylist())
        row = next(rest, None)
        while row is not None:
            path, totals = f"{folder}/{uuid.uuid4().hex}.warc.zst", [0, len(head)]

            def fill(stream):
                nonlocal row
                stream.write(head)
                raw = 0
                while row is not None and raw < archive_bytes:
                    data = record(row)
                    packed = compressor.compress(data)
                    stream.write(packed)
                    raw += len(data)
                    totals[0] += 1
                    totals[1] += len(packed)
                    row = next(rest, None)

            publish(path, fill)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([totals[0]], pa.int64()), pa.array([totals[1]], pa.int64())],
                ["path", "records", "size"])

    return pages.select("page_id", "url", "payload", "bytes", "digest", "refers_to").mapInArrow(
        write, "path string, records bigint, size bigint")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the archives in column ``path``. Payloads of responses are digested again and compared."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = file_system(path)
                with system.open_input_stream(inner, compression=None) as stream:
                    rows = [_entry(*parse(data), path.rsplit("/", 1)[-1]) for data in frames(stream)]
                columns = zip(*rows) if rows else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, kinds)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"])

    return archives.select("path").mapInArrow(read, RECORDS)


def _entry(fields: dict[str, str], block: bytes, archive: str) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    size = int(head.decode().rpartition("Content-Length:")[2])
    response = fields["warc-type"] == "response"
    if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload differs from its digest in {archive}")
    page = fields.get("page-id")
    refers = None if response else int(fields["refers-to-page-id"])
    if not response and fields["warc-refers-to"] != record_id(refers, digest):
        raise ValueError(f"a revisit in {archive} refers to another record than its page's")
    return None if page is None else int(page), size, digest, fields["warc-type"], refers, archive


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """Archive every page and return the archives' table: ``path, records, size``."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumns(
        {"bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})
    first = written(
        rows.filter(F.col("bytes") >= min_revisit_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    decided = rows.join(first, "digest", "left").withColumn("refers_to", F.when(again, F.col("first_id")))
    lean = decided.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    folder = shared_folder(pages.sparkSession, "warc")
    return written(write_archives(lean, folder, train_dictionary(rows, "payload")))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive the pages and read the archives back, one row per record."""
    archives = archive_pages(pages)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_archives(archives.repartition(tasks, "path"))
