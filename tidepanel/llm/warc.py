"""WARC archives in Zstandard frames that share a dictionary.

An archive file starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; every record is a frame of its own, so a record can be read alone.
Between frames stands an empty skippable frame, which decoders pass over.  Spark's
text source writes and reads the files with that empty frame as line separator:
writing goes through Spark's own commit protocol to any file system Spark knows,
reading is split by byte range and needs memory for one record at a time.

The dictionary is built from all records: each task trains a segment on every
``BLOCK`` bytes that pass, and segments are merged in groups until the last few
are trained into one dictionary on the driver (at most ``MERGE`` segments).

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the
least page_id is a response and the others revisit it.

Results: a null payload is an empty one; a null url is written as ``urn:page:<id>``;
a null page_id comes after all others; rows of equal page_id and payload are all
responses if theirs is the least id, else all revisits; payloads are written
whole; an empty table gives an archive without files, read back as no rows; other
columns are ignored.  Where there is too little to train on, archives have no
dictionary frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, shared_dir, table

DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
#: An empty skippable frame; it is plain ASCII and cannot overlap itself.
BETWEEN = "P*M\x18\x00\x00\x00\x00"
BLOCK, SEGMENT, MERGE, DICTIONARY = 4 << 20, 16 << 10, 64, 64 << 10
LEVEL = 3


def _trained(samples: list[bytes], size: int) -> bytes | None:
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8, f=20, accel=10).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on
        return None


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples, size = [], 0

    def segment() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_trained(samples, SEGMENT) or b"".join(samples)[-SEGMENT:]], pa.binary())], ["segment"])

    for batch in batches:
        for value in batch.column(0):
            payload = value.as_buffer()
            for at in range(0, len(payload) if payload else 0, BLOCK):
                samples.append(payload[at : at + BLOCK].to_pybytes())
                size += len(samples[-1])
                if size >= BLOCK:
                    yield segment()
                    samples, size = [], 0
    if samples:
        yield segment()


def dictionary(payloads: DataFrame) -> bytes | None:
    """A dictionary from every row of the only, binary column; None if there is too little."""
    segments = kept(payloads.mapInArrow(_segments, "segment binary"), "segments")

    def merge(key, part):
        import pandas as pd

        pieces = [s[i : i + 2048] for s in sorted(part["segment"]) for i in range(0, len(s), 2048)]
        return pd.DataFrame({"segment": [_trained(pieces, SEGMENT) or b"".join(pieces)[-SEGMENT:]]})

    while (n := segments.count()) > MERGE:
        # Segments go to groups by their content: as many groups as make MERGE each on average.
        segments = kept(segments.groupBy(F.pmod(F.xxhash64("segment"), F.lit(-(-n // MERGE)))).applyInPandas(merge, "segment binary"), "segments")
    last = sorted(bytes(r[0]) for r in segments.collect())
    return _trained([s[i : i + 2048] for s in last for i in range(0, len(s), 2048)], DICTIONARY) if last else None


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, refers_url, date: str) -> bytes:
    """The bytes of one WARC record; a revisit if refers_to is given."""

    def uri(page, address):
        return quote(address, safe="!#$%&'()*+,/:;=?@[]~") if address else f"urn:page:{page}"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri(page_id, url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{_digest(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {uri(refers_to, refers_url)}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _frame(data: bytes, shared: zstandard.ZstdCompressionDict | None) -> bytes:
    for level in (LEVEL, *range(1, 20)):
        compressor = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)
        if BETWEEN.encode() not in (frame := compressor.compress(data)):
            return frame
    raise ValueError("no level gives a frame without the separator")


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of pages(page_id, url, html) into archives at path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # Only digests that occur twice are joined: page_id, url and digest are shuffled, after partial sums, and no payload.
    twice = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    twice = kept(twice.select("sha", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "payloads")
    rows = rows.join(twice, "sha", "left").select("page_id", "url", "payload", F.expr("CASE WHEN NOT (page_id <=> refers_to) THEN refers_to END AS refers_to"), "refers_url")
    found = dictionary(rows.select("payload"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(found) if found else None
        fast = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True)
        if shared:
            shared.precompute_compress(level=LEVEL)
        first = True
        for batch in batches:
            out = [DICTIONARY_MAGIC + struct.pack("<I", len(found)) + found] if first and found and batch.num_rows else []
            first = first and not batch.num_rows
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(*r, date)
                frame = fast.compress(data)
                out.append(frame if BETWEEN.encode() not in frame else _frame(data, shared))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", BETWEEN).text(path)


_HEADER = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)
READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, date string"


def parsed(data: bytes, payload: bool) -> tuple:
    """The fields of one record; a response's digest is checked."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(head)}
    block = block[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(dict((k.lower(), v) for k, v in _HEADER.findall(http))[b"content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(body) != length or _digest(body) != digest):
        raise ValueError(f"{fields['warc-record-id']}: payload and digest differ")
    page = lambda x: None if x in (None, "null", "None") else int(x)
    own, other = (fields.get(k, "<urn:page:null>")[10:-1] for k in ("warc-record-id", "warc-refers-to"))
    url = fields["warc-target-uri"]
    row = (page(own), None if url == f"urn:page:{own}" else url, fields["warc-type"], digest, length, page(other), fields["warc-date"])
    return (*row, body) if payload else row


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record of the archives at path; with its body if payload."""
    frames = spark.read.option("lineSep", BETWEEN).schema("value string").text(path).select(F.col("value").cast("binary").alias("frame"))
    is_dictionary = F.substring("frame", 1, 4) == F.lit(DICTIONARY_MAGIC)
    # One for each write() that went into path.
    shared = {zstandard.ZstdCompressionDict(d).dict_id(): d for d in (bytes(r[0])[8:] for r in frames.where(is_dictionary).distinct().limit(65).collect())}
    if len(shared) > 64:
        raise ValueError("over 64 dictionaries under one path: read its parts by themselves")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("date", pa.string()), *([("payload", pa.binary())] if payload else [])])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {k: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)) for k, d in shared.items()} | {0: zstandard.ZstdDecompressor()}
        for batch in batches:
            rows = [parsed(by[zstandard.get_frame_parameters(f).dict_id].decompress(f), payload) for f in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema.names)

    return frames.where(~is_dictionary).mapInArrow(records, READ + (", payload binary" if payload else ""))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to
    FROM f"""
