"""WARC archives (operator 12): seekable Zstandard bundles.

An archive is one file: Zstandard frames that each hold whole WARC records and can be read alone, an index in a skippable
frame, and at the end the seek table in a skippable frame (compressed and plain size of each frame), as the published
seekable format lays it out.  Any Zstandard reader reads the whole file as one WARC stream; ``fetch`` reads a record by
its frame and the offset within that frame, and unpacks no other frame.

1. *Duplicates*: payloads are grouped by SHA-256 and length with the smallest page_id of each (combined before the
   shuffle).  Only digests that occur more than once meet their pages in a join; payloads are not shuffled where Spark can
   broadcast that table, and where it cannot, AQE splits the pages of a hot digest, because the other side is a written
   table.  The page with the smallest id becomes a ``response``, every other one a ``revisit`` without payload, which
   names the response, the digest and the size of the full payload.
2. *Writing*: a task deals its records into frames of about ``FRAME_BYTES`` and archives of about ``ARCHIVE_BYTES``
   (plain), so memory is bounded whatever the table's size; a longer record is a frame of its own.  Files are written
   by Spark's text writer, one row a file, whose line separator is the last four bytes of the format (its magic number):
   any storage that Spark can write will do, and a task that runs again leaves no second copy.
3. *Reading*: ``read_records`` unpacks archives frame by frame, and ``write_index`` keeps the record identifiers with
   archive, frame, byte range of the frame in the file and offset and length in the frame.

Results for odd input: a null html is an empty payload; empty payloads are duplicates of each other (with ``least_bytes``
0); a null page_id counts as the largest and comes back as null; rows with the same page_id and payload are all response,
or all revisit the same page; page_id and payload decide alone, whatever the url; a null url has no target in the record
and comes back as null, control characters and blanks in a url are percent-encoded; an empty table writes no archive and
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.common import NULL_KEY, doc_key, materialize, read_table, released_shuffles, shared_dir

#: Plain bytes; readers hold one archive's packed bytes and one plain frame at a time.
FRAME_BYTES, ARCHIVE_BYTES = 256 << 10, 16 << 20
#: WARC-Date of all records, unless another is given: the tables have no fetch time.
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the Zstandard frame format and its seekable variant.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
URN = "urn:page:"
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
          "payload binary")
PLACE = "archive string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long"


# ---------------------------------------------------------------- records

def _urn(key: int | None) -> str:
    return f"<{URN}{'null' if key is None else key}>"


def _of_urn(text: str | None) -> int | None:
    name = text[len(URN) + 1:-1] if text else "null"
    return None if name == "null" else int(name)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False,
           date: str = DATE) -> bytes:
    """One WARC 1.1 record: the HTTP response with ``payload``, or a revisit of another page's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "WARC/1.1\r\n".encode() + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """The record (columns of ``RECORD``) that starts at ``at``, and where the next one starts; checks the digest."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start, size = end + 4, int(head["Content-Length"])
    close = start + size
    if data[close: close + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut")
    revisit = head["WARC-Type"] == "revisit"
    payload = None if revisit else data[data.index(b"\r\n\r\n", start, close) + 4: close]
    sha1 = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and (digest(payload) != sha1 or len(payload) != int(head["X-Payload-Length"])):
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    return (_of_urn(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"],
            _of_urn(head.get("WARC-Refers-To")), sha1, int(head["X-Payload-Length"]), payload), close + 4


# ---------------------------------------------------------------- archives

def bundle(frames: list[list[tuple[int | None, bytes]]], level: int = 3) -> bytes:
    """An archive of frames of (page_id, record): the frames, the index and the seek table."""
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    packed = [packer.compress(b"".join(r for _, r in frame)) for frame in frames]
    entries = bytearray()
    for number, frame in enumerate(frames):
        at = 0
        for key, r in frame:
            entries += struct.pack("<?qIQQ", key is not None, key or 0, number, at, len(r))
            at += len(r)
    index = packer.compress(bytes(entries))
    packed.append(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
    sizes = [(len(p), sum(len(r) for _, r in f)) for p, f in zip(packed, frames)] + [(len(packed[-1]), 0)]
    table = b"".join(struct.pack("<II", *s) for s in sizes)
    return b"".join(packed) + struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + struct.pack("<IBI", len(sizes), 0, SEEK_MAGIC)


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(offset in the file, packed size, plain size) of every frame, from the end of the archive."""
    count, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEK_MAGIC or flags:
        raise ValueError("no seek table at the end of the archive")
    table, at = [], 0
    for packed, plain in struct.iter_unpack("<II", archive[-9 - 8 * count: -9]):
        table.append((at, packed, plain))
        at += packed
    if at + 8 + 8 * count + 9 != len(archive):
        raise ValueError("the seek table does not fit the archive")
    return table


def archive_index(archive: bytes) -> list[tuple[int | None, int, int, int]]:
    """(page_id, frame, offset in the frame, length) of every record, from the archive's index frame."""
    at, size, _ = seek_table(archive)[-1]
    entries = zstandard.ZstdDecompressor().decompress(archive[at + 8: at + size])
    return [(key if known else None, frame, offset, length)
            for known, key, frame, offset, length in struct.iter_unpack("<?qIQQ", entries)]


def read_frame(archive: bytes, place: tuple[int, int, int]) -> bytes:
    at, packed, plain = place
    return zstandard.ZstdDecompressor().decompress(archive[at: at + packed], max_output_size=plain)


def _pack(frame_bytes: int, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames: list[list[tuple]] = []
        in_frame = in_archive = 0

        def close():
            # the writer's line separator is the magic number that ends the archive
            return pa.RecordBatch.from_arrays([pa.array([bundle(frames)[:-4]], pa.binary())], ["value"])

        for batch in batches:
            keys, urls, html, first = (batch.column(c) for c in ("key", "url", "html", "first"))
            for i in range(len(batch)):
                key, refers = keys[i].as_py(), first[i].as_py()
                payload = html[i].as_py()
                named = None if key == NULL_KEY else key
                r = record(named, urls[i].as_py(), payload, None if refers == NULL_KEY else refers, refers is not None, date)
                if frames and in_archive + len(r) > archive_bytes:
                    yield close()
                    frames, in_frame, in_archive = [], 0, 0
                if not frames or in_frame + len(r) > frame_bytes:
                    frames.append([])
                    in_frame = 0
                frames[-1].append((named, r))
                in_frame += len(r)
                in_archive += len(r)
        if frames:
            yield close()

    return run


def with_response(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(key, url, html, first): payloads as bytes, first = key of the page that this one revisits (null: a response)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(doc_key("page_id").alias("key"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("html", 256)), "size": F.length("html")})
    seen = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    shared = materialize(seen.where("first < last").select("digest", "size", "first"), "shared")
    first = F.when(F.col("key") > F.col("first"), F.col("first"))
    return rows.join(shared, ["digest", "size"], "left").select("key", "url", "html", first.alias("first"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    """A WARC record for each row of ``pages`` (page_id, url, html) in archives below the new ``folder``."""
    packed = with_response(pages, least_bytes).mapInArrow(_pack(frame_bytes, archive_bytes, date), "value binary")
    with released_shuffles(pages.sparkSession):
        (packed.select(F.col("value").cast("string").alias("value")).write
         .option("lineSep", struct.pack("<I", SEEK_MAGIC).decode("latin-1")).option("encoding", "ISO-8859-1")
         .option("compression", "none").option("maxRecordsPerFile", 1).text(folder))


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return found.where("length > 0").select(F.col("path").alias("archive"), "content")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)],
                                      [n for n, _ in fields])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            path, data = batch.column("archive")[i].as_py(), batch.column("content")[i].as_py()
            for number, place in enumerate(seek_table(data)[:-1]):
                plain, at, rows = read_frame(data, place), 0, []
                while at < len(plain):
                    found, following = parse(plain, at)
                    rows.append((*found, path, number, place[0], place[1], at, following - at))
                    at = following
                yield _batch(rows, f"{RECORD}, {PLACE}")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record below ``folder`` with its place (columns of ``RECORD`` and ``PLACE``); revisits have no payload."""
    return _archives(spark, folder).mapInArrow(_unpack, f"{RECORD}, {PLACE}")


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            path, data = batch.column("archive")[i].as_py(), batch.column("content")[i].as_py()
            table = seek_table(data)
            yield _batch([(key, path, frame, *table[frame][:2], offset, length)
                          for key, frame, offset, length in archive_index(data)], f"page_id long, {PLACE}")


def write_index(spark: SparkSession, folder: str, path: str) -> None:
    """Record identifiers with their places, sorted by page_id within files so that a lookup skips most of them."""
    index = _archives(spark, folder).mapInArrow(_list, f"page_id long, {PLACE}")
    index.repartitionByRange("page_id").sortWithinPartitions("page_id").write.parquet(path)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            path, data = batch.column("archive")[i].as_py(), batch.column("content")[i].as_py()
            at, size = batch.column("frame_offset")[i].as_py(), batch.column("frame_bytes")[i].as_py()
            plain = read_frame(data, next(p for p in seek_table(data) if p[0] == at and p[1] == size))
            yield _batch([parse(plain, p["record_offset"])[0] for p in batch.column("places")[i].as_py()], RECORD)


def fetch(spark: SparkSession, folder: str, index_path: str, wanted: DataFrame) -> DataFrame:
    """The records of the page_ids in ``wanted``: each of their frames is unpacked once, no other frame is.

    Frames of a few ids are a small table, which Spark broadcasts to the scan of the archives.
    """
    index = spark.read.parquet(index_path).join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    frames = index.groupBy("archive", "frame_offset", "frame_bytes").agg(F.collect_list(F.struct("record_offset")).alias("places"))
    return _archives(spark, folder).join(frames, "archive").mapInArrow(_fetch, RECORD)


def warc_query(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# DuckDB has no base32: the 160 bits of the digest, five at a time
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
b AS (SELECT *, [('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT FOR i IN range(8)] AS words FROM s)
SELECT page_id, payload_bytes,
       list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((w >> k) & 31)::INTEGER, 1) FOR k IN [15, 10, 5, 0]] FOR w IN words]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
