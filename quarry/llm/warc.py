"""WARC archives in Zstandard: one frame per record behind a skippable frame that holds the dictionary; a validating reader.

Archives are rows (path, content), the shape that Spark's binaryFile source gives for files, so the reader takes either.
Null payloads count as empty; very long ones are one record, and an archive of its own. Of rows with equal payloads those of the smallest id are
responses, all others revisit it; repeated rows of that id are all responses. Rows with a null id are kept and never revisit. Null urls are empty. Columns
other than id, url and payload are ignored. An empty table gives no archive. The reader rejects records whose version, headers, lengths or digests
don't hold, and revisits for which the archives hold no response of the page they refer to with their digest and length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, payload, small_or_shuffled

#: Fixed values of the format: magic numbers of the dictionary's skippable frame and of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES, DICTIONARY_SAMPLES = 16 << 10, 200
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, stored_bytes long"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def build_record(page_id: int | None, url: str, data: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has no block, but the full payload's digest and length."""
    block = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(data) + data
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_uri(page_id)}", f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(data)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(data)}", f"Content-Length: {len(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_uri(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; raises WarcError unless version, lengths and digests hold."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[A-Za-z0-9\-]+", name):
            raise WarcError(f"bad header {line!r}")
        headers[name.lower()] = value.strip()
    if not {"warc-type", "warc-record-id", "warc-date", "content-length"} <= headers.keys() or not headers["content-length"].isdigit():
        raise WarcError("a header that every record has is missing")
    n = int(headers["content-length"])
    block = rest[:n]
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not fit the record")
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise WarcError("block digest does not fit")
    data = None
    if headers["warc-type"] == "response":
        http, found, data = block.partition(b"\r\n\r\n")
        if not found or not http.startswith(b"HTTP/"):
            raise WarcError("no HTTP head")
        if (m := re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)) and int(m[1]) != len(data):
            raise WarcError("HTTP Content-Length does not fit")
        if headers.get("warc-payload-digest", f"sha1:{digest(data)}") != f"sha1:{digest(data)}":
            raise WarcError("payload digest does not fit")
    return {"headers": headers, "payload": data}


def pack(records: list[bytes]) -> bytes:
    """One archive: a dictionary trained on the first records where they suffice for one, then a frame for each record."""
    dictionary = None
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, records[:DICTIONARY_SAMPLES])
    except zstandard.ZstdError:
        pass
    data = dictionary.as_bytes() if dictionary else b""
    head = struct.pack("<II", SKIPPABLE, len(data)) + data if dictionary else b""
    maker = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=3, write_checksum=True)
    return head + b"".join(maker.compress(r) for r in records)


def unpack(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        n = struct.unpack_from("<I", content, 4)[0]
        if 8 + n > len(content):
            raise WarcError("the dictionary frame is cut short")
        data = content[8 : 8 + n]
        if data[:4] == struct.pack("<I", FRAME):
            data = zstandard.ZstdDecompressor().decompress(data)
        dictionary, at = zstandard.ZstdCompressionDict(data), 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(content):
        magic = struct.unpack_from("<I", content, at)[0] if at + 4 <= len(content) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack_from("<I", content, at + 4)[0] if at + 8 <= len(content) else len(content)
            if at + 8 + size > len(content):
                raise WarcError("a skippable frame is cut short")
            at += 8 + size
            continue
        if magic != FRAME:
            raise WarcError("no frame where one should begin")
        one = reader.decompressobj()
        out = one.decompress(content[at:] if len(content) - at < 1 << 16 else memoryview(content)[at : at + (1 << 16)])
        fed = min(len(content), at + (1 << 16))
        parts = [out]
        while not one.eof:
            if fed >= len(content):
                raise WarcError("a frame is cut short")
            parts.append(one.decompress(memoryview(content)[fed : fed + (1 << 16)]))
            fed = min(len(content), fed + (1 << 16))
        at = fed - len(one.unused_data)
        yield b"".join(parts)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        content = pack(records)
        return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.zst"]), pa.array([content], pa.binary())], names=["path", "content"])

    for batch in batches:
        for page_id, url, data, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
            clean = re.sub(r"[\r\n]", " ", url.as_py() or "")
            records.append(build_record(page_id.as_py(), clean, data.as_py(), refers_to.as_py()))
            size += len(records[-1])
            if size >= ARCHIVE_BYTES:
                yield flush()
                records, size = [], 0
    if records:
        yield flush()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for raw in unpack(content.as_py()):
                record = parse_record(raw)
                h, data = record["headers"], record["payload"]
                if data is None and not (h["warc-type"] == "revisit" and {"x-payload-length", "warc-payload-digest", "x-refers-to-page"} <= h.keys() and h["x-payload-length"].isdigit()):
                    raise WarcError("neither a response nor a revisit that names its response, length and digest")
                n = len(data) if data is not None else int(h["x-payload-length"])
                own = digest(data) if data is not None else h["warc-payload-digest"].removeprefix("sha1:")
                rows.append((int(h["x-page-id"]) if h.get("x-page-id") else None, h.get("warc-target-uri"), h["warc-type"], int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None, n, own, len(raw)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=RECORD_SCHEMA.split()[::2])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The archives as a table (path, content) in the shared folder. Only digests are shuffled, summed before; payloads stay in their tasks unless
    the digests that occur again are too many to broadcast, when pages and digests meet in a join whose large keys Spark splits."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload(payload_col).alias("data"))
    again = (
        rows.select("page_id", F.unhex(F.sha2("data", 256)).alias("digest")).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    )
    again = materialize(again, "warc-again")
    joined = rows.withColumn("digest", F.unhex(F.sha2("data", 256))).join(small_or_shuffled(again, again.count()), "digest", "left")
    refers = F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))
    return materialize(joined.select("page_id", "url", "data", refers.alias("refers_to")).mapInArrow(_write, "path string, content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records (RECORD_SCHEMA) of archives (content binary), each frame decoded and checked, as a table in the shared folder. Raises WarcError
    if a revisit fits no response: what revisits claim, once each, meets the responses by page, digest and length."""
    records = materialize(archives.select("content").mapInArrow(_read, RECORD_SCHEMA), "warc-records")
    claims = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    unmet = claims.join(records.where("record_type = 'response'"), ["page_id", "payload_digest", "payload_bytes"], "left_anti").first()
    if unmet is not None:
        raise WarcError(f"no response of page {unmet['page_id']} with {unmet['payload_bytes']} bytes and digest {unmet['payload_digest']}, to which a revisit refers")
    return records
