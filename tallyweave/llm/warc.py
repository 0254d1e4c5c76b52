"""WARC archives in Zstandard frames with a shared dictionary (operator 2).

An archive starts with a skippable frame that holds the dictionary; every record is a
frame of its own that needs it. Archives travel as rows of a table (archive, content) in
the shared folder, since Spark has no writer of bare binary files; ``read_archives`` takes
such a table or what the ``binaryFile`` source reads.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2020-01-01T00:00:00Z"

REVISIT_BYTES = 100
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 16 << 10
DICTIONARY_SAMPLES = 64
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def _one_line(url: str) -> str:
    """A url that a header can hold; ``urllib.parse.unquote`` undoes it where something was encoded."""
    if "\r" not in url and "\n" not in url and url == url.strip():
        return url
    url = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    bare = url.strip()
    at = url.index(bare)
    quote = lambda blanks: "".join(f"%{b:02X}" for b in blanks.encode())
    return quote(url[:at]) + bare + quote(url[at + len(bare) :])


def build_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit with an empty block that names the response's record.

    A url's percent signs, carriage returns and line feeds, and blanks at its ends, are
    percent-encoded where it has such breaks or blanks; all other urls are written as they are.
    """
    revisit = refers_to is not None
    block = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", _one_line(url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = WARC_VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    return head + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-cased names, block) of one record. Raises WarcError where headers or lengths are wrong."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != WARC_VERSION:
        raise WarcError("no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        try:
            name, colon, value = line.decode().partition(":")
        except UnicodeDecodeError as e:
            raise WarcError(f"header {line[:60]!r} is not UTF-8") from e
        if not colon or not name or name != name.strip():
            raise WarcError(f"malformed header {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in REQUIRED:
        if name not in headers:
            raise WarcError(f"missing header {name}")
    if not headers["content-length"].isdecimal():
        raise WarcError("Content-Length is not a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, its header says {n}")
    block = rest[:n]
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "")
    if kind == "response" and digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise WarcError("payload digest differs")
    if kind == "revisit" and "warc-refers-to" not in headers:
        raise WarcError("a revisit without WARC-Refers-To")
    return headers, block


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary out of the samples: trained where there is enough, else their raw text."""
    joined = b"".join(samples)[: 4 * DICTIONARY_BYTES]
    if len(samples) >= 16 and sum(map(len, samples)) >= 8 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            pass  # samples too alike for the trainer: raw content serves as well
    return joined[:DICTIONARY_BYTES] or b"\r\n\r\n\r\n\r\n"


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == DICTIONARY_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def build_archive(records: list[bytes], level: int = 3) -> bytes:
    """The dictionary in a skippable frame, then a frame for each record."""
    step = max(1, len(records) // DICTIONARY_SAMPLES)
    raw = train_dictionary([r[: 64 << 10] for r in records[::step]])
    compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw), write_content_size=True, write_checksum=True)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw + b"".join(compressor.compress(r) for r in records)


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, frame by frame. Raises WarcError where it is damaged or cut off."""
    if len(content) < 8:
        raise WarcError("an archive starts with a dictionary frame")
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE_MAGIC or 8 + size > len(content):
        raise WarcError("no dictionary frame, or a cut one")
    raw = content[8 : 8 + size]
    if raw[:4] == FRAME_MAGIC:  # the dictionary itself may be compressed
        try:
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
        except zstandard.ZstdError as e:
            raise WarcError(f"damaged dictionary: {e}") from e
    decompressor, at = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)), 8 + size
    view = memoryview(content)
    while at < len(content):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        frame = decompressor.decompressobj()
        out, step = [], 1 << 16
        try:
            while not frame.eof:
                if at >= len(content):
                    raise WarcError("the last frame is cut off")
                chunk = view[at : at + step]
                out.append(frame.decompress(chunk))
                at += len(chunk)
            at -= len(frame.unused_data)
        except zstandard.ZstdError as e:
            raise WarcError(f"damaged frame: {e}") from e
        yield parse_record(b"".join(out))


def decide_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html; other columns are dropped) with payload_digest, payload_bytes and refers_to.

    Of rows with equal payloads of at least ``least`` bytes, the smallest page_id is the
    response that the others refer to; a null page_id counts as the largest. Rows that
    repeat the smallest page_id are responses as well. A null html is an empty payload.
    """
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"payload_digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html").cast("long")})
    repeated = own.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = own.join(repeated.select("payload_digest", "first"), "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def write_archives(pages: DataFrame) -> DataFrame:
    """Write a record for each row of ``pages`` into archives of about ``ARCHIVE_BYTES`` of payload: (archive, content)."""

    def build(batches):
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            nonlocal n, held, size
            row = pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{n:06d}.warc.zst"], "content": [build_archive(held)]})
            n, held, size = n + 1, [], 0
            return row

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")]
            for page_id, url, html, digest, refers_to in zip(*columns):
                payload = html.encode()
                held.append(build_record(page_id, url, payload, digest, refers_to))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield out()
        if held:
            yield out()

    return written(arrow_map(decide_revisits(pages), build, "archive string, content binary"), "uncompressed")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row a record of the archives (content): record_id, record_type, url, payload_bytes, payload_digest, refers_to, block.

    Damaged archives raise WarcError. Of a revisit, length and digest are those of the
    payload it stands for, and its block is empty.
    """
    kinds = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary())])

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for h, block in read_archive(content.as_py()):
                    rows.append((h["warc-record-id"].strip("<>"), h["warc-type"], h.get("warc-target-uri"), int(h["x-payload-length"]) if "x-payload-length" in h else len(block), h.get("warc-payload-digest", "").removeprefix("sha256:") or None, h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return arrow_map(archives.select("content"), read, "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, block binary")


def page_of(record: str):
    """The page_id that ``build_record`` put in a record id; null for none."""
    return F.expr(f"try_cast(replace({record}, 'urn:page:', '') as bigint)")
