"""WARC archives compressed record by record with a Zstandard dictionary of their own."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm._common import materialise, ship, spread_join, table

SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
LEAST_REVISIT = 1000
#: Up to this size the payloads that occur again, a digest and a URL each, go to all executors.
BROADCAST_BYTES = 32 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, url: str | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}\0{url}\0'.encode() + digest).digest())}>"


def _line(value: str) -> str:
    """Without what would break a header line: white space and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A response, or with refers_to (and that record's URL) a revisit, which has the response's HTTP header but no payload.

    Fields of the format name the record that a revisit refers to, so other readers find it; fields with X- hold what the format has no
    field for: page ids, and a URL that can't stand in a header line as it is.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
        if _line(url) != url:
            head.append(f"X-Target-URI: {base64.b64encode(url.encode()).decode()}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_line(refers_url)}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = 32 << 10, sample: int = 2 << 20) -> bytes:
    """A dictionary from pieces of at most 16 KiB spread over the whole of all records, about `sample` bytes of them; empty if the
    records are too short or too much alike for one."""
    total = sum(map(len, records))
    piece = min(16 << 10, max(256, total // 16))  # an archive of few bytes is cut finer
    pieces = [r[at : at + piece] for r in records for at in range(0, len(r), piece)]
    step = max(1, total // sample)
    used = pieces[::step]
    if len(used) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, used)) // 8)), used, k=256, d=8, f=18, accel=4).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(records: list[bytes], level: int = 6) -> bytes:
    """The dictionary in a leading skippable frame, then a frame for each record."""
    raw = build_dictionary(records)
    if not raw:
        packer = zstandard.ZstdCompressor(level=level)
        return b"".join(packer.compress(r) for r in records)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT))
    stored = zstandard.ZstdCompressor(level=level).compress(raw)
    return b"".join([struct.pack("<II", SKIPPABLE, len(stored)), stored, *(packer.compress(r) for r in records)])


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at `at` ends, from its headers alone."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if magic != 0xFD2FB528:
        raise ValueError(f"no frame at {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    p = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(data[p : p + 3], "little")
        p += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return p + 4 * (flags >> 2 & 1)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    at, shared = 0, None
    view = memoryview(data)
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == SKIPPABLE:
        at = frame_end(data, 0)
        raw = bytes(view[8:at])
        shared = zstandard.ZstdCompressionDict(zstandard.decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw)
    opener = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        yield opener.decompress(view[at:end])
        at = end


def parse_record(raw: bytes) -> dict[str, object]:
    """Header fields in lower case, and http (its header block) and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out: dict[str, object] = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    out["http"], _, out["payload"] = block.partition(b"\r\n\r\n")
    return out


def write_warc(pages: DataFrame, archive_bytes: int = 8 << 20) -> DataFrame:
    """Archives (archive, records, data) of a record for each row of pages (page_id, url, html).

    A null html is an empty payload. Of rows with equal payloads of at least LEAST_REVISIT bytes, those with
    the largest page_id are responses and the others refer to it; nulls come below all ids, and if all are null, all are responses.
    Each task closes an archive at `archive_bytes` of records, so none grows with the input, and each has a dictionary of its own.
    """
    ship(pages.sparkSession)
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw.alias("payload"), F.unhex(F.sha1(raw)).alias("digest"))
    long = F.length("payload") >= LEAST_REVISIT
    # Which records are responses is decided on narrow rows; payloads stay where they are.
    last = F.max(F.struct("page_id", "url"))
    kept = rows.filter(long).groupBy("digest").agg(last.alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1 and kept.page_id is not null").select("digest", "kept")
    kept = materialise(kept, "kept")
    size = kept.agg(F.coalesce(F.sum(F.lit(64) + F.coalesce(F.length("kept.url"), F.lit(0))), F.lit(0))).first()[0]
    # Beyond the bound both sides are shuffled, a hot payload's rows over several tasks.
    joined = rows.join(F.broadcast(kept), "digest", "left") if size <= BROADCAST_BYTES else spread_join(rows.withColumn("_row", F.xxhash64("page_id", "url")), kept, ["digest"], "_row", 64, "left")
    refers = F.when(long & ~F.col("page_id").eqNullSafe(F.col("kept.page_id")), F.col("kept"))
    joined = joined.select("page_id", "url", "payload", "digest", refers["page_id"].alias("refers_to"), refers["url"].alias("refers_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = write_archive(own)
            names = ["archive", "records", "data"]
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(data).hexdigest()}.warc.zst"]), pa.array([len(own)], pa.int64()), pa.array([data], pa.binary())], names=names)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                    own.append(record(*row))
                    size += len(own[-1])
                    if size >= archive_bytes:
                        yield close()
                        own, size = [], 0
        if own:
            yield close()

    return joined.mapInArrow(run, "archive string, records long, data binary")


def read_warc(archives: DataFrame) -> DataFrame:
    """A row for each record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null in revisits).

    Length and digest of a response are those of the payload read; of a revisit, those of its headers.
    """
    ship(archives.sparkSession)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in schema.split(", ")]
    number = lambda x: None if x is None else int(x)

    def row(raw: bytes) -> tuple:
        r = parse_record(raw)
        whole = r["warc-type"] == "response"
        n = len(r["payload"]) if whole else int(re.search(rb"(?i)\r\ncontent-length: (\d+)", r["http"])[1])
        digest = base64.b32decode(r["warc-payload-digest"][5:]).hex()
        if whole and hashlib.sha1(r["payload"]).hexdigest() != digest:
            raise ValueError("a payload doesn't match its digest")
        url = base64.b64decode(r["x-target-uri"]).decode() if "x-target-uri" in r else r.get("warc-target-uri")
        return number(r.get("x-page-id")), url, r["warc-type"], number(r.get("x-refers-to-page-id")), n, digest, r["payload"] if whole else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows: list[tuple] = []
                for raw in read_archive(data):
                    rows.append(row(raw))
                    if len(rows) == 256:
                        yield _batch(rows, kinds, names)
                        rows = []
                if rows:
                    yield _batch(rows, kinds, names)

    return archives.select("data").mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialise(write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html")), "warc")
    return read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
