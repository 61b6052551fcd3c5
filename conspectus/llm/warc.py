"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES``; a bundle ends
in a skippable frame with the seek table (sizes of all frames, in the public
seekable format), so any frame is read without the ones before it, and any
Zstandard tool still reads the whole. The index maps each record to its bundle,
frame and offset in the frame. Bundles are written under new names in the shared
folder, and count only once the index lists them: a task that runs again leaves
nothing half done.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom, common

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
#: Tasks that read archives back at most; each takes one bundle after another.
READ_TASKS = 20_000
#: Equal payloads from this size on are stored once.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def _open(uri: str, mode: str):
    """A file of the shared folder; other schemes than file go through Arrow's file systems."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        path = unquote(parts.path)
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path)
    return system.open_input_file(path)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'page:{page_id}'.encode()).hexdigest())}>"


def _header(value: str) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """One record; a revisit (refers_to given) carries the response's headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}")
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """WARC headers, HTTP headers, payload and the place after the record that starts at ``at``."""

    def headers(block: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if line)

    end = data.index(b"\r\n\r\n", at)
    head = headers(data[at:end])
    start, size = end + 4, int(head["Content-Length"])
    block = data[start : start + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, headers(http), payload, start + size + 4


class BundleWriter:
    def __init__(self, uri: str):
        import zstandard

        self.uri, self.file = uri, _open(uri, "wb")
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.sizes: list[tuple[int, int]] = []
        self.frame = bytearray()
        self.total = 0
        self.rows: list[tuple] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.frame and len(self.frame) + len(data) > FRAME_BYTES:
            self.flush()
        self.rows.append((page_id, self.uri, len(self.sizes), len(self.frame), len(data)))
        self.frame += data
        self.total += len(data)

    def flush(self) -> None:
        if self.frame:
            packed = self.zstd.compress(bytes(self.frame))
            self.file.write(packed)
            self.sizes.append((len(packed), len(self.frame)))
            self.frame = bytearray()

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()
        return self.rows


class BundleReader:
    """Frames of a bundle by number, with the seek table read first."""

    def __init__(self, uri: str):
        self.uri, self.file = uri, _open(uri, "rb")
        self.file.seek(0, 2)
        end = self.file.tell()
        self.file.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(end - 9 - 8 * count)
        entries = list(struct.iter_unpack("<II", self.file.read(8 * count)))
        self.frames, at = [], 0
        for packed, size in entries:
            self.frames.append((at, packed, size))
            at += packed

    def frame(self, k: int) -> bytes:
        import zstandard

        at, packed, size = self.frames[k]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)

    def close(self) -> None:
        self.file.close()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row; returns the index lazily: page_id, bundle, frame, offset, length.

    pages: page_id, url, payload (binary), payload_bytes, payload_digest, refers_to.
    Whoever uses the index more than once has to store it first.
    """
    common.small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def index(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "bundle", "frame", "offset", "length"])

        bundle = None
        for batch in batches:
            columns = [common.column(batch, c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")]
            for k in range(batch.num_rows):
                page_id, url, payload, size, sha1, refers_to = (c[k].as_py() for c in columns)
                if bundle is None:
                    bundle = BundleWriter(f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst")
                bundle.add(page_id, record(page_id, url, payload, size, sha1, refers_to))
                if bundle.total >= BUNDLE_BYTES:
                    yield index(bundle.close())
                    bundle = None
        if bundle is not None:
            yield index(bundle.close())

    return pages.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, "page_id long, bundle string, frame int, offset long, length long")


def read(index: DataFrame) -> DataFrame:
    """Every record of the index, fetched through its entry: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Entries are dealt by bundle and sorted by place, so a task decodes each frame that it
    needs once. A record has to name the entry's page, and a response's payload to agree
    with the digest in its header.
    """
    spark = index.sparkSession
    common.small_batches(spark)
    tasks = index.select(F.approx_count_distinct("bundle")).first()[0]
    tasks = min(READ_TASKS, max(1, tasks, spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, frame, data = None, None, b""
        for batch in batches:
            rows = []
            for page_id, uri, k, at, length in zip(*(common.column(batch, c).to_pylist() for c in ("page_id", "bundle", "frame", "offset", "length")), strict=True):
                if reader is None or reader.uri != uri:
                    if reader is not None:
                        reader.close()
                    reader, frame = BundleReader(uri), None
                if frame != k:
                    frame, data = k, reader.frame(k)
                head, http, payload, end = parse(data, at)
                sha1 = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                size = int(http["Content-Length"])
                own, refers_to = (int(head[c]) if c in head else None for c in ("Page-Id", "Refers-To-Page-Id"))
                if own != page_id or end - at != length:
                    raise ValueError(f"the index doesn't fit {uri}, frame {k}, offset {at}")
                if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
                    raise ValueError(f"a record of {uri} doesn't agree with its digest")
                rows.append((own, size, sha1, head["WARC-Type"], refers_to))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if reader is not None:
            reader.close()

    dealt = index.repartition(tasks, "bundle").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(index: DataFrame, page_ids: list[int]) -> dict[int, bytes]:
    """Payload bytes of a few records, each read from its one frame (empty for revisits)."""
    out = {}
    for r in index.filter(F.col("page_id").isin(page_ids)).collect():
        reader = BundleReader(r["bundle"])
        out[r["page_id"]] = parse(reader.frame(r["frame"]), r["offset"])[2]
        reader.close()
    return out


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write all pages as records; returns the stored index and the records read back through it.

    The payload is the html in UTF-8 (null or empty: no bytes), whole at any length. Of
    records with equal payloads of at least ``LEAST_REVISIT`` bytes those with the greatest
    page_id are responses (all of them, if rows repeat), the others revisit it; without any
    id among them, all are responses, as are records without an id. An empty table gives an
    empty index and no record; columns other than page_id, url and html are left out.

    A Bloom filter of the digests that repeat goes to the rows. Payloads that it rules out
    are written where they are; only the others are shuffled to meet their digest's row, in
    a join that adaptive execution splits where one payload is hot.
    """
    spark = pages.sparkSession
    work = common.Workspace(spark)
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.cast("binary").alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    repeated = base.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1 and response_id is not null")
    repeated = work.save(repeated.select("payload_digest", "response_id", _digest_key("payload_digest").alias("key")), "repeated")
    sent = spark.sparkContext.broadcast(bloom.of_column(repeated, "key"))

    @F.pandas_udf("boolean")
    def may_repeat(key: pd.Series) -> pd.Series:
        return pd.Series(sent.value.has_key(key.to_numpy(np.int64).view(np.uint64)))

    hit = (F.col("payload_bytes") >= LEAST_REVISIT) & may_repeat(_digest_key("payload_digest"))
    flagged = base.withColumn("hit", hit)
    alone = flagged.filter(~F.col("hit")).drop("hit").withColumn("refers_to", F.lit(None).cast("long"))
    joined = flagged.filter("hit").drop("hit").join(repeated.drop("key"), "payload_digest", "left")
    refers = F.when(F.col("page_id").isNotNull() & (F.col("page_id") != F.col("response_id")), F.col("response_id"))
    shared = joined.withColumn("refers_to", refers).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    rows = alone.unionByName(shared.select(alone.columns))
    index = work.save(write(rows, work.path("bundles")), "index")
    work.drop(repeated)
    return index, read(index)


def _digest_key(digest: str) -> Column:
    return F.xxhash64(digest)
