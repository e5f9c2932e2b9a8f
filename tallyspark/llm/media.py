"""Media columns: content-addressed payloads in tar shards, rows with digest, offset and length.

A payload is stored as an 8-bit greyscale PNG of WIDTH samples a row (lossless). Each task appends to
tar shards of its own in the shared folder and stores equal payloads of a shard once; a member's name is
the digest of its bytes. A task that is run again writes new shards, and only the rows of the finished
attempt name theirs. Metadata come from a range read of the header alone; features read the member.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import scratch, session, stored, texts

WIDTH, SHARD_BYTES, LEVEL = 192, 1 << 29, 4
#: Bytes of members that a task reads, in runs of neighbours; beyond MOST_READERS tasks each of them reads more.
READ_BYTES, MOST_READERS = 8 << 20, 100_000
MAGIC, HEADER = b"\x89PNG\r\n\x1a\n", 33
REFS = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_media(payload: bytes) -> bytes:
    """PNG, colour type 0, depth 8; the payload's length is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if head[:8] != MAGIC or head[12:16] != b"IHDR":
        raise ValueError("no PNG header at this place")
    return struct.unpack(">IIB", head[16:25])


def from_media(media: bytes) -> bytes:
    width, height, _ = read_header(media[:HEADER])
    at, body = 8, b""
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            body += media[at + 8 : at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """A file system that Spark's URI names (file, hdfs, s3, gs ...) and the path in it."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write each text, padded with blanks to a positive multiple of WIDTH bytes, into tar shards under folder.

    One row for each input row: doc_id, n_bytes (unpadded), digest (SHA-256 of the stored member), shard,
    offset, length. Null texts are empty ones; repeated rows name the same member of a shard; other
    columns are ignored; an empty table gives no rows and no shard. Texts are stored whole: a worker holds one payload and its PNG at a time.
    Lazy: the caller stores the rows before reading members.
    """

    def run(batches):
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, known = None, "", 0, {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                body = text.encode()
                payload = body + b" " * (-len(body) % WIDTH or (0 if body else WIDTH))
                key = hashlib.sha256(payload).digest()
                if key not in known:
                    if out is None or at >= SHARD_BYTES:
                        if out:
                            out.write(bytes(1024))
                            out.close()
                        name, at, known = f"{uuid.uuid4().hex}.tar", 0, {}
                        out = fs.open_output_stream(f"{root}/{name}")
                    media = to_media(payload)
                    digest = hashlib.sha256(media).digest()
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(media)
                    member = info.tobuf() + media + bytes(-len(media) % 512)
                    out.write(member)
                    known[key] = digest, name, at + len(member) - len(media) - (-len(media) % 512), len(media)
                    at += len(member)
                rows.append((doc, len(body), *known[key]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, TYPES, strict=True)], NAMES)
        if out:
            out.write(bytes(1024))
            out.close()

    session(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, REFS)


NAMES = [x.split()[0] for x in REFS.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]


class Members:
    """Range reads from the shards of a folder; the shard read last stays open."""

    def __init__(self, folder: str):
        self.fs, self.root = opened(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.root}/{shard}")
        return self.file.read_at(length, offset)


def metadata(refs: DataFrame, folder: str) -> DataFrame:
    """refs with width, height and bit depth, each from a read of HEADER bytes."""

    def run(batches):
        members = Members(folder)
        for batch in batches:
            heads = [read_header(members.read(*x, HEADER)) for x in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in (zip(*heads, strict=True) if heads else [[]] * 3))], [*batch.schema.names, "width", "height", "depth"])

    session(refs.sparkSession)
    return refs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in refs.schema) + ", width int, height int, depth int")


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and the share of each of 8 ranges of the sample values."""
    counts = np.bincount(samples >> 5, minlength=8) / len(samples)
    return json.dumps({"mean": round(float(samples.mean()), 6), "std": round(float(samples.std()), 6), "hist": [round(float(x), 6) for x in counts]})


def features(refs: DataFrame, folder: str) -> DataFrame:
    """refs with what the stored members hold: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. A member whose digest differs from the row's ends the job."""

    def run(batches):
        members = Members(folder)

        @lru_cache(4096)
        def of(shard: str, offset: int, length: int, digest: bytes) -> tuple:
            media = members.read(shard, offset, length)
            if hashlib.sha256(media).digest() != digest:
                raise ValueError(f"{shard} at {offset}: not the bytes that were stored")
            payload = from_media(media)
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), digest.hex(), feature(np.frombuffer(payload, np.uint8))

        for batch in batches:
            got = [of(*x) for x in zip(*(batch.column(n).to_pylist() for n in ("shard", "offset", "length", "digest")), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else [[]] * 6, kinds, strict=True))], [*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    session(refs.sparkSession)
    return refs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in refs.schema) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def dealt(refs: DataFrame, total: int) -> DataFrame:
    """refs, whose members have `total` bytes, dealt out so that a task reads about READ_BYTES of them: runs of neighbours in a
    shard stay together and in order, whatever the number of rows or files that the refs are in."""
    tasks = max(1, min(MOST_READERS, -(-total // READ_BYTES)))
    run = F.floor(F.col("offset") / max(1, total // tasks // 8))
    return refs.repartition(tasks, "shard", run).sortWithinPartitions("shard", "offset")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store, then metadata and features; the shards stay in the shared folder, where the rows point.

    Nulls, repeated rows, empty tables, very long texts and other columns: as `store` says."""
    folder, size = scratch(docs.sparkSession, "media"), Observation()
    refs = stored(store(docs, folder).observe(size, F.sum("length").alias("total")), "media-refs")
    return features(metadata(dealt(refs, size.get["total"] or 0), folder), folder)
