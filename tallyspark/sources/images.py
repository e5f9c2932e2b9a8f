"""Type, size and digest of images in a binary column (Spark's binaryFile source or retained responses)."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame

PNG, JPEG, SIDES = b"\x89PNG\r\n\x1a\n", (b"\xff\xd8", b"\xff\xd9"), range(16, 8193)
MOST_BYTES = 16 << 20
RESULT = "name string, mime string, width int, height int, bytes long, sha256 string, problem string"
#: One JPEG segment after another: fill bytes, a marker without a body, or a marker with its length; entropy-coded data begin after SOS.
segment = re.compile(rb"\xff+(?:(?P<bare>[\x01\xd0-\xd9])|(?P<marker>[\x02-\xcf\xda-\xfe])(?P<size>..))", re.DOTALL)
#: Start-of-frame markers of baseline, extended and progressive pictures; start of scan.
FRAMES, SCAN = b"\xc0\xc1\xc2", b"\xda"


class Unreadable(ValueError):
    pass


def png_size(raw: bytes) -> tuple[int, int]:
    """Chunks are laid out first (length, kind, body, checksum), then judged as a list: a 13-byte IHDR leads, an empty IEND ends the bytes, data lie
    between, and each checksum holds."""
    laid, at = [], len(PNG)
    while at + 12 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        laid.append((at, size))
        at += size + 12
    if not laid or at != len(raw):
        raise Unreadable("truncated")
    part = [(raw[a + 4 : a + 8], raw[a + 8 : a + 8 + n], int.from_bytes(raw[a + 8 + n : a + 12 + n], "big")) for a, n in laid]
    if any(zlib.crc32(body, zlib.crc32(kind)) != check for kind, body, check in part):
        raise Unreadable("checksum")
    order = b" ".join(kind for kind, _, _ in part)
    if order.count(b"IHDR") != 1 or not order.startswith(b"IHDR") or len(part[0][1]) != 13:
        raise Unreadable("header")
    if order.count(b"IEND") != 1 or not order.endswith(b"IEND") or part[-1][1] or b"IDAT" not in order:
        raise Unreadable("incomplete")
    return struct.unpack(">II", part[0][1][:8])


def jpeg_size(raw: bytes) -> tuple[int, int]:
    """The first frame header's height and width, before any scan."""
    found = segment.match(raw, 2)
    while found:
        end = found.end()
        if marker := found["marker"]:
            end += int.from_bytes(found["size"], "big") - 2
            if end < found.end() or end > len(raw):
                raise Unreadable("truncated")
            if marker in FRAMES:
                return struct.unpack(">HH", raw[found.end() + 1 : found.end() + 5])[::-1]
            if marker == SCAN:
                raise Unreadable("no_frame")
        found = segment.match(raw, end)
    raise Unreadable("no_frame")


def inspect(raw: bytes | None, declared: str | None = None) -> tuple:
    """What the bytes are; declared: the content type they came with, which must be theirs."""
    raw = raw or b""
    mime = "image/png" if raw[:8] == PNG else "image/jpeg" if (raw[:2], raw[-2:]) == JPEG else None
    width = height = None
    try:
        if mime is None:
            raise Unreadable("not_an_image")
        if len(raw) > MOST_BYTES:
            raise Unreadable("too_large")
        width, height = (png_size if mime == "image/png" else jpeg_size)(raw)
        if declared and declared.split(";")[0].strip().lower() != mime:
            raise Unreadable("content_type")
        problem = None if width in SIDES and height in SIDES else "dimensions"
    except (Unreadable, struct.error) as error:
        problem = str(error) if isinstance(error, Unreadable) else "truncated"
    return mime, width, height, len(raw), hashlib.sha256(raw).hexdigest(), problem


def inspected(images: DataFrame) -> DataFrame:
    """images (name, content) -> what each holds, and `problem` where it can't be used."""

    def run(frames):
        for frame in frames:
            rows = [(name, *inspect(None if raw is None else bytes(raw))) for name, raw in zip(frame["name"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"width": "Int32", "height": "Int32"})

    return images.select("name", "content").mapInPandas(run, RESULT)
