"""Media columns: payload bytes as PNG images in a binary column, read back with checks, and a perceptual hash.

Writer: 8-bit greyscale, WIDTH samples a row, one row filter for each image (the one of none, sub and up with the
least sum of absolute differences), zlib-compressed, cut into IDAT chunks. Reader: signature, chunk lengths and CRC-32
of every chunk, the zlib checksum, all five row filters undone in numpy. Any failed test raises ValueError.

Feature: the image is averaged to 32 x 32, its 8 x 8 lowest two-dimensional cosine coefficients are taken, and each
gives a bit: whether it exceeds their median (the constant term is left out of the median). Hexadecimal, 16 digits.

Cases: null text is empty; an empty payload becomes 64 zero bytes; equal texts give equal images and features; images
grow with the text, of any length.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Compressed bytes of an IDAT chunk at most; zlib level.
CHUNK, LEVEL = 1 << 16, 1


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes, width: int = WIDTH) -> bytes:
    """payload: a positive multiple of width bytes."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, above = image.copy(), image.copy()
    left[:, 1:] -= image[:, :-1]
    above[1:] -= image[:-1]
    filtered = (image, left, above)
    kind = int(np.argmin([np.abs(x.view(np.int8).astype(np.int16)).sum() for x in filtered]))
    rows = np.empty((len(image), width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, filtered[kind]
    packed = zlib.compress(rows.tobytes(), LEVEL)
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0))]
    out += [_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return b"".join([*out, _chunk(b"IEND", b"")])


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters; stretches of rows with one filter are done at once where rows don't depend on each other
    but by sums."""
    out = np.zeros((len(rows) + 1, rows.shape[1]), np.uint8)  # row 0 stands above the first
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for start, end in zip([0, *edges], [*edges, len(rows)]):
        kind, part = kinds[start], rows[start:end]
        if kind == 0:
            out[start + 1 : end + 1] = part
        elif kind == 1:
            out[start + 1 : end + 1] = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            out[start + 1 : end + 1] = np.cumsum(np.vstack([out[start], part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(start, end):
                above, a = out[y].astype(np.int64), 0
                for x in range(rows.shape[1]):
                    b, c = int(above[x]), int(above[x - 1]) if x else 0
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        p = a + b - c
                        guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    a = (int(rows[y, x]) + guess) & 255
                    out[y + 1, x] = a
        else:
            raise ValueError(f"PNG: row filter {kind}")
    return out[1:]


def read_png(data: bytes) -> np.ndarray:
    """Samples (rows x width, 8-bit greyscale) of a PNG, with all its checksums tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("PNG: a chunk is cut off")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(crc) != 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"PNG: checksum of chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG: not a whole 8-bit greyscale image")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as error:
        raise ValueError("PNG: zlib stream") from error
    width, height = header[:2]
    if raw.size != height * (width + 1):
        raise ValueError("PNG: size")
    rows = raw.reshape(height, width + 1)
    return _unfilter(rows[:, 0], rows[:, 1:])


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(low)[:, None])


_LOW = _cosines(32, 8)


def cosine_hash(image: np.ndarray) -> str:
    height, width = image.shape
    if height < 32:
        image, height = np.repeat(image, -(-32 // height), axis=0), height * -(-32 // height)
    if width < 32:
        image, width = np.repeat(image, -(-32 // width), axis=1), width * -(-32 // width)
    y, x = np.arange(33) * height // 32, np.arange(33) * width // 32
    sums = np.add.reduceat(np.add.reduceat(image, x[:-1], axis=1, dtype=np.int64), y[:-1], axis=0)
    small = sums / (np.diff(y)[:, None] * np.diff(x))
    low = np.round(_LOW @ small @ _LOW.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (64 if not data else 0))


def store(text: Column) -> Column:
    """The PNG (binary) of a text's payload: its UTF-8 bytes and zeros up to a positive multiple of 64."""

    @arrow_udf("binary")
    def stored(column: pa.Array) -> pa.Array:
        return pa.array([write_png(padded(x.as_py())) for x in column], pa.binary())

    return stored(text)


def read(media: Column) -> Column:
    """struct<payload: binary, crc: tail's CRC-32 as long, feature: string> read back from a PNG column; null: null."""

    @arrow_udf("struct<payload:binary,tail_crc32:long,feature:string>")
    def back(column: pa.Array) -> pa.Array:
        payloads, crcs, features = [], [], []
        for x in column:
            image = read_png(x.as_py()) if x.is_valid else None
            payloads.append(None if image is None else image.tobytes())
            crcs.append(None if image is None else zlib.crc32(payloads[-1][-64:]))
            features.append(None if image is None else cosine_hash(image))
        return pa.StructArray.from_arrays(
            [pa.array(payloads, pa.binary()), pa.array(crcs, pa.int64()), pa.array(features, pa.string())],
            names=["payload", "tail_crc32", "feature"],
        )

    return back(media)


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """df with media (binary PNG) and media_read (the struct of `read`)."""
    return df.withColumn("media", store(F.col(text))).withColumn("media_read", read(F.col("media")))
