"""Media columns: byte payloads as PNG images in binary columns, checked, decoded and hashed.

A payload is stored as 8-bit RGB samples, 64 pixels (192 bytes) a row, with the row filter of least absolute sum among
None, Sub and Up. Reading walks the chunks, tests every CRC, inflates the IDAT chunks, and undoes the five row filters with numpy
(None, Sub and Up for whole runs of rows, Average and Paeth a pixel at a time). The feature is a perceptual hash: the
grey image's 8 x 8 low frequencies of a cosine transform of its 32 x 32 cell means, each against their median.

Cases: a null or empty text is one row of spaces; equal texts give equal values; rows are independent, so repeated rows
and ids, null ids and empty tables need nothing special; a damaged image raises ValueError.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import common

ROW, PIXEL, HASH = 192, 3, 8
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")


def to_png(payload: bytes) -> bytes:
    """A PNG image of a payload whose length is a positive multiple of 192."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, PIXEL:], above[1:] = rows[:, :-PIXEL], rows[:-1]
    choices = np.stack([rows, rows - left, rows - above])
    cost = np.minimum(choices, 0 - choices).sum(axis=2, dtype=np.int64)
    kind = cost.argmin(axis=0)
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = choices[kind, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", ROW // PIXEL, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples (rows, pixels, channels) of an 8-bit grey, RGB or RGBA image that isn't interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, shape, packed, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(data):
            raise ValueError("the image ends early")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"bad checksum of {kind!r}")
        if kind == b"IHDR":
            wide, high, depth, colour, method, filtering, interlaced = struct.unpack(">IIBBBBB", body)
            channels = {0: 1, 2: 3, 6: 4}.get(colour)
            if depth != 8 or channels is None or method or filtering or interlaced:
                raise ValueError("unsupported kind of PNG")
            shape = high, wide, channels
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + size
    if shape is None:
        raise ValueError("no header")
    high, wide, channels = shape
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != high * (wide * channels + 1):
        raise ValueError("wrong amount of samples")
    return unfilter(raw.reshape(high, -1), channels).reshape(shape)


def unfilter(lines: np.ndarray, pixel: int) -> np.ndarray:
    """Samples of filtered lines (first byte: filter), runs of one filter at a time."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(edges, edges[1:], strict=False):
        kind = kinds[a] if b > a else NONE
        above = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kind == SUB:
            out[a:b] = np.cumsum(out[a:b].reshape(b - a, -1, pixel), axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == UP:
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8) + above
        elif kind in (AVERAGE, PAETH):
            for r in range(a, b):
                before = (out[r - 1] if r else np.zeros(out.shape[1], np.uint8)).astype(np.int32)
                row, left, corner = out[r].astype(np.int32), np.zeros(pixel, np.int32), np.zeros(pixel, np.int32)
                for x in range(0, len(row), pixel):
                    up = before[x : x + pixel]
                    if kind == AVERAGE:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        dl, du, dc = abs(p - left), abs(p - up), abs(p - corner)
                        guess = np.where((dl <= du) & (dl <= dc), left, np.where(du <= dc, up, corner))
                    left = row[x : x + pixel] = (row[x : x + pixel] + guess) & 255
                    corner = up
                out[r] = row
        elif kind != NONE:
            raise ValueError(f"unknown filter {kind}")
    return out


def _averaged(x: np.ndarray, size: int = 32) -> np.ndarray:
    """The rows of x averaged to `size` cells of equal length; a row that a boundary parts counts by its shares."""
    n = len(x)
    sums = np.zeros((n + 1, x.shape[1]))
    np.cumsum(x, axis=0, out=sums[1:])
    edge = np.arange(size + 1) * n / size
    row = np.minimum(edge.astype(np.int64), n - 1)
    return np.diff(sums[row] + (edge - row)[:, None] * x[row], axis=0) * size / n


@functools.cache
def _cosines(size: int = 32, keep: int = HASH) -> np.ndarray:
    return np.cos(np.pi * (np.arange(size) + 0.5) * np.arange(keep)[:, None] / size)


def perceptual_hash(samples: np.ndarray) -> str:
    grey = samples.mean(axis=2)
    cells = _averaged(_averaged(grey).T).T
    low = np.round(_cosines() @ cells @ _cosines().T, 6).ravel()
    bits = np.packbits(low > np.median(low[1:]))
    return bits.tobytes().hex()


def store(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Appends n_bytes and media, a binary column of PNG images of the texts."""

    def make():
        def work(texts):
            return [len(t or b"") for t in texts], [to_png(pad(t or b"")) for t in texts]

        return work

    binary = docs.withColumn(text_col, F.col(text_col).cast("binary"))
    return common.arrow_map(binary, ["doc_id"] if carry is None else carry, text_col, T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]), make)


def features(images: DataFrame, media_col: str = "media", carry: list[str] | None = None) -> DataFrame:
    """Appends what reading the images gives: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature."""
    out = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])

    def make():
        def one(data: bytes | None):
            if data is None:
                return (None,) * 6
            samples = from_png(data)
            payload = samples.tobytes()
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), perceptual_hash(samples)

        return lambda images: tuple(zip(*map(one, images), strict=True))

    return common.arrow_map(images, ["doc_id", "n_bytes"] if carry is None else carry, media_col, out, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return features(store(docs))
