"""What the first bytes of a file tell: formats and sizes of images, kinds of fonts; hidden fonts made readable."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first bytes of each format, in hexadecimal.
IMAGES = {"png": "89504E470D0A1A0A", "gif": "47494638", "jpeg": "FFD8FF", "bmp": "424D"}
FONTS = {"ttf": "00010000", "otf": "4F54544F", "ttc": "74746366", "woff": "774F4646", "woff2": "774F4632"}


def _kind(data: Column, kinds: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, first in kinds.items():
        out = F.when(F.hex(F.substring(data, 1, len(first) // 2)) == first, name).otherwise(out)
    return out


def image_kind(data: Column) -> Column:
    """`png`, `gif`, `jpeg`, `bmp`, `webp` or null, by the first bytes."""
    riff = (F.hex(F.substring(data, 1, 4)) == "52494646") & (F.hex(F.substring(data, 9, 4)) == "57454250")
    return F.when(riff, "webp").otherwise(_kind(data, IMAGES))


def font_kind(data: Column) -> Column:
    return _kind(data, FONTS)


def _number(data: Column, at: int, size: int, little: bool = False) -> Column:
    """The unsigned integer of `size` bytes from byte `at` (from 1)."""
    digits = F.hex(F.substring(data, at, size))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("int")


def image_size(data: Column) -> Column:
    """(width, height) of a PNG, GIF or BMP; null for what has no size at a fixed place."""
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    kind = image_kind(data)
    out = F.when((kind == "png") & (F.octet_length(data) >= 24), size(_number(data, 17, 4), _number(data, 21, 4)))
    out = out.when((kind == "gif") & (F.octet_length(data) >= 10), size(_number(data, 7, 2, True), _number(data, 9, 2, True)))
    return out.when((kind == "bmp") & (F.octet_length(data) >= 26), size(_number(data, 19, 4, True), _number(data, 23, 4, True)))


def book_key(identifier: Column) -> Column:
    """The key that hides fonts of a book: the digest of its identifier without white space."""
    return F.unhex(F.sha1(F.encode(F.regexp_replace(identifier, r"\s", ""), "UTF-8")))


def unhidden(fonts: DataFrame, data_col: str = "data", key_col: str = "key", first: int = 1040) -> DataFrame:
    """Fonts whose first bytes were mixed with a repeated key, in `data`; the same call hides them. A null or empty key
    changes nothing."""
    names = fonts.columns
    at, k = names.index(data_col), names.index(key_col)

    def run(batches):
        for batch in batches:
            out = []
            for data, key in zip(batch.column(at).to_pylist(), batch.column(k).to_pylist(), strict=True):
                if data and key:
                    n = min(first, len(data))
                    mask = (key * (n // len(key) + 1))[:n]
                    data = (int.from_bytes(data[:n], "big") ^ int.from_bytes(mask, "big")).to_bytes(n, "big") + data[n:]
                out.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return fonts.mapInArrow(run, fonts.schema)
