"""Bytes of documents as text: encodings that are declared, mended or neither; characters lost on the way to an output."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A declaration is looked for in so many first bytes.
HEAD = 2048
DECLARED = re.compile(rb"""(?:<\?xml[^>]*?encoding|<meta[^>]*?charset)\s*=\s*["']?([A-Za-z0-9._-]+)""", re.I)
#: What a byte that is no UTF-8 is read as.
STRAY = "cp1250"
DECODED = "text string, encoding string, stray int"


def read_text(data: bytes | None) -> tuple[str | None, str | None, int]:
    """(text, encoding, stray bytes). UTF-8 is taken as it is, whatever is declared. Else a declared encoding is believed if
    its text gives the same bytes again; else only the bytes that are no UTF-8 are read as `STRAY`, one by one."""
    if data is None:
        return None, None, 0
    try:
        return data.decode("utf-8"), "utf-8", 0
    except UnicodeDecodeError:
        pass
    found = DECLARED.search(data[:HEAD])
    name = found.group(1).decode("ascii") if found else "utf-8"
    if name.lower().replace("_", "-") not in ("utf-8", "utf8"):
        try:
            text = data.decode(name)
            if text.encode(name) == data:
                return text, name.lower(), 0
        except (UnicodeError, LookupError):
            pass
    # Bytes outside UTF-8 come out as the code points DC80 to DCFF, which valid UTF-8 can't hold.
    loose = data.decode("utf-8", "surrogateescape")
    bad = re.findall("[\udc80-\udcff]", loose)
    as_read = {ord(c): bytes([ord(c) - 0xDC00]).decode(STRAY, "replace") for c in set(bad)}
    return loose.translate(as_read), "utf-8", len(bad)


def first_lost(source: str | None, output: str | None) -> int:
    """The place of the first character of `source` that `output` doesn't hold in order; -1 if it holds them all."""
    left = iter(output or "")
    return next((i for i, c in enumerate(source or "") if c not in left), -1)


def texts(rows: DataFrame, carry: list[str], data_col: str = "data") -> DataFrame:
    """The carried columns with `DECODED`; declarations inside a text stay as they are."""
    kept = rows.select(*carry, data_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [DECODED])
    names, types = [*carry, "text", "encoding", "stray"], (pa.string(), pa.string(), pa.int32())

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(len(carry))):  # one document at a time
                made = read_text(data.as_py())
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 1) for j in range(len(carry))), *(pa.array([v], t) for v, t in zip(made, types, strict=True))], names=names)

    return kept.mapInArrow(run, schema)


def losses(pairs: DataFrame, carry: list[str], source_col: str = "source", output_col: str = "output") -> DataFrame:
    """The carried columns with `lost_at` (see `first_lost`), white space left out of both sides. A whole text is one value:
    the test reads each of them once, in order."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    kept = pairs.select(*carry, bare(source_col).alias("__s"), bare(output_col).alias("__o"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-2]] + ["lost_at long"])
    n = len(carry)

    def run(batches):
        for batch in batches:
            at = [first_lost(s, o) for s, o in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(n)), pa.array(at, pa.int64())], names=[*carry, "lost_at"])

    return kept.mapInArrow(run, schema)
