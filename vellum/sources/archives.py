"""Packaged books: listing, scanning and writing ZIP archives with canonical entry names, budgets and digests."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An entry may be this large, and this many times its compressed size once it is beyond `RATIO_FLOOR` bytes.
ENTRY_BYTES, RATIO, RATIO_FLOOR, CHUNK = 512 << 20, 200, 64 << 10, 1 << 20
#: Every entry carries this time, so that equal books are equal bytes.
STAMP = (1980, 1, 1, 0, 0, 0)
ENTRY_SCHEMA = "book string, name string, declared_size long, size long, ok boolean, reason string, digest string, data binary"


def books_in(spark: SparkSession, folder: str, suffix: str = ".epub") -> DataFrame:
    """(path, modificationTime, length, content) of every book below `folder`; unread columns are pruned."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)


def canonical_name(name: Column) -> Column:
    """An entry name cut at NUL, with slashes forward, drive, leading slashes, `.` and `..` resolved.

    Null for a name that is empty or leaves the archive; a null name stays null.
    """
    cut = F.substring_index(name, "\0", 1)
    plain = F.regexp_replace(F.translate(cut, "\\", "/"), "^[A-Za-z]:", "")
    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", "."))
    gone = F.array(F.lit(".."))  # what a path becomes once it has left the archive: nothing brings it back

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) == 0, gone).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        return F.when(F.element_at(F.concat(done, F.array(F.lit(""))), 1) == "..", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    out = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when((F.size(out) > 0) & (F.element_at(F.concat(out, F.array(F.lit(""))), 1) != ".."), F.array_join(out, "/"))


def _bounded(archive: zipfile.ZipFile, info: zipfile.ZipInfo, most: int) -> tuple[bytes | None, str | None]:
    """The bytes of an entry, or why it is refused: the headers are checked first, what really comes out as well."""
    if info.flag_bits & 1:
        return None, "encrypted"
    if info.file_size > most or (info.file_size > RATIO_FLOOR and info.file_size > RATIO * max(1, info.compress_size)):
        return None, "too large"
    out = bytearray()
    try:
        with archive.open(info) as stream:
            while chunk := stream.read(CHUNK):
                out += chunk
                if len(out) > most or (len(out) > RATIO_FLOOR and len(out) > RATIO * max(1, info.compress_size)):
                    return None, "too large"
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, NotImplementedError, RuntimeError) as e:
        return None, "checksum" if "CRC" in str(e) else "damaged"
    return bytes(out), None


def _rows(book: str, content: bytes, most: int, with_data: bool) -> Iterator[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        yield book, None, None, None, False, "not an archive", None, None
        return
    for info in archive.infolist():
        if info.is_dir():
            continue
        data, reason = _bounded(archive, info, most)
        digest = None if data is None else hashlib.sha256(data).hexdigest()
        yield book, info.filename, info.file_size, None if data is None else len(data), data is not None, reason, digest, data if with_data else None


def entries(books: DataFrame, book_col: str = "path", content_col: str = "content", most: int = ENTRY_BYTES, with_data: bool = True) -> DataFrame:
    """A row for every entry of every book, in `ENTRY_SCHEMA`, with the name made canonical.

    Refused and damaged entries are rows too, with `ok` false and a reason: nothing is dropped. A book that is no archive
    gives one such row without a name; so does a null content. One entry at a time is held beside its book.
    """
    names = ["book", "name", "declared_size", "size", "ok", "reason", "digest", "data"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.binary()]

    def scan(batches):
        for batch in batches:
            for book, content in zip(batch.column(0), batch.column(1), strict=True):
                for row in _rows(book.as_py(), content.as_py() or b"", most, with_data):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    found = books.select(F.col(book_col).cast("string"), F.col(content_col)).mapInArrow(scan, ENTRY_SCHEMA)
    bad = F.col("name").isNotNull() & canonical_name(F.col("name")).isNull()
    reason = F.when(bad, F.lit("unusable name")).otherwise(F.col("reason"))
    return found.select("book", canonical_name(F.col("name")).alias("name"), "declared_size", "size", (F.col("ok") & ~bad).alias("ok"), reason.alias("reason"), "digest", "data")


def repeated_names(found: DataFrame) -> DataFrame:
    """(book, name, n, same): names that several entries of a book have, and whether all of them hold the same bytes."""
    return found.where("name IS NOT NULL").groupBy("book", "name").agg(F.count("*").alias("n"), (F.count_distinct("digest") == 1).alias("same")).where("n > 1")


def pack(parts: DataFrame) -> DataFrame:
    """(book, content, length) from (book, name, data): `mimetype` first and stored, the rest by name and deflated.

    A group is one book's files, which its archive has to hold together anyway. Equal parts give equal bytes.
    """

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("name").to_pylist(), table.column("data").to_pylist(), strict=True), key=lambda r: (r[0] != "mimetype", r[0]))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for name, data in rows:
                info = zipfile.ZipInfo(name, STAMP)
                info.create_system, info.compress_type = 3, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
                archive.writestr(info, data or b"")
        return pa.table({"book": table.column("book").slice(0, 1), "content": pa.array([out.getvalue()], pa.binary()), "length": pa.array([out.tell()], pa.int64())})

    return parts.select(F.col("book").cast("string").alias("book"), "name", "data").groupBy("book").applyInArrow(build, "book string, content binary, length long")
