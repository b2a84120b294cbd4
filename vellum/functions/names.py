"""Names that books and their files go by: paths, slugs, derived identifiers, languages, people (column expressions)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx

# The shape of a language tag.
TAG = "^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"
# Folders by the beginning of a media type.
FOLDERS = {"application/xhtml+xml": "text", "text/html": "text", "text/css": "styles", "image/": "images", "font/": "fonts", "application/font": "fonts", "application/vnd.ms-opentype": "fonts", "audio/": "audio", "video/": "video"}


def relative(from_file: Column, to_path: Column) -> Column:
    """The path of one file as seen from another; both are counted from the same root."""
    here = F.split(F.regexp_replace(from_file, "/?[^/]*$", ""), "/")
    here = F.when(here == F.array(F.lit("")), F.array().cast("array<string>")).otherwise(here)
    there = F.split(to_path, "/")
    folders = F.slice(there, F.lit(1), F.size(there) - 1)
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    same = F.aggregate(F.zip_with(here, folders, lambda a, b: F.coalesce(a == b, F.lit(False))), start, lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    up = F.array_repeat(F.lit(".."), F.size(here) - same)
    return F.array_join(F.concat(up, F.slice(there, same + 1, F.size(there))), "/")


def file_slug(name: Column, fallback: str = "file") -> Column:
    """A file name of small letters, digits and hyphens with its extension; `fallback` where nothing is left of the stem."""
    has = F.contains(name, F.lit("."))
    stem = F.when(has, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    suffix = F.when(has, F.replace(tx.slug(F.element_at(F.split(name, r"\."), -1)), F.lit("-"), F.lit(""))).otherwise("")
    plain = tx.slug(stem)
    return F.concat(F.when(plain == "", fallback).otherwise(plain), F.when(suffix == "", "").otherwise(F.concat(F.lit("."), suffix)))


def unique_names(files: DataFrame, key: str, name: str, order: str, to: str = "unique") -> DataFrame:
    """`files` with a name of its own for each row of a key: the first keeps it, later ones get `-2`, `-3` before the extension."""
    place = F.row_number().over(Window.partitionBy(key, name).orderBy(order))
    numbered = F.regexp_replace(F.col(name), r"^(.*?)(\.[^.]*)?$", "$1-\x00$2")
    return files.withColumn(to, F.when(place == 1, F.col(name)).otherwise(F.replace(numbered, F.lit("\x00"), place.cast("string"))))


def name_uuid(name: Column, space: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based UUID (version 5) of a name in a space."""
    digest = F.sha1(F.unhex(F.concat(F.lit(space.hex), F.hex(F.encode(name, "UTF-8")))))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.substr(F.lit("89ab89ab89ab89ab"), nibble + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def book_uuid(files: DataFrame) -> DataFrame:
    """(book, identifier) from (book, path, digest): one identifier for one set of files, whoever computes it."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda f: F.concat(f["path"], F.lit("\t"), f["digest"])), "\n")
    return files.groupBy("book").agg(F.sha2(lines, 256).alias("d")).select("book", F.concat(F.lit("urn:uuid:"), name_uuid(F.col("d"))).alias("identifier"))


def language_tag(raw: Column, default: str = "en") -> Column:
    """A language tag in canonical case; the default for none or one that is no tag."""
    plain = F.replace(F.trim(F.coalesce(raw, F.lit(""))), F.lit("_"), F.lit("-"))
    parts = F.split(plain, "-")
    made = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(F.length(p) == 2, F.upper(p)).otherwise(p)), "-")
    return F.when(F.rlike(plain, F.lit(TAG)), made).otherwise(default)


def settled_language(declared: Column, text: Column, default: str = "en", enough: int = 500) -> Column:
    """The declared language, unless a text of at least `enough` characters is plainly Polish."""
    tag = language_tag(declared, default)
    return F.when((F.substring_index(tag, "-", 1) != "pl") & (F.length(text) >= enough) & tx.looks_polish(text), "pl").otherwise(tag)


def file_as(name: Column) -> Column:
    """`Family, Given` for a name of several words without a comma; else null."""
    plain = F.trim(F.regexp_replace(name, r"\s+", " "))
    family = F.substring_index(plain, " ", -1)
    given = F.substr(plain, F.lit(1), F.length(plain) - F.length(family) - 1)
    return F.when(F.contains(plain, F.lit(" ")) & ~F.contains(plain, F.lit(",")), F.concat(family, F.lit(", "), given))


def folder_of(media_type: Column) -> Column:
    """The folder for files of a media type; `misc` for what has none."""
    out = F.lit("misc")
    for start, folder in reversed(FOLDERS.items()):
        out = F.when(F.startswith(media_type, F.lit(start)), folder).otherwise(out)
    return out
