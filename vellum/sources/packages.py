"""Package documents of books: metadata, manifest, reading order and navigation as rows, and what must hold between them."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources import batches

#: A part each: `metadata` (name, value), `manifest` (id, path, media type), `spine` (id of a manifest item, linear).
SCHEMA = "book string, part string, ord int, id string, name string, value string, path string, media_type string, fallback string, properties array<string>, linear boolean"
NAV_SCHEMA = "book string, section string, pre int, parent int, depth int, label string, path string, fragment string"
# Navigation sections that a reader knows.
SECTIONS = ["landmarks", "page-list", "toc"]


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _parse(data: bytes | None):
    try:
        return ElementTree.fromstring(data or b"")
    except (ElementTree.ParseError, ValueError, LookupError):
        return None


def _inside(base: str, href: str) -> tuple[str, str | None]:
    path, _, fragment = href.partition("#")
    full = posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(path))) if path else base
    return full.lstrip("/"), fragment or None


def package_rows(where: str, data: bytes | None) -> list[tuple]:
    """Rows of `SCHEMA` without the book; a document that is no XML has none."""
    root, rows = _parse(data), []
    if root is None:
        return rows
    of = {_local(e.tag): e for e in root}
    for i, e in enumerate(of.get("metadata", ())):
        name = e.get("property") or e.get("name") or _local(e.tag)
        value = " ".join((e.get("content") or "".join(e.itertext())).split())
        rows.append(("metadata", i, e.get("id"), name, value, (e.get("refines") or "").lstrip("#") or None, None, None, None, None))
    for i, e in enumerate(x for x in of.get("manifest", ()) if _local(x.tag) == "item"):
        path = _inside(where, e.get("href") or "")[0] if e.get("href") else None
        rows.append(("manifest", i, e.get("id"), None, None, path, e.get("media-type"), e.get("fallback"), (e.get("properties") or "").split(), None))
    for i, e in enumerate(x for x in of.get("spine", ()) if _local(x.tag) == "itemref"):
        rows.append(("spine", i, e.get("idref"), None, None, None, None, None, (e.get("properties") or "").split(), e.get("linear") != "no"))
    return rows


def nav_rows(where: str, data: bytes | None) -> list[tuple]:
    """Rows of `NAV_SCHEMA` without the book, of a navigation document or an older table of contents."""
    root, rows = _parse(data), []

    def add(section, parent, depth, label, href):
        path, fragment = _inside(where, href) if href else (None, None)
        rows.append((section, len(rows), parent, depth, " ".join(label.split()), path, fragment))
        return len(rows) - 1

    def items(section, holder, parent, depth):
        for li in (x for x in holder if _local(x.tag) == "li"):
            head = next((x for x in li if _local(x.tag) in ("a", "span")), None)
            me = add(section, parent, depth, "".join(head.itertext()) if head is not None else "", head.get("href") if head is not None else None)
            for ol in (x for x in li if _local(x.tag) == "ol"):
                items(section, ol, me, depth + 1)

    def points(holder, parent, depth):
        for p in (x for x in holder if _local(x.tag) == "navpoint"):
            of = {_local(x.tag): x for x in p}
            target = of["content"].get("src") if "content" in of else None
            points(p, add("toc", parent, depth, "".join(of["navlabel"].itertext()) if "navlabel" in of else "", target), depth + 1)

    for e in root.iter() if root is not None else ():
        if _local(e.tag) == "navmap":
            points(e, None, 0)
        elif _local(e.tag) == "nav":
            kind = next((v for k, v in e.attrib.items() if _local(k) == "type"), "") or e.get("role", "").removeprefix("doc-")
            for ol in (x for x in e if _local(x.tag) == "ol"):
                items(kind if kind in SECTIONS else "other", ol, None, 0)
    return rows


def package_documents(entries: DataFrame) -> DataFrame:
    """(book, name, data): each book's package document: the first that its container file names and that is there, else
    the `.opf` of least depth, then shortest name. Books without one have no row."""
    roots = F.regexp_extract_all(F.decode("data", "UTF-8"), F.lit(r'full-path\s*=\s*["\x27]([^"\x27]+)'), 1)
    asked = entries.where("name = 'META-INF/container.xml'").select("book", F.posexplode(F.transform(roots, lambda x: F.regexp_replace(F.translate(x, "\\", "/"), "^/+", ""))).alias("rank", "name"))
    opf = entries.where(F.lower("name").endswith(".opf")).select("book", "name", (1000 + F.size(F.split("name", "/"))).alias("rank"))
    first = Window.partitionBy("book").orderBy("rank", F.length("name"), "name")
    chosen = asked.select("book", "name", "rank").union(opf).join(entries.select("book", "name", "data"), ["book", "name"]).withColumn("k", F.row_number().over(first))
    return chosen.where("k = 1").select("book", "name", "data")


def _mapped(documents: DataFrame, schema: str, read) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    names, types = zip(*((f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")), strict=True)

    def run(arrived):
        every = ((book, *row) for batch in arrived for book, where, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for row in read(where, data))
        yield from batches.gathered(every, list(types), list(names))

    return documents.select("book", "name", "data").mapInArrow(run, schema)


def packages(documents: DataFrame) -> DataFrame:
    """The parts of package documents (book, name, data), in `SCHEMA`."""
    return _mapped(documents, SCHEMA, package_rows)


def navigation(documents: DataFrame) -> DataFrame:
    """The points of navigation documents (book, name, data) in document order, in `NAV_SCHEMA`."""
    return _mapped(documents, NAV_SCHEMA, nav_rows)


def reading_order(parts: DataFrame) -> DataFrame:
    """(book, ord, path, linear): spine entries by their manifest item; a path is null where no item has the id."""
    item = (F.col("part") == "manifest") & F.col("id").isNotNull() & F.col("book").isNotNull()
    # Both sides are one grouping, so that documents are parsed once.
    met = parts.where("part IN ('manifest', 'spine')").groupBy("book", "id").agg(F.min_by(F.when(item, F.col("path")), F.when(item, F.col("ord"))).alias("path"), F.collect_list(F.when(F.col("part") == "spine", F.struct("ord", "linear"))).alias("s"))
    return met.select("book", "path", F.explode("s").alias("s")).select("book", "s.ord", "path", "s.linear")


def order_rows(where: str, data: bytes | None) -> list[tuple]:
    """(ord, path, linear) of a package document's spine; of items with one id the first counts."""
    root, items = _parse(data), {}
    if root is None:
        return []
    of = {_local(e.tag): e for e in root}
    for e in of.get("manifest", ()):
        if _local(e.tag) == "item" and e.get("id") is not None:
            items.setdefault(e.get("id"), e.get("href"))
    refs = [x for x in of.get("spine", ()) if _local(x.tag) == "itemref"]
    return [(i, _inside(where, items[x.get("idref")])[0] if items.get(x.get("idref")) else None, x.get("linear") != "no") for i, x in enumerate(refs)]


def reading_orders(documents: DataFrame) -> DataFrame:
    """What `reading_order` says of package documents (book, name, data), each resolved where it is parsed."""
    return _mapped(documents, "book string, ord int, path string, linear boolean", order_rows)


def violations(parts: DataFrame, points: DataFrame, entries: DataFrame) -> DataFrame:
    """(book, rule, subject): what doesn't resolve: manifest items without a file, spine entries without an item, navigation
    without a file, files that no manifest lists, ids that are given twice."""
    files = entries.where("name IS NOT NULL").select("book", F.col("name").alias("path")).distinct()
    items = parts.where("part = 'manifest'")
    listed = items.where("path IS NOT NULL").select("book", "path")
    say = lambda df, rule, subject: df.select("book", F.lit(rule).alias("rule"), F.col(subject).alias("subject"))
    remote = F.rlike("path", F.lit(re.compile("^[a-z][a-z0-9+.-]*:").pattern))
    found = [
        say(listed.where(~remote).join(files, ["book", "path"], "left_anti"), "manifest-missing", "path"),
        say(parts.where("part = 'spine'").join(items.select("book", "id"), ["book", "id"], "left_anti"), "spine-unknown", "id"),
        say(points.where("path IS NOT NULL").where(~remote).join(files, ["book", "path"], "left_anti"), "navigation-missing", "path"),
        say(files.where("path <> 'mimetype' AND path NOT LIKE 'META-INF/%' AND lower(path) NOT LIKE '%.opf'").join(listed, ["book", "path"], "left_anti"), "unlisted", "path"),
        say(items.where("id IS NOT NULL").groupBy("book", "id").count().where("count > 1"), "repeated-id", "id"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def natural_key(path):
    """A path that sorts as people count: every number padded to the same width (column expression)."""
    pieces = F.regexp_extract_all(F.lower(path), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(F.rlike(p, F.lit(r"^\d")), F.lpad(p, 20, "0")).otherwise(p)), "")


def recovered_order(points: DataFrame, parts: DataFrame, entries: DataFrame, suffixes: str = r"\.x?html?$") -> DataFrame:
    """(book, ord, path): an order of reading for books without one: as navigation has it, then the manifest, then by name."""
    documents = entries.where("name IS NOT NULL").where(F.rlike(F.lower("name"), F.lit(suffixes))).select("book", F.col("name").alias("path")).distinct()
    nav = points.where("path IS NOT NULL AND section = 'toc'").select("book", "path", F.lit(0).alias("rank"), F.col("pre").alias("at"))
    listed = parts.where("part = 'manifest' AND path IS NOT NULL").select("book", "path", F.lit(1), "ord")
    every = nav.union(listed).union(documents.select("book", "path", F.lit(2), F.lit(0))).groupBy("book", "path").agg(F.min(F.struct("rank", "at")).alias("place"))
    known = every.join(documents, ["book", "path"])
    by = Window.partitionBy("book").orderBy("place", natural_key(F.col("path")), "path")
    return known.select("book", (F.row_number().over(by) - 1).alias("ord"), "path")


def cover(parts: DataFrame, points: DataFrame) -> DataFrame:
    """(book, path): each book's cover: the item with that property, else the one its metadata names, else a landmark, else
    an image with `cover` in its name."""
    items = parts.where("part = 'manifest' AND path IS NOT NULL").select("book", "id", "path", "media_type", "properties", "ord")
    named = parts.where("part = 'metadata' AND name = 'cover'").select("book", F.col("value").alias("id"))
    picture = F.col("media_type").startswith("image/") & F.contains(F.lower("path"), F.lit("cover"))
    found = items.where(F.array_contains("properties", "cover-image")).select("book", "path", F.lit(0).alias("rank"), "ord")
    found = found.union(items.join(named, ["book", "id"]).select("book", "path", F.lit(1), "ord"))
    found = found.union(points.where("section = 'landmarks' AND path IS NOT NULL").where(F.contains(F.lower("label"), F.lit("cover"))).select("book", "path", F.lit(2), "pre"))
    found = found.union(items.where(picture).select("book", "path", F.lit(3), "ord"))
    return found.groupBy("book").agg(F.min_by("path", F.struct("rank", "ord", "path")).alias("path"))


def _escaped(c):
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def package_text(parts: DataFrame) -> DataFrame:
    """(book, text): package documents written from rows of `SCHEMA`, in the order of `ord`, whose paths are relative to the
    archive and names to the Dublin Core; equal rows give equal text."""
    attr = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), _escaped(c), F.lit('"')), F.lit(""))
    refined = F.coalesce(F.concat(F.lit("#"), F.col("path")), F.lit(None))
    element = F.concat(F.lit("<dc:"), F.col("name"), attr("id", F.col("id")), F.lit(">"), _escaped(F.col("value")), F.lit("</dc:"), F.col("name"), F.lit(">"))
    meta = F.concat(F.lit("<meta"), attr("refines", refined), attr("property", F.col("name")), F.lit(">"), _escaped(F.col("value")), F.lit("</meta>"))
    properties = F.nullif(F.array_join("properties", " "), F.lit(""))
    href = F.array_join(F.transform(F.split("path", "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")
    item = F.concat(F.lit("<item"), attr("id", F.col("id")), attr("href", href), attr("media-type", F.col("media_type")), attr("fallback", F.col("fallback")), attr("properties", properties), F.lit("/>"))
    ref = F.concat(F.lit("<itemref"), attr("idref", F.col("id")), F.when(F.col("linear"), "").otherwise(' linear="no"'), attr("properties", properties), F.lit("/>"))
    dublin = F.rlike("name", F.lit("^[a-z]+$")) & F.col("path").isNull()
    line = F.when(F.col("part") == "metadata", F.when(dublin, element).otherwise(meta)).when(F.col("part") == "manifest", item).otherwise(ref)
    rows = parts.select("book", "part", "ord", line.alias("line"))
    body = lambda part: F.array_join(F.transform(F.filter("rows", lambda r: r["part"] == part), lambda r: r["line"]), "")
    held = rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))).alias("rows"))
    head = '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
    return held.select("book", F.concat(F.lit(head), body("metadata"), F.lit("</metadata><manifest>"), body("manifest"), F.lit("</manifest><spine>"), body("spine"), F.lit("</spine></package>")).alias("text"))
