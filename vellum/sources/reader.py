"""Whole books as relations: one pass over an archive gives rows of every kind that the rest of the library joins.

A book is one row of its bytes and is read by one task; its parts come out as rows tagged with their kind. What is read and
in which order: entries, container, package, metadata, manifest, collections, spine, navigation, guide, cover, encryption,
files of the container's own folder, files that nothing lists, and an order of reading where none is given.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import unicodedata
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.sources import archives, packages, trees

SCHEMA = "book string, kind string, ord int, id string, parent string, name string, value string, path string, media_type string, flag boolean, digest string"
#: Bytes of all of a book's entries together.
TOTAL_BYTES = 2 << 30
# Algorithms that hide fonts and are no protection of rights.
HIDING = ["http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC"]
# Older names of places in a book, by the newer ones.
GUIDE = {
    "cover": "cover", "title-page": "titlepage", "toc": "toc", "text": "bodymatter", "start": "bodymatter", "acknowledgements": "acknowledgments", "bibliography": "bibliography", "colophon": "colophon", "copyright-page": "copyright-page",
    "dedication": "dedication", "epigraph": "epigraph", "foreword": "foreword", "glossary": "glossary", "index": "index", "loi": "loi", "lot": "lot", "notes": "footnotes", "preface": "preface",
}
# What becomes of files in the container's own folder.
META_INF = {"container.xml": "rebuilt", "encryption.xml": "rebuilt", "manifest.xml": "invalidated", "signatures.xml": "invalidated", "rights.xml": "invalidated"}
# Media types by suffix, and types that are so often wrong that the suffix is believed.
TYPES = {
    "xhtml": "application/xhtml+xml", "html": "application/xhtml+xml", "htm": "application/xhtml+xml", "css": "text/css", "ncx": "application/x-dtbncx+xml", "opf": "application/oebps-package+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2", "mp3": "audio/mpeg", "mp4": "video/mp4", "js": "text/javascript", "smil": "application/smil+xml",
}
DOUBTED = frozenset(["", "text/xml", "text/html", "text/x-oeb1-document", "text/x-oeb1-css", "application/octet-stream", "application/xml", "text/plain", "image/jpg"])


def media_type(path: str, declared: str | None) -> str:
    """The declared type unless it is often wrong; then that of the name's suffix."""
    given = (declared or "").strip().lower()
    return TYPES.get(path.rpartition(".")[2].lower(), given or "application/octet-stream") if given in DOUBTED else given


def spellings(path: str) -> list[str]:
    """Other ways to write a path: decoded, composed and decomposed, and without regard to case (last, in lower case)."""
    plain = unquote(path)
    return list(dict.fromkeys([path, plain, *(unicodedata.normalize(f, x) for x in (path, plain) for f in ("NFC", "NFD"))]))


def find(path: str, entries: dict) -> str | None:
    """The entry that a path means: as written, else by another spelling, else the only one that differs in case."""
    found = next((s for s in spellings(path) if s in entries), None)
    if found is None:
        low = {unicodedata.normalize("NFC", s).lower() for s in spellings(path)}
        near = [e for e in entries if unicodedata.normalize("NFC", e).lower() in low]
        found = near[0] if len(near) == 1 else None
    return found


def parse_xml(data: bytes | None) -> tuple[ElementTree.Element | None, bool]:
    """(root, recovered): XML as it stands, else what a lenient reading makes of it."""
    try:
        return ElementTree.fromstring(data or b""), False
    except (ElementTree.ParseError, ValueError, LookupError):
        pass
    if not (data or b"").strip():
        return None, True
    root, _ = trees.parse(data)
    text = trees.serialise(root)
    try:
        return ElementTree.fromstring(re.sub(r"<(/?)[\w-]+:", r"<\1", re.sub(r"\s[\w-]+:([\w-]+)=", r" \1=", text))), True
    except (ElementTree.ParseError, ValueError):
        return None, True


def _entries(content: bytes) -> tuple[dict[str, bytes | None], list[tuple[str, str]]]:
    """Bytes by canonical name (null for what can't be read) and findings (rule, name)."""
    found, notes, total = {}, [], 0
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        return {}, [("unreadable", "")]
    for info in archive.infolist():
        if info.is_dir():
            continue
        name = canonical(info.filename)[0]
        if name is None:
            notes.append(("name-dropped", info.filename))
            continue
        data, reason = archives._bounded(archive, info, min(archives.ENTRY_BYTES, TOTAL_BYTES - total))
        total += len(data or b"")
        if reason:
            notes.append((f"entry-{'too-large' if reason == 'too large' else 'unreadable'}", name))
        if name in found and data != found[name]:
            notes.append(("name-repeated", name))
            continue
        found[name] = data
    return found, notes


def canonical(raw: str) -> tuple[str | None, list[str]]:
    """(name, changes) of an entry's name; null for one that is empty or leads out of the archive."""
    changes, name = [], raw
    for why, new in (("nul", name.split("\0")[0]),):
        if new != name:
            changes.append(why)
            name = new
    for why, pattern, to in (("backslash", r"\\", "/"), ("drive", r"^[A-Za-z]:", ""), ("rooted", r"^/+", ""), ("doubled", r"/{2,}", "/")):
        new = re.sub(pattern, to, name)
        if new != name:
            changes.append(why)
            name = new
    parts: list[str] = []
    for p in name.split("/"):
        if p == "..":
            if not parts:
                return None, [*changes, "escapes"]
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    if name.split("/") != parts:
        changes.append("dots")
    return "/".join(parts) or None, changes


def _collections(package, base: str, parent: str = "") -> list[tuple]:
    rows = []
    for k, c in enumerate(x for x in package if packages._local(x.tag) == "collection"):
        me = f"{parent}/{k}"
        rows.append(("collection", k, me, parent or None, c.get("role"), None, None, None, None, None))
        rows += [("collection-link", j, me, None, None, None, packages._inside(base, x.get("href", ""))[0], None, None, None) for j, x in enumerate(x for x in c if packages._local(x.tag) == "link")]
        rows += _collections(c, base, me)
    return rows


def read_book(content: bytes | None) -> list[tuple]:
    """The rows of `SCHEMA`, without the book, of one archive."""
    entries, notes = _entries(content or b"")
    row = lambda kind, ord_=0, id=None, parent=None, name=None, value=None, path=None, type=None, flag=None, digest=None: (kind, ord_, id, parent, name, value, path, type, flag, digest)  # noqa: E731,A002
    rows = [row("finding", i, name=rule, path=path) for i, (rule, path) in enumerate(notes)]
    rows += [row("entry", i, path=n, flag=d is not None, digest=hashlib.sha256(d).hexdigest() if d is not None else None) for i, (n, d) in enumerate(sorted(entries.items()))]
    container, _ = parse_xml(entries.get("META-INF/container.xml"))
    roots = [canonical(unquote(e.get("full-path", "")))[0] for e in (container.iter() if container is not None else ()) if packages._local(e.tag) == "rootfile"]
    rows += [row("rendition", i, path=p, flag=p in entries) for i, p in enumerate(roots)]
    opf = next((p for p in roots if p in entries), None) or min((n for n in entries if n.lower().endswith(".opf")), key=lambda n: (n.count("/"), len(n), n), default=None)
    if opf is None:
        return [*rows, row("finding", len(notes), name="package-missing")]
    package, recovered = parse_xml(entries[opf])
    if recovered:
        rows.append(row("finding", len(notes), name="package-recovered", path=opf))
    if package is None:
        return rows
    parts = packages.package_rows(opf, ElementTree.tostring(package))
    rows.append(row("package", 0, path=opf, value=package.get("version"), name=next((x.get("page-progression-direction") for x in package.iter() if packages._local(x.tag) == "spine"), None)))
    rows += [row("metadata", o, id=i, parent=p, name=n, value=v) for part, o, i, n, v, p, *_ in parts if part == "metadata"]
    by_id, listed = {}, set()
    for part, o, i, _n, _v, path, kind, fallback, properties, _l in parts:
        if part == "manifest" and path:
            real = None if re.match(r"[a-z][a-z0-9+.-]*:", path) else find(path, entries)
            rows.append(row("manifest", o, id=i, parent=fallback, name=" ".join(properties or []), value=path, path=real, type=media_type(path, kind), flag=i not in by_id))
            if real is None:
                rows.append(row("finding", o, name="manifest-file-missing", path=path))
            by_id.setdefault(i, (real, kind, properties or []))
            listed.add(real)
    spine = [(o, i, by_id.get(i, (None,))[0], linear) for part, o, i, *_x, linear in parts if part == "spine"]
    rows += [row("spine", o, id=i, path=p, flag=bool(linear)) for o, i, p, linear in spine]
    rows += [row("finding", o, name="spine-id-unknown", value=i) for o, i, _p, _l in spine if i not in by_id]
    rows += _collections(package, opf)
    toc: list[tuple] = []
    for real, kind, properties in by_id.values():
        if real and ("nav" in properties or kind == "application/x-dtbncx+xml"):
            if "nav" in properties or not toc:
                data, _ = parse_xml(entries.get(real))
                toc = packages.nav_rows(real, ElementTree.tostring(data) if data is not None else None) or toc
    rows += [row("nav", pre, id=str(pre), parent=None if parent is None else str(parent), name=section, value=label, path=path, type=fragment) for section, pre, parent, _d, label, path, fragment in toc]
    guide = [x for x in package.iter() if packages._local(x.tag) == "reference"]
    rows += [row("landmark", k, name=GUIDE.get(x.get("type", "").lower(), "bodymatter"), value=x.get("title"), path=packages._inside(opf, x.get("href", ""))[0]) for k, x in enumerate(guide)]
    named = next((v for part, _o, _i, n, v, *_ in parts if part == "metadata" and n == "cover"), None)
    cover = next((p for p, _k, props in by_id.values() if p and "cover-image" in props), None) or by_id.get(named, (None,))[0] or next((p for s, _a, _b, _c, label, p, _f in toc if s == "landmarks" and "cover" in label.lower()), None)
    cover = cover or next((p for p, kind, _x in by_id.values() if p and (kind or "").startswith("image/") and "cover" in p.lower()), None)
    if cover:
        rows.append(row("cover", path=cover))
    register, _ = parse_xml(entries.get("META-INF/encryption.xml"))
    for k, e in enumerate(x for x in (register.iter() if register is not None else ()) if packages._local(x.tag) == "encrypteddata"):
        method = next((x.get("Algorithm") for x in e.iter() if packages._local(x.tag) == "encryptionmethod"), None)
        target = next((x.get("URI") for x in e.iter() if packages._local(x.tag) == "cipherreference"), None)
        rows.append(row("encrypted", k, value=method, path=unquote(target or ""), flag=method not in HIDING))
    rows += [row("meta-inf", k, path=n, value=META_INF.get(posixpath.basename(n).lower(), "carried")) for k, n in enumerate(sorted(n for n in entries if n.startswith("META-INF/")))]
    loose = sorted(n for n in entries if n not in listed and n not in ("mimetype", opf) and not n.startswith("META-INF/"))
    rows += [row("unlisted", k, path=n, type=media_type(n, None)) for k, n in enumerate(loose)]
    if not any(p for _o, _i, p, _l in spine):
        digits = lambda p: [(int(x), "") if x.isdigit() else (0, x) for x in re.findall(r"\d+|\D+", p.lower())]
        documents = {n for n in entries if re.search(r"\.x?html?$", n, re.I)}
        order = list(dict.fromkeys([*(p for s, *_x, p, _f in toc if s == "toc"), *(p for p, *_x in by_id.values()), *sorted(documents, key=digits)]))
        rows += [row("recovered", k, path=p) for k, p in enumerate(p for p in order if p in documents)]
    return rows


def books(archives_: DataFrame, book_col: str = "path", content_col: str = "content") -> DataFrame:
    """The rows of all books in `SCHEMA`. A null content or one that is no archive gives one finding."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 6, pa.bool_(), pa.string()]

    def run(batches):
        for batch in batches:
            for book, content in zip(batch.column(0), batch.column(1), strict=True):  # one book at a time
                made = [(book.as_py(), *r) for r in read_book(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

    return archives_.select(F.col(book_col).cast("string"), content_col).mapInArrow(run, SCHEMA)


def of_kind(rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    """The rows of one kind: a relation of its own."""
    return rows.where(F.col("kind") == kind).select("book", *columns)


def is_protected(rows: DataFrame) -> DataFrame:
    """(book, protected): whether anything in a book is encrypted by more than what hides fonts."""
    return rows.groupBy("book").agg(F.max(F.when(F.col("kind") == "encrypted", F.col("flag")).otherwise(F.lit(False))).alias("protected"))


def estimate(content: bytes | None) -> tuple[int, int] | None:
    """(bytes of text, bytes of anything else) that an archive's directory declares: nothing is unpacked. Null for no archive."""
    from vellum.operators import gates

    try:
        infos = zipfile.ZipFile(io.BytesIO(content or b"")).infolist()
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        return None
    is_text = lambda n: n.rpartition(".")[2].lower() in gates.TEXT_SUFFIXES
    return sum(i.file_size for i in infos if is_text(i.filename)), sum(i.file_size for i in infos if not is_text(i.filename))


def picture(data: bytes | None) -> tuple[str, int | None, int | None, int] | None:
    """(format, width, height, frames) of an image by its headers; null for what is none."""
    d = data or b""
    if d[:8] == b"\x89PNG\r\n\x1a\n" and len(d) >= 24:
        return "png", *struct.unpack(">II", d[16:24]), struct.unpack(">I", d[d.index(b"acTL") + 4 :][:4])[0] if b"acTL" in d[:256] else 1
    if d[:4] == b"GIF8" and len(d) >= 10:
        return "gif", *struct.unpack("<HH", d[6:10]), max(1, d.count(b"\x21\xf9\x04"))
    if d[:2] == b"BM" and len(d) >= 26:
        return "bmp", *struct.unpack("<ii", d[18:26]), 1
    if d[:4] == b"RIFF" and d[8:12] == b"WEBP" and len(d) >= 30:
        kind = d[12:16]
        size = (1 + int.from_bytes(d[24:27], "little"), 1 + int.from_bytes(d[27:30], "little")) if kind == b"VP8X" else (struct.unpack("<HH", d[26:30]) if kind == b"VP8 " else (1 + (int.from_bytes(d[21:25], "little") & 0x3FFF), 1 + (int.from_bytes(d[21:25], "little") >> 14 & 0x3FFF)))
        return "webp", size[0] & 0xFFFFFF, size[1] & 0xFFFFFF, max(1, d.count(b"ANMF"))
    if d[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 < len(d) and d[at] == 0xFF:
            if d[at + 1] in {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}:
                height, width = struct.unpack(">HH", d[at + 5 : at + 9])
                return "jpeg", width, height, 1
            at += 2 + int.from_bytes(d[at + 2 : at + 4], "big")
        return "jpeg", None, None, 1
    return None


def font_class(data: bytes | None) -> str | None:
    """The general family that a font's own classification tells: by its `OS/2` table's PANOSE numbers."""
    d = data or b""
    if d[:4] not in (b"\x00\x01\x00\x00", b"OTTO") or len(d) < 12:
        return None
    for k in range(struct.unpack(">H", d[4:6])[0]):
        tag, _, offset, length = struct.unpack(">4sIII", d[12 + 16 * k : 28 + 16 * k].ljust(16, b"\0"))
        if tag == b"OS/2" and length >= 42 and offset + 42 <= len(d):
            family, style, proportion = d[offset + 32], d[offset + 33], d[offset + 35]
            if family == 2 and proportion == 9:
                return "monospace"
            if family == 3:
                return "cursive"
            if family == 4:
                return "fantasy"
            return "sans-serif" if family == 2 and 11 <= style <= 15 else "serif" if family == 2 and 2 <= style <= 10 else None
    return None


def adobe_key(identifier: str) -> bytes:
    """The sixteen bytes of a UUID, by which the older method hides fonts; empty for no UUID."""
    digits = re.sub(r"(?i)urn:uuid:|[^0-9a-f]", "", identifier.strip())
    return bytes.fromhex(digits) if len(digits) == 32 else b""


def encryption_text(hidden: list[str], method: str = HIDING[0]) -> str:
    """The register of a book's hidden fonts; empty where there are none."""
    from xml.sax.saxutils import quoteattr

    rows = "".join(f'<enc:EncryptedData><enc:EncryptionMethod Algorithm="{method}"/><enc:CipherData><enc:CipherReference URI={quoteattr(p)}/></enc:CipherData></enc:EncryptedData>' for p in sorted(hidden))
    return f'<?xml version="1.0" encoding="utf-8"?><encryption xmlns="urn:oasis:names:tc:opendocument:xmlns:container" xmlns:enc="http://www.w3.org/2001/04/xmlenc#">{rows}</encryption>' if hidden else ""


def verified(content: bytes) -> list[str]:
    """What is wrong with a container that was written: nothing if its first entry is the type, stored and as it must be, every
    entry reads back, no name comes twice, and it names a package that is there."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return ["no archive"]
    infos = archive.infolist()
    wrong = [] if infos and infos[0].filename == "mimetype" and infos[0].compress_type == zipfile.ZIP_STORED and not infos[0].extra and archive.read(infos[0]) == b"application/epub+zip" else ["mimetype"]
    names = [i.filename for i in infos]
    wrong += ["names"] if len(set(names)) < len(names) or any(canonical(n)[0] != n for n in names) else []
    wrong += ["damaged"] if archive.testzip() else []
    rows = read_book(content)
    return wrong + ([] if any(r[0] == "package" for r in rows) else ["package"])
