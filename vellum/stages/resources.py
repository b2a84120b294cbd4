"""Fonts, images, notes and concessions to families of readers; profiles of shapes; the chain of stages and its guard."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.sources import binaries, reader, trees

# Suffixes and media types by what a file's first bytes say it is.
TRUE_TYPES = {"png": ("png", "image/png"), "gif": ("gif", "image/gif"), "jpeg": ("jpg", "image/jpeg"), "webp": ("webp", "image/webp"), "bmp": ("bmp", "image/bmp"), "ttf": ("ttf", "font/ttf"), "otf": ("otf", "font/otf"), "woff": ("woff", "font/woff"), "woff2": ("woff2", "font/woff2")}
# What is done for whom.
PROFILES = {"kindle": ["guide", "html5-blocks", "page-break"], "kobo": ["ncx", "guide", "html5-blocks"], "apple": ["apple-fonts"], "legacy": ["ncx", "guide", "html5-blocks", "page-break", "legacy-font-types"]}
# Media types of fonts from before they were registered, and sectioning elements that older readers take for inline ones.
LEGACY_FONTS = {"font/ttf": "application/x-font-truetype", "font/otf": "application/vnd.ms-opentype", "font/woff": "application/font-woff"}
SECTIONING = "article aside figure figcaption footer header hgroup main nav section".split()
# The older name of a place for each newer one; others have none.
GUIDE_TYPES = {new: old for old, new in reversed(reader.GUIDE.items()) if old not in ("start", "notes")}
#: Paragraphs that a document of notes has at least; characters of a paragraph that parts others.
NOTES, SEPARATOR = 5, 12


def measures(chosen: list[str]) -> tuple[set[str], list[str]]:
    """(what is done for the chosen families of readers, names that are none of them)."""
    plain = [n.strip().lower() for n in chosen if n.strip()]
    return {m for n in plain for m in PROFILES.get(n, ())}, [n for n, p in zip([c for c in chosen if c.strip()], plain, strict=True) if p not in PROFILES]


def wanted_by(measure: str) -> list[str]:
    return sorted(n for n, ms in PROFILES.items() if measure in ms)


def guide(landmarks: DataFrame) -> DataFrame:
    """(book, ord, kind, path): landmarks under the older names; the first of each name and target, those without one left out."""
    known = F.create_map(*[F.lit(x) for pair in GUIDE_TYPES.items() for x in pair])
    older = landmarks.withColumn("kind", F.try_element_at(known, F.col("kind"))).where("kind IS NOT NULL")
    return older.groupBy("book", "kind", "path").agg(F.min("ord").alias("ord")).select("book", "ord", "kind", "path")


def sectioning_sheet() -> str:
    return f"{', '.join(SECTIONING)} {{ display: block }}\n"


def true_type(data) -> "F.Column":
    """What a file is by its first bytes: an image's or a font's kind, null for anything else."""
    return F.coalesce(binaries.image_kind(data), binaries.font_kind(data))


def retyped(files: DataFrame) -> DataFrame:
    """(book, path, new_path, media_type): images and fonts under the suffix and the type that their bytes tell."""
    kinds = F.create_map(*[F.lit(x) for k, (s, m) in TRUE_TYPES.items() for x in (k, f"{s} {m}")])
    told = F.split(F.try_element_at(kinds, true_type(F.col("data"))), " ")
    own = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    right = F.get(told, F.lit(0))
    same = (own == right) | ((right == "jpg") & (own == "jpeg"))
    new = F.when(right.isNotNull() & ~same, F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("."), right)).otherwise(F.col("path"))
    return files.select("book", "path", new.alias("new_path"), F.coalesce(F.get(told, F.lit(1)), "media_type").alias("media_type"))


def recovered_fonts(files: DataFrame) -> DataFrame:
    """(book, path, data, recovered) of hidden files (book, path, data, key): those whose bytes are a font once the key is taken
    off are recovered; the others stay as they are, and protected."""
    shown = binaries.unhidden(files.withColumn("plain", F.col("data")), "plain", "key")
    good = binaries.font_kind(F.col("plain")).isNotNull()
    return shown.select("book", "path", F.when(good, F.col("plain")).otherwise(F.col("data")).alias("data"), good.alias("recovered"))


def linked_notes(html: str, notes: dict[str, str]) -> tuple[str, int]:
    """(document, links): the first bare `[N]` of each number that has a note, outside links, becomes a link to it."""
    root, _ = trees.parse(html)
    left, made = dict(notes), 0
    for node in list(root.walk()):
        if node.tag in ("a", "script", "style", "title") or any(a.tag == "a" for a in node.above()):
            continue
        i = 0
        while i < len(node.children):
            text = node.children[i]
            found = next((m for m in re.finditer(r"\[(\d{1,9})\]", text) if m.group(1) in left), None) if isinstance(text, str) else None
            if found:
                link = trees.Node("a", {"href": left.pop(found.group(1)), "epub:type": "noteref"}, [found.group(0)])
                node.children[i : i + 1] = [text[: found.start()], link, text[found.end() :]]
                link.parent = node
                made += 1
                i += 1
            i += 1
    return trees.serialise(root), made


def footnotes(documents: DataFrame, notes: DataFrame) -> DataFrame:
    """(book, path, data, links): documents (book, path, data) with their marks linked to the book's notes (book, number, href),
    of which the first of a number counts. Only books with notes are read."""
    listed = notes.groupBy("book", "number").agg(F.min("href").alias("href")).groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct(F.col("number").cast("string"), "href"))).alias("notes"))  # a book's own
    joined = documents.join(listed, "book").select(F.col("book").cast("string").alias("book"), "path", "data", "notes")

    def run(batches):
        for batch in batches:
            rows = [linked_notes(d or "", dict(n)) for d, n in zip(batch.column("data").to_pylist(), batch.column("notes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("book"), batch.column("path"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["book", "path", "data", "links"])

    return joined.mapInArrow(run, "book string, path string, data string, links int")


def cut_words(nodes: DataFrame) -> DataFrame:
    """(book, path, pre, lhs, rhs): words that the end of a text node cuts at a hyphen, which the next node of the same flow goes
    on with. nodes: (book, path, pre, is_block, is_bare, text), a flow beginning with each block; either node must be bare."""
    from pyspark.sql import Window

    by = Window.partitionBy("book", "path").orderBy("pre")
    flow = F.sum(F.col("is_block").cast("int")).over(by)
    marked = nodes.withColumn("flow", flow)
    after = Window.partitionBy("book", "path", "flow").orderBy("pre")
    both = marked.withColumn("next", F.lead("text").over(after)).withColumn("next_bare", F.lead("is_bare").over(after))
    lhs, rhs = F.regexp_extract("text", r"([\p{L}]{2,})-$", 1), F.regexp_extract("next", r"^(\p{Ll}[\p{L}]+)", 1)
    return both.where((lhs != "") & (rhs != "") & (F.col("is_bare") | F.col("next_bare"))).select("book", "path", "pre", lhs.alias("lhs"), rhs.alias("rhs"))


def editable(nodes: DataFrame, language: str | None = None) -> DataFrame:
    """Text nodes (book, path, pre, post, tag, lang, text) that may be retyped: none below code, preformatted or other protected
    elements, and none below one in another language."""
    from vellum.sources import elements

    protected = F.col("tag").isin("code", "pre", "kbd", "samp", "var", "script", "style", "math", "svg", "textarea")
    foreign = F.lit(False) if language is None else F.col("lang").isNotNull() & (F.substring_index(F.lower("lang"), "-", 1) != language.split("-")[0].lower())
    held = nodes.withColumn("tag", F.when(protected | foreign, "\0held").otherwise(F.col("tag"))).withColumn("page_id", F.concat_ws("\0", "book", "path"))
    free = elements.outside(held, ["\0held"]).select("book", "path", "pre")
    return nodes.join(free, ["book", "path", "pre"], "left_semi")


def profile(paragraphs: DataFrame, key: str) -> DataFrame:
    """(key, paragraphs, indented, spaced, separators, headings): shapes of paragraphs (key, text, indent, space, bold, centred):
    indented by more than a fifth of an em, spaced by more than half of one, short ones that only part others, and those that
    look like headings."""
    text = F.trim(F.col("text"))
    short = (F.length(text) <= SEPARATOR) & (text != "") & ~F.rlike(text, F.lit(r"[\p{L}\p{N}]"))
    head = (F.length(text).between(1, 80)) & ~F.rlike(text, F.lit(r"[.!?…:;,]$")) & (F.col("bold") | F.col("centred"))
    return paragraphs.groupBy(key).agg(F.count("*").alias("paragraphs"), F.count_if(F.col("indent") > 0.2).alias("indented"), F.count_if(F.col("space") > 0.5).alias("spaced"), F.count_if(short).alias("separators"), F.count_if(head).alias("headings"))


def class_census(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """(book, name, tags, properties, first, uses) of classes: the elements that carry one, what it declares, and where it is
    used first. Kinds of elements and properties are as few as their languages have."""
    carried = uses.groupBy("book", "name").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"), F.min("ord").alias("first"), F.count("*").alias("uses"))
    says = declared.groupBy("book", "name").agg(F.array_join(F.array_sort(F.collect_set("prop")), ",").alias("properties"))
    return carried.join(says, ["book", "name"], "left")


@dataclass(frozen=True)
class Stage:
    """A step over a book's relation: its name, whether it may change anything, and what it does."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    mutates: bool = True


def run_stages(rows: DataFrame, stages: list[Stage], key: list[str], digest: str = "data") -> tuple[DataFrame, DataFrame]:
    """(rows after all stages, (stage, changed)): how many rows each stage changed. A stage that may change nothing and does
    anyway raises: its rows before and after are compared by digest."""
    report = None
    for stage in stages:
        after = stage.run(rows)
        old = rows.select(*key, F.xxhash64(digest).alias("__a"))
        changed = old.join(after.select(*key, F.xxhash64(digest).alias("__b")), key, "full").where(~F.col("__a").eqNullSafe(F.col("__b")))
        if not stage.mutates and not changed.isEmpty():
            raise ValueError(f"the stage {stage.name} says that it changes nothing and does")
        counted = changed.agg(F.count("*").alias("changed")).select(F.lit(stage.name).alias("stage"), "changed")
        report = counted if report is None else report.union(counted)
        rows = after
    return rows, report


