"""What can be counted in books and between a source and its rebuilt book: accessibility, media, shapes, styles, marks, orders."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import markup
from vellum.functions import text as tx
from vellum.sources import batches

# Properties that decide how a page looks.
VISIBLE_PROPERTIES = [
    "display", "float", "text-align", "text-indent", "font-size", "font-weight", "font-style", "font-family", "color", "background-color", "margin-left", "margin-right", "margin-top", "margin-bottom",
    "line-height", "width", "page-break-before", "page-break-after", "list-style-type", "vertical-align",
]
# The share of elements of a kind that a rebuild may lose; characters that stand for an element's text.
TOLERANCE, OPENING = 0.05, 40
# A page without prose has fewer characters than this, and a comic has at least so many such pages.
PICTURE_TEXT, PICTURE_PAGES = 40, 2
#: An attribute's value in a start tag.
ATTRIBUTE = r'(?is)\s{}\s*=\s*"([^"]*)"'
#: An element with text and no element inside: its start tag and its text.
LEAF = r"(?s)<([a-zA-Z][a-zA-Z0-9]*[^>]*)>([^<>]{1,400})</"
LEAVES = r"(?s)(<[a-zA-Z][a-zA-Z0-9]*[^>]*>[^<>]{1,400}</)"


def tags(html: Column, name: str) -> Column:
    """The start tags of elements of one name."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}(?:\s[^>]*)?>)"), 1)


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a start tag; null where it has none."""
    return F.when(F.rlike(tag, F.lit(ATTRIBUTE.format(name))), F.regexp_extract(tag, ATTRIBUTE.format(name), 1))


def accessibility(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """A row a book of what its documents offer: pictures with and without a description, decorative ones, placeholders,
    headings and leaps among them, tables with and without heads, drawings, scripts, sound, film and motion."""
    doc, images = F.coalesce(F.col(html), F.lit("")), tags(F.coalesce(F.col(html), F.lit("")), "img")
    alt = lambda t: F.trim(F.coalesce(attribute(t, "alt"), F.lit("")))
    decorative = lambda t: F.coalesce(F.lower(attribute(t, "role")) == "presentation", F.lit(False)) | F.coalesce(F.lower(attribute(t, "aria-hidden")) == "true", F.lit(False))
    many = lambda test: F.size(F.filter(images, test))
    levels = F.transform(F.regexp_extract_all(doc, F.lit(r"(?i)<h([1-6])[\s>]"), 1), lambda x: x.cast("int"))
    leaps = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0)) + 1), lambda i: F.coalesce(F.get(levels, i) > F.get(levels, i - 1) + 1, F.lit(False))))
    tables = F.regexp_extract_all(doc, F.lit(r"(?is)(<table[\s>].*?</table>)"), 1)
    has = lambda p: F.rlike(doc, F.lit(p))
    each = pages.select(
        key, F.size(images).alias("images"), many(lambda t: (alt(t) == "") & ~decorative(t)).alias("undescribed"), many(lambda t: (alt(t) == "") & decorative(t)).alias("decorative"),
        many(lambda t: (alt(t) != "") & markup.is_placeholder(alt(t), attribute(t, "src"))).alias("placeholders"), F.size(levels).alias("headings"), leaps.alias("leaps"), F.size(tables).alias("tables"),
        F.size(F.filter(tables, lambda t: ~F.rlike(t, F.lit(r"(?i)<th[\s>]")))).alias("headless"), F.size(tags(doc, "svg")).alias("drawings"), has(r"(?i)<math[\s>]").alias("mathml"), has(r"(?i)<script[\s>]").alias("scripted"),
        has(r"(?i)<audio[\s>]").alias("audio"), has(r"(?i)<video[\s>]").alias("video"), has(r"(?i)(animation|transition)(-[a-z-]+)?\s*:").alias("motion"),
    )
    sums = ["images", "undescribed", "decorative", "placeholders", "headings", "leaps", "tables", "headless", "drawings"]
    flags = ["mathml", "scripted", "audio", "video", "motion"]
    return each.groupBy(key).agg(F.count("*").alias("documents"), *[F.sum(c).cast("long").alias(c) for c in sums], *[F.max(c).alias(c) for c in flags])


def declared(survey: DataFrame, key: str) -> DataFrame:
    """(key, modes, sufficient, features, hazards): what a book may claim. A description of every picture is claimed only where
    none lacks one, and the absence of hazards only where nothing could move."""
    pictures, bare = (F.col("images") > 0) | (F.col("drawings") > 0), F.col("undescribed") + F.col("placeholders") + F.col("drawings")
    described = pictures & (bare == 0)
    listed = lambda **tests: F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c in tests.items()]))), ",")
    always = F.lit(True)
    features = listed(tableOfContents=always, readingOrder=always, structuralNavigation=F.col("headings") > 0, alternativeText=described, MathML=F.col("mathml"), displayTransformability=always)
    moving = F.col("video") | F.col("scripted") | F.col("motion")
    return survey.select(key, listed(textual=always, visual=pictures, auditory=F.col("audio")).alias("modes"), F.when(described | ~pictures, "textual").otherwise("textual,visual").alias("sufficient"), features.alias("features"), F.when(moving, "unknown").otherwise("none").alias("hazards"))


def gaps(survey: DataFrame, key: str) -> DataFrame:
    """(key, gap, n): what a book lacks for readers who can't see its pages."""
    found = {"undescribed": F.col("undescribed"), "placeholders": F.col("placeholders"), "leaps": F.col("leaps"), "headless": F.col("headless")}
    return survey.select(key, F.explode(F.array(*[F.struct(F.lit(g).alias("gap"), n.alias("n")) for g, n in found.items()])).alias("g")).select(key, "g.gap", "g.n").where("n > 0")


def marks(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, notices, tokens): elements without elements inside that say a visible notice, and opaque tokens set too small to read."""
    leaves = F.regexp_extract_all(F.col(html), F.lit(LEAVES), 1)
    each = pages.select(key, F.explode(leaves).alias("leaf")).select(key, F.regexp_extract("leaf", LEAF, 1).alias("tag"), F.trim(F.regexp_extract("leaf", LEAF, 2)).alias("text")).where("text <> ''")
    notice = markup.is_visible_notice(F.col("text"))
    token = F.rlike("text", F.lit("^[A-Za-z0-9+/=_-]{10,120}$")) & F.rlike("text", F.lit("[A-Za-z]")) & F.rlike("text", F.lit("[0-9]"))
    small = markup.is_unreadable(F.coalesce(attribute(F.concat(F.lit("<"), "tag", F.lit(">")), "style"), F.lit("")))
    return each.groupBy(key).agg(F.count_if(notice).alias("notices"), F.count_if(~notice & token & small).alias("tokens"))


def media_survive(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book, digest, name): pictures and fonts of the source (book, digest, name) of which the rebuilt book has no equal bytes."""
    return before.groupBy("book", "digest").agg(F.min("name").alias("name")).join(after.select("book", "digest"), ["book", "digest"], "left_anti")


def shapes_survive(before: DataFrame, after: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(book, tag, was, now): kinds of elements, counted on both sides from (book, tag) rows, of which too many are gone."""
    both = before.select("book", "tag", F.lit(1).alias("b"), F.lit(0).alias("a")).union(after.select("book", "tag", F.lit(0), F.lit(1)))
    sums = both.groupBy("book", "tag").agg(F.sum("b").alias("was"), F.sum("a").alias("now"))
    return sums.where((F.col("was") > 0) & (F.col("now") < F.col("was") * (1 - tolerance)))


def styles_survive(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book, tag, opening, prop, was, now) from (book, tag, text, prop, value): visible properties that no longer reach an
    element that both books have. Elements are the same by their tag and the beginning of their text."""
    def keyed(side: DataFrame, name: str) -> DataFrame:
        rows = side.where(F.col("prop").isin(VISIBLE_PROPERTIES)).withColumn("opening", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, OPENING)).where("opening <> ''")
        return rows.groupBy("book", "tag", "opening", "prop").agg(F.max("value").alias(name))

    key = ["book", "tag", "opening"]
    there = keyed(after, "now")
    known = after.select("book", "tag", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, OPENING).alias("opening")).distinct()
    return keyed(before, "was").join(known, key, "left_semi").join(there, [*key, "prop"], "left").where(~F.lower("was").eqNullSafe(F.lower("now"))).select(*key, "prop", "was", "now")


def missing_words(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book, word, at): words of the source (book, at, word) that the rebuilt book (book, word) has nowhere, by first place."""
    first = before.groupBy("book", "word").agg(F.min("at").alias("at"))
    return first.join(after.select("book", "word").distinct(), ["book", "word"], "left_anti")


def opening_words(text: Column, n: int = 12) -> Column:
    """The first words of a document, which tell it from others."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1), 1, n), " ")


def order_survives(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book, out_of_order): documents (book, ord, opening) of the source that don't follow in the rebuilt book as they did.

    A book's openings are two short lists, walked once: each source document must come after the last one found.
    """
    lists = lambda side, name: side.where("opening <> ''").groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "opening"))), lambda d: d["opening"]).alias(name))
    both = lists(before, "b").join(lists(after, "a"), "book", "left").withColumn("a", F.coalesce("a", F.array().cast("array<string>")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("lost"))

    def step(s: Column, opening: Column) -> Column:
        left = F.slice(F.col("a"), s["at"] + 1, F.size("a"))
        place = F.array_position(left, opening).cast("int")
        return F.struct((s["at"] + place).alias("at"), (s["lost"] + (place == 0).cast("int")).alias("lost"))

    return both.select("book", F.aggregate("b", start, step, lambda s: s["lost"]).alias("out_of_order"))


def matching(x: list, y: list) -> list[tuple[int, int]]:
    """Places of two lists that correspond by the longest matching blocks. Where nothing repeats on its side and what is shared
    comes in one order, these blocks hold all that is shared, which a look-up finds."""
    at = {v: j for j, v in enumerate(y)}
    if len(at) == len(y) and len(set(x)) == len(x):
        pairs = [(i, at[v]) for i, v in enumerate(x) if v in at]
        if all(p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False)):
            return pairs
    return [(m.a + k, m.b + k) for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() for k in range(m.size)]


def aligned(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book, before_ord, after_ord): documents of two reading orders (book, ord, opening) that correspond, by the longest
    matching blocks; what has no partner has none. A book's openings are one row, and Python takes many books at once."""
    side = lambda s, kind: s.select(F.col("book").cast("string").alias("book"), F.lit(kind).alias("side"), F.struct(F.col("ord").cast("long").alias("ord"), "opening").alias("d"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("side") == kind, F.col("d")))).alias(kind)
    books = side(before, "b").union(side(after, "a")).groupBy("book").agg(of("b"), of("a")).where((F.size("b") > 0) & (F.size("a") > 0))
    names, types = ["book", "before_ord", "after_ord"], [pa.string(), pa.int64(), pa.int64()]

    def pair(arrived):
        every = ((book, b[i], a[j]) for batch in arrived for book, b, x, a, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, j in matching(x, y))
        yield from batches.gathered(every, types, names)

    return books.select("book", "b.ord", "b.opening", "a.ord", "a.opening").toDF("book", "b", "x", "a", "y").mapInArrow(pair, "book string, before_ord long, after_ord long")


def checks(**found: DataFrame) -> DataFrame:
    """(book, check, failures): the rows of several checks, counted by book; a check without rows has none."""
    out = None
    for name, rows in found.items():
        counted = rows.groupBy("book").agg(F.count("*").alias("failures")).select("book", F.lit(name).alias("check"), "failures")
        out = counted if out is None else out.union(counted)
    return out


def mostly_pictures(pages: Column, documents: Column, characters: Column) -> Column:
    """Whether a book is a comic: pages of pictures, and hardly a character on any."""
    return (documents > 0) & (pages >= PICTURE_PAGES) & (characters < PICTURE_TEXT * documents)


def inventory(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """A row a book of what its documents hold: structure, damage and typography, in one scan with partial sums.

    Names of classes are told apart in a second, narrow grouping.
    """
    doc = F.coalesce(F.col(html), F.lit(""))
    prose = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(doc, r"(?is)<(script|style|title)[\s>].*?</(script|style|title)>", " "), "<[^>]+>", " "), r"\s+", " "))
    images, spans = tags(doc, "img"), tags(doc, "span")
    n = lambda c, p: F.regexp_count(c, F.lit(p))
    each = pages.select(key, doc.alias("d"), prose.alias("t"), images.alias("i"), spans.alias("s"))
    t, d = F.col("t"), F.col("d")
    long_ = lambda c, name: F.sum(c).cast("long").alias(name)
    facts = each.groupBy(key).agg(
        F.count("*").alias("documents"), long_(F.octet_length(d), "bytes"), long_(n(d, r"(?i)<(p|div|h[1-6]|li|blockquote|td|th)[\s>]"), "blocks"), long_(n(d, r"(?i)<p(\s[^>]*)?>\s*</p>"), "empty_paragraphs"),
        long_(F.size("i"), "images"), long_(F.size(F.filter("i", lambda x: attribute(x, "alt").isNull())), "images_without_alt"), long_(F.size(F.filter("i", lambda x: F.trim(attribute(x, "alt")) == "")), "images_empty_alt"),
        long_(((F.size("i") > 0) & (F.length(t) < PICTURE_TEXT)).cast("int"), "image_pages"), long_(F.size("s"), "spans"),
        long_(F.size(F.filter("s", lambda x: ~F.rlike(x, F.lit(r"(?i)\s(id|lang|role|aria-hidden|epub:type)\s*=")))), "bare_spans"), long_(n(d, r"(?i)<span[^>]*>\s*<span[\s>]"), "nested_spans"), long_(n(d, r'(?i)\sstyle="'), "inline_styles"),
        long_(n(d, r'(?i)\s(align|bgcolor|face|valign|border)="'), "presentational_attributes"), long_(n(d, r"(?i)font-size\s*:\s*[\d.]+(px|pt)"), "absolute_font_sizes"), long_(n(d, r"(?i)page-break-(before|after)\s*:\s*always"), "forced_page_breaks"),
        long_(n(d, r"(?i)<a\s[^>]*href="), "links"), long_(n(d, r"(?i)<table[\s>]"), "tables"), long_(n(d, r"(?i)<h[1-6][\s>]"), "headings"), long_(n(d, r"(?i)<script[\s>]"), "scripts"), long_(n(d, r"(?i)<(br)[\s/>]"), "breaks"),
        long_(F.length(t), "characters"), long_(F.length(t) - F.length(F.replace(t, F.lit("…"), F.lit(""))), "ellipses"), long_(n(t, r"\.\.\."), "ellipsis_dots"), long_(n(t, " "), "bound_spaces"), long_(n(t, "­"), "soft_hyphens"),
        long_(n(t, "​"), "zero_width"), long_(n(t, "[–—]"), "dashes"), long_(n(t, '"'), "straight_quotes"), long_(n(t, "[„“”«»]"), "curly_quotes"), long_(tx.polish_letters(t), "polish_letters"), long_(tx.misread(t), "misread"),
        long_(n(t, r"[\p{L}]- [\p{Ll}]"), "broken_hyphens"), long_(F.size(tx.emails(t)), "emails"), F.count_if(markup.is_visible_notice(t)).alias("with_notice"), F.count_if(F.rlike(d, F.lit("(?i)isbn"))).alias("with_isbn"),
        F.max(F.rlike(d, F.lit(r"(?i)<nav[\s>]"))).alias("has_nav"), F.max(F.rlike(d, F.lit(r"(?i)dir\s*=\s*.rtl"))).alias("rtl"),
    )
    classes = pages.select(key, F.explode(F.regexp_extract_all(doc, F.lit(r'(?i)\sclass="([^"]*)"'), 1)).alias("c")).select(key, F.explode(F.split("c", r"\s+")).alias("name")).where("name <> ''").distinct()
    meaningless = F.rlike("name", F.lit(r"(?i)^(c|p|s|t|x|calibre|class|style|para|span|sgc-?)_?-?\d+$"))
    counted = classes.groupBy(key).agg(F.count("*").alias("distinct_classes"), F.count_if(meaningless).alias("meaningless_classes"))
    out = facts.join(counted, key, "left").fillna(0, ["distinct_classes", "meaningless_classes"])
    ratio = lambda a, b, scale, digits: F.when(F.col(b) > 0, F.round(scale * F.col(a) / F.col(b), digits)).otherwise(0.0)
    return (
        out.withColumn("spans_per_block", ratio("spans", "blocks", 1.0, 2)).withColumn("classes_per_100_blocks", ratio("distinct_classes", "blocks", 100.0, 1)).withColumn("polish_per_1000", ratio("polish_letters", "characters", 1000.0, 2))
        .withColumn("comic", mostly_pictures(F.col("image_pages"), F.col("documents"), F.col("characters")))
    )
