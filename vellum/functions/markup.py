"""Judgements on text nodes, attributes, declared styles and bytes of documents, as column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases by which a shop names a sale.
SHOP = [
    "this document is protected using an electronic watermark", "this document is protected", "electronic watermark", "order ##", "order number", "licensed to", "purchased by", "generated for", "sold to",
    "this copy was prepared for", "zamówienie nr", "nr zamówienia", "numer zamówienia", "zakupione dla", "zakupione przez", "zakupiony przez", "zakupiona przez", "wygenerowane dla", "wygenerowano dla",
    "przygotowane dla", "egzemplarz dla", "kopia dla", "znak wodny", "znakiem wodnym", "dokument jest chroniony", "dokument zabezpieczony",
]
# Phrases of a mark that is meant to be seen.
VISIBLE = ["watermark", "znak wodny", "znakiem wodnym", "electronic watermark", "order ##", "zamówienie nr", "nr zamówienia", "this document is protected", "dokument jest chroniony", "kopia dla", "licensed to"]
# Words that stand in for a description of a picture.
PLACEHOLDERS = [
    "image", "img", "picture", "photo", "graphic", "illustration", "figure", "cover", "okladka", "okładka", "obraz", "obrazek", "ilustracja", "zdjęcie", "rysunek", "grafika", "untitled", "bez tytułu", "beztytułu",
]
# Suffixes of files by kind, and the part of a media type that tells it.
KINDS = {"documents": ["xhtml", "html", "htm"], "images": ["jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "tif", "tiff"], "fonts": ["ttf", "otf", "woff", "woff2"], "stylesheets": ["css"]}
# Characters that XML 1.0 does not allow.
ILLEGAL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\ufffe\uffff]"
# Elements that style sheets make blocks of by themselves.
BLOCKS = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary ul".split()
# Linking endings and particles that make a hyphenated word read as a compound.
LINKING, PARTICLES = ["o", "i"], ["pol", "poł", "pół", "eks", "pseudo", "anty", "nie"]
# What a property has before anything is declared.
INITIAL = {"font-style": "normal", "font-weight": "normal", "text-decoration": "none", "text-transform": "none", "font-variant": "normal", "float": "none", "display": "inline", "vertical-align": "baseline", "letter-spacing": "normal", "word-spacing": "normal", "background-color": "transparent"}


def illegal_count(text: Column) -> Column:
    """Characters that XML can't hold."""
    return F.length(text) - F.length(legal(text))


def legal(text: Column) -> Column:
    return F.regexp_replace(text, ILLEGAL, "")


def _has_any(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def is_shop_notice(text: Column) -> Column:
    return _has_any(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), SHOP)


def is_visible_notice(text: Column) -> Column:
    return _has_any(F.lower(text), VISIBLE)


def reads_as_prose(text: Column) -> Column:
    """At least three words, of which one is three or more lower-case letters."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return (F.size(words) >= 3) & F.exists(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.rlike(w, F.lit("^[a-ząćęłńóśźż]{3,}$")))


def without_notices(text: Column) -> Column:
    """(kept, removed) of a text: what a shop stamped into it goes, sentence by sentence.

    A sentence with one of the phrases is cut in front of the first of them and after what trails it: words with a digit,
    `@` or `#`. What is left on either side stays if it reads as prose. A null text gives nothing kept and nothing removed.
    """
    phrase = "|".join(sorted(SHOP, key=len, reverse=True)).replace(" ", r"\s+")
    sentences = F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n+"), lambda s: F.trim(s)), lambda s: s != "")  # F.trim alone would take a sentence's number for the letters to trim

    def cut(s: Column) -> Column:
        part = lambda k: F.regexp_extract(s, rf"(?is)^(.*?)({phrase})((?:[\s.,:;–—-]*[^\s\d@#]*[\d@#]\S*[\s.,:;]*)*)(.*)$", k)
        before, after = F.trim(part(1)), F.trim(part(4))
        keep_before, keep_after = reads_as_prose(before), reads_as_prose(after)
        empty = F.lit("")
        gone = F.trim(F.concat(F.when(keep_before | (before == ""), empty).otherwise(F.concat(before, F.lit(" "))), F.trim(F.concat(part(2), part(3))), F.when(keep_after | (after == ""), empty).otherwise(F.concat(F.lit(" "), after))))
        kept = F.filter(F.array(F.when(keep_before, before).otherwise(empty), F.when(keep_after, after).otherwise(empty)), lambda x: x != "")
        return F.struct(kept.alias("kept"), F.array(gone).alias("gone"))

    none = F.array().cast("array<string>")
    parts = F.transform(sentences, lambda s: F.when(is_shop_notice(s), cut(s)).otherwise(F.struct(F.array(s).alias("kept"), none.alias("gone"))))
    flat = lambda name: F.coalesce(F.flatten(F.transform(parts, lambda p: p[name])), none)
    return F.struct(F.array_join(flat("kept"), " ").alias("kept"), flat("gone").alias("removed"))


def is_unreadable(style: Column) -> Column:
    """Whether an inline style hides its element: not displayed, not visible, or set in no more than two pixels or points."""
    low = F.lower(style)
    hidden = F.rlike(low, F.lit(r"display\s*:\s*none|visibility\s*:\s*hidden"))
    sizes = F.regexp_extract_all(low, F.lit(r"font-size\s*:\s*(\d*\.?\d+\s*(?:px|pt|em|rem|%)?)\s*(?:!\s*important)?\s*(?:;|$)"), 1)
    number = lambda s: F.regexp_extract(s, r"^[\d.]+", 0).try_cast("double")
    tiny = F.exists(sizes, lambda s: (number(s) == 0) | (F.rlike(s, F.lit("p[xt]$")) & (number(s) <= 2)))
    return F.coalesce(hidden | tiny, F.lit(False))


def is_placeholder(alt: Column, source: Column) -> Column:
    """Whether a picture's description only names a file, a kind of picture or a number."""
    text = F.lower(F.trim(alt))
    stem = F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"\.[^.]*$", "")
    named = F.regexp_replace(text, r"\s+", " ").isin(PLACEHOLDERS) | F.rlike(text, F.lit(r"^[a-z0-9._-]+\.(jpg|jpeg|png|gif|svg|webp)$"))
    return F.coalesce(named | F.rlike(text, F.lit(r"^[a-z]{1,12}[\s._-]*[0-9]{1,3}$")), F.lit(False)) | F.coalesce((stem != "") & (text == F.lower(stem)), F.lit(False))


def is_animated(data: Column) -> Column:
    """Whether a GIF has several frames with a control block, or a WebP an animation chunk near its start."""
    digits, first = F.hex(data), F.hex(F.substring(data, 1, 12))
    frames = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(digits) / 2, F.lit(1)).cast("int")), lambda i: F.substr(digits, 2 * i - 1, F.lit(6)) == "21F904"))
    head = F.hex(F.substring(data, 1, 512))
    moving = F.rlike(head, F.lit("^(..)*(414E494D|414E4D46)"))
    gif, webp = F.startswith(first, F.lit("47494638")), F.rlike(first, F.lit("^52494646........57454250"))
    return F.coalesce(F.when(gif, frames > 1).when(webp, moving), F.lit(False))


def resource_kind(path: Column, media_type: Column) -> Column:
    """`documents`, `images`, `fonts`, `stylesheets` or `other`: by the media type, else by the name's suffix."""
    media, suffix = F.lower(F.coalesce(media_type, F.lit(""))), F.lower(F.element_at(F.split(path, r"\."), -1))
    has = lambda *xs: F.rlike(media, F.lit("|".join(xs)))
    out = F.when(has("html"), "documents").when(has("^image/"), "images").when(has("font", "opentype"), "fonts").when(has("css"), "stylesheets")
    for kind, suffixes in KINDS.items():
        out = out.when(suffix.isin(suffixes), kind)
    return out.otherwise("other")


def is_zero_length(value: Column) -> Column:
    """`0`, with or without a unit or a fraction of zeros."""
    return F.coalesce(F.rlike(F.trim(value), F.lit(r"^[+-]?(0+\.?0*|\.0+)([a-zA-Z]+|%)?$")), F.lit(False))


def display_of(tag: Column, inline: Column, declared: Column) -> Column:
    """How an element is displayed: as its own style says, else as the sheets do (`declared`), else by its kind."""
    own = F.nullif(F.regexp_extract(F.lower(inline), r"(?:^|;)\s*display\s*:\s*([a-z-]+)", 1), F.lit(""))
    return F.coalesce(own, F.lower(F.trim(declared)), F.when(tag.isin(BLOCKS), "block").when(tag == "li", "list-item").when(F.startswith(tag, F.lit("t")) & tag.isin("table", "tr", "td", "th"), "table").otherwise("inline"))


def is_block(display: Column) -> Column:
    return display.isin("block", "list-item", "table", "flex", "grid", "flow-root")


def is_inert(prop: Column, value: Column, inherited: Column) -> Column:
    """Whether a declaration changes nothing: it says what the property has anyway, or what the element inherits."""
    text = F.lower(F.trim(value))
    initial = F.try_element_at(F.create_map(*[F.lit(x) for pair in INITIAL.items() for x in pair]), prop)
    return F.coalesce(text == F.lower(F.trim(inherited)), F.coalesce(text == initial, F.lit(False)) & inherited.isNull(), F.lit(False)) | F.coalesce(text.isin("inherit", "unset"), F.lit(False))


def colour(value: Column) -> Column:
    """(red, green, blue) of `#rgb`, `#rrggbb` or `rgb(…)`; null for anything else."""
    text = F.lower(F.trim(value))
    digits = F.when(F.rlike(text, F.lit("^#[0-9a-f]{6}$")), F.substr(text, F.lit(2))).when(F.rlike(text, F.lit("^#[0-9a-f]{3}$")), F.regexp_replace(F.substr(text, F.lit(2)), "(.)", "$1$1"))
    of_hex = F.struct(*[F.conv(F.substring(digits, k, 2), 16, 10).cast("int").alias(n) for k, n in ((1, "red"), (3, "green"), (5, "blue"))])
    parts = F.regexp_extract_all(text, F.lit("([0-9]+)"), 1)
    of_numbers = F.struct(*[F.least(F.get(parts, F.lit(k)).cast("int"), F.lit(255)).alias(n) for k, n in enumerate(("red", "green", "blue"))])
    return F.when(digits.isNotNull(), of_hex).when(F.rlike(text, F.lit(r"^rgb\(\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*\)$")), of_numbers)


def size_in_rem(value: Column) -> Column:
    """An absolute font size as `rem` to four places, a point being four thirds of a pixel; null for any other value."""
    text = F.lower(F.trim(value))
    number = F.regexp_extract(text, r"^(\d*\.?\d+)\s*(px|pt)$", 1).try_cast("double")
    pixels = F.when(text.endswith("pt"), number * 4 / 3).otherwise(number)
    return F.round(pixels / 16, 4)


def reads_as_compound(left: Column) -> Column:
    """Whether the first half of a hyphenated word looks like that of a compound: a particle, or a linking vowel at its end."""
    low = F.lower(left)
    linked = F.lit(False)
    for ending in LINKING:
        linked = linked | (low.endswith(ending) & (F.length(left) > len(ending) + 1))
    return low.isin(PARTICLES) | linked


def retyped(text: Column, opening: str, closing: str, inside: Column | None = None) -> Column:
    """(text, replaced, inside): straight quotation marks become the pair's in turn; `inside` says whether one is open."""
    parts = F.split(text, '"', -1)
    start = F.when(F.lit(False) if inside is None else inside, 1).otherwise(0)
    made = F.transform(parts, lambda p, i: F.when(i == 0, p).when((i + start) % 2 == 1, F.concat(F.lit(opening), p)).otherwise(F.concat(F.lit(closing), p)))
    count = F.size(parts) - 1
    return F.struct(F.array_join(made, "").alias("text"), count.alias("replaced"), ((count + start) % 2 == 1).alias("inside"))


def modern_doctype(html: Column) -> Column:
    """The document with whatever document type it names replaced by the plain one."""
    return F.regexp_replace(html, r"(?i)<!doctype[^>\[]*(\[[^\]]*\])?[^>]*>", "<!DOCTYPE html>")


def filled_title(html: Column, title: Column) -> Column:
    """The document with an empty title filled in; a title that says something stays."""
    empty = F.rlike(html, F.lit(r"(?i)<title[^>]*>\s*</title>|<title[^>]*/>"))
    made = F.concat(F.lit("<title>"), F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</title>"))
    mark = "\x00"
    return F.when(empty, F.replace(F.regexp_replace(html, r"(?i)<title[^>]*>\s*</title>|<title[^>]*/>", mark), F.lit(mark), made)).otherwise(html)


def entities(html: Column) -> Column:
    """The names of the entities in a document."""
    return F.regexp_extract_all(html, F.lit("&([A-Za-z][A-Za-z0-9]*);"), 1)


def unresolvable(html: Column) -> Column:
    """Entities that neither XML nor HTML 4 knows, each once, in order of name."""
    known = F.array(*[F.lit(n) for n in sorted({*name2codepoint, "apos"})])
    return F.array_sort(F.array_except(F.array_distinct(entities(html)), known))


def numeric_entities(html: Column) -> Column:
    """The document with HTML's named entities as numbers; XML's own five and unknown ones stay."""
    table = {n: f"&#{c};" for n, c in name2codepoint.items() if n not in ("amp", "lt", "gt", "quot")}
    known = F.create_map(*[F.lit(x) for n, c in sorted(table.items()) for x in (f"&{n};", c)])
    parts = F.regexp_extract_all(html, F.lit("(?s)(&[A-Za-z][A-Za-z0-9]*;|[^&]+|&)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


def title_of(html: Column, path: Column) -> Column:
    """What a document is called: its title, else its first heading of the first or second level, else its file's name."""
    def inner(tag: str) -> Column:
        found = F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
        return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(found, "<[^>]+>", ""), r"\s+", " ")), F.lit(""))

    name = F.replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), F.lit("-"), F.lit(" "))
    return F.substring(F.coalesce(inner("title"), inner("h1"), inner("h2"), name), 1, 200)
