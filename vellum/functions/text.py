"""Scalar measures and rewrites of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that canonical text folds, from and to.
FOLD_FROM, FOLD_TO = "„”“‟«»‚’‘‛‹›‐‑‒–—―\u00a0\u2007\u202f", '""""""' + "''''''" + "------   "
# Characters without width, which canonical text drops.
INVISIBLE = "[\u00ad\u200b\u200c\u200d\u2060\ufeff]"
# Letters that mark Polish, and how many in 1000 characters do.
POLISH, POLISH_PER_1000 = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", 35
# Windows-1252 characters as they look when their bytes are read as control characters, in code order.
C1_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
C1_FROM, C1_TO = "".join(map(chr, C1_BYTES)), bytes(C1_BYTES).decode("cp1252")
# Phrases of a shop's or a rights holder's notice, in lower case.
NOTICES = ["all rights reserved", "licensed under", "released under", "this work is licensed", "this copy belongs to", "purchased by"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
TOKEN = r"[A-Za-z0-9]{10,120}"
# Marks that open and close a quotation in a message.
QUOTATIONS = ["''", '""', "“”", "„”"]


def canonical(text: Column) -> Column:
    """Ellipses, quotes, dashes and spaces folded, invisible characters dropped, white space made single spaces."""
    folded = F.translate(F.replace(text, F.lit("..."), F.lit("…")), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(F.regexp_replace(folded, INVISIBLE, ""), r"[ \t\n\r\f]+", " "))


def polish_letters(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, POLISH, ""))


def looks_polish(text: Column) -> Column:
    """At least 35 Polish letters in 1000 characters; false for empty texts."""
    return (F.length(text) > 0) & (polish_letters(text) * 1000 >= F.length(text) * POLISH_PER_1000)


def misread(text: Column) -> Column:
    """Characters that are Windows-1252 bytes read as control characters."""
    return F.length(text) - F.length(F.translate(text, C1_FROM, ""))


def reread(text: Column) -> Column:
    return F.translate(text, C1_FROM, C1_TO)


def has_notice(text: Column) -> Column:
    low = F.lower(F.regexp_replace(text, r"[ \t\n\r]+", " "))
    out = F.lit(False)
    for phrase in NOTICES:
        out = out | F.contains(low, F.lit(phrase))
    return out


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({EMAIL})"), 1)


def opaque_tokens(words: Column) -> Column:
    """Words of 10 to 120 letters and digits that have both."""
    return F.filter(words, lambda w: F.rlike(w, F.lit(f"^{TOKEN}$")) & F.rlike(w, F.lit("[A-Za-z]")) & F.rlike(w, F.lit("[0-9]")))


def message_shape(message: Column) -> Column:
    """A message with quotations and numbers taken out, so that like ones group. The kind of mark that comes first in
    `QUOTATIONS` is taken out first; a mark without its partner stays."""
    for a, b in QUOTATIONS:
        message = F.regexp_replace(message, f"{a}[^{b}]*{b}", "…")
    whole = F.regexp_replace(message, "[0-9]+", "\0")
    return F.trim(F.replace(F.regexp_replace(whole, "\0[.,]\0", "\0"), F.lit("\0"), F.lit("N")))


def without_paths(message: Column) -> Column:
    """A message whose words that hold a slash are taken out; quotation marks part words too."""
    parts = F.regexp_extract_all(message, F.lit(r"""([\s'"]+|[^\s'"]+)"""), 1)
    kept = F.transform(parts, lambda p: F.when(F.contains(p, F.lit("/")) | F.contains(p, F.lit("\\")), "…").otherwise(p))
    return F.trim(F.array_join(kept, ""))


def slug(name: Column) -> Column:
    out = F.translate(F.lower(name), "ąćęłńóśźżäöüßáàâéèêëíîïñóôúûç", "acelnoszzaousaaaeeeeiiinoouuc")
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.substring_index(F.substring_index(path, "#", 1), "?", 1), "/"), -1)


def resolve(base: Column, href: Column) -> Column:
    """`href` seen from the file `base`, with . and .. resolved; null beyond the root and for remote targets."""
    bare = F.substring_index(href, "#", 1)
    folder = F.regexp_replace(base, "[^/]*$", "")
    whole = F.when(bare == "", base).when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(folder, bare))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("up"), F.lit(True).alias("ok"))

    def step(s: Column, p: Column) -> Column:
        back = F.struct(F.slice(s["up"], F.lit(1), F.greatest(F.size(s["up"]) - 1, F.lit(0))).alias("up"), (s["ok"] & (F.size(s["up"]) > 0)).alias("ok"))
        return F.when(p == "..", back).otherwise(F.struct(F.concat(s["up"], F.array(p)).alias("up"), s["ok"].alias("ok")))

    return F.aggregate(parts, start, step, lambda s: F.when(~F.rlike(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:|^//")) & s["ok"], F.array_join(s["up"], "/")))
