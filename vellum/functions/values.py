"""Values that books declare: dates, identifiers, lengths, selectors, quotation marks (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the months.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# Ems a unit stands for, roughly; an absent unit counts for nothing.
EMS = {"em": 1.0, "rem": 1.0, "ex": 0.5, "ch": 0.5, "pt": 1 / 12, "px": 1 / 16, "in": 6.0, "cm": 2.4, "mm": 0.24}
# Quotation marks, and the pair of marks of each convention.
QUOTES = {"bottom66": "„", "top66": "“", "top99": "”", "angles_out": "«", "angles_in": "»", "upright": '"'}
CONVENTIONS = {"polish": ("bottom66", "top99"), "german": ("bottom66", "top66"), "english": ("top66", "top99"), "french": ("angles_out", "angles_in"), "straight": ("upright", "upright")}


def _day(year: Column, month: Column, day: Column) -> Column:
    """The three numbers as `yyyy-MM-dd`; null where they are no day of the calendar."""
    made = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & F.try_to_timestamp(made, F.lit("yyyy-MM-dd")).isNotNull(), made)


def normal_date(raw: Column) -> Column:
    """A date as `yyyy-MM-dd`, `yyyy-MM` or `yyyy`, as exact as it was given; else the first likely year in it; else null.

    A text is taken apart into runs of letters and runs of digits. The shape of these runs (how many digits each has, and
    what parts them) says which is the year, the month and the day.
    """
    text = F.lower(F.trim(raw))
    date = F.regexp_replace(F.regexp_replace(text, r"(?<=\d)t\d+:\d+.*$", ""), r"(?<=[-/]\d{1,2})z$", "")
    runs = F.regexp_extract_all(date, F.lit(r"(\d+|[a-z]+)"), 1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(date, r"\d{4}", "Y"), r"\d{1,2}", "N"), r"[a-z]+", "M")
    at = lambda i: F.get(runs, F.lit(i))
    named = lambda i: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), at(i)), F.lit(0)).cast("string")
    month = F.lpad(at(1), 2, "0")
    found = F.when(shape == "Y", date).when((shape == "Y-N") & month.between("01", "12"), F.concat_ws("-", at(0), month))
    found = found.when(shape == "Y-N-N", _day(at(0), at(1), at(2))).when(shape == "N.N.Y", _day(at(2), at(1), at(0)))
    found = found.when(shape == "N/N/Y", F.coalesce(_day(at(2), at(1), at(0)), _day(at(2), at(0), at(1))))
    found = found.when(shape == "M N, Y", _day(at(2), named(0), at(1))).when(shape == "N M Y", _day(at(2), named(1), at(0)))
    likely = F.filter(F.regexp_extract_all(raw, F.lit(r"(\w+)"), 1), lambda w: F.rlike(w, F.lit(r"^\d{4}$")) & w.between("1000", "2099"))
    return F.coalesce(found, F.get(likely, F.lit(0)))


def identifier_scheme(value: Column) -> Column:
    """`ISBN` or `DOI` by the look of an identifier; null for a UUID, which needs none, and for anything else.

    A name before the number decides: `urn:` and a namespace, or `isbn:`. Without one, hexadecimal digits in groups of
    8, 4, 4, 4 and 12 are a UUID, a number below the directory `10.` is a DOI, and what holds 10 to 13 digits (of which
    the last may be an X), hyphens and spaces only, is an ISBN.
    """
    low = F.lower(F.trim(value))
    space = F.when(F.startswith(low, F.lit("urn:")), F.get(F.split(low, ":"), F.lit(1))).when(F.startswith(low, F.lit("isbn:")), "isbn")
    groups = F.transform(F.split(low, "-"), lambda g: F.when(F.rlike(g, F.lit("^[0-9a-f]+$")), F.length(g)).otherwise(0))
    uuid = groups == F.array(*map(F.lit, (8, 4, 4, 4, 12)))
    bare = F.translate(low, "- ", "")
    number = F.rlike(bare, F.lit("^[0-9]+x?$")) & F.length(bare).between(10, 13) & ~F.startswith(low, F.lit("-"))
    of_space = F.when(space == "isbn", "ISBN").when(space == "doi", "DOI")
    return F.when(space.isNotNull(), of_space).when(uuid, F.lit(None)).when(F.startswith(low, F.lit("10.")), "DOI").when(number, "ISBN")


def length_em(value: Column) -> Column:
    """A length in ems; what can't be told without a layout (percentages, viewport units) is 0."""
    shape = r"^\s*(-?\d+\.?\d*|-?\.\d+)\s*(em|rem|ex|ch|pt|px|in|cm|mm)\s*$"
    ems = F.create_map(*[F.lit(x) for pair in EMS.items() for x in pair])
    return F.coalesce(F.try_multiply(F.regexp_extract(value, shape, 1).try_cast("double"), F.try_element_at(ems, F.regexp_extract(value, shape, 2))), F.lit(0.0))


def margin_side(value: Column, side: str) -> Column:
    """One side of a margin shorthand of one to four parts; null for any other number of parts."""
    parts = F.split(F.trim(value), r"\s+")
    at = {"top": [1, 1, 1, 1], "right": [1, 2, 2, 2], "bottom": [1, 1, 3, 3], "left": [1, 2, 2, 4]}[side]
    found = F.lit(None).cast("string")
    for n, k in enumerate(at, 1):
        found = F.when(F.size(parts) == n, F.try_element_at(parts, F.lit(k))).otherwise(found)
    return found


def specificity(selector: Column) -> Column:
    """(ids, classes, types) of one selector: structs compare as specificities do.

    The selector is read as a list of simple selectors, each known by its first character; names of functions count, and
    what stands in their brackets counts as if it stood outside.
    """
    simple = F.regexp_extract_all(selector, F.lit(r"(\[[^\]]*\]|::?[\w-]+|[#.]?[\w-]+|[*])"), 1)
    kind = F.transform(simple, lambda s: F.when(F.startswith(s, F.lit("::")), "type").when(F.substring(s, 1, 1) == "#", "id").when(F.substring(s, 1, 1).isin(".", "[", ":"), "class").when(F.rlike(s, F.lit("^[A-Za-z]")), "type"))
    many = lambda k: F.size(F.filter(kind, lambda x: x == k))
    return F.struct(many("id").alias("ids"), many("class").alias("classes"), many("type").alias("types"))


def selector_key(selector: Column) -> Column:
    """The last compound of a selector without its pseudo-classes; `*` if nothing is left."""
    last = F.element_at(F.split(F.trim(selector), r"\s*[>+~]\s*|\s+"), -1)
    return F.coalesce(F.nullif(F.regexp_replace(last, r"::?[-\w]+(\([^)]*\))?", ""), F.lit("")), F.lit("*"))


def quote_counts(text: Column) -> dict[str, Column]:
    """How often each shape of quotation mark is in a text."""
    return {name: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit(""))) for name, mark in QUOTES.items()}


def sampled(place: Column, count: Column, wanted: int) -> Column:
    """Whether the item at `place` (from 0) of `count` belongs to a sample of `wanted`: the first three and then every
    so-manyth."""
    first = min(3, wanted)
    step = F.greatest(F.lit(1), F.floor((count - first) / max(1, wanted - first)))
    after = place - first
    return (count <= wanted) | (place < first) | ((after % step == 0) & (after / step < wanted - first))
