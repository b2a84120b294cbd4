"""Style sheets as rows: a declaration each, with its rule, selector, place in the text and conditions around it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.sources import batches

SCHEMA = "sheet string, ord int, selector string, condition string, start int, stop int, place int, prop string, value string, important boolean"
#: What a scan steps over as a whole, and the marks it stops at. Offsets count code points.
TOKEN = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|\\.|[{};(),:]""", re.S)
IMPORTANT = re.compile(r"\s*!\s*important\s*$", re.I)


def _plain(text: str) -> str:
    if "/*" not in text:
        return text.strip()
    return re.sub(r"/\*.*?(?:\*/|\Z)", " ", text, flags=re.S).strip()


def _split(text: str, mark: str) -> list[str]:
    """Parts of a text between `mark`s that stand outside strings, comments and brackets."""
    parts, start, depth = [], 0, 0
    for m in TOKEN.finditer(text):
        t = m.group()
        depth += (t == "(") - (t == ")" and depth > 0)
        if t == mark and depth == 0:
            parts.append(text[start : m.start()])
            start = m.end()
    return [*parts, text[start:]]


@lru_cache(maxsize=256)
def declarations(body: str) -> tuple[tuple[str, str, bool], ...]:
    """(property, value, important) of the inside of a block; what has no colon or no value is left out. Bodies recur, in a
    sheet's steps as among books, so the last ones are kept."""
    return tuple(_declarations(body))


def _declarations(body: str) -> Iterator[tuple[str, str, bool]]:
    for part in _split(body, ";"):
        name, *rest = _split(part, ":")
        value = _plain(":".join(rest))
        bare = IMPORTANT.sub("", value)
        if rest and bare and (prop := _plain(name).lower()):
            yield prop, bare, bare != value


def blocks(text: str) -> Iterator[tuple[str, tuple[str, ...], int, int, str]]:
    """(prelude, conditions, start, stop, body) of every innermost block; an unclosed one ends with the text."""
    open_: list[tuple[int, int, str, bool]] = []  # start of the prelude, of the body, prelude, whether a block is inside
    start = depth = 0
    for m in TOKEN.finditer(text):
        t = m.group()
        depth += (t == "(") - (t == ")" and depth > 0)
        if t == "{" and depth == 0:
            if open_:
                open_[-1] = (*open_[-1][:3], True)
            open_.append((start, m.end(), _plain(text[start : m.start()]), False))
            start = m.end()
        elif t == "}":
            depth = 0
            if open_:
                begun, inside, prelude, nested = open_.pop()
                if not nested:
                    yield prelude, tuple(o[2] for o in open_), begun, m.end(), text[inside : m.start()]
            start = m.end()
        elif t == ";" and depth == 0 and not open_:
            start = m.end()  # a statement such as an import
    if open_ and not open_[-1][3]:
        begun, inside, prelude, _ = open_.pop()
        yield prelude, tuple(o[2] for o in open_), begun, len(text), text[inside:]


@lru_cache(maxsize=256)
def _selectors(prelude: str) -> tuple[str, ...]:
    return (prelude,) if prelude.startswith("@") else tuple(filter(None, map(_plain, _split(prelude, ","))))


def read_sheet(text: str | None) -> list[tuple]:
    """Rows of `SCHEMA` without the sheet: one for every selector of a list and declaration of its block."""
    rows = []
    for ord_, (prelude, around, start, stop, body) in enumerate(blocks(text or "")):
        for selector in _selectors(prelude):
            for place, (prop, value, important) in enumerate(declarations(body)):
                rows.append((ord_, selector, " ".join(around) or None, start, stop, place, prop, value, important))
    return rows


def rules(sheets: DataFrame, id_col: str, text_col: str, columns: list[str] | None = None) -> DataFrame:
    """The declarations of all sheets in `SCHEMA`, or some columns of it. Null and empty sheets have none."""
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    chosen = [names.index(c) for c in columns or names]
    wanted = itemgetter(*chosen) if len(chosen) > 1 else lambda row: (row[chosen[0]],)

    def read(arrived):
        every = ((sheet, *row) for batch in arrived for sheet, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in read_sheet(text))
        yield from batches.gathered(map(wanted, every), [types[i] for i in chosen], [names[i] for i in chosen])

    return sheets.select(F.col(id_col).cast("string"), text_col).mapInArrow(read, ", ".join(SCHEMA.split(", ")[i] for i in chosen))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without some spans of it; one that overlaps an earlier one goes from where that ends."""
    out, at = [], 0
    for start, stop in sorted(spans):
        out.append(text[at : max(at, start)])
        at = max(at, stop)
    return "".join([*out, text[at:]])
