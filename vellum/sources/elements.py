"""Elements of marked-up documents as rows: nesting by preorder and postorder numbers, and what rests on them."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SCHEMA = "page_id long, pre int, post int, parent int, depth int, tag string, classes array<string>, element_id string, text string"


class _Reader(HTMLParser):
    """Numbers elements as they open and close; an end tag closes what is open inside it, a stray one nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.closed = 0

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        self.rows.append([len(self.rows), None, self.open[-1] if self.open else None, len(self.open), tag, (given.get("class") or "").split(), given.get("id"), ""])
        self.open.append(len(self.rows) - 1)
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def handle_endtag(self, tag):
        if any(self.rows[i][4] == tag for i in self.open):
            while self.rows[self.open[-1]][4] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.open:
            self.rows[self.open[-1]][7] += data

    def _close(self):
        self.rows[self.open.pop()][1] = self.closed
        self.closed += 1

    def finish(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        while self.open:
            self._close()
        return self.rows


def read_elements(html: str | None) -> list[list]:
    return _Reader().finish(html or "")


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for every element in `SCHEMA`; `text` is the element's own. Null and empty pages have none."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def read(batches):
        for batch in batches:
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := read_elements(html):
                    yield pa.RecordBatch.from_arrays([pa.array([page] * len(rows), types[0]), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True))], names=names)

    return pages.select(F.col(id_col).cast("long"), html_col).mapInArrow(read, SCHEMA)


def nesting(found: DataFrame) -> DataFrame:
    """(page_id, elements, deepest): size and depth of every page's tree."""
    return found.groupBy("page_id").agg(F.count("*").alias("elements"), F.max(F.col("depth") + 1).alias("deepest"))


def outline(found: DataFrame) -> DataFrame:
    """(page_id, pre, level, label, skipped): headings in document order; `skipped` where a level is left out."""
    heads = found.where(F.rlike("tag", F.lit("^h[1-6]$"))).withColumn("level", F.substring("tag", 2, 1).cast("int"))
    before = F.lag("level", 1, 0).over(Window.partitionBy("page_id").orderBy("pre"))
    return heads.select("page_id", "pre", "level", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("label"), (F.col("level") > before + 1).alias("skipped"))


def inside(found: DataFrame, tags: list[str]) -> DataFrame:
    """Elements below one of `tags`: containment of preorder and postorder numbers, an equi-join by page with a residual.

    Only the outermost holders are joined, of which an element has at most one, so the join makes no row twice.
    """
    holders = found.where(F.col("tag").isin(tags)).select("page_id", F.col("pre").alias("from_pre"), F.col("post").alias("to_post"))
    reach = F.max("to_post").over(Window.partitionBy("page_id").orderBy("from_pre").rowsBetween(Window.unboundedPreceding, -1))
    outer = holders.withColumn("reach", reach).where("reach IS NULL OR to_post > reach").drop("reach")
    return found.join(outer, "page_id").where("pre > from_pre AND post < to_post").drop("from_pre", "to_post")


def outside(found: DataFrame, tags: list[str]) -> DataFrame:
    """The elements that are neither one of `tags` nor below one."""
    return found.where(~F.col("tag").isin(tags)).join(inside(found, tags).select("page_id", "pre"), ["page_id", "pre"], "left_anti")
