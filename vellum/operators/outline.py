"""Tables of contents, landmarks and layouts of books: pruning, synthesis, numbering, moves and what may not move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import names
from vellum.functions import text as tx

# Names that archives pick up on their way.
JUNK = r"(?i)(^|/)(\.ds_store|thumbs\.db|desktop\.ini|__macosx/.*|\._[^/]*|[^/]*\.(bak|tmp|swp|orig))$"


def subtree_ends(points: DataFrame, key: str, pre: str, depth: str) -> DataFrame:
    """`points` with `until`: the place after a point's last descendant, null where that is the end.

    A point ends every open one of its depth or more, so it is a mark on each of these levels; the next mark on a point's
    own level is where it ends. Marks are as many as points times levels.
    """
    deep = points.withColumn("__deepest", F.max(depth).over(Window.partitionBy(key)))
    marks = deep.withColumn("__level", F.explode(F.sequence(depth, "__deepest"))).drop("__deepest").withColumn("until", F.lead(pre).over(Window.partitionBy(key, "__level").orderBy(pre)))
    return marks.where(F.col("__level") == F.col(depth)).drop("__level")


def pruned(points: DataFrame, files: DataFrame, anchors: DataFrame, key: str = "book") -> DataFrame:
    """(key, pre, depth, label, path, fragment) of a table of contents without dead entries.

    An entry whose file isn't there loses its target; one whose anchor isn't there keeps the file alone, if the file's
    anchors are known at all. What then has neither a target nor a descendant with one goes. files: (key, path),
    anchors: (key, path, fragment).
    """
    known = anchors.select(key, "path").distinct().withColumn("__asked", F.lit(True))
    there = files.select(key, "path").distinct().withColumn("__file", F.lit(True))
    met = points.join(there, [key, "path"], "left").join(known, [key, "path"], "left").join(anchors.select(key, "path", "fragment").distinct().withColumn("__anchor", F.lit(True)), [key, "path", "fragment"], "left")
    lost = F.col("fragment").isNotNull() & F.col("__asked").isNotNull() & F.col("__anchor").isNull()
    path = F.when(F.col("__file"), F.col("path"))
    met = met.select(key, "pre", "depth", "label", path.alias("path"), F.when(path.isNotNull() & ~lost, F.col("fragment")).alias("fragment"))
    by = Window.partitionBy(key).orderBy("pre")
    alive = F.sum(F.col("path").isNotNull().cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))  # before each point
    counted = met.withColumn("__before", F.coalesce(alive, F.lit(0))).withColumn("__all", F.sum(F.col("path").isNotNull().cast("int")).over(Window.partitionBy(key)))
    ended = subtree_ends(counted, key, "pre", "depth")
    # The count before the point at which a subtree ends, less the count before its root, is what lives in it.
    at_end = counted.select(key, F.col("pre").alias("until"), F.col("__before").alias("__after"))
    live = ended.join(at_end, [key, "until"], "left").where(F.coalesce("__after", "__all") > F.col("__before"))
    return live.select(key, "pre", "depth", "label", "path", "fragment")


def synthesised(spine: DataFrame, titled: DataFrame) -> DataFrame:
    """(book, pre, label, path): a table of contents of the linear documents of a spine, by their titles."""
    linear = spine.where("linear").join(titled, ["book", "path"])
    return linear.select("book", (F.row_number().over(Window.partitionBy("book").orderBy("ord")) - 1).alias("pre"), "label", "path")


def landmarks(given: DataFrame, spine: DataFrame) -> DataFrame:
    """(book, ord, kind, path): landmarks without repetitions of kind and target, and a beginning of the text where a book has
    none: its first linear document but for the first landmark's."""
    once = given.groupBy("book", "kind", "path").agg(F.min("ord").alias("ord")).select("book", "ord", "kind", "path")
    facts = given.groupBy("book").agg(F.min_by("path", "ord").alias("__first"), F.max(F.col("kind") == "bodymatter").alias("__has"), F.max("ord").alias("__last"))
    start = spine.where("linear").join(facts, "book", "left").where(~F.coalesce("__has", F.lit(False)) & (F.col("__first").isNull() | (F.col("path") != F.col("__first"))))
    found = start.groupBy("book").agg(F.min_by("path", "ord").alias("path"), (F.coalesce(F.max("__last"), F.lit(-1)) + 1).alias("ord"))
    return once.union(found.select("book", "ord", F.lit("bodymatter"), "path"))


def depths(points: DataFrame, key: str = "book") -> DataFrame:
    """(key, entries, deepest) of tables of contents."""
    return points.groupBy(key).agg(F.count("*").alias("entries"), (F.max("depth") + 1).alias("deepest"))


def rendered(points: DataFrame, key: str = "book") -> DataFrame:
    """(key, html): a table of contents as nested lists. A book's points are one row of the result, as the document is."""
    escaped = F.col("label")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(entity))
    href = F.concat("path", F.coalesce(F.concat(F.lit("#"), "fragment"), F.lit("")))
    text = F.when(escaped.isNull() | (escaped == ""), "—").otherwise(escaped)
    entry = F.when(F.col("path").isNull(), F.concat(F.lit("<span>"), text, F.lit("</span>"))).otherwise(F.concat(F.lit('<a href="'), href, F.lit('">'), text, F.lit("</a>")))
    deeper = F.col("depth") - F.coalesce(F.lag("depth").over(Window.partitionBy(key).orderBy("pre")), F.lit(-1))
    shut = F.when(deeper > 0, "<ol>").otherwise(F.concat(F.lit("</li>"), F.repeat(F.lit("</ol></li>"), (-deeper).cast("int"))))
    pieces = points.withColumn("__piece", F.concat(shut, F.lit("<li>"), entry))
    out = pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "__piece"))), lambda p: p["__piece"]), "").alias("body"), F.max_by("depth", "pre").alias("last"))
    return out.select(key, F.concat("body", F.lit("</li></ol>"), F.repeat(F.lit("</li></ol>"), F.col("last").cast("int"))).alias("html"))


def anchors_of(elements: DataFrame, links: DataFrame) -> DataFrame:
    """(book, path, fragment): ids of elements and the older names of links, each once."""
    return elements.select("book", "path", F.col("element_id").alias("fragment")).union(links.select("book", "path", "name")).where("fragment IS NOT NULL AND fragment <> ''").distinct()


def redirected(references: DataFrame, moved: DataFrame, renamed: DataFrame) -> DataFrame:
    """References (…, path, fragment) after files moved (path, new_path) and anchors were renamed (path, fragment,
    new_fragment), both by their old names."""
    out = references.join(renamed, ["path", "fragment"], "left").join(moved, "path", "left")
    return out.withColumn("fragment", F.coalesce("new_fragment", "fragment")).withColumn("path", F.coalesce("new_path", "path")).drop("new_path", "new_fragment")


def junk(files: DataFrame, reached: DataFrame, referenced: DataFrame) -> DataFrame:
    """(book, path, kept): files with a name that archives pick up; those that the book reaches or names anywhere stay."""
    spoken = reached.select("book", "path").union(referenced.select("book", "path")).distinct().withColumn("__s", F.lit(True))
    named = files.where(F.rlike("path", F.lit(JUNK))).select("book", "path")
    return named.join(spoken, ["book", "path"], "left").select("book", "path", F.col("__s").isNotNull().alias("kept"))


def unmovable(files: DataFrame) -> DataFrame:
    """(book, path): files of a kind that can't be rewritten which name another file of the book, and the files that they name.

    files: (book, path, understood, text). A text's words are met with base names by an equi-join on both.
    """
    named = files.select("book", F.col("path").alias("target"), tx.basename(F.col("path")).alias("word"))
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_.-]+)"), 1))
    said = files.where("NOT understood AND text IS NOT NULL").select("book", "path", F.explode(tokens).alias("word")).where(F.col("word") != tx.basename(F.col("path")))
    met = said.join(named, ["book", "word"])
    return met.select("book", "path").union(met.select("book", "target")).distinct()


def relaid(files: DataFrame, spine: DataFrame, stuck: DataFrame, root: str = "OPS") -> DataFrame:
    """(book, path, new_path): where each file goes: a folder by its media type, a plain name, reading order before the names
    of documents, numbers after names that would meet. Files that may not move keep their place."""
    place = spine.groupBy("book", "path").agg(F.min("ord").alias("ord"))
    free = files.join(stuck, ["book", "path"], "left_anti").join(place, ["book", "path"], "left")
    document = F.col("media_type").isin("application/xhtml+xml", "text/html")
    base = names.file_slug(tx.basename(F.col("path")))
    stem = F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), r"^\d{4}-", "")
    numbered = F.concat(F.coalesce(F.concat(F.lpad(F.col("ord").cast("string"), 4, "0"), F.lit("-")), F.lit("")), F.when(stem == "", "section").otherwise(stem), F.lit(".xhtml"))
    wish = F.when(F.col("media_type") == "application/x-dtbncx+xml", f"{root}/toc.ncx").otherwise(F.concat_ws("/", F.lit(root), names.folder_of(F.col("media_type")), F.when(document, numbered).otherwise(base)))
    order = F.struct(F.col("ord").isNull(), "ord", "path")
    made = names.unique_names(free.withColumn("wish", wish).withColumn("__order", order), "book", "wish", "__order", "new_path")
    return made.select("book", "path", "new_path")


def spine_names(spine: DataFrame) -> DataFrame:
    """(book, path, prefix): the four digits that reading order puts before a document's name."""
    return spine.select("book", "path", F.concat(F.lpad(F.col("ord").cast("string"), 4, "0"), F.lit("-")).alias("prefix"))


def foreign(manifests: DataFrame, mine: Column) -> DataFrame:
    """(book, path): files that other renditions' manifests (book, rendition, path) list and the chosen one does not."""
    return manifests.where(~mine).select("book", "path").distinct().join(manifests.where(mine).select("book", "path").distinct(), ["book", "path"], "left_anti")


def withdrawn(declared: Column, found: Column) -> Column:
    """Properties of a manifest item that its document doesn't bear out."""
    return F.array_sort(F.array_except(declared, found))


def reading_text(spine: DataFrame, texts: DataFrame) -> DataFrame:
    """(book, text, documents): a book's text in its order of reading, without what is out of it; a book is one value here, as
    the gate that compares texts needs it. spine: (book, ord, path, linear), texts: (book, path, text)."""
    read = spine.where("linear").join(texts, ["book", "path"]).groupBy("book")
    parts = F.array_sort(F.collect_list(F.struct("ord", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))))
    return read.agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.count("*").alias("documents"))


def renamed(files: DataFrame, pointers: dict[str, DataFrame], moved: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(files, pointers) after files moved (book, path, new_path): every relation that names a file by (book, path) names it by
    its new path."""

    def follow(rows: DataFrame) -> DataFrame:
        return rows.join(moved, ["book", "path"], "left").withColumn("path", F.coalesce("new_path", "path")).drop("new_path").select(*rows.columns)

    return follow(files), {name: follow(rows) for name, rows in pointers.items()}
