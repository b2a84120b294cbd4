"""Order within a book: pairs by position, places for what is missing, runs, chains, notes, shapes of prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import values
from vellum.operators.references import _cut


def pair_by_place(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """(key, place, l, r): the nth of one side with the nth of the other, where a key has as many on both sides."""
    by = Window.partitionBy(key)

    def numbered(side: DataFrame, name: str) -> DataFrame:
        return side.select(key, F.col(order).alias(name), F.row_number().over(by.orderBy(order)).alias("place"), F.count("*").over(by).alias("n"))

    return numbered(left, "l").join(numbered(right, "r"), [key, "place", "n"]).drop("n")


def next_held(rows: DataFrame, key: str, order: str, held: str) -> DataFrame:
    """(key, order, before): for each row that `held` is false of, the next one by order that it is true of; null at the end."""
    # Backwards, so that the frame only grows: Spark computes a frame that shrinks anew for every row.
    ahead = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("before", F.last(F.when(F.expr(held), F.col(order)), ignorenulls=True).over(ahead))
    return found.where(~F.expr(held)).select(key, order, "before")


def runs(rows: DataFrame, key: str, order: str, is_member: str, least: int = 2) -> DataFrame:
    """(key, start, n): runs of at least `least` neighbouring members, counted where they start."""
    by = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("__in", F.expr(is_member)).withColumn("__gap", F.sum(F.when(F.col("__in"), 0).otherwise(1)).over(by))
    return marked.where("__in").groupBy(key, "__gap").agg(F.min(order).alias("start"), F.count("*").alias("n")).where(F.col("n") >= least).drop("__gap")


def chains(rows: DataFrame) -> DataFrame:
    """(node, outcome) of (node, next) rows: `ends`, `missing` if the chain leads out of the rows, `cycle` if it never ends.

    Every round doubles the steps taken. A round that answers no further node leaves only those that lead to a cycle.
    """
    nodes = rows.select("node")
    known = rows.join(nodes.select(F.col("node").alias("next"), F.lit(True).alias("here")), "next", "left")
    outcome = F.when(F.col("next").isNull(), "ends").when(F.col("here").isNull(), "missing")
    every = _cut(known.select("node", "next", outcome.alias("outcome")))
    left = None
    while True:
        open_ = every.where("outcome IS NULL")
        now = open_.count()
        if now in (0, left):
            return every.select("node", F.coalesce("outcome", F.lit("cycle")).alias("outcome"))
        left = now
        ahead = every.select(F.col("node").alias("next"), F.col("next").alias("far"), F.col("outcome").alias("there"))
        every = _cut(every.where("outcome IS NOT NULL").union(open_.join(ahead, "next").select("node", F.col("far").alias("next"), F.col("there").alias("outcome"))))


def markers_with_notes(texts: DataFrame, notes: DataFrame) -> DataFrame:
    """(book, number, markers, note): bare `[N]` marks in (book, text) with the first note (book, number, ord, note) of that
    number; marks are counted before they are joined."""
    marks = texts.select("book", F.explode(F.regexp_extract_all("text", F.lit(r"\[(\d{1,9})\]"), 1)).alias("number")).groupBy("book", F.col("number").cast("int").alias("number")).agg(F.count("*").alias("markers"))
    return marks.join(notes.groupBy("book", "number").agg(F.min_by("note", "ord").alias("note")), ["book", "number"])


def body_shape(blocks: DataFrame, key: str, shape: str, least: float = 0.6) -> DataFrame:
    """(key, shape, blocks, agreeing, share, consistent): the commonest shape of a book's blocks, the first by name on a tie."""
    counts = blocks.groupBy(key, shape).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.sum("n").alias("blocks"), F.max("n").alias("agreeing"))
    named = counts.join(best, key).where("n = agreeing").groupBy(key, "blocks", "agreeing").agg(F.min(shape).alias(shape))
    share = F.col("agreeing") / F.col("blocks")
    return named.select(key, shape, "blocks", "agreeing", share.alias("share"), (share >= least).alias("consistent"))


def paradigm(paragraphs: DataFrame, key: str, share: float = 0.9, coverage: float = 0.5) -> DataFrame:
    """(key, paradigm) of (indented, spaced) paragraphs: INDENTED, SPACED, BOTH, else MIXED; UNKNOWN if too few are either."""
    kinds = {"INDENTED": "indented AND NOT spaced", "SPACED": "spaced AND NOT indented", "BOTH": "indented AND spaced"}
    counts = paragraphs.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(F.expr(t)).alias(k) for k, t in kinds.items()])
    decided = F.col("INDENTED") + F.col("SPACED") + F.col("BOTH")
    out = F.when((decided == 0) | (decided < coverage * F.col("n")), "UNKNOWN")
    for k in kinds:
        out = out.when(F.col(k) >= share * decided, k)
    return counts.select(key, out.otherwise("MIXED").alias("paradigm"))


def quote_convention(docs: DataFrame, key: str, enough: int = 20) -> DataFrame:
    """(key, convention): the pair of marks that accounts for at least two thirds of a book's marks; null if there are fewer
    than `enough` marks or two pairs tie."""
    counts = docs.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in values.quote_counts(F.col("text")).items()])
    total = sum((F.col(f"`{n}`") for n in values.QUOTES), F.lit(0))
    scores = F.array_sort(F.array(*[F.struct((-sum((F.col(f"`{m}`") for m in sorted(set(pair))), F.lit(0))).alias("n"), F.lit(name).alias("name")) for name, pair in values.CONVENTIONS.items()]))
    best, second = F.element_at(scores, 1), F.element_at(scores, 2)
    sure = (total >= enough) & (-best["n"] * 3 >= total * 2) & (best["n"] != second["n"])
    return counts.select(key, F.when(sure, best["name"]).alias("convention"))


def unique_ids(elements: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """The first element of an id keeps it; later ones get `-2`, `-3` and so on in `renamed`."""
    place = F.row_number().over(Window.partitionBy(key, name).orderBy(order))
    return elements.withColumn("renamed", F.when(place == 1, F.col(name)).otherwise(F.concat_ws("-", name, place)))


def found_by_spelling(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, found, how): files by exact name, else by the percent-decoded one, else by lower case: one equi-join each."""
    exact = files.select(F.col("path").alias("k"), F.col("path").alias("e"))
    lower = files.groupBy(F.lower("path").alias("k")).agg(F.min("path").alias("e"))
    plain = F.coalesce(F.try_url_decode("path"), F.col("path"))
    out = wanted.select("path").distinct()
    for how, k, side in (("exact", F.col("path"), exact), ("decoded", plain, exact), ("case", F.lower(plain), lower)):
        out = out.join(side.select(F.col("k").alias(f"__{how}"), F.col("e").alias(how)), k == F.col(f"__{how}"), "left").drop(f"__{how}")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("decoded").isNotNull(), "decoded").when(F.col("case").isNotNull(), "case")
    return out.select("path", F.coalesce("exact", "decoded", "case").alias("found"), how.alias("how"))
