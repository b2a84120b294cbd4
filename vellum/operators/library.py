"""Library-scale aggregates: inventory, shape, families and coverage, survey, evidence, conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx

WORDS = r"[\p{L}\p{N}_]+"


def inventory(docs: DataFrame) -> DataFrame:
    """One row of counters a book (`source`): one pass, partial aggregates before the shuffle."""
    t = F.coalesce("text", F.lit(""))
    return docs.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.length(t)).alias("characters"), F.sum(F.size(F.split(t, "\n"))).cast("long").alias("lines"),
        F.sum(F.regexp_count(t, F.lit("[0-9]"))).cast("long").alias("digits"), F.sum(tx.polish_letters(t)).cast("long").alias("polish_letters"),
        F.sum(F.regexp_count(t, F.lit("[A-Za-z]-[A-Za-z]"))).cast("long").alias("hyphens"), F.sum(F.size(tx.emails(t))).cast("long").alias("emails"),
        F.count_if(tx.has_notice(t)).alias("with_notice"), F.count_if(F.length(t) == 0).alias("empty"),
    )


def shape(books: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """How many books pass each test, and of how many: one scan, then one row a test."""
    counted = books.agg(F.count("*").alias("books"), *[F.count_if(c).alias(n) for n, c in tests.items()])
    return counted.unpivot("books", list(tests), "test", "n").select("test", "n", "books")


def families(rows: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """(key, family): every family of which a row is a member; one row may be in several or in none."""
    member = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return rows.select(key, F.explode(member).alias("family"))


def coverage(members: DataFrame, quotas: DataFrame) -> DataFrame:
    """(family, want, have, short) of every quota, those without members too."""
    have = members.groupBy("family").agg(F.count("*").alias("have"))
    return quotas.join(have, "family", "left").select("family", "want", F.coalesce("have", F.lit(0)).alias("have"), F.greatest(F.lit(0), F.col("want") - F.coalesce("have", F.lit(0))).alias("short"))


def ranked(findings: DataFrame, top: int | None = None, levels: list[str] | None = None) -> DataFrame:
    """Findings (book, stage, level, rule) by how many books have them, then how often, with up to three of these books.

    Each kind has a `place`; with `top` only the first places stay, and with `levels` only those of them (the cut comes
    first). Books are counted from their distinct pairs with a kind and the three smallest are ranked within each task
    before the shuffle, so no kind's books meet in one task. The kinds themselves are as few as the rules.
    """
    kind = ["stage", "level", "rule"]
    by_book = findings.groupBy(*kind, "book").agg(F.count("*").alias("n"))
    smallest = by_book.withColumn("k", F.row_number().over(Window.partitionBy(*kind).orderBy("book"))).where("k <= 3")
    examples = smallest.groupBy(*kind).agg(F.array_join(F.array_sort(F.collect_list("book")), ",").alias("examples"))
    counts = by_book.groupBy(*kind).agg(F.count("*").alias("books"), F.sum("n").alias("occurrences"))
    out = counts.join(examples, kind).withColumn("place", F.row_number().over(Window.orderBy(F.desc("books"), F.desc("occurrences"), *kind)))
    out = out if top is None else out.where(F.col("place") <= top)
    return out if levels is None else out.where(F.col("level").isin(levels))


def noisy_or(evidence: DataFrame, keys: list[str], floor: float = 0.5, cap: float = 0.999) -> DataFrame:
    """Combined confidence 1 - prod(1 - w) of the best weight of each pattern, for what reaches the floor."""
    best = evidence.groupBy(*keys, "pattern").agg(F.max("weight").alias("weight"))
    out = best.groupBy(*keys).agg(F.least(F.lit(cap), F.round(1 - F.product(1 - F.col("weight")), 3)).alias("confidence"), F.count("*").alias("patterns"))
    return out.where(F.col("confidence") >= floor)


def dominant(rows: DataFrame, key: str, value: str, share: tuple[int, int] = (2, 3), enough: int = 20) -> DataFrame:
    """(key, dominant, n, total): the value that two thirds of at least twenty rows have, else null."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(key).agg(F.sum("n").alias("total"), F.max(F.struct("n", value)).alias("top"))
    holds = (F.col("top.n") * share[1] >= F.col("total") * share[0]) & (F.col("total") >= enough)
    return top.select(key, F.when(holds, F.col(f"top.{value}")).alias("dominant"), F.col("top.n").alias("n"), "total")


def words(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, word): the words of each text in lower case, hyphenated words in parts."""
    return docs.select(*keys, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORDS})"), 1)).alias("word"))


def vocabulary(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, word, n) of the wanted (source, word) only: words are counted within tasks and by their shuffle before the
    semi-join, which needs no other one, since both sides are dealt by the same key."""
    return words(docs, "source").groupBy("source", "word").agg(F.count("*").alias("n")).join(wanted, ["source", "word"], "left_semi")


def hyphen_candidates(docs: DataFrame) -> DataFrame:
    """(source, lhs, rhs, n, joined, alone, confidence) of hyphenated words, from what the rest of the book writes.

    Digits, a capital on the right, upper-case halves, single letters and doubled halves are never candidates.
    """
    pair = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+-[\p{L}\p{N}]+)"), 1)
    found = docs.select("source", F.explode(pair).alias("pair")).groupBy("source", "pair").agg(F.count("*").alias("n"))
    halves = found.select("source", "n", F.substring_index("pair", "-", 1).alias("lhs"), F.substring_index("pair", "-", -1).alias("rhs"))
    a, b = F.col("lhs"), F.col("rhs")
    never = F.rlike(F.concat(a, b), F.lit(r"\p{N}")) | (F.substring(b, 1, 1) != F.lower(F.substring(b, 1, 1))) | ((a == F.upper(a)) & (a != F.lower(a))) | (F.length(a) == 1) | (F.length(b) == 1) | (F.lower(a) == F.lower(b))
    kept = halves.where(~never).groupBy("source", F.lower("lhs").alias("lhs"), F.lower("rhs").alias("rhs")).agg(F.sum("n").alias("n"))
    # Both looks at a book's words are one join, so that texts are cut into words once.
    asked = kept.select("*", F.explode(F.array(F.struct(F.concat("lhs", "rhs").alias("word"), F.lit(True).alias("whole")), F.struct(F.col("lhs").alias("word"), F.lit(False).alias("whole")))).alias("a")).select("source", "lhs", "rhs", "n", "a.word", "a.whole")
    counts = words(docs, "source").groupBy("source", "word").agg(F.count("*").alias("c"))
    met = asked.join(counts, ["source", "word"], "left").groupBy("source", "lhs", "rhs", "n")
    out = met.agg(F.max(F.when(F.col("whole"), F.col("c"))).alias("joined"), F.max(F.when(~F.col("whole"), F.col("c"))).alias("alone"))
    # The half before the hyphen is itself cut out as a word once for every hyphenation, which is no use on its own.
    out = out.select("source", "lhs", "rhs", "n", F.coalesce("joined", F.lit(0)).alias("joined"), F.greatest(F.coalesce("alone", F.lit(0)) - F.col("n"), F.lit(0)).alias("alone"))
    return out.withColumn("confidence", F.when(F.col("joined") >= 1, "confirmed").when(F.col("n") > 3, "kept").when(F.col("alone") == 0, "likely").otherwise("uncertain"))


def level_jumps(rows: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """(key, jumps): how often a level is more than one deeper than the one before it."""
    before = F.lag(level).over(Window.partitionBy(key).orderBy(order))
    return rows.select(key, (F.col(level) > before + 1).alias("jump")).groupBy(key).agg(F.count_if("jump").alias("jumps"))
