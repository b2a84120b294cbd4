"""Two-sided comparison: balance, survival, multiset difference, signature trees, duplicates, merges, run ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators import ordered

#: Keys that the rows of one digest are dealt over.
SALTS = 16


def balance(before: DataFrame, after: DataFrame, explained: DataFrame) -> DataFrame:
    """(category, before_n, after_n, explained_n, lost): losses that the ledger of changes does not cover.

    Each side is (category, n) rows; sides are tagged and summed in one shuffle.
    """
    sides = before.select("category", F.lit("b").alias("side"), "n").union(after.select("category", F.lit("a"), "n")).union(explained.select("category", F.lit("e"), "n"))
    of = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).cast("long")
    out = sides.groupBy("category").agg(of("b").alias("before_n"), of("a").alias("after_n"), of("e").alias("explained_n"))
    return out.withColumn("lost", F.greatest(F.lit(0), F.col("before_n") - F.col("after_n") - F.col("explained_n")))


def multiset_minus(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how many more rows of each kind the left has."""
    signed = left.select(*keys, F.lit(1).alias("s")).union(right.select(*keys, F.lit(-1)))
    return signed.groupBy(*keys).agg(F.sum("s").alias("n")).where("n > 0")


def signature_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, old, new, change) of signature leaves (path, value) that differ; null counts as absent, not as zero."""
    joined = old.select("path", F.col("value").alias("old"), F.lit(True).alias("in_old")).join(new.select("path", F.col("value").alias("new"), F.lit(True).alias("in_new")), "path", "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return joined.select("path", "old", "new", change.alias("change")).where("change IS NOT NULL")


def duplicates(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """(order, digest, first, copies): rows whose digest a smaller one has. Groups are counted with partial sums; a group of
    very many copies is dealt over `SALTS` keys, each of which meets one row of the group."""
    salt = F.pmod(F.xxhash64(order), F.lit(SALTS))
    groups = rows.groupBy(digest).agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    dealt = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.select(order, digest, salt.alias("__salt")).join(dealt, [digest, "__salt"]).where(F.col(order) != F.col("first")).select(order, digest, "first", "copies")


def merge_plan(entries: DataFrame) -> DataFrame:
    """(name, take, copies, conflict) over archive copies (name, copy, digest, ok): the first clean copy; conflicts of clean digests."""
    clean = F.col("ok")
    out = entries.groupBy("name").agg(F.min(F.when(clean, F.col("copy"))).alias("take"), F.count("*").alias("copies"), (F.countDistinct(F.when(clean, F.col("digest"))) > 1).alias("conflict"))
    return out.withColumn("missing", F.col("take").isNull())


def change_summary(changes: DataFrame) -> DataFrame:
    """(action, risk, n, irreversible) by both, by each, and in all; null stands for all."""
    return changes.groupingSets([["action", "risk"], ["action"], ["risk"], []], "action", "risk").agg(F.count("*").alias("n"), F.count_if(~F.col("reversible")).alias("irreversible"))


def run_ledger(runs: DataFrame, minimum: int = 1, n: int = 16) -> DataFrame:
    """Runs (run, version, books, modes, clean) in order with `widened` and `streak`, the length of the clean run so far.

    A run that asks more than the one before (more books or more modes, and none fewer) is passed over; an unclean one
    starts afresh; a version counts once in a row. Runs are compared and summed within `n` ranges of their number, with a
    row a range between them.
    """
    seen = ordered.with_previous(runs.where(F.col("books") >= minimum), "run", ["books", "modes"], n)
    p = F.col("previous")
    grew = (F.col("books") >= p["books"]) & (F.col("modes") >= p["modes"]) & ((F.col("books") > p["books"]) | (F.col("modes") > p["modes"]))
    marked = seen.withColumn("widened", F.coalesce(grew, F.lit(False))).drop("previous", "range")
    # What the streak counts: clean runs that aren't passed over, and of neighbours among them with one version the first.
    counted = marked.where("NOT widened")
    before = ordered.with_previous(counted, "run", ["version", "clean"], n)
    p = F.col("previous")
    new = F.col("clean") & F.coalesce(~p["clean"] | (p["version"] != F.col("version")), F.lit(True))
    summed = ordered.running(before.withColumn("new", new.cast("long")), "run", "total", F.col("new")).withColumn("island", F.when(~F.col("clean"), F.col("run")))
    # The last unclean run before each, and the total there: both only grow, so a running maximum finds them.
    found = marked.join(summed.select("run", "total", "island"), "run", "left")
    found = found.withColumn("range", ordered.ranges(found, "run", n)).withColumn("at", F.struct("run", "total"))
    tops = found.groupBy("range").agg(F.max(F.when(F.col("island").isNotNull(), F.col("at"))).alias("reset"), F.max(F.when(F.col("total").isNotNull(), F.col("at"))).alias("last"))
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    tops = tops.select("range", F.max("reset").over(over).alias("reset_before"), F.max("last").over(over).alias("last_before"))
    own = Window.partitionBy("range").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("reset", F.max(F.when(F.col("island").isNotNull(), F.col("at"))).over(own)).withColumn("last", F.max(F.when(F.col("total").isNotNull(), F.col("at"))).over(own)).join(tops, "range")
    total = lambda a, b: F.coalesce(F.coalesce(F.col(a), F.col(b))["total"], F.lit(0))
    return found.select("run", "version", "books", "modes", "clean", "widened", (total("last", "last_before") - total("reset", "reset_before")).cast("long").alias("streak"))


def widenings(ledger: DataFrame) -> DataFrame:
    """(run, version, books, modes) of the runs that ask more than the one before."""
    return ledger.where("widened").select("run", "version", "books", "modes")
