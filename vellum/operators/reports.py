"""Reports of findings and changes: counts, orders, run totals, ledgers, documents for people and machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels of a finding, the worst first.
LEVELS = ["ERROR", "WARN", "PRESERVED", "FIX", "INFO"]


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def counts(findings: DataFrame, key: str = "book") -> DataFrame:
    """A row a book: how many findings of each level, and `ok` where none is an error."""
    out = findings.groupBy(key).agg(*[F.count_if(F.col("level") == v).alias(v.lower()) for v in LEVELS])
    return out.withColumn("ok", F.col("error") == 0)


def ordered(findings: DataFrame, key: str = "book") -> DataFrame:
    """`findings` with `place`: within a book by level, the worst first, then by stage and message."""
    from pyspark.sql import Window

    return findings.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(level_rank(F.col("level")), "stage", "message")))


def worst_first(books: DataFrame) -> DataFrame:
    """Books of a run (source, ok, error, warn): those with errors first, the most errors, then the most warnings, then by name."""
    return books.orderBy(F.col("ok"), F.desc("error"), F.desc("warn"), "source")


def run_totals(results: DataFrame) -> DataFrame:
    """One row a run from (run, book, errors, before, fatal, lost, written): a book counts once; errors that the source had are
    carried or inherent, others introduced. A book without a count of its source's errors leaves that split unknown (null)."""
    once = results.groupBy("run", "book").agg(F.max(F.struct("errors", "before", "fatal", "lost", "written")).alias("r")).select("run", "book", "r.*")
    grown = F.greatest(F.col("errors") - F.col("before"), F.lit(0))
    out = once.groupBy("run").agg(
        F.count("*").alias("books"), F.sum("errors").alias("errors"), F.when(F.count_if(F.col("before").isNull()) == 0, F.sum(grown)).alias("introduced"),
        F.when(F.count_if(F.col("before").isNull()) == 0, F.sum(F.least("errors", "before"))).alias("carried"), F.sum("fatal").alias("fatal"), F.count_if("lost").alias("lost"), F.count_if(~F.col("written")).alias("unwritten"),
    )
    return out.withColumn("clean", (F.coalesce("introduced", "errors") == 0) & (F.col("fatal") == 0) & (F.col("lost") == 0) & (F.col("unwritten") == 0))


def releases(runs: DataFrame) -> DataFrame:
    """(version, runs) of a ledger."""
    return runs.groupBy("version").agg(F.count("*").alias("runs"))


def health(entries: DataFrame) -> DataFrame:
    """(book, entries, damaged, bytes) of scanned archives."""
    return entries.groupBy("book").agg(F.count("*").alias("entries"), F.count_if(~F.col("ok")).alias("damaged"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def ledger_lines(changes: DataFrame) -> DataFrame:
    """(book, line) of the changes that cost something or can't be undone."""
    risky = changes.where((F.col("risk") != "none") | ~F.col("reversible"))
    undo = F.when(F.col("reversible"), "").otherwise(" (for good)")
    return risky.select("book", F.concat(F.col("stage"), F.lit(": "), F.col("action"), F.lit(" "), F.col("subject"), F.lit(" ["), F.col("risk"), F.lit("]"), undo).alias("line"))


def as_json(findings: DataFrame, key: str = "book", version: int = 4) -> DataFrame:
    """(key, json): a report of each book as one document: its summary and its findings in order. A book's own findings meet,
    as they do in the document."""
    placed = ordered(findings, key)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "level", "stage", "message"))), lambda f: F.struct(f["level"].alias("level"), f["stage"].alias("stage"), f["message"].alias("message")))
    summary = F.struct(*[F.count_if(F.col("level") == v).alias(v.lower()) for v in LEVELS])
    return placed.groupBy(key).agg(F.to_json(F.struct(F.lit(version).alias("schema"), (F.count_if(F.col("level") == "ERROR") == 0).alias("ok"), summary.alias("summary"), listed.alias("findings"))).alias("json"))


def as_text(findings: DataFrame, key: str = "book") -> DataFrame:
    """(key, text): the same for people: a line a finding below a line a level."""
    placed = ordered(findings, key)
    lines = F.array_sort(F.collect_list(F.struct("place", "level", "stage", "message")))
    head = lambda i: F.when((i == 0) | (F.get(lines, i - 1)["level"] != F.get(lines, i)["level"]), F.concat(F.lit("["), F.get(lines, i)["level"], F.lit("]\n"))).otherwise("")
    made = F.transform(lines, lambda f, i: F.concat(head(i), F.lit("  - "), f["stage"], F.lit(": "), f["message"]))
    return placed.groupBy(key).agg(F.array_join(made, "\n").alias("text"))


def percent(part: Column, whole: Column) -> Column:
    """A share in percent to one place; 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(F.lit(0.0))
