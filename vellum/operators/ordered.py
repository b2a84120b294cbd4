"""Global order without a global sort in one task: rows in ranges of a key, what precedes a row, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a key at most; their edges and sums are all that meets in one place.
RANGES = 1024


def ranges(rows: DataFrame, key: str, n: int) -> Column:
    """The number of the range, of about `n` with about as many rows each, that a key falls in; null keys come first."""
    shares = [i / n for i in range(1, min(n, RANGES))]
    edges = rows.agg(F.percentile_approx(key, shares, 10_000).alias("e")).first()["e"] if shares else []
    out = F.lit(0)
    for edge in sorted(set(edges or [])):
        out = out + F.coalesce(F.col(key) > F.lit(edge), F.lit(False)).cast("int")
    return out


def with_previous(rows: DataFrame, key: str, columns: list[str], n: int) -> DataFrame:
    """`rows` (of distinct keys) with `previous`, the columns of the row before by `key`, and `range`.

    A range's last row is sent to the next one that has rows, so each range is sorted on its own.
    """
    marked = rows.withColumn("range", ranges(rows, key, n))
    value = F.struct(*columns)
    last = marked.groupBy("range").agg(F.max_by(value, key).alias("last"))
    sent = last.select("range", F.lag("last").over(Window.orderBy("range")).alias("sent"))  # a row a range
    own = F.lag(value).over(Window.partitionBy("range").orderBy(key))
    return marked.withColumn("__own", own).join(sent, "range").withColumn("previous", F.coalesce("__own", "sent")).drop("__own", "sent")


def running(rows: DataFrame, key: str, name: str, value: Column) -> DataFrame:
    """`rows` with `name`, the sum of `value` up to and with each row by `key`; `rows` have a `range` (see `ranges`)."""
    sums = rows.groupBy("range").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("range", before.alias("__base"))  # a row a range
    within = F.sum(value).over(Window.partitionBy("range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__in", within).join(base, "range").withColumn(name, F.col("__base") + F.col("__in")).drop("__in", "__base")
