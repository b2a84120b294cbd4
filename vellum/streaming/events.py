"""Windows over streams of events by their own time: tumbling, sliding and sessions, with late events bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, keys, n): events by windows of `width`, begun every `slide` if given. Events later than `late` behind the latest
    one are left out, and state older than that is dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """(start, end, keys, n): runs of events that follow each other within `gap`."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def once(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key; what is remembered of a key goes with the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def streaks(events: DataFrame, key: str, order: str, good: Column) -> DataFrame:
    """(key, length): the length of each key's run of good events so far, kept as state between batches."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("__o")
        for is_good in rows["__g"]:
            length = length + 1 if is_good else 0
        state.update((length,))
        yield pd.DataFrame({key: [name[0]], "length": [length]})

    rows = events.select(F.col(key).cast("string").alias(key), F.col(order).cast("long").alias("__o"), good.alias("__g"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, length long", "length long", "update", GroupStateTimeout.NoTimeout)
