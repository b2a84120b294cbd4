"""Rows that Python makes of documents, in Arrow batches: dealt to all tasks, gathered until a batch is worth its cost."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are gathered before they leave as a batch.
GATHERED = 8192


def spread(rows: DataFrame) -> DataFrame:
    """The same rows dealt evenly to `spark.sql.shuffle.partitions` tasks: a small file is one task, however long its rows take."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def gathered(rows: Iterable[tuple], types: list[pa.DataType], names: list[str], most: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Batches of up to `most` rows of a stream of them, so that documents of few rows share one."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, types, names)
            held = []
    if held:
        yield _batch(held, types, names)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
