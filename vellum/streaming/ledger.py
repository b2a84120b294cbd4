"""Incremental counts over a drop folder: a stream of partial counts, each batch written once under its number."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.references import shared_folder


def drop_folder(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files: int = 1000) -> DataFrame:
    """Files as they arrive below `folder`, at most `files` a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(folder)


def counted(stream: DataFrame, keys: dict[str, Column], where: str | None = None) -> DataFrame:
    """(keys, n) of all that a stream holds now. The state is a folder of partial counts, one sub-folder a batch.

    A batch that is run again overwrites its own sub-folder, so every file counts once; late rows need no watermark, since
    a partial count can be for any key. Start it again with the same `where` to take in what has arrived since.
    """
    spark = stream.sparkSession
    base = where or f"{shared_folder(spark)}/vellum/{spark.sparkContext.applicationId}/counts-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/parts/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/parts").groupBy(*keys).agg(F.sum("n").alias("n"))


def finished(stream: DataFrame, where: str | None = None) -> DataFrame:
    """What a streaming aggregate holds when all that is there has been read: each batch replaces its own folder, the last one
    is the whole."""
    spark = stream.sparkSession
    base = where or f"{shared_folder(spark)}/vellum/{spark.sparkContext.applicationId}/whole-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        if number == 0 or not batch.isEmpty():  # a batch that only moves the watermark on says nothing new
            batch.write.mode("overwrite").parquet(f"{base}/whole")

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/whole")


def tumbling(ts: Column, width: str) -> Column:
    """The start of the window of `width` that a time falls in."""
    return F.window(ts, width)["start"]
