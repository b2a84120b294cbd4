"""Tables from elsewhere under one shape of call: files of several formats, databases, topics; findings and ledgers as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of recorded signatures: sixteen hexadecimal digits.
SIGNATURE = r"/[0-9a-f]{16}\.json$"
RUNS = "version string, date string, books long, modes array<string>, failed long, errors long, introduced long, inherent long, carried long, fatal long, text_lost long, unwritten long, duplicates long, clean boolean, note string"
FORMATS = ("parquet", "csv", "json", "orc", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table of files. CSV has a header and needs a schema, so that no pass over the data guesses one."""
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    if kind == "csv" and schema is None:
        raise ValueError("a table of comma-separated values needs a schema")
    reader = spark.read.format(kind).options(**({"header": True} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**({"header": True} if kind == "csv" else {}), **options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def database(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, tasks: int, **options) -> DataFrame:
    """A database's table, read by `tasks` ranges of a numeric key at once; needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=tasks, **options).load()


def topic(spark: SparkSession, servers: str, name: str, schema: T.StructType | str, **options) -> DataFrame:
    """A stream of a topic's JSON messages with their time; needs the connector on the class path."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": name, **options}).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v"), F.col("timestamp").alias("arrived")).select("v.*", "arrived")


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """(book, path, value): the leaves of recorded signatures, one file a book; other files are passed over."""
    whole = spark.read.option("wholetext", True).text(folder).select("value", F.col("_metadata.file_path").alias("file")).where(F.rlike("file", F.lit(SIGNATURE)))
    return leaves(whole.select(F.regexp_extract("file", r"([0-9a-f]{16})\.json$", 1).alias("book"), F.col("value").alias("json")), "json")


def leaves(rows: DataFrame, json_col: str, depth: int = 6) -> DataFrame:
    """The other columns with (path, value) of every leaf of a JSON document, down to `depth` levels; lists are leaves."""
    keys = [c for c in rows.columns if c != json_col]
    open_ = rows.select(*keys, F.lit("").alias("path"), F.col(json_col).alias("value"))
    done = None
    for _ in range(depth):
        each = open_.select(*keys, "path", "value", F.json_object_keys("value").alias("__keys"))
        closed = each.where("__keys IS NULL").select(*keys, "path", "value")
        done = closed if done is None else done.union(closed)
        inner = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
        open_ = each.where("__keys IS NOT NULL").select(*keys, "path", F.explode(inner).alias("__k", "__v")).select(*keys, F.concat_ws("/", F.nullif("path", F.lit("")), "__k").alias("path"), F.col("__v").alias("value"))
    return done.union(open_)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a ledger: what older runs didn't count stays unknown and is not nothing."""
    return spark.read.schema(RUNS).option("multiLine", True).json(path)


def append_run(run: DataFrame, path: str) -> None:
    """Adds a run to a ledger that is a folder of lines."""
    run.coalesce(1).write.mode("append").json(path)  # one row


def publish(df: DataFrame, path: str, check) -> None:
    """Writes a table beside its place, reads it again, and moves it there only if `check` of what was read is true."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged"
    df.write.mode("overwrite").parquet(staged)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here, there = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(conf)
    if not check(spark.read.schema(df.schema).parquet(staged)):
        files.delete(here, True)
        raise ValueError("what was written is not what was wanted; nothing was published")
    if files.exists(there):
        files.delete(there, True)
    if not files.rename(here, there):
        raise OSError(f"could not move {staged} to {path}")
