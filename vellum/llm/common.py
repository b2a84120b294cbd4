"""Shared plumbing of the training-data operators: scratch tables, ordered blocks, Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bins of the key histogram that `ordered_blocks` collects; the driver never holds more.
HISTOGRAM_BINS = 1024
#: A bin of more than so many times the mean is looked into.
HEAVY = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. A session of one machine, as in tests, may do without: it gets
    a temporary one; on a cluster that would be a folder of the driver alone, so the setting is asked for."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/vellum/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already; the folder belongs to this application only
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """About how many bytes `df` reads, as the optimiser knows from file sizes; 0 where it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _numbers(values: list[float]) -> Column:
    """A constant array; parsed and folded once instead of one call per element."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def ordered_blocks(df: DataFrame, key: str, n: int, weight: Column | None = None, unit: float | None = None, spread: str | None = None) -> Column:
    """A block number in 0..n-1 that never falls as `key` rises, with about equal weight a block; `unit` asks for more
    blocks if they would weigh more than it. Equal keys share a block. Null keys get negative numbers: -1, or by the hash
    of the column `spread` as many as their weight is due.

    Narrow scans give the range and a histogram of `HISTOGRAM_BINS` bins; keys are spread evenly within a bin. A bin that
    holds far more than its share, as when a few keys lie far from all others, is parted by a histogram of its own.
    """
    x, w = F.col(key).cast("double"), (F.lit(1) if weight is None else weight).cast("double")
    low, high, total, free = df.agg(F.min(x), F.max(x), F.sum(F.when(x.isNotNull(), w)), F.sum(F.when(x.isNull(), w))).first()
    total, free = total or 0.0, free or 0.0
    n = max(1, n, math.ceil((total + free) / unit) if unit else 1)
    null = F.lit(-1)
    if spread and free:
        null = -1 - F.pmod(F.xxhash64(spread), F.lit(max(1, math.ceil(n * free / (total + free)))))
    if low is None or high <= low:
        return F.when(F.col(key).isNull(), null).otherwise(0).cast("int")

    def place(rows: DataFrame, low: float, high: float, first: float, share: float) -> Column:
        """Where in first..first+share (blocks) the keys of low..high lie."""
        at = (x - F.lit(low)) / F.lit(high - low) * HISTOGRAM_BINS
        bin_ = F.greatest(F.lit(0), F.least(F.floor(at), F.lit(HISTOGRAM_BINS - 1))).cast("int")
        mass = {b: m or 0.0 for b, m in rows.groupBy(bin_.alias("b")).agg(F.sum(w)).collect()}
        all_ = sum(mass.values()) or 1.0
        edges = [first]
        for b in range(HISTOGRAM_BINS):
            edges.append(edges[-1] + mass.get(b, 0.0) / all_ * share)
        lo, hi = F.element_at(_numbers(edges[:-1]), bin_ + 1), F.element_at(_numbers(edges[1:]), bin_ + 1)
        out = lo + (hi - lo) * F.least(at - bin_, F.lit(1.0))
        width = (high - low) / HISTOGRAM_BINS
        for b in (b for b, m in mass.items() if m > HEAVY * all_ / HISTOGRAM_BINS and edges[b + 1] - edges[b] > 1 and width > 1):
            inner = rows.where(bin_ == b)
            a, z = inner.agg(F.min(x), F.max(x)).first()
            if z > a:
                out = F.when(bin_ == b, place(inner, a, z, edges[b], edges[b + 1] - edges[b])).otherwise(out)
        return out

    block = F.floor(place(df.where(x.isNotNull()), low, high, 0.0, float(n)))
    return F.when(F.col(key).isNull(), null).otherwise(F.least(block, F.lit(n - 1))).cast("int")


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no label may be learnt from: crc32 of the id's text leaves 2 on division by 4. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def slices(sizes: list[int], budget: int = 1 << 20, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `rows` rows and about `budget` bytes."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > budget or i - start >= rows):
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def arrow_map(df: DataFrame, carry: list[str], text_col: str, out: T.StructType, make: Callable[[], Callable], slice_bytes: int = 1 << 20) -> DataFrame:
    """Appends columns that Python computes from one text or binary column, in Arrow batches.

    `make()` runs once a task and gives a function from a list of values to one list a column of `out`.
    Carried columns whose name (in any case) is also an output's are left out: the output wins.
    """
    taken = {f.name.lower() for f in out.fields}
    kept = [c for c in carry if c.lower() not in taken]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__value"))
    schema = T.StructType([*source.schema.fields[:-1], *out.fields])
    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    names = [f.name for f in schema.fields]
    width = len(kept)

    def run(batches):
        work = make()
        for batch in batches:
            values = batch.column(width)
            lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
            for a, b in slices(lengths, slice_bytes, 4096):
                made = work(values.slice(a, b - a).to_pylist())
                arrays = [batch.column(i).slice(a, b - a) for i in range(width)]
                arrays += [m if isinstance(m, pa.Array) else pa.array(m, type=k) for m, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


_held: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task under a key: one thing at a time, so operators that follow each other in
    the same workers don't add up."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drops what the worker keeps and gives its memory back to the system, where the C library can."""
    if _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass


def unseen(rows: list[list[str]], cache: dict, older: dict) -> list[str]:
    """The distinct items of `rows` that neither generation of a cache holds; what the older one holds moves to the younger."""
    new = set().union(*rows).difference(cache)
    for x in [x for x in new if x in older]:
        cache[x] = older[x]
        new.discard(x)
    return list(new)
