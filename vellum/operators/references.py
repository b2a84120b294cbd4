"""References between documents: extraction, resolution, dangling and relocated targets, reachability, collisions."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx


def edges(pages: DataFrame) -> DataFrame:
    """(page_id, url, href) of every double-quoted href of a page."""
    return pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


def site_path(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(url, "#", 1), "^[a-z]+://[^/]*", "")


def dangling(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links (…, target) with no such row in `targets` (target)."""
    return links.join(targets, "target", "left_anti")


def relocations(links: DataFrame, files: DataFrame) -> DataFrame:
    """(target, moved_to) of dangling targets that exactly one file of the same base name could be."""
    named = files.groupBy(F.lower(tx.basename(F.col("path"))).alias("name")).agg(F.min("path").alias("moved_to"), F.countDistinct("path").alias("n")).where("n = 1")
    return links.select("target", F.lower(tx.basename(F.col("target"))).alias("name")).distinct().join(named, "name").select("target", "moved_to")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that (src, dst) edges reach from `roots` (node), by a frontier that only grows by new nodes.

    Every round's frontier is written to the checkpoint folder, so lineage stays short and lost executors cost one round.
    """
    found = _cut(roots.select("node").distinct())
    frontier = found
    while not frontier.isEmpty():
        step = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()
        frontier = _cut(step.join(found, "node", "left_anti"))
        found = found.union(frontier)
    return found


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. A session of one machine, as in tests, gets a temporary
    one where it is unset; on a cluster the setting is asked for."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vellum/{spark.sparkContext.applicationId}/frontier-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already; the folder belongs to this application only
        pass


def orphans(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    return nodes.join(reached, "node", "left_anti")


def collisions(paths: DataFrame) -> DataFrame:
    """(view, name, n): names that several paths become as they are, in lower case, without extension, or as base names."""
    views = {"exact": F.col("path"), "case": F.lower("path"), "stem": F.lower(F.regexp_replace("path", r"\.[^./]*$", "")), "basename": F.lower(tx.basename(F.col("path")))}
    each = paths.select(F.explode(F.array(*[F.struct(F.lit(v).alias("view"), c.alias("name")) for v, c in views.items()])).alias("x"))
    return each.groupBy("x.view", "x.name").agg(F.count("*").alias("n")).where("n > 1")
