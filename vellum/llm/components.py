"""Connected components of a distributed edge list: stars within tasks, then alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

#: Edges that a task contracts at a time.
TASK_EDGES = 1 << 20


def _stars(kind: pa.DataType):
    """Edges (a, b) of each run of a task's edges, replaced by stars: every node but the smallest of a component names that one."""

    def contract(a: list, b: list) -> pa.RecordBatch:
        up: dict = {}

        def root(x):
            top = x
            while (y := up.get(top, top)) != top:
                top = y
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for x, y in zip(a, b, strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["a", "b"])

    def run(batches):
        a, b = [], []
        for batch in batches:
            a += batch.column("a").to_pylist()
            b += batch.column("b").to_pylist()
            if len(a) >= 2 * TASK_EDGES:  # uneven dealing: what has been contracted is a forest, and fewer
                yield contract(a, b)
                a, b = [], []
        yield contract(a, b)

    return run


def _contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """Stars of the edges, dealt evenly over as many tasks as they fill; with one task these are the components."""
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    kind = common.arrow_schema(edges.schema).field("a").type
    return common.materialise(edges.repartition(tasks).mapInArrow(_stars(kind), edges.schema), "stars"), tasks


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected `edges` (a, b); the component is its smallest node.

    Steps between tasks group by node with partial aggregation and join back, so a node with very many edges is split
    like any skewed join. Edges stay distributed; the driver sees a count and a checksum a round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, tasks = _contracted(common.materialise(edges, "edges"))
    last = None
    while tasks > 1 and (now := _state(edges)) != last:
        last = now
        # Large star: a node's larger neighbours move to its smallest neighbour (or itself).
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours move to the smallest of them.
        large = large.where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        moved = large.join(low, large["a"] == low["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.materialise(moved.union(low.select("n", "m")).where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
