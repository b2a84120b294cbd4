"""Temperature mixing of sources, realised as block permutations. DataFrame functions only.

A source's weight is its token count to the power a, normalised. The exponent is bisected to the largest one whose
weights reach a target entropy, or to the smallest one that repeats no source more than a limit. The budget is the
least that leaves nothing out: the source that the weights favour least is taken once, every other one as often as its weight says. Whole repetitions
and a part of one follow each other; every repetition of a source is a permutation of its documents by a seeded hash.
The sequence is cut into blocks of about `block_tokens` tokens in each of which every source has its share.

Positions within a source come from sums over hash buckets of about `BUCKET_ROWS` documents and a running sum within a
bucket, so no source, however large, meets in one task. Sources are rows throughout, however many there are.

Cases: null sources are a source; documents that share an id and a source move together as one; those with a null id do
if their texts are equal; null, empty and blank texts have no tokens: they are taken once in each whole repetition and
dealt to blocks by hash; a source without tokens is taken once; an empty table gives an empty result; columns but the id,
the source and the text are ignored by `plan` and carried by `mix`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import common

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents of a bucket; halvings of the exponent's range; exponents that one pass over the sources tries.
BUCKET_ROWS, STEPS, TRIED = 2000, 50, 63


def plan(docs: DataFrame, repetition_limit: float | None = 2.0, target_entropy: float | None = None, block_tokens: int = 200_000, seed: int = 7, marks: bool = False) -> DataFrame:
    """(block, position, doc_id, source, epoch, n_tokens): the mixture in order. Target entropy is in nats. `marks` adds the
    digest by which documents without an id are told apart."""
    if (repetition_limit is None) == (target_entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    tokens = F.sum(F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"))
    units = common.materialise(docs.groupBy("doc_id", "source", _mark().alias("mark")).agg(tokens.alias("n_tokens")), "units")
    by_source = units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    ends = by_source.where("tokens > 0").agg(F.max("tokens").cast("double").alias("most"), F.min("tokens").cast("double").alias("least"))
    if target_entropy is None:  # repetition falls as the exponent rises
        step = f"IF(coalesce(power(most / least, 1 - (s.lo + s.hi) / 2), 1D) <= {float(repetition_limit)!r}D, named_struct('lo', s.lo, 'hi', (s.lo + s.hi) / 2), named_struct('lo', (s.lo + s.hi) / 2, 'hi', s.hi))"
        solved = ends.selectExpr("most", f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (s, i) -> {step}, s -> round(s.hi, 6)) AS a")
    else:
        solved = ends.select("most", F.lit(round(entropy_exponent(by_source, target_entropy), 6)).alias("a"))
    # (most / tokens) ^ (1 - a): how often a source is taken, once for the largest.
    rates = by_source.withColumn("one", F.lit(1)).join(F.broadcast(solved.withColumn("one", F.lit(1))), "one")  # one row
    rates = rates.select("source", "tokens", "n_docs", F.expr("CASE WHEN tokens > 0 THEN round(power(most / tokens, 1 - a), 6) ELSE 1D END").alias("times"))
    total = rates.agg(F.sum(F.col("times") * F.col("tokens")).alias("budget")).select(F.greatest(F.lit(1), F.ceil(F.coalesce("budget", F.lit(0.0)) / block_tokens)).cast("long").alias("n_blocks"), F.lit(1).alias("one"))
    rates = rates.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select(F.col("source").alias("s"), "tokens", "n_docs", "times", "n_blocks")

    each = units.join(rates, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    each = each.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.ceil("times") - 1).cast("int"))))
    each = each.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.col("mark")))))
    u = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32
    each = each.withColumn("u", u).withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("long"))
    keys = ["source", "epoch", "bucket"]
    sums = each.groupBy(*keys).agg(F.sum("n_tokens").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("bucket").alias("b"), before.alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("h", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    placed = each.withColumn("within", within).join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("at", F.col("before") + F.col("within"))
    # The last repetition is a part: documents whose place is before its end; whole ones hold every document without words too.
    whole = (F.col("tokens") == 0) | ((F.col("n_tokens") == 0) & (F.col("epoch") + 1 <= F.col("times")))
    placed = placed.where(whole | (F.col("at") < F.round((F.col("times") - F.col("epoch")) * F.col("tokens"))))
    block = F.when((F.col("tokens") == 0) | (F.col("n_tokens") == 0), F.floor(F.col("u") * F.col("n_blocks"))).otherwise(F.floor((F.col("epoch") * F.col("tokens") + F.col("at")) * F.col("n_blocks") / (F.col("times") * F.col("tokens"))))
    blocks = placed.withColumn("block", F.least(block.cast("long"), F.col("n_blocks") - 1))
    position = F.row_number().over(Window.partitionBy("block").orderBy("h", "doc_id", "source", "epoch", "mark")).cast("long")
    return blocks.select("block", position.alias("position"), "doc_id", "source", "epoch", "n_tokens", *(["mark"] if marks else []))


def _mark():
    """What tells documents without an id apart: a digest of the text."""
    return F.when(F.col("doc_id").isNull(), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit("")))))


def entropy_exponent(by_source: DataFrame, target: float) -> float:
    """The largest exponent in 0..1 whose weights reach a target entropy (in nats), from rows (tokens).

    Entropy falls as the exponent rises. Every pass over the sources narrows the range to one of `TRIED` + 1 parts.
    """
    low, high = 0.0, 1.0
    tokens = common.materialise(by_source.where("tokens > 0").select(F.ln(F.col("tokens").cast("double")).alias("x")), "sources")
    while high - low > 2.0**-STEPS:
        tried = [low + (high - low) * (k + 1) / (TRIED + 1) for k in range(TRIED)]
        sums = tokens.agg(*[F.sum(F.exp(F.lit(a) * F.col("x"))).alias(f"p{k}") for k, a in enumerate(tried)], *[F.sum(F.exp(F.lit(a) * F.col("x")) * F.lit(a) * F.col("x")).alias(f"q{k}") for k, a in enumerate(tried)]).first()
        if sums["p0"] is None:
            return low
        reach = [math.log(sums[f"p{k}"]) - sums[f"q{k}"] / sums[f"p{k}"] >= target for k in range(TRIED)]
        k = sum(reach)
        low, high = tried[k - 1] if k else low, tried[k] if k < TRIED else high
    return low


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The documents in their mixture, with the columns of `docs`: a row for each time that one is taken.

    Rows come in the order of the plan: blocks in ranges over the partitions, and by position within each of them. Rows
    that share an id and a source (or, without an id, a text) are taken together.
    """
    order = plan(docs, marks=True, **settings).select(F.col("block").alias("__block"), F.col("position").alias("__position"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("mark").alias("__mark"))
    joined = docs.withColumn("__m", _mark()).join(order, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & F.col("__m").eqNullSafe(F.col("__mark")))
    n = common.partitions(docs.sparkSession)
    return joined.repartitionByRange(n, "__block", "__position").sortWithinPartitions("__block", "__position").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"))


def sql() -> str:
    return f"""
WITH RECURSIVE units AS (SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN 'null' || any_value(md5(coalesce(text, ''))) END AS mark, sum(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0))::BIGINT AS n_tokens FROM documents GROUP BY doc_id, source, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END),
by_source AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_docs FROM units GROUP BY 1),
ends AS (SELECT max(tokens)::DOUBLE AS most, (min(tokens) FILTER (tokens > 0))::DOUBLE AS least FROM by_source),
half AS (SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, coalesce(power(most / least, 1 - (lo + hi) / 2), 1) <= 2.0 AS ok FROM half, ends WHERE i < {STEPS})),
rates AS (SELECT s.*, CASE WHEN tokens > 0 THEN round(power(most / tokens, 1 - (SELECT round(hi, 6) FROM half WHERE i = {STEPS})), 6) ELSE 1 END AS times FROM by_source s, ends),
budget AS (SELECT greatest(1, ceil(sum(times * tokens) / 200000))::BIGINT AS n_blocks FROM rates),
each AS (SELECT u.doc_id, u.source, u.mark, u.n_tokens, r.tokens, r.n_docs, r.times, n_blocks, epoch::INTEGER AS epoch,
    md5('7:' || epoch || ':' || coalesce(u.doc_id::VARCHAR, u.mark)) AS h
  FROM units u JOIN rates r ON u.source IS NOT DISTINCT FROM r.source, budget, unnest(range(0, ceil(times)::BIGINT)) t(epoch)),
placed AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
    sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY h, doc_id, mark ROWS UNBOUNDED PRECEDING) - n_tokens AS place FROM each),
kept AS (SELECT *, least(n_blocks - 1, CASE WHEN tokens = 0 OR n_tokens = 0 THEN floor(u * n_blocks) ELSE floor((epoch * tokens + place)::DOUBLE * n_blocks / (times * tokens)) END)::BIGINT AS block
  FROM placed WHERE tokens = 0 OR (n_tokens = 0 AND epoch + 1 <= times) OR place < round((times - epoch) * tokens))
SELECT block, row_number() OVER (PARTITION BY block ORDER BY h, doc_id, source, epoch, mark) AS position, doc_id, source, epoch, n_tokens FROM kept"""
