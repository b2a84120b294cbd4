"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words. DataFrame functions only.

A text is cut at blank lines into sections, at line ends into paragraphs, and each paragraph at fixed word counts from
its start (1, 2, 4, 8, 16, 24, ...) into leaves. Every node's digest covers its children's, so equal roots mean equal
texts and unequal branches lead to the edits. The fingerprint string is the root, then each section's digest with its paragraphs'
and leaves' (8 hexadecimal digits each).

Cases: a null text counts as empty (one empty leaf); texts are whole, however long; null ids come first in id order, in blocks
by the hash of their texts; rows that share an id are ordered by a hash of their texts; repeated rows each keep their row; the only row of a table is its own next;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import common

SHORT = 8


def _sha(x: Column, n: int | None = None) -> Column:
    digest = F.sha2(x, 256)
    return digest if n is None else F.substring(digest, 1, n)


def _start(i: Column) -> Column:
    """The word at which leaf i of a paragraph starts: 0, 1, 2, 4, 8, 16, 24, ..."""
    return F.when(i < 3, i).otherwise(F.when(i == 3, 4).otherwise(8 * (i - 3))).cast("int")


def _leaves(paragraph: Column) -> Column:
    words = F.split(paragraph, " ", -1)
    n = F.size(words)
    count = F.when(n <= 2, n).when(n <= 4, 3).when(n <= 8, 4).otherwise(F.ceil((n - 8) / 8) + 4).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: _sha(F.array_join(F.slice(words, _start(i) + 1, _start(i + 1) - _start(i)), " ")))


def tree(text: Column) -> Column:
    """struct(root, sections: array(struct(hash, paragraphs: array(struct(hash, leaves: array))))), digests shortened below the root."""
    short = lambda xs: F.transform(xs, lambda x: F.substring(x, 1, SHORT))
    paragraphs = lambda s: F.transform(F.transform(F.split(s, "\n", -1), _leaves), lambda ls: F.struct(_sha(F.concat(F.lit("p"), F.array_join(ls, ""))).alias("hash"), short(ls).alias("leaves")))
    sections = F.transform(F.transform(F.split(text, "\n\n", -1), paragraphs), lambda ps: F.struct(_sha(F.concat(F.lit("s"), F.array_join(F.transform(ps, lambda p: p["hash"]), ""))).alias("hash"), F.transform(ps, lambda p: F.struct(F.substring(p["hash"], 1, SHORT).alias("hash"), p["leaves"].alias("leaves"))).alias("paragraphs")))
    return F.transform(F.array(sections), lambda ss: F.struct(_sha(F.concat(F.lit("d"), F.array_join(F.transform(ss, lambda s: s["hash"]), ""))).alias("root"), F.transform(ss, lambda s: F.struct(F.substring(s["hash"], 1, SHORT).alias("hash"), s["paragraphs"].alias("paragraphs"))).alias("sections")))[0]


def fingerprint(t: Column) -> Column:
    """The tree as one string: root|section(paragraph:leaves,paragraph:leaves)..."""
    paragraph = lambda p: F.concat(p["hash"], F.lit(":"), F.array_join(p["leaves"], ""))
    section = lambda s: F.concat(s["hash"], F.lit("("), F.array_join(F.transform(s["paragraphs"], paragraph), ","), F.lit(")"))
    return F.concat(t["root"], F.lit("|"), F.array_join(F.transform(t["sections"], section), ""))


def leaf_set(t: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(t["sections"], lambda s: s["paragraphs"])), lambda p: p["leaves"])))


def printed_leaves(printed: Column) -> Column:
    """The leaf set as a fingerprint has it: what follows a colon, eight digits a leaf."""
    runs = F.array_join(F.regexp_extract_all(printed, F.lit(":([0-9a-f]+)"), 1), "")
    return F.array_distinct(F.regexp_extract_all(runs, F.lit(f"([0-9a-f]{{{SHORT}}})"), 1))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two leaf sets."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """(section, paragraph) positions at which two trees differ, descending only where a digest does."""
    places = lambda x, y: F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
    of = lambda xs, i: F.get(xs, i)
    paragraphs = lambda t, i: F.coalesce(of(t["sections"], i)["paragraphs"], F.filter(t["sections"][0]["paragraphs"], lambda _: F.lit(False)))
    differing = F.filter(places(a["sections"], b["sections"]), lambda i: ~of(a["sections"], i)["hash"].eqNullSafe(of(b["sections"], i)["hash"]))
    inside = lambda i: F.transform(F.filter(places(paragraphs(a, i), paragraphs(b, i)), lambda j: ~of(paragraphs(a, i), j)["hash"].eqNullSafe(of(paragraphs(b, i), j)["hash"])), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))
    return F.when(a["root"] == b["root"], F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.flatten(F.transform(differing, inside)))


def with_next(rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, text, …) with `next_` columns: those of the next document in descending id order; after the last comes
    the first.

    Blocks of ids are sorted apart; the largest id of a block is sent to the following one as well, so no task sees all
    rows and texts are shuffled once.
    """
    spark, along = rows.sparkSession, [c for c in rows.columns if c != "doc_id"]
    block = common.ordered_blocks(rows.select("doc_id", "text"), "doc_id", 4 * common.partitions(spark), F.octet_length("text") + 64, spread="text")
    # One row a block, whose number is bounded by the number of partitions. Rows that share an id are ordered by a hash.
    last = F.struct("doc_id", F.xxhash64("text").alias("tie"))
    tops = rows.select(last.alias("last"), block.alias("of_block")).groupBy("of_block").agg(F.max("last").alias("top"))
    beyond = Window.orderBy("of_block")
    sent = tops.select("of_block", "top", F.coalesce(F.lead("of_block").over(beyond), F.min("of_block").over(Window.partitionBy())).alias("to"))
    marked = rows.withColumn("tie", F.xxhash64("text")).withColumn("block", block).join(F.broadcast(sent), (F.col("block") == F.col("of_block")) & F.struct("doc_id", "tie").eqNullSafe(F.col("top")), "left")
    own, ghost = F.struct(F.col("block").alias("b"), F.lit(1).alias("rank")), F.struct(F.col("to").alias("b"), F.lit(0).alias("rank"))
    placed = marked.select(*rows.columns, "tie", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, ghost))).alias("at")).select(*rows.columns, "tie", "at.b", "at.rank")
    ordered = Window.partitionBy("b").orderBy("rank", "doc_id", "tie")
    before = F.lag(F.struct(*along)).over(ordered)
    # The window's own exchange deals blocks out: one by ranges would read everything before it for a sample.
    return placed.withColumn("__next", before).where("rank = 1").select(*rows.columns, *[F.col(f"__next.{c}").alias(f"next_{c}") for c in along])


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). A document's tree is built
    once, before it goes to its neighbour; only the edited text needs another."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = rows.select("doc_id", "text", tree(F.col("text")).alias("t")).select("doc_id", "text", fingerprint(F.col("t")).alias("fingerprint"))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    pairs = with_next(own).select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    trees = pairs.select("doc_id", "n_chars", "fingerprint", printed_leaves(F.col("fingerprint")).alias("leaves"), printed_leaves(F.col("next_fingerprint")).alias("next_leaves"), F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("edited")).alias("e"))
    flat = trees.select("doc_id", "n_chars", "edited_sha256", "fingerprint", fingerprint(F.col("e")).alias("edited_fingerprint"), "leaves", "next_leaves", leaf_set(F.col("e")).alias("el"))
    return flat.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("leaves"), F.col("el")).alias("near_edited"), likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
