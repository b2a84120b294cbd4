"""Style rules against each other and against elements: duplicates, dead names, order of specificity, cascade, inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import values
from vellum.operators.references import _cut


def losing_declarations(declarations: DataFrame) -> DataFrame:
    """Rows of (block, prop, ord, important, …) that another one of their block and property overrules: the last important
    one wins, else the last."""
    by = Window.partitionBy("block", "prop").orderBy(F.desc("important"), F.desc("ord"))
    return declarations.withColumn("__place", F.row_number().over(by)).where("__place > 1").drop("__place")


def winning_declarations(declarations: DataFrame) -> DataFrame:
    """(block, prop, value): the declaration that holds for each property of a block."""
    return declarations.groupBy("block", "prop").agg(F.max_by("value", F.struct("important", "ord")).alias("value"))


def equal_classes(declarations: DataFrame) -> DataFrame:
    """(name, first, n): classes that declare what at least one other does, from (name, prop, value) rows, with the smallest
    name and the size of their group. Groups stay rows, however many classes are alike."""
    signed = declarations.groupBy("name").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("\0", "prop", "value"))), "\1"), 256).alias("signature"))
    groups = signed.groupBy("signature").agg(F.min("name").alias("first"), F.count("*").alias("n")).where("n > 1")
    return signed.join(groups, "signature").select("name", "first", "n")


def usage(declared: DataFrame, used: DataFrame) -> DataFrame:
    """(name, state): `dead` names that rules declare and nothing uses, `bare` names in use that no rule declares."""
    a, b = declared.select("name").distinct(), used.select("name").distinct()
    return a.join(b, "name", "left_anti").withColumn("state", F.lit("dead")).union(b.join(a, "name", "left_anti").withColumn("state", F.lit("bare")))


def out_of_order(rules: DataFrame) -> DataFrame:
    """(sheet, ord, selector) of rules that come after a more specific one with the same last compound: one window over the
    running maximum instead of a join of rules with rules."""
    ranked = rules.withColumn("spec", values.specificity(F.col("selector"))).withColumn("key", values.selector_key(F.col("selector")))
    before = F.max("spec").over(Window.partitionBy("sheet", "key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("before", before).where(F.col("before") > F.col("spec")).select("sheet", "ord", "selector")


def cascade(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, prop, value, targeted): what holds for each element; a rule that aims at classes or an id outranks the others,
    and a later one outranks an earlier one.

    elements: (node, tag, classes, element_id); rules: (ord, tag, classes, element_id, targeted, prop, value), with null
    for a tag or id that a rule leaves open. A rule joins by its rarest part (id, else first class, else tag), so each join
    is on equality; the other parts are tested after it. Rules that leave everything open meet every element: they are put into
    one row beforehand, a property each, so they need no key that all elements share.
    """
    open_ = F.col("element_id").isNull() & (F.size("classes") == 0) & (F.col("tag").isNull() | (F.col("tag") == "*"))
    anchor = F.when(F.col("element_id").isNotNull(), F.concat(F.lit("#"), "element_id")).when(F.size("classes") > 0, F.concat(F.lit("."), F.element_at("classes", 1))).otherwise(F.col("tag"))
    offers = F.array_compact(F.concat(F.array(F.col("tag"), F.concat(F.lit("#"), "element_id")), F.transform(F.array_distinct("classes"), lambda c: F.concat(F.lit("."), c))))
    asked = rules.where(~open_).select(anchor.alias("anchor"), "ord", F.col("tag").alias("r_tag"), F.col("classes").alias("r_classes"), F.col("element_id").alias("r_id"), "targeted", "prop", "value")
    met = elements.withColumn("anchor", F.explode(offers)).join(asked, "anchor")
    fits = (F.col("r_tag").isNull() | F.col("r_tag").isin("*") | (F.col("r_tag") == F.col("tag"))) & (F.size(F.array_except("r_classes", "classes")) == 0)
    fits = fits & (F.col("r_id").isNull() | F.coalesce(F.col("r_id") == F.col("element_id"), F.lit(False)))
    own = met.where(fits).groupBy("node", "prop").agg(F.max(F.struct("targeted", "ord", "value")).alias("best"))
    # One rule a property: their number is bounded by the properties that style sheets know.
    general = rules.where(open_).groupBy("prop").agg(F.max(F.struct("targeted", "ord", "value")).alias("best"))
    whole = general.agg(F.collect_list(F.struct("prop", "best")).alias("all"))
    every = elements.select("node", whole.scalar().alias("all")).select("node", F.explode("all").alias("a")).select("node", "a.prop", "a.best")
    out = own.union(every).groupBy("node", "prop").agg(F.max("best").alias("best"))
    return out.select("node", "prop", "best.value", "best.targeted")


def inherited(nodes: DataFrame) -> DataFrame:
    """(doc, node, value, distance): the nearest value among a node and its ancestors, from (doc, node, parent, value).

    Every round doubles the distance that each node has looked, so a tree of depth d takes about log2(d) joins on
    (doc, parent); only unanswered nodes join. Without any value above it a node gets null and -1; so does one whose
    parents go round in a circle without a value, which a distance beyond the number of nodes tells.
    """
    every = _cut(nodes.select("doc", "node", F.col("parent").alias("up"), "value", F.when(F.col("value").isNull(), 1).otherwise(0).alias("distance")))
    most = every.groupBy("doc").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        above = every.select("doc", F.col("node").alias("up"), F.col("up").alias("far"), F.col("value").alias("there"), F.col("distance").alias("more"))
        open_ = every.where(F.col("value").isNull() & F.col("up").isNotNull() & (F.col("distance") <= most))
        if open_.isEmpty():
            break
        step = open_.join(above, ["doc", "up"], "left").select("doc", "node", F.col("far").alias("up"), F.col("there").alias("value"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance"))
        every = _cut(every.where(F.col("value").isNotNull() | F.col("up").isNull() | (F.col("distance") > most)).union(step))
    return every.select("doc", "node", "value", F.when(F.col("value").isNull(), -1).otherwise(F.col("distance")).alias("distance"))
