"""Repairs of texts and descriptions that keep what they cannot prove: typography, hyphens, notices, titles, identifiers, people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import markup, names, values
from vellum.functions import text as tx
from vellum.operators import library

# Three dots that are no part of a longer run; Polish words of one letter that belong to the next word.
DOTS, CONJUNCTION = r"(?<!\.)\.\.\.(?!\.)", r"(?<![^\s(„«\"])([aiouwzAIOUWZ]) (?=[\p{L}\p{N}_])"
NBSP = " "
#: A question's choice that changes nothing.
KEEP = "keep"


def carried_out(rows: DataFrame, before: str, after: Column, holds: Column, to: str = "result") -> DataFrame:
    """A change with a condition on its result: `to` is the changed value where `holds` (of `before` and `__after`) is true,
    else the old one, and `reverted` says where a change was taken back."""
    made = rows.withColumn("__after", after).withColumn("__holds", F.coalesce(holds, F.lit(False)))
    changed = ~F.col(before).eqNullSafe(F.col("__after"))
    return made.withColumn(to, F.when(F.col("__holds"), F.col("__after")).otherwise(F.col(before))).withColumn("reverted", changed & ~F.col("__holds")).drop("__after", "__holds")


def typography(docs: DataFrame, book: str, language: Column, conventions: DataFrame) -> DataFrame:
    """`docs` with `repaired`, `ellipses`, `conjunctions`, `quotes` and `reverted`: dots made an ellipsis, Polish conjunctions
    bound to the next word, straight marks made those of the book's convention.

    The convention comes from the whole book (`conventions`: its key, convention); none or straight marks leave marks alone.
    A text whose canonical form would change goes back as it came.
    """
    joined = docs.join(conventions, book, "left")
    dotted = F.regexp_replace("text", DOTS, "…")
    polish = F.startswith(F.lower(language), F.lit("pl"))
    bound = F.when(polish, F.regexp_replace(dotted, CONJUNCTION, "$1" + NBSP)).otherwise(dotted)
    quoted = bound
    for name, (opening, closing) in values.CONVENTIONS.items():
        if name != "straight":
            quoted = F.when(F.col("convention") == name, markup.retyped(bound, values.QUOTES[opening], values.QUOTES[closing])["text"]).otherwise(quoted)
    settled = F.coalesce(F.col("convention") != "straight", F.lit(False))
    counted = joined.withColumn("__n", F.struct(
        F.regexp_count("text", F.lit(DOTS)).alias("ellipses"), F.when(polish, F.regexp_count(dotted, F.lit(CONJUNCTION))).otherwise(0).alias("conjunctions"),
        F.when(settled, F.regexp_count("text", F.lit('"'))).otherwise(0).alias("quotes"),
    ))
    out = carried_out(counted, "text", quoted, tx.canonical(F.col("text")) == tx.canonical(F.col("__after")), "repaired")
    kept = lambda n: F.when(F.col("reverted"), 0).otherwise(F.coalesce(F.col(f"__n.{n}"), F.lit(0))).alias(n)
    return out.select(*docs.columns, "repaired", kept("ellipses"), kept("conjunctions"), kept("quotes"), "reverted")


def joined_hyphens(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """(source, doc_id, before, text, joined): hyphens taken out of the words (source, lhs, rhs) that were decided to be broken,
    in either case of their letters. Only hyphens go: the letters stay as they are, which `only_hyphens_went` tests.

    A text's own hyphenated words are met with the decided ones by a join, so that no text carries its book's whole list.
    """
    hyphenated = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+-[\p{L}\p{N}]+)"), 1), lambda p: F.lower(p)))
    wanted = decided.select("source", F.concat_ws("-", "lhs", "rhs").alias("pair")).distinct()
    met = docs.select("source", F.col("doc_id").alias("__id"), F.explode(hyphenated).alias("pair")).join(wanted, ["source", "pair"], "left_semi")
    own = met.groupBy(F.col("source").alias("__source"), "__id").agg(F.collect_set("pair").alias("broken"))
    found = docs.join(own, (F.col("source") == F.col("__source")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    parts = F.regexp_extract_all("text", F.lit(r"(?s)([\p{L}\p{N}]+-[\p{L}\p{N}]+|[\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    made = F.transform(parts, lambda p: F.when(F.contains(p, F.lit("-")) & F.array_contains("broken", F.lower(p)), F.replace(p, F.lit("-"), F.lit(""))).otherwise(p))
    after = F.when(F.col("broken").isNotNull(), F.array_join(made, "")).otherwise(F.col("text"))
    out = found.select("source", "doc_id", F.col("text").alias("before"), after.alias("text"))
    return out.withColumn("joined", F.coalesce(F.length("before") - F.length("text"), F.lit(0)))


def only_hyphens_went(before: Column, after: Column) -> Column:
    return F.replace(before, F.lit("-"), F.lit("")) == F.replace(after, F.lit("-"), F.lit(""))


def review_questions(candidates: DataFrame, shown: int = 40) -> DataFrame:
    """(source, confidence, words, shown, question): one question for all weaker candidates of a book, with the first words."""
    weaker = candidates.where(F.col("confidence").isin("likely", "uncertain")).withColumn("word", F.concat_ws("-", "lhs", "rhs"))
    # Candidates are made once and a book's are never one list: parts of it are counted and cut first.
    cut = lambda words: F.slice(F.array_sort(words), 1, shown)
    part = weaker.groupBy("source", "confidence", F.pmod(F.xxhash64("word"), F.lit(64)).alias("part")).agg(F.count("*").alias("n"), cut(F.collect_list("word")).alias("first"))
    listed = part.groupBy("source", "confidence").agg(F.sum("n").alias("words"), F.array_join(cut(F.flatten(F.collect_list("first"))), ", ").alias("shown"))
    return listed.withColumn("question", question_id(F.lit("hyphen"), F.col("source"), F.concat_ws(":", "confidence", "words"), F.lit("join")))


def question_id(kind: Column, where: Column, subject: Column, summary: Column) -> Column:
    """An identifier that depends on what is asked alone, not on when or in what order."""
    return F.substring(F.sha2(F.concat_ws("\0", kind, where, subject, summary), 256), 1, 16)


def answered(questions: DataFrame, answers: DataFrame, standing: DataFrame) -> DataFrame:
    """`questions` (question, group, …) with `choice` and `origin`: the stored answer of a question, else the standing one of
    its group, else to keep things as they are. Stored answers (question, choice), standing ones (group, choice)."""
    stored = answers.groupBy("question").agg(F.min("choice").alias("__stored"))
    by_group = standing.groupBy("group").agg(F.min("choice").alias("__standing"))
    out = questions.join(stored, "question", "left").join(by_group, "group", "left")
    origin = F.when(F.col("__stored").isNotNull(), "stored").when(F.col("__standing").isNotNull(), "group").otherwise("unanswered")
    return out.withColumn("choice", F.coalesce("__stored", "__standing", F.lit(KEEP))).withColumn("origin", origin).drop("__stored", "__standing")


def to_save(given: DataFrame) -> DataFrame:
    """The answers worth writing down: those that a person gave and that change something."""
    return given.where((F.col("origin") == "person") & (F.col("choice") != KEEP))


def titles(rows: DataFrame) -> DataFrame:
    """(book, main, subtitle, others) from (book, ord, value): blank ones go; the first is the main one, the second the
    subtitle, the rest stay. A book without any is `Untitled`."""
    plain = rows.withColumn("value", F.trim("value"))
    kept = plain.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.when((F.col("value") != "") & F.col("value").isNotNull(), F.struct("ord", "value")))), lambda t: t["value"]).alias("t"))
    return kept.select("book", F.coalesce(F.get("t", F.lit(0)), F.lit("Untitled")).alias("main"), F.get("t", F.lit(1)).alias("subtitle"), F.array_join(F.slice("t", 3, F.greatest(F.size("t"), F.lit(1))), "|").alias("others"))


def identifiers(rows: DataFrame, derived: DataFrame) -> DataFrame:
    """(book, value, scheme, is_primary, minted) from (book, ord, value, is_primary): blank and repeated ones go; the first is
    made the primary one where none is; a book without any gets its derived one (book, identifier)."""
    plain = rows.withColumn("value", F.trim("value")).where("value <> ''")
    once = plain.groupBy("book", "value").agg(F.min(F.struct("ord", "is_primary")).alias("first")).select("book", "value", "first.ord", "first.is_primary")
    facts = once.groupBy("book").agg(F.max("is_primary").alias("any_primary"), F.min("ord").alias("first_ord"))
    kept = once.join(facts, "book")
    is_primary = F.col("is_primary") | (~F.col("any_primary") & (F.col("ord") == F.col("first_ord")))
    kept = kept.select("book", "value", values.identifier_scheme(F.col("value")).alias("scheme"), is_primary.alias("is_primary"), F.lit(False).alias("minted"))
    bare = derived.join(facts.select("book"), "book", "left_anti")
    return kept.union(bare.select("book", "identifier", F.lit(None).cast("string"), F.lit(True), F.lit(True)))


def creators(rows: DataFrame) -> DataFrame:
    """(book, ord, name, role, file_as) from (book, ord, name, role): white space folded, repeated people of one role left
    out, a role that is none made the author's."""
    plain = rows.withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " "))).where("name <> ''")
    first = plain.groupBy("book", F.lower("name").alias("low"), "role").agg(F.min(F.struct("ord", "name")).alias("f"))
    role = F.when(F.rlike(F.coalesce("role", F.lit("")), F.lit("^[a-z]{3}$")), F.col("role")).otherwise("aut")
    return first.select("book", "f.ord", "f.name", role.alias("role"), names.file_as(F.col("f.name")).alias("file_as"))


def pinned_modified(modified: Column, published: Column) -> Column:
    """A time of change that depends on the book alone: its own if it is a whole time, else that of publication, else the epoch."""
    whole = lambda c: F.when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")), c)
    return F.coalesce(whole(modified), whole(published), F.lit("1970-01-01T00:00:00Z"))


def notices_taken_out(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with `kept` and `removed`, the number of pieces of shop notices; only texts with a notice change."""
    cut = markup.without_notices(F.col("text"))
    found = docs.withColumn("__c", F.when(markup.is_shop_notice(F.col("text")), cut))
    return found.select(*docs.columns, F.coalesce("__c.kept", "text").alias("kept"), F.coalesce(F.size("__c.removed"), F.lit(0)).alias("removed"))


def hyphen_counts(docs: DataFrame) -> DataFrame:
    """(confidence, n) of a library's hyphen candidates."""
    return library.hyphen_candidates(docs).groupBy("confidence").agg(F.count("*").alias("n"))


def halves_known(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """`candidates` (language, lhs, rhs, …) with `broken`: true where the left half is no word and the joined one is, by the list
    (language, word) of that language; null where there is no list, which says nothing."""
    listed = words.select("language").distinct().withColumn("__list", F.lit(True))
    has = lambda name: words.select("language", F.col("word").alias(name), F.lit(True).alias(f"__{name}")).distinct()
    asked = candidates.withColumn("left", F.lower("lhs")).withColumn("joined", F.lower(F.concat("lhs", "rhs")))
    met = asked.join(has("left"), ["language", "left"], "left").join(has("joined"), ["language", "joined"], "left").join(listed, "language", "left")
    broken = F.when(F.col("__list"), F.col("__left").isNull() & F.col("__joined").isNotNull())
    return met.withColumn("broken", broken).drop("__left", "__joined", "__list", "left", "joined")
