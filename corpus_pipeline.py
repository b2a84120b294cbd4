"""A training corpus from `documents`: language, near duplicates, repeated passages, source weights, token ids.

Every stage carries whatever further columns its documents have, whatever their names. Rows with a null id are documents
without a name: they pass the language stage like others, count as nobody's near duplicate and nobody's source of a
passage, and are mixed by their text. An empty table passes every stage as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import byte_bpe, common, jaccard, language, mixing, substrings

#: Documents whose language is less sure than this, or undefined, go.
LEAST_SURE = 0.05


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """`docs` under names that no operator uses, with `text` and `doc_id` beside them."""
    own = [f"__own{i}" for i in range(len(docs.columns))]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own, strict=True)], F.col("doc_id"), F.col("text")), own


def _named(docs: DataFrame, own: list[str], names: list[str], **changed) -> DataFrame:
    """The columns again by their names, some of them with new values."""
    return docs.select(*[changed.get(c, F.col(n)).alias(c) for n, c in zip(own, names, strict=True)])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language; the label that the text shows replaces the given one.

    Null and empty texts, and those without letters, have no language and go. Rows are judged one by one, so repeated rows
    stay or go together. Long texts are read whole. Without any labelled document all go.
    """
    model = language.train(docs)
    plain, own = _plain(docs)
    found = language.identify(plain, model, carry=own)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE))
    return _named(kept, own, docs.columns, lang=F.col("lang_pred"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates: five-word shingles, likeness of 0.8 or more.

    Of rows that repeat this id one stays, the first by its text. Null, empty and blank texts are near nothing and stay, as do
    rows with a null id.
    """
    groups = jaccard.similar_classes(docs, n=5, percent=80)
    others = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    kept = docs.join(others, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = common.materialise(groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = kept.join(again, "doc_id", "left_semi").withColumn("__place", first).where("__place = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.join(again, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).union(one)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the passages that an earlier document has; a document goes if nothing is left of it.

    Null, empty and blank texts and those of less than a passage's words stay as they are, as do rows with a null id. Rows
    that share an id keep what only they have. `n_chars` is that of the text that is left.
    """
    plain, own = _plain(docs)
    cut = substrings.remove_repeats(plain, carry=own, keep_text=True)
    was = dict(zip(docs.columns, map(F.col, own), strict=True))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(was["text"])
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(was["n_chars"])
    kept = cut.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _named(kept, own, docs.columns, text=text, n_chars=length)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats the documents of small sources, up to twice, by temperature, in the order of the mixture.

    A null source is a source. Documents without words are taken as often as their source goes round; an empty table
    stays empty.
    """
    return mixing.mix(docs, repetition_limit=2.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, as little-endian unsigned 32-bit integers. Null and empty texts have none."""
    ids = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=["doc_id", "lang", "source"])
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("language", known_language), ("near_duplicates", one_of_each_group), ("substrings", without_repeats), ("mixing", mixed), ("token_ids", encoded)]

#: A language model, signatures and merges are beyond SQL: tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return docs
