"""Scalar functions on literals: a positive, a negative and a boundary case each."""

from pyspark.sql import functions as F

from vellum.functions import text as tx


def _one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def test_canonical(spark):
    assert _one(spark, tx.canonical(F.col("t")), t=" „a”...\u00a0b \u200b– c ") == '"a"… b - c'
    assert _one(spark, tx.canonical(F.col("t")), t="") == ""


def test_polish_floor(spark):
    assert _one(spark, tx.looks_polish(F.col("t")), t="ą" * 35 + "a" * 965)
    assert not _one(spark, tx.looks_polish(F.col("t")), t="ą" * 34 + "a" * 966)
    assert not _one(spark, tx.looks_polish(F.col("t")), t="")


def test_misread_characters(spark):
    assert _one(spark, tx.reread(F.col("t")), t="\x93a\x94") == "“a”"
    assert _one(spark, tx.misread(F.col("t")), t="\x93a\x81") == 1


def test_opaque_tokens(spark):
    words = F.split("t", " ")
    assert _one(spark, tx.opaque_tokens(words), t="abcdefghi1 abcdefgh1 abcdefghij 1234567890") == ["abcdefghi1"]


def test_message_shape(spark):
    assert _one(spark, tx.message_shape(F.col("t")), t="12 rules in 'a.css' take 3,5 s ") == "N rules in … take N s"
    assert _one(spark, tx.without_paths(F.col("t")), t="cannot read C:\\a\\b.epub now") == "cannot read … now"


def test_resolve(spark):
    resolve = tx.resolve(F.col("base"), F.col("href"))
    assert _one(spark, resolve, base="a/b/c.html", href="../d.html#x") == "a/d.html"
    assert _one(spark, resolve, base="a/b/c.html", href="/d.html") == "d.html"
    assert _one(spark, resolve, base="a/c.html", href="#x") == "a/c.html"
    assert _one(spark, resolve, base="a/c.html", href="../../d.html") is None
    assert _one(spark, resolve, base="a/c.html", href="https://x.org/d") is None


def test_notice(spark):
    assert _one(spark, tx.has_notice(F.col("t")), t="x\nAll  rights\nreserved.")
    assert not _one(spark, tx.has_notice(F.col("t")), t="all right")
