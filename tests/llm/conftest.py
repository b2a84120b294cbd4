import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("N_Tokens", T.StringType()),
])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts; ids count from 0 unless given. Two extra columns clash with outputs."""

    def run(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", None if k % 3 == 2 else f"s{k % 2}", len(t or ""), "x", "y") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(3)

    return run


@pytest.fixture(scope="session")
def texts():
    """Nulls, empties, blanks, copies, near copies, a long text, several scripts."""
    base = " ".join(f"word{i} and" for i in range(60))
    return [None, "", " \n\t ", base, base, base.replace("word7 ", "other "), "Short one.", "short ONE.", base + "\n\n" + base.upper(), "a\x1cb\x85c d e  f \n g", "Ünïcödé “quotes” 中文 кириллица 123 <|endoftext|> don't", "z" * 3000, " ".join(f"w{i % 977}" for i in range(30000)), "x " * 15 + base]
