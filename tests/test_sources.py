"""Archives, elements and the stream of counts, on small cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.sources import archives, elements
from vellum.streaming import ledger


@pytest.mark.parametrize(
    ("name", "want"),
    [("a/./b//c", "a/b/c"), ("\\a\\..\\b", "b"), ("C:/x", "x"), ("/x", "x"), ("a/../../b", None), ("../../a/b/c", None), ("", None), ("a/..", None), ("x\0y", "x"), (None, None)],
)
def test_canonical_name(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(archives.canonical_name(F.col("n")).alias("n")).first()["n"] == want


def test_round_trip_of_archives(spark):
    parts = spark.createDataFrame([("b", "z.txt", b"z"), ("b", "mimetype", b"application/epub+zip"), ("b", "a.txt", None)], "book string, name string, data binary")
    first, again = (archives.pack(p).first() for p in (parts, parts.orderBy("name")))
    assert bytes(first["content"]) == bytes(again["content"]) and first["length"] == len(first["content"])
    infos = zipfile.ZipFile(io.BytesIO(first["content"])).infolist()
    assert [(i.filename, i.compress_type) for i in infos] == [("mimetype", 0), ("a.txt", 8), ("z.txt", 8)]
    rows = archives.entries(archives.pack(parts), "book").collect()
    assert {(r["name"], bytes(r["data"]), r["ok"]) for r in rows} == {("mimetype", b"application/epub+zip", True), ("a.txt", b"", True), ("z.txt", b"z", True)}


def test_refused_entries_stay_as_rows(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("bomb", b"\0" * (3 << 20))
        archive.writestr("../out", b"x")
        archive.writestr("good", b"unlike the others")
    broken = out.getvalue().replace(b"good", b"gone", 1)
    books = spark.createDataFrame([("a", out.getvalue()), ("b", b"no archive"), ("c", None), ("d", broken)], "path string, content binary")
    rows = {(r["book"], r["name"]): (r["ok"], r["reason"]) for r in archives.entries(books).collect()}
    assert rows[("a", "bomb")] == (False, "too large") and rows[("a", None)] == (False, "unusable name") and rows[("a", "good")] == (True, None)
    assert rows[("b", None)] == rows[("c", None)] == (False, "not an archive") and rows[("d", "good")] == (False, "damaged")


def test_books_are_listed_below_folders(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.epub").write_bytes(b"1")
    (tmp_path / "b.txt").write_bytes(b"2")
    assert [r["length"] for r in archives.books_in(spark, str(tmp_path)).collect()] == [1]


def test_repeated_names(spark):
    rows = spark.createDataFrame([("b", "x", "1"), ("b", "x", "1"), ("b", "y", "1"), ("b", "y", "2"), ("b", "z", "3")], "book string, name string, digest string")
    assert {(r["name"], r["same"]) for r in archives.repeated_names(rows).collect()} == {("x", True), ("y", False)}


HTML = "<html><body><h1 id=t>One &amp;\n two</h1><nav><p class='a b'>x<br>y</nav><div><h3>Three</h3></div></x></body>"


def test_elements(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id long, html string")
    found = elements.elements(pages)
    rows = found.orderBy("pre").collect()
    assert [(r["tag"], r["depth"], r["parent"]) for r in rows] == [("html", 0, None), ("body", 1, 0), ("h1", 2, 1), ("nav", 2, 1), ("p", 3, 3), ("br", 4, 4), ("div", 2, 1), ("h3", 3, 6)]
    assert rows[4]["classes"] == ["a", "b"] and rows[2]["element_id"] == "t" and rows[4]["text"] == "xy"
    assert [(r["label"], r["level"], r["skipped"]) for r in elements.outline(found).orderBy("pre").collect()] == [("One & two", 1, False), ("Three", 3, True)]
    assert {r["tag"] for r in elements.inside(found, ["nav", "p"]).collect()} == {"p", "br"}
    assert [r["tag"] for r in elements.outside(found, ["nav"]).orderBy("pre").collect()] == ["html", "body", "h1", "div", "h3"]
    assert elements.nesting(found).collect()[0].asDict() == {"page_id": 1, "elements": 8, "deepest": 5}


def test_stream_counts_each_file_once(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    count = lambda: {r["k"]: r["n"] for r in ledger.counted(ledger.drop_folder(spark, str(tmp_path / "in"), rows.schema), {"k": F.col("k")}, str(tmp_path / "state")).collect()}
    assert count() == {"a": 2, "b": 1}
    assert count() == {"a": 2, "b": 1}
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert count() == {"a": 4, "b": 2}
