"""Style sheets, packages, declared values and sequences on small literals."""

from pyspark.sql import functions as F

from vellum.functions import values
from vellum.operators import sequences, styles
from vellum.sources import binaries, packages, stylesheets


def _values(spark, f, given):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_dates(spark):
    given = ["2020-02-30", "1999-1-2", "May 3, 1987", "3 May 1987", "31/12/2001", "12/31/2001", "0101", "2001-05", "about 1890", "", None, "2010-01-02T03:04:05+02:00"]
    assert _values(spark, values.normal_date, given) == ["2020", "1999-01-02", "1987-05-03", "1987-05-03", "2001-12-31", "2001-12-31", "0101", "2001-05", "1890", None, None, "2010-01-02"]


def test_lengths_and_margins(spark):
    assert _values(spark, values.length_em, ["-1.5em", "24px", "50%", "", None, "em", ".5ex"]) == [-1.5, 1.5, 0.0, 0.0, 0.0, 0.0, 0.25]
    assert _values(spark, lambda v: values.margin_side(v, "left"), ["1em", "1em 2em", "1 2 3", "1 2 3 4", "1 2 3 4 5", None]) == ["1em", "2em", "2", "4", None, None]


def test_selectors(spark):
    got = _values(spark, values.specificity, ["#a .b:hover > p::before", "*", "a[href='#x'].c"])
    assert [tuple(r) for r in got] == [(1, 2, 2), (0, 0, 0), (0, 2, 1)]
    assert _values(spark, values.selector_key, ["div > p.x:first-child", ":root", "a"]) == ["p.x", "*", "a"]


def test_sample_of_pages(spark):
    got = spark.range(20).where(values.sampled(F.col("id"), F.lit(20), 6)).orderBy("id")
    assert [r[0] for r in got.collect()] == [0, 1, 2, 3, 8, 13]
    assert spark.range(4).where(values.sampled(F.col("id"), F.lit(4), 6)).count() == 4


def test_sheet_is_read_past_strings_comments_and_conditions():
    got = stylesheets.read_sheet("@import 'a;b'; /* x{} */ a, b:is(c, d) { color: red !important; background: url(data:x;y) } @media print { p { margin: 0 } } .z { top: 1")
    assert [(r[1], r[2], r[6], r[7], r[8]) for r in got] == [
        ("a", None, "color", "red", True), ("a", None, "background", "url(data:x;y)", False), ("b:is(c, d)", None, "color", "red", True),
        ("b:is(c, d)", None, "background", "url(data:x;y)", False), ("p", "@media print", "margin", "0", False), (".z", None, "top", "1", False),
    ]
    assert stylesheets.read_sheet(None) == stylesheets.read_sheet("") == stylesheets.read_sheet("}}") == []
    assert stylesheets.without("abcdef", [(3, 5), (1, 4)]) == "af"


def test_inheritance_and_chains(spark):
    tree = spark.createDataFrame([(1, 0, None, "a"), (1, 1, 0, None), (1, 2, 1, None), (1, 3, 2, None), (1, 4, 3, "b"), (2, 0, None, None), (2, 1, 0, None)], "doc int, node int, parent int, value string")
    got = {(r["doc"], r["node"]): (r["value"], r["distance"]) for r in styles.inherited(tree).collect()}
    assert got == {(1, 0): ("a", 0), (1, 1): ("a", 1), (1, 2): ("a", 2), (1, 3): ("a", 3), (1, 4): ("b", 0), (2, 0): (None, -1), (2, 1): (None, -1)}
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("d", "e"), ("e", "d"), ("f", "gone"), ("g", "g"), ("h", "f")], "node string, next string")
    assert {r[0]: r[1] for r in sequences.chains(rows).collect()} == {"a": "ends", "b": "ends", "c": "ends", "d": "cycle", "e": "cycle", "f": "missing", "g": "cycle", "h": "missing"}
    assert sequences.chains(rows.limit(0)).count() == 0


PACKAGE = b"""<package xmlns="x"><metadata><title id="t">A  book</title><meta refines="#t" property="title-type">main</meta></metadata>
<manifest><item id="a" href="a%20b.xhtml" media-type="text/html"/><item id="n" href="../nav.xhtml" properties="nav scripted"/><item id="a" href="gone.css"/></manifest>
<spine><itemref idref="a"/><itemref idref="lost" linear="no"/></spine></package>"""
NAV = b'<html xmlns:e="e"><nav e:type="toc"><ol><li><a href="ops/a%20b.xhtml#x">One</a><ol><li><span>Two</span></li></ol></li><li><a href="no.xhtml">3</a></li></ol></nav></html>'


def test_package(spark):
    container = b'<container><rootfiles><rootfile full-path="no.opf"/><rootfile full-path="/ops/p.opf"/></rootfiles></container>'
    entries = spark.createDataFrame([("b", n, d) for n, d in [("META-INF/container.xml", container), ("ops/p.opf", PACKAGE), ("z.opf", b""), ("nav.xhtml", NAV), ("ops/a b.xhtml", b""), ("extra.txt", b"")]] + [("c", "x/y.opf", b"<bad"), ("c", "q.opf", None)], "book string, name string, data binary")
    chosen = packages.package_documents(entries)
    assert sorted((r["book"], r["name"]) for r in chosen.collect()) == [("b", "ops/p.opf"), ("c", "q.opf")]
    parts = packages.packages(chosen)
    assert [tuple(r) for r in parts.where("part = 'metadata'").orderBy("ord").select("name", "value", "path").collect()] == [("title", "A book", None), ("title-type", "main", "t")]
    assert sorted(((r["ord"], r["path"], r["linear"]) for r in packages.reading_order(parts).collect())) == [(0, "ops/a b.xhtml", True), (1, None, False)]
    points = packages.navigation(entries.where("name = 'nav.xhtml'"))
    assert [tuple(r)[2:] for r in points.orderBy("pre").collect()] == [(0, None, 0, "One", "ops/a b.xhtml", "x"), (1, 0, 1, "Two", None, None), (2, None, 0, "3", "no.xhtml", None)]
    got = {(r["rule"], r["subject"]) for r in packages.violations(parts, points, entries.where("book = 'b'")).collect()}
    assert got == {("manifest-missing", "ops/gone.css"), ("spine-unknown", "lost"), ("navigation-missing", "no.xhtml"), ("unlisted", "extra.txt"), ("repeated-id", "a")}


def test_package_round_trip_order_and_cover(spark):
    book = spark.createDataFrame([("b", "p.opf", PACKAGE)], "book string, name string, data binary")
    parts = packages.packages(book)
    again = packages.packages(packages.package_text(parts).select("book", F.lit("p.opf").alias("name"), F.col("text").cast("binary").alias("data")))
    # The one path outside the archive's root is the navigation's, which is read as a name at the root both times.
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, parts.collect())) == sorted(map(key, again.collect()))
    names = spark.createDataFrame([("b", f"c{i}.xhtml") for i in (10, 9, 2)] + [("b", "a b.xhtml"), ("b", "x.png")], "book string, name string")
    points = packages.navigation(spark.createDataFrame([("b", "n", b'<nav role="doc-toc"><ol><li><a href="c10.xhtml">x</a></li></ol></nav>')], "book string, name string, data binary"))
    assert [r["path"] for r in packages.recovered_order(points, parts, names).orderBy("ord").collect()] == ["c10.xhtml", "a b.xhtml", "c2.xhtml", "c9.xhtml"]
    covers = packages.packages(spark.createDataFrame([("b", "p", b'<p><metadata><meta name="cover" content="i"/></metadata><manifest><item id="k" href="cover.png" media-type="image/png"/><item id="i" href="a.png"/></manifest></p>')], "book string, name string, data binary"))
    assert [tuple(r) for r in packages.cover(covers, points).collect()] == [("b", "a.png")]


def test_first_bytes_and_hidden_fonts(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000000070000000901")
    rows = spark.createDataFrame([(1, png), (2, b"GIF89a\x05\x00\x06\x01"), (3, b"RIFF0000WEBPx"), (4, b""), (5, None), (6, b"OTTOx" * 500)], "i int, data binary").withColumn("key", binaries.book_key(F.lit(" urn:x y ")))
    got = rows.orderBy("i").select(binaries.image_kind(F.col("data")), binaries.image_size(F.col("data")), binaries.font_kind(F.col("data"))).collect()
    assert [r[0] for r in got] == ["png", "gif", "webp", None, None, None]
    assert [r[1] and tuple(r[1]) for r in got] == [(7, 9), (5, 262), None, None, None, None]
    assert got[5][2] == "otf"
    hidden = binaries.unhidden(rows)
    assert hidden.where("i = 6").first()["data"][:1040] != (b"OTTOx" * 500)[:1040] and hidden.where("i = 6").first()["data"][1040:] == (b"OTTOx" * 500)[1040:]
    assert [r["data"] for r in binaries.unhidden(hidden).orderBy("i").collect()] == [r["data"] for r in rows.orderBy("i").collect()]
