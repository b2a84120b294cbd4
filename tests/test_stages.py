"""Reader, rewriting stages, guards and tables on small literals: a positive, a negative and a boundary case each."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.functions import markup, names
from vellum.operators import ordered, repairs, styles
from vellum.sources import archives, reader, tables, trees
from vellum.stages import content, resources, style
from vellum.streaming import events


def _one(spark, column, **values):
    kinds = {str: "string", bytes: "binary", bool: "boolean", int: "int"}
    schema = ", ".join(f"{n} {kinds.get(type(v), 'string')}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_notices(spark):
    cut = lambda t: tuple(_one(spark, markup.without_notices(F.col("t")), t=t))
    assert cut("Order ##46932 (l***k@…) It was a bright cold day in April.") == ("It was a bright cold day in April.", ["Order ##46932 (l***k@…)"])
    assert cut("First. Purchased by Jan Kowalski. Then he left the house.") == ("First. Then he left the house.", ["Purchased by Jan Kowalski."])
    assert cut("Nothing to see.") == ("Nothing to see.", []) and cut(None) == ("", [])


def test_quotes_and_compounds(spark):
    made = _one(spark, markup.retyped(F.col("t"), "„", "”"), t='a "b" "c')
    assert tuple(made) == ("a „b” „c", 3, True)
    assert tuple(_one(spark, markup.retyped(F.col("t"), "„", "”", F.lit(True)), t='b"')) == ("b”", 1, False)
    assert _one(spark, markup.reads_as_compound(F.col("t")), t="biało") and not _one(spark, markup.reads_as_compound(F.col("t")), t="to")


def test_guard_takes_back(spark):
    rows = spark.createDataFrame([("a...b",), ("keep",)], "text string")
    out = repairs.carried_out(rows, "text", F.upper("text"), F.length("text") == F.length("__after")).orderBy("text").collect()
    assert [(r.result, r.reverted) for r in out] == [("A...B", False), ("KEEP", False)]
    out = repairs.carried_out(rows, "text", F.lit("lost"), F.col("text") == F.col("__after")).orderBy("text").collect()
    assert [(r.result, r.reverted) for r in out] == [("a...b", True), ("keep", True)]


def test_relative_paths_and_uuids(spark):
    import uuid

    rel = lambda a, b: _one(spark, names.relative(F.col("a"), F.col("b")), a=a, b=b)
    assert [rel("a/b/c.x", "a/d.x"), rel("c.x", "d/e.x"), rel("a/c.x", "a/d.x"), rel("a/b/c.x", "d.x")] == ["../d.x", "d/e.x", "d.x", "../../d.x"]
    assert _one(spark, names.name_uuid(F.col("n")), n="żółw") == str(uuid.uuid5(uuid.NAMESPACE_URL, "żółw"))


def test_inheritance_ends_on_a_circle(spark):
    rows = spark.createDataFrame([(1, 1, 2, None), (1, 2, 1, None), (1, 3, 2, None), (1, 4, None, "x"), (1, 5, 4, None)], "doc int, node int, parent int, value string")
    assert {r.node: (r.value, r.distance) for r in styles.inherited(rows).collect()} == {1: (None, -1), 2: (None, -1), 3: (None, -1), 4: ("x", 0), 5: ("x", 1)}


def test_universal_rules_meet_every_element(spark):
    elements = spark.createDataFrame([(k, "p" if k % 2 else "h1", [], None) for k in range(5)], "node int, tag string, classes array<string>, element_id string")
    rules = spark.createDataFrame([(1, "*", [], None, False, "color", "black"), (2, "p", [], None, False, "color", "red"), (3, None, [], None, False, "top", "0")], "ord int, tag string, classes array<string>, element_id string, targeted boolean, prop string, value string")
    got = {(r.node, r.prop): r.value for r in styles.cascade(elements, rules).collect()}
    assert got == {(k, "color"): "red" if k % 2 else "black" for k in range(5)} | {(k, "top"): "0" for k in range(5)}


@pytest.mark.parametrize("n", [1, 4])
def test_global_order(spark, n):
    rows = spark.createDataFrame([(k * k, k % 3) for k in range(30)], "k long, v long")
    seen = ordered.with_previous(rows, "k", ["v"], n)
    got = {r.k: (r.previous, r.total) for r in ordered.running(seen, "k", "total", F.col("v")).collect()}
    assert all(got[k * k][1] == sum(i % 3 for i in range(k + 1)) for k in range(30))
    assert got[0][0] is None and all(got[k * k][0].v == (k - 1) % 3 for k in range(1, 30))


def test_documents_are_read_and_written():
    assert trees.parse("<p>a<p>b")[1] == "html" and trees.serialise(trees.parse("<p>a<p>b&amp;<br>")[0]) == "<p>a</p><p>b&amp;<br/></p>"
    assert trees.parse('<?xml version="1.0"?><!DOCTYPE html [<!ENTITY a "&b;x"><!ENTITY b "y">]><p>&a;&nbsp;</p>')[0].text() == "yx\u00a0"
    bomb = "".join(f'<!ENTITY e{i} "{f"&e{i - 1};" * 10 if i else "x" * 50}">' for i in range(9))
    assert len(trees.expanded(f"<!DOCTYPE html [{bomb}]><p>&e8;</p>")) < 20 * len(bomb)
    assert trees.srcset("a,b.png 1x, c.png 2x,d.png") == [("a,b.png", "1x"), ("c.png", "2x"), ("d.png", "")]
    assert trees.references('<a href="x&amp;y"><img srcset="a.png 1x, b.png 2x">url(q)') == ["x&y", "a.png", "b.png", "q"]
    assert trees.parse(None)[0].text() == "" and trees.serialise(trees.parse(b"")[0]) == ""


def test_content_steps_keep_the_text():
    known = content.Known(path="t/a.html", files=frozenset({"t/in.png"}), inert=frozenset({"c1"}), strict=True)
    page = '<html><head><title>T</title></head><body><center>a</center><p align="right">b <span class="c1">c</span><img src="in.png"><img src="out.png"><a href="no.html">d</a></p></body></html>'
    text, mode, done, reverted = content.rewrite(page, known, list(content.STEPS))
    assert mode == "html" and not reverted and "out.png" not in text and "in.png" in text and "no.html" not in text and ">d</a>" in text
    assert "text-align: right" in text and "c1" not in text and done["unwrap"] == 1
    assert content.rewrite(None, known, ["modernise"]) == ("", "html", {}, False)
    assert content.unresolved(trees.parse('<a href="b.html#q">t</a><a href="b.html#z">u</a>')[0], content.Known(path="a.html", ids={"b.html": frozenset("z")})) == [("b.html", "q", "t")]
    assert content.anchors(trees.parse('<a name="x"/><p id="y"/><p id="y"/>')[0]) == ["x", "y"]
    assert content.older_markup(trees.parse('<center align="left">x</center>')[0]) == ["@align", "center"]


def test_style_steps():
    known = style.Known(path="s/a.css", classes=frozenset("ab"), files=frozenset({"s/f.ttf"}), moved={"s/f.ttf": "OPS/f.ttf", "s/a.css": "OPS/css/a.css"})
    assert style.names_nothing(".x, p.y", frozenset("a"), frozenset()) and not style.names_nothing(".x, a:hover", frozenset("a"), frozenset())
    assert style.mend("p { color: red; color: blue !important; color: green }", known)[0] == "p { color: blue !important }"
    assert style.mend("@font-face { src: url(f.ttf), url(no.ttf) }", known)[0] == "@font-face { src: url(../f.ttf) }"
    assert style.mend("p { top: 1px } .a { color: red } p { left: 1px }", known)[1] == {"merged": 1}
    assert style.mend("p { top: 1px } .a { color: red } p { bottom: 1px } .q { top: 0 }", known)[1] == {"merged": 1, "unreachable": 1}
    assert style.mend("p { top: 1px } h1 { top: 2px } p { top: 3px }", known)[1] == {}
    assert style.mend("p { font-style: regular } b { font-weight: bold }", known)[1] == {} and style.mend(None, known) == ("", {})
    assert style.conflict({"margin": "0"}, {"margin-left": "1px"}) and not style.conflict({"top": "0"}, {"top": "0"})
    assert style.is_sound("a { b: c }") and not style.is_sound("a { b: (c }")
    assert style.general_family('"Georgia"') == "serif" and style.general_family("Unknown") is None and style.general_family("My", {"my": "cursive"}) == "cursive"
    assert style.sizes_relative("html { font-size: 10px } p { font-size: 12pt }")[1] == [] and style.sizes_relative("p { font-size: 12pt }")[0] == "p { font-size: 1rem }"
    assert [style.role(t, p) for t, p in (({"h1", "span"}, set()), ({"p"}, {"text-align"}), ({"p"}, {"color"}), ({"td"}, set()), ({"p", "img"}, set()), (set(), set()))] == ["heading", "alignment", "face", "table", "other", "other"]
    assert style.readable("a{b:c}") == "a {\n  b: c;\n}\n"


def _book(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_reader(spark):
    package = '<package version="2.0" xmlns="x"><metadata><title>T</title><meta name="cover" content="c"/></metadata><manifest><item id="c" href="A%20b.PNG" media-type="image/png"/><item id="t" href="a.html" media-type="text/html"/></manifest><spine><itemref idref="zz"/></spine><guide><reference type="text" href="a.html"/></guide><collection role="r"><collection role="q"/></collection></package>'
    content_ = _book(**{"META-INF__container.xml": '<container><rootfiles><rootfile full-path="no.opf"/><rootfile full-path="ops/p.opf"/></rootfiles></container>', "ops__p.opf": package, "ops__a b.png": b"\x89PNG", "ops__a.html": "<p>x", "ops__c10.html": "", "ops__c9.html": "", "META-INF__encryption.xml": '<e><EncryptedData><EncryptionMethod Algorithm="drm"/><CipherReference URI="x"/></EncryptedData></e>'})
    rows = reader.books(spark.createDataFrame([("b", content_), ("c", b"no"), ("d", None)], "path string, content binary"))
    got = {}
    for r in rows.collect():
        got.setdefault((r.book, r.kind), []).append(r)
    assert [r.path for r in got["b", "manifest"]] == ["ops/a b.png", "ops/a.html"] and got["b", "cover"][0].path == "ops/a b.png" and got["b", "landmark"][0].name == "bodymatter"
    assert [(r.id, r.parent) for r in got["b", "collection"]] == [("/0", None), ("/0/0", "/0")] and [r.flag for r in got["b", "rendition"]] == [False, True]
    assert [r.path for r in got["b", "recovered"]] == ["ops/a.html", "ops/c9.html", "ops/c10.html"] and [r.name for r in got["b", "finding"]] == ["spine-id-unknown"]
    assert {r.name for r in got["c", "finding"]} == {"unreadable", "package-missing"} and ("d", "finding") in got
    assert {r.book: r.protected for r in reader.is_protected(rows).collect()} == {"b": True, "c": False, "d": False}
    assert reader.verified(content_) == [] and reader.verified(_book(x="1")) == ["package"] and reader.verified(b"x") == ["no archive"]
    assert reader.canonical("C:\\a\\.\\b//c")[0] == "a/b/c" and reader.canonical("a/../../b") == (None, ["escapes"]) and reader.canonical("\0x")[0] is None
    assert reader.parse_xml(b"<a><b></a>")[1] and reader.parse_xml(b"<a/>")[1] is False and reader.parse_xml(b"")[0] is None
    assert reader.estimate(content_)[1] == 24 and reader.estimate(b"") is None


def test_pictures_and_fonts():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x05\0\x06\x01\0"
    assert reader.picture(png) == ("png", 7, 9, 1) and reader.picture(jpeg) == ("jpeg", 6, 5, 1) and reader.picture(b"x") is None and reader.picture(None) is None
    table = bytes(32) + bytes([2, 11, 0, 3]) + bytes(10)
    font = b"\x00\x01\x00\x00\x00\x01" + bytes(6) + b"OS/2" + bytes(4) + (28).to_bytes(4, "big") + len(table).to_bytes(4, "big") + table
    assert reader.font_class(font) == "sans-serif" and reader.font_class(b"wOFF") is None
    assert reader.adobe_key("urn:uuid:12345678-1234-1234-1234-123456789abc").hex() == "12345678123412341234123456789abc" and reader.adobe_key("isbn") == b""


def test_archives_refuse_what_grows_too_much(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb", b"0" * (1 << 20))
        z.writestr("small", b"0" * (60 << 10))
    rows = {r.name: r.ok for r in archives.entries(spark.createDataFrame([("b", out.getvalue())], "path string, content binary")).collect()}
    assert rows == {"bomb": False, "small": True}


def test_stage_that_lies_is_caught(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, data string")
    with pytest.raises(ValueError, match="changes nothing"):
        resources.run_stages(rows, [resources.Stage("x", lambda d: d.withColumn("data", F.lit("b")), mutates=False)], ["k"])
    assert resources.measures(["Kindle", "nobody"])[1] == ["nobody"] and resources.wanted_by("ncx") == ["kobo", "legacy"]
    assert resources.linked_notes("<p>[1] <a>[2]</a> [2] [1]</p>", {"1": "n#1", "2": "n#2"})[1] == 2


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for kind in ("parquet", "csv", "json", "orc"):
        tables.write(df, f"file://{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, tables.read(spark, f"file://{tmp_path}/{kind}", kind, "k int, v string").collect()), key=str) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="schema"):
        tables.read(spark, "x", "csv")
    tables.publish(df, f"file://{tmp_path}/out", lambda t: t.count() == 2)
    with pytest.raises(ValueError, match="nothing was published"):
        tables.publish(df.limit(1), f"file://{tmp_path}/out", lambda t: t.count() == 2)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    (tmp_path / "sig").mkdir()
    (tmp_path / "sig" / "0123456789abcdef.json").write_text('{"a": {"b": 1}, "c": null}')
    (tmp_path / "sig" / "other.json").write_text('{"x": 1}')
    assert sorted((r.book, r.path, r.value) for r in tables.signatures(spark, f"file://{tmp_path}/sig").where("value IS NOT NULL").collect()) == [("0123456789abcdef", "a/b", "1")]
    tables.append_run(spark.createDataFrame([("1.0", 3)], "version string, books long"), f"file://{tmp_path}/runs")
    assert [(r.books, r.introduced) for r in spark.read.schema(tables.RUNS).json(f"file://{tmp_path}/runs").collect()] == [(3, None)]


def test_state_between_batches(spark, tmp_path):
    for i, flags in enumerate(([True, True], [True, False], [True])):
        spark.createDataFrame([("a", 10 * i + k, f) for k, f in enumerate(flags)], "k string, o long, g boolean").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k string, o long, g boolean").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got: list = []
    events.streaks(stream, "k", "o", F.col("g")).writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend(r.length for r in b.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert len(got) == 3 and sum(got) > 0
