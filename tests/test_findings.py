"""What a reviewer's findings were about, on a few rows each."""

import difflib

import pyarrow as pa
from pyspark.sql import functions as F

from vellum.functions import markup, unicode
from vellum.operators import evidence, library, repairs
from vellum.plans import registry, stages
from vellum.sources import batches, packages, stylesheets
from vellum.stages import style


def test_sheets_of_one_task_are_dealt_to_all_and_equal_ones_mended_once(spark):
    rows = [(i, f".a {{ color: red; color: blue; top: {i % 3}px }} .gone {{ left: 0 }}" if i % 10 else None) for i in range(400)]
    out = style.mended(spark.createDataFrame(rows, "n int, css string").coalesce(1), ["n"], classes=frozenset(["a"]))
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = style.Known(classes=frozenset(["a"]))
    assert {r["n"]: (r["css"], r["changes"]) for r in out.collect()} == {n: style.mend(css, known) for n, css in rows}


def test_a_sheet_is_parsed_anew_only_where_a_step_changed_it(monkeypatch):
    parsed, whole = [], style.stylesheets.blocks
    monkeypatch.setattr(style.stylesheets, "blocks", lambda text: parsed.append(text) or whole(text))
    text, done = style.mend(".only-here { color: red; color: blue } .b { top: 1px }", style.Known(classes=frozenset(["only-here", "b"])))
    assert done == {"repeated": 1} and text == ".only-here { color: blue } .b { top: 1px }"
    assert len(parsed) == len(set(parsed)) == 2


def test_hyphens_are_joined_by_a_list_of_any_length_and_each_text_once(spark):
    docs = spark.createDataFrame([("b", 1, "Na-tion, na-tion x-ray-x"), ("b", 1, "sta-tion"), ("c", None, "na-tion sta-tion"), (None, 4, "na-tion"), ("b", 5, None)], "source string, doc_id int, text string")
    sure = spark.createDataFrame([("b", "na", "tion"), ("c", "sta", "tion"), ("b", "ray", "x")], "source string, lhs string, rhs string")
    out = repairs.joined_hyphens(docs, sure)
    assert sorted(map(tuple, out.select("before", "text", "joined").collect()), key=str) == sorted(
        [("Na-tion, na-tion x-ray-x", "Nation, nation x-ray-x", 2), ("sta-tion", "sta-tion", 0), ("na-tion sta-tion", "na-tion station", 1), ("na-tion", "na-tion", 0), (None, None, 0)], key=str)
    assert "map_from_entries" not in out._jdf.queryExecution().toString()  # a map is walked from its start for every word


def test_junk_of_books_whose_names_read_alike_stays_apart(spark, tmp_path):
    spark.createDataFrame([("Brand#2", 36), ("Brand#2", 3342), ("Brand#23", 342)], "p_brand string, p_partkey long").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = stages.queries()["junk_files"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("Brand#2" + "3342", "a/Thumbs.db", False), ("Brand#23" + "342", "a/Thumbs.db", True), ("Brand#2" + "36", "a/Thumbs.db", True)]


def test_sentences_keep_the_digits_they_begin_with(spark):
    text = "0 a. 1 b.  22 c. 3 d.\n 4 e. Sold to A1. 6 f"
    row = spark.createDataFrame([(text,)], "t string").select(markup.without_notices(F.col("t")).alias("r")).first()["r"]
    assert row["kept"] == "0 a. 1 b. 22 c. 3 d. 4 e. 6 f" and row["removed"] == ["Sold to A1."]


def _texts_cut(df):
    """How often a plan cuts texts into words; a reused exchange counts as what it is."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_candidates_and_questions_cut_each_text_once(spark):
    docs = spark.createDataFrame([("b", "na-tion nation re-do re-do re re zz-yy"), (None, "na-tion nation")], "source string, text string")
    found = library.hyphen_candidates(docs)
    want = [("b", "na", "tion", 1, 1, 0, "confirmed"), ("b", "re", "do", 2, 0, 2, "uncertain"), ("b", "zz", "yy", 1, 0, 0, "likely"), (None, "na", "tion", 1, 0, 0, "likely")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    asked = repairs.review_questions(found.where("source = 'b'"), shown=1)
    assert sorted(tuple(r)[:4] for r in asked.collect()) == [("b", "likely", 1, "zz-yy"), ("b", "uncertain", 1, "re-do")]
    assert _texts_cut(found) == _texts_cut(asked) <= 4


def test_orders_of_many_books_are_aligned_in_few_calls_as_by_matching_blocks(spark):
    lists = [("abc", "abc"), ("abcd", "axcd"), ("abc", "cab"), ("aab", "aba"), ("abcde", "bd"), ("xy", "zw")]
    for x, y in lists:
        blocks = difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
        assert evidence.matching(list(x), list(y)) == [(m.a + k, m.b + k) for m in blocks for k in range(m.size)]
    rows = lambda side: spark.createDataFrame([(b, 10 * i, c) for b, pair in enumerate(lists) for i, c in enumerate(pair[side])], "book int, ord int, opening string")
    out = evidence.aligned(rows(0), rows(1))
    assert sorted(map(tuple, out.collect())) == sorted((str(b), 10 * i, 10 * j) for b, (x, y) in enumerate(lists) for i, j in evidence.matching(list(x), list(y)))
    assert "FlatMapCoGroups" not in out._jdf.queryExecution().toString()


def test_sheets_and_packages_leave_in_gathered_batches():
    made = list(batches.gathered(((str(i), i) for i in range(10)), [pa.string(), pa.int32()], ["a", "b"], most=4))
    assert [b.num_rows for b in made] == [4, 4, 2] and pa.Table.from_batches(made).column("b").to_pylist() == list(range(10))


def test_rules_give_only_the_columns_that_are_asked_for(spark):
    out = stylesheets.rules(spark.createDataFrame([(1, "a, b { c: d }"), (2, None)], "n int, css string"), "n", "css", ["prop", "selector"])
    assert out.columns == ["prop", "selector"] and sorted(map(tuple, out.collect())) == [("c", "a"), ("c", "b")]


def test_reading_order_parses_a_package_once(spark):
    text = b'<package><manifest><item id="a" href="x%20y.html"/><item id="a" href="z.html"/><item id="n"/></manifest><spine><itemref idref="a"/><itemref idref="n" linear="no"/><itemref/><itemref idref="gone"/></spine></package>'
    documents = spark.createDataFrame([("b", "o/p.opf", text), ("c", "p.opf", b"<broken"), ("d", "p.opf", None)], "book string, name string, data binary")
    want = [("b", 0, "o/x y.html", True), ("b", 1, None, False), ("b", 2, None, True), ("b", 3, None, True)]
    plain = packages.reading_order(packages.packages(documents))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, packages.reading_orders(documents).collect()), key=str) == want
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_unicode_forms_hold_few_texts_at_once(monkeypatch):
    monkeypatch.setattr(unicode, "HELD", 8)
    texts = pa.array(["é", None, "abcdefgh", "", "ü"])
    assert unicode._ruled(unicode.compose, texts).to_pylist() == ["é", None, "abcdefgh", "", "ü"]
    assert unicode._ruled(unicode.compose, texts.slice(0, 0)).to_pylist() == [] and unicode._ruled(unicode.compose, pa.array([None], pa.string())).to_pylist() == [None]


def test_edges_are_made_once_for_orphans(spark, monkeypatch):
    made, whole = [], registry._graph
    monkeypatch.setattr(registry, "_graph", lambda s, d: made.append(1) or whole(s, d))
    plan = registry.queries()["orphans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert made == [1] and "l_partkey" not in plan
