"""Queries of the operators on declared values, styles, sequences and packages, over relations that a rule derives from
the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import values
from vellum.operators import sequences, styles
from vellum.sources import encodings, packages, stylesheets

DATES = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT08:09:10Z')
 WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN 'printed in ' || strftime(o_orderdate, '%Y') || ', revised' ELSE 'undated' END"""
LENGTHS = "CAST(l_linenumber AS VARCHAR(9)) || CASE l_orderkey % 6 WHEN 0 THEN 'em' WHEN 1 THEN '.5rem' WHEN 2 THEN ' px' WHEN 3 THEN 'pt' WHEN 4 THEN '%' ELSE '' END"
IDENTIFIERS = "CASE p_partkey % 5 WHEN 0 THEN 'urn:isbn:' || p_partkey WHEN 1 THEN '978-3-16-148410-' || (p_partkey % 10) WHEN 2 THEN '10.1000/' || p_partkey WHEN 3 THEN 'urn:uuid:' || p_partkey ELSE 'book ' || p_partkey END"
SELECTORS = "CASE (doc_id * 7 + length(coalesce(text, ''))) % 4 WHEN 0 THEN 'body > p.' || source WHEN 1 THEN '#d' || (doc_id % 9) || ' p.' || source WHEN 2 THEN 'p.' || source || ':first-child' ELSE 'div a[href].' || source || '::before' END"
#: Text with quotation marks put in by a rule: some sources keep to one pair, others mix two.
QUOTED = "CASE length(source) % 3 WHEN 0 THEN '„' || text || '”' WHEN 1 THEN '«' || text || '»' ELSE CASE doc_id % 2 WHEN 0 THEN '“' || text || '”' ELSE '„' || text || '“' END END"


#: Texts that lost something by a rule: their ends, or a letter wherever it stands; others gained something, or changed in nothing.
CUT = "CASE doc_id % 4 WHEN 0 THEN substr(text, 1, CAST(doc_id % 900 AS INT)) WHEN 1 THEN replace(text, 'z', '') WHEN 2 THEN '# ' || text || ' #' ELSE text END"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dates(spark, sf):
    o, day = _t(spark, sf, "orders"), "date_format(o_orderdate, '{}')"
    raw = f"""CASE o_orderkey % 6 WHEN 0 THEN {day.format("yyyy-MM-dd")} WHEN 1 THEN {day.format("dd.MM.yyyy")} WHEN 2 THEN {day.format("yyyy-MM-dd")} || 'T08:09:10Z' WHEN 3 THEN {day.format("yyyy-MM")}
 WHEN 4 THEN 'printed in ' || {day.format("yyyy")} || ', revised' ELSE 'undated' END"""
    return o.select("o_orderkey", values.normal_date(F.expr(raw)).alias("date"))


def _lengths(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(values.length_em(F.expr(LENGTHS)), 6).alias("em"))


def _schemes(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", values.identifier_scheme(F.expr(IDENTIFIERS)).alias("scheme"))


def _specificity(spark, sf):
    s = F.expr(SELECTORS)
    found = _t(spark, sf, "documents").where("source IS NOT NULL").select("doc_id", values.specificity(s).alias("s"), values.selector_key(s).alias("key"))
    return found.select("doc_id", "s.ids", "s.classes", "s.types", "key")


def _declarations(spark, sf):
    return _t(spark, sf, "events").select(F.col("user_id").alias("block"), F.col("event_type").alias("prop"), F.col("event_id").alias("ord"), (F.col("value") > 90).alias("important"), F.col("value"))


def _out_of_order(spark, sf):
    return styles.out_of_order(_t(spark, sf, "documents").where("source IS NOT NULL").select(F.col("lang").alias("sheet"), F.col("doc_id").alias("ord"), F.expr(SELECTORS).alias("selector")))


def _cascade(spark, sf):
    elements = _t(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("tag"), F.array(F.concat(F.lit("n"), "c_nationkey"), F.lit("all")).alias("classes"), F.concat(F.lit("i"), F.col("c_custkey") % 50).alias("element_id"))
    none, text = F.lit(None).cast("string"), F.array().cast("array<string>")
    n = _t(spark, sf, "nation")
    rules = n.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("ord"), none.alias("tag"), F.array(F.concat(F.lit("n"), "n_nationkey")).alias("classes"), none.alias("element_id"), F.lit(True).alias("targeted"), F.lit("margin").alias("prop"), F.col("n_name").alias("value"))
    rules = rules.union(n.where("n_nationkey = 7").select(F.lit(90), F.lit("BUILDING"), text, none, F.lit(False), F.lit("margin"), F.lit("tagged")))
    rules = rules.union(n.where("n_nationkey = 7").select(F.lit(80), none, F.array(F.lit("all")), F.lit("i7"), F.lit(True), F.lit("margin"), F.lit("named")))
    rules = rules.union(n.where("n_nationkey = 7").select(F.lit(1), F.lit("*"), text, none, F.lit(False), F.lit("color"), F.lit("black")))
    return styles.cascade(elements, rules)


def _turns(spark, sf):
    return _t(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))


def _inherited(spark, sf):
    t = _turns(spark, sf).select(F.col("conv_id").alias("doc"), F.col("turn").alias("node"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"), F.when(F.col("turn") % 3 == 1, F.col("role")).alias("value"))
    return styles.inherited(t)


def _pairs(spark, sf):
    e = _t(spark, sf, "events")
    return sequences.pair_by_place(*[e.where(f"event_type = '{k}'").select("user_id", "event_id") for k in ("click", "purchase")], "user_id", "event_id")


def _chains(spark, sf):
    p = F.col("p_partkey")
    return sequences.chains(_t(spark, sf, "part").select(p.alias("node"), F.when(p % 4 == 0, None).when(p % 10 == 9, p - 2).when(p % 10 == 7, p + 2).when(p % 97 == 1, -p).otherwise(p + 1).alias("next")))


def _notes(spark, sf):
    o = _t(spark, sf, "orders")
    notes = o.select(F.col("o_custkey").alias("book"), (F.col("o_orderkey") % 7).cast("int").alias("number"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("note"))
    lines = o.select(F.col("o_custkey").alias("book"), F.concat(F.lit("see ["), (F.col("o_orderkey") % 5).cast("string"), F.lit("] and ["), (F.col("o_orderkey") % 3).cast("string"), F.lit("]")).alias("text"))
    return sequences.markers_with_notes(lines, notes)


def _ids(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("name"), "event_id")
    return sequences.unique_ids(e, "page", "name", "event_id").select("event_id", "renamed")


def _spelling(spark, sf):
    part = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit("img/"), "p_brand", F.lit(" "), "p_partkey", F.lit(".png")).alias("path"))
    asked = F.expr("CASE p_partkey % 4 WHEN 0 THEN path WHEN 1 THEN replace(path, ' ', '%20') WHEN 2 THEN lower(path) ELSE path || 'x' END")
    return sequences.found_by_spelling(part.select(asked.alias("path")), part.select("path"))


def _sheets(spark, sf):
    """A sheet of every order's lines: a rule a line, every third inside a condition."""
    rule = F.expr("CASE WHEN l_linenumber % 3 = 0 THEN '@media print{' ELSE '' END || '.c' || l_suppkey || ', p > a { width: ' || l_linenumber || 'em /* ; */; content: \"};\" ' || CASE WHEN l_partkey % 2 = 0 THEN '!important' ELSE '' END || ' }' || CASE WHEN l_linenumber % 3 = 0 THEN '}' ELSE '' END")
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rule.alias("rule"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "rule"))), lambda r: r["rule"]), "\n")
    sheets = lines.groupBy("l_orderkey").agg(ordered.alias("css"))
    return stylesheets.rules(sheets, "l_orderkey", "css", ["selector", "condition", "prop", "important"]).groupBy("selector", "prop", F.coalesce("condition", F.lit("")).alias("condition")).agg(F.count("*").alias("n"), F.count_if("important").alias("important"))


def _packages(spark, sf):
    """A package document of every order: an item a line, of which the spine holds those whose part number is not a multiple
    of 5, and one entry that no item has."""
    item = F.expr("'<item id=\"i' || l_linenumber || '-' || l_partkey || '\" href=\"t%20' || l_partkey || '.xhtml\" media-type=\"application/xhtml+xml\"/>'")
    ref = F.expr("CASE WHEN l_partkey % 5 <> 0 THEN '<itemref idref=\"i' || l_linenumber || '-' || l_partkey || '\"/>' ELSE '' END")
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("item"), ref.alias("ref"))))
    books = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("book")).agg(lines.alias("x"))
    made = F.concat(F.lit('<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest>'), F.array_join("x.item", ""), F.lit("</manifest><spine>"), F.array_join("x.ref", ""), F.lit('<itemref idref="lost"/></spine></package>'))
    return books.select("book", F.lit("ops/book.opf").alias("name"), made.cast("binary").alias("data"))


def _paragraphs(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_custkey").alias("book"), (F.col("o_orderkey") % 3 > 0).alias("indented"), (F.col("o_orderkey") % 8 == 0).alias("spaced"))


def queries() -> dict:
    return {
        "dates_normal": _dates,
        "lengths_em": _lengths,
        "identifier_schemes": _schemes,
        "css_specificity": _specificity,
        "css_duplicate_props": lambda s, d: styles.losing_declarations(_declarations(s, d)).select("block", "prop", "ord"),
        "css_winning_props": lambda s, d: styles.winning_declarations(_declarations(s, d)),
        "css_equal_classes": lambda s, d: styles.equal_classes(_t(s, d, "events").select(F.col("user_id").alias("name"), F.col("event_type").alias("prop"), F.lit("x").alias("value"))),
        "css_dead_classes": lambda s, d: styles.usage(_t(s, d, "part").select(F.col("p_partkey").alias("name")), _t(s, d, "lineitem").select((F.col("l_partkey") * 2).alias("name"))),
        "css_out_of_order": _out_of_order,
        "css_cascade": _cascade,
        "css_inherited": _inherited,
        "css_rules": _sheets,
        "package_reading_order": lambda s, d: packages.reading_orders(_packages(s, d)),
        "pairs_by_place": _pairs,
        "spine_insertions": lambda s, d: sequences.next_held(_turns(s, d), "conv_id", "turn", "turn % 3 = 2"),
        "break_runs": lambda s, d: sequences.runs(_t(s, d, "events"), "user_id", "event_id", "value < 40"),
        "fallback_chains": _chains,
        "note_markers": _notes,
        "body_shape": lambda s, d: sequences.body_shape(_t(s, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL"), "source", "lang"),
        "paragraph_paradigm": lambda s, d: sequences.paradigm(_paragraphs(s, d), "book"),
        "quote_convention": lambda s, d: sequences.quote_convention(_t(s, d, "documents").where("source IS NOT NULL").withColumn("text", F.expr(QUOTED)), "source"),
        "ids_unique": _ids,
        "found_by_spelling": _spelling,
        "characters_lost": lambda s, d: encodings.losses(_t(s, d, "documents").select("doc_id", "text", F.expr(CUT).alias("cut")), ["doc_id"], "text", "cut"),
    }


def oracle_sql() -> dict[str, str]:
    marks = list(values.QUOTES.items())
    counted = ", ".join(f"""sum(length(t) - length(replace(t, '{m}', ''))) AS "{n}" """ for n, m in marks)
    total = " + ".join(f'"{n}"' for n, _ in marks)
    scores = " UNION ALL ".join(f"""SELECT source, {total} AS total, '{name}' AS name, {" + ".join(f'"{m}"' for m in sorted(set(pair)))} AS n FROM c""" for name, pair in values.CONVENTIONS.items())
    chain = "SELECT p_partkey AS node, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 10 = 9 THEN p_partkey - 2 WHEN p_partkey % 10 = 7 THEN p_partkey + 2 WHEN p_partkey % 97 = 1 THEN -p_partkey ELSE p_partkey + 1 END AS next FROM part"
    path = "'img/' || p_brand || ' ' || p_partkey || '.png'"
    turns = "SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2"
    spec = f"""SELECT doc_id, lang, s, len(regexp_extract_all(s, '#[-a-z0-9]+'))::INTEGER AS ids, (len(regexp_extract_all(s, '\\.[-\\w]+')) + len(regexp_extract_all(s, '\\[')) + len(regexp_extract_all(s, ':first')))::INTEGER AS classes,
(len(regexp_extract_all(s, '(^|[ >])[a-z]')) + len(regexp_extract_all(s, '::')))::INTEGER AS types, regexp_replace(regexp_extract(s, '[^ ]+$'), '::?[-a-z]+$', '') AS key FROM (SELECT doc_id, lang, {SELECTORS} AS s FROM documents WHERE source IS NOT NULL)"""
    return {
        "dates_normal": f"""WITH d AS (SELECT o_orderkey, {DATES} AS raw FROM orders) SELECT o_orderkey, coalesce(CASE WHEN regexp_full_match(raw, '\\d{{4}}-\\d{{2}}') THEN raw END,
strftime(coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(raw, '%d.%m.%Y')), '%Y-%m-%d'), nullif(regexp_extract(raw, '\\b(1\\d{{3}}|20\\d{{2}})\\b', 1), '')) AS date FROM d""",
        "lengths_em": f"SELECT l_orderkey, l_linenumber, round(CASE WHEN v LIKE '%rem' THEN replace(v, 'rem', '')::DOUBLE WHEN v LIKE '%em' THEN replace(v, 'em', '')::DOUBLE WHEN v LIKE '%px' THEN replace(v, ' px', '')::DOUBLE / 16 WHEN v LIKE '%pt' THEN replace(v, 'pt', '')::DOUBLE / 12 ELSE 0 END, 6) AS em FROM (SELECT l_orderkey, l_linenumber, {LENGTHS} AS v FROM lineitem)",
        "identifier_schemes": "SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN 'ISBN' WHEN p_partkey % 5 = 2 THEN 'DOI' END AS scheme FROM part",
        "css_specificity": f"SELECT doc_id, ids, classes, types, key FROM ({spec})",
        "css_duplicate_props": "SELECT user_id AS block, event_type AS prop, event_id AS ord FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value > 90) DESC, event_id DESC) > 1",
        "css_winning_props": "SELECT user_id AS block, event_type AS prop, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value > 90) DESC, event_id DESC) = 1",
        "css_equal_classes": "WITH c AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS s FROM events GROUP BY 1) SELECT * FROM (SELECT user_id AS name, min(user_id) OVER w AS first, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY s)) WHERE n > 1",
        "css_dead_classes": "WITH u AS (SELECT DISTINCT l_partkey * 2 AS name FROM lineitem) SELECT p_partkey AS name, 'dead' AS state FROM part WHERE p_partkey NOT IN (SELECT name FROM u) UNION ALL SELECT name, 'bare' FROM u WHERE name NOT IN (SELECT p_partkey FROM part)",
        "css_out_of_order": f"WITH r AS ({spec}) SELECT lang AS sheet, doc_id AS ord, s AS selector FROM r WHERE EXISTS (SELECT 1 FROM r b WHERE b.lang IS NOT DISTINCT FROM r.lang AND b.key = r.key AND b.doc_id < r.doc_id AND (b.ids, b.classes, b.types) > (r.ids, r.classes, r.types))",
        "css_cascade": """SELECT c_custkey AS node, 'color' AS prop, 'black' AS value, false AS targeted FROM customer UNION ALL
SELECT c_custkey, 'margin', CASE WHEN c_custkey % 50 = 7 THEN 'named' WHEN n_name IS NOT NULL THEN n_name ELSE 'tagged' END, c_custkey % 50 = 7 OR n_name IS NOT NULL
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 7 OR n_name IS NOT NULL OR c_mktsegment = 'BUILDING'""",
        "css_inherited": f"""WITH t AS ({turns}), h AS (SELECT conv_id, turn, max(CASE WHEN turn % 3 = 1 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS at FROM t)
SELECT h.conv_id AS doc, h.turn AS node, t.role AS value, coalesce(h.turn - h.at, -1)::INTEGER AS distance FROM h LEFT JOIN t ON t.conv_id = h.conv_id AND t.turn = h.at""",
        "css_rules": """SELECT selector, prop, CASE WHEN l_linenumber % 3 = 0 THEN '@media print' ELSE '' END AS condition, count(*) AS n, count(*) FILTER (prop = 'content' AND l_partkey % 2 = 0) AS important
FROM (SELECT *, unnest(['.c' || l_suppkey, 'p > a']) AS selector FROM lineitem), (VALUES ('width'), ('content')) p(prop) GROUP BY ALL""",
        "package_reading_order": """WITH s AS (SELECT l_orderkey::VARCHAR AS book, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS ord, 'ops/t ' || l_partkey || '.xhtml' AS path, true AS linear FROM lineitem WHERE l_partkey % 5 <> 0)
SELECT * FROM s UNION ALL SELECT l_orderkey::VARCHAR, (count(*) FILTER (l_partkey % 5 <> 0))::INTEGER, NULL, true FROM lineitem GROUP BY l_orderkey""",
        "pairs_by_place": """WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT a.user_id, a.place::INTEGER AS place, a.event_id AS l, b.event_id AS r FROM e a JOIN e b USING (user_id, place, n) WHERE a.event_type = 'click' AND b.event_type = 'purchase'""",
        "spine_insertions": f"WITH t AS ({turns}) SELECT conv_id, turn, (SELECT min(b.turn) FROM t b WHERE b.conv_id = t.conv_id AND b.turn > t.turn AND b.turn % 3 = 2) AS before FROM t WHERE turn % 3 <> 2",
        "break_runs": "WITH e AS (SELECT *, sum(CASE WHEN value < 40 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) SELECT user_id, min(event_id) AS start, count(*) AS n FROM e WHERE value < 40 GROUP BY user_id, gap HAVING count(*) > 1",
        "fallback_chains": f"""WITH RECURSIVE p AS ({chain}), w AS (SELECT node, next, 0 AS steps FROM p UNION ALL SELECT w.node, p.next, steps + 1 FROM w JOIN p ON p.node = w.next WHERE steps < 12)
SELECT node, CASE WHEN bool_or(next IS NULL) THEN 'ends' WHEN bool_or(next NOT IN (SELECT node FROM p)) THEN 'missing' ELSE 'cycle' END AS outcome FROM w GROUP BY node""",
        "note_markers": """WITH m AS (SELECT o_custkey AS book, unnest([o_orderkey % 5, o_orderkey % 3]) AS number FROM orders), n AS (SELECT o_custkey AS book, o_orderkey % 7 AS number, arg_min(o_orderstatus, o_orderkey) AS note FROM orders GROUP BY 1, 2)
SELECT book, number::INTEGER AS number, count(*) AS markers, any_value(note) AS note FROM m JOIN n USING (book, number) GROUP BY book, number""",
        "body_shape": """WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2) SELECT source, lang, blocks, n AS agreeing, n / blocks AS share, n / blocks >= 0.6 AS consistent
FROM (SELECT *, (sum(n) OVER (PARTITION BY source))::BIGINT AS blocks FROM c) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""",
        "paragraph_paradigm": """WITH c AS (SELECT o_custkey AS book, count(*) AS n, count(*) FILTER (i AND NOT s) AS a, count(*) FILTER (s AND NOT i) AS b, count(*) FILTER (i AND s) AS c FROM (SELECT o_custkey, o_orderkey % 3 > 0 AS i, o_orderkey % 8 = 0 AS s FROM orders) GROUP BY 1)
SELECT book, CASE WHEN a + b + c = 0 OR (a + b + c) * 2 < n THEN 'UNKNOWN' WHEN a * 10 >= 9 * (a + b + c) THEN 'INDENTED' WHEN b * 10 >= 9 * (a + b + c) THEN 'SPACED' WHEN c * 10 >= 9 * (a + b + c) THEN 'BOTH' ELSE 'MIXED' END AS paradigm FROM c""",
        "quote_convention": f"""WITH c AS (SELECT source, {counted} FROM (SELECT source, {QUOTED} AS t FROM documents WHERE source IS NOT NULL) GROUP BY source), s AS ({scores})
SELECT source, CASE WHEN any_value(total) >= 20 AND max(n) * 3 >= any_value(total) * 2 AND list_sort(list(n))[-1] <> list_sort(list(n))[-2] THEN arg_max(name, n) END AS convention FROM s GROUP BY source""",
        "ids_unique": "SELECT event_id, CASE WHEN k = 1 THEN event_type ELSE event_type || '-' || k END AS renamed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)",
        "characters_lost": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN length(whole) > length(cut) THEN length(cut) ELSE -1 END WHEN 1 THEN strpos(whole, 'z') - 1 ELSE -1 END::BIGINT AS lost_at
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS whole, regexp_replace(coalesce(left(text, doc_id % 900), ''), '\\s+', '', 'g') AS cut FROM documents)""",
        "found_by_spelling": f"""SELECT CASE p_partkey % 4 WHEN 0 THEN path WHEN 1 THEN replace(path, ' ', '%20') WHEN 2 THEN lower(path) ELSE path || 'x' END AS path, CASE WHEN p_partkey % 4 < 3 THEN path END AS found,
CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'decoded' WHEN 2 THEN 'case' END AS how FROM (SELECT p_partkey, {path} AS path FROM part)""",
    }
