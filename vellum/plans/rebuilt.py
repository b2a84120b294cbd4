"""Queries of the reader, the rewriting stages, tables from elsewhere and streams, each beside the SQL that checks it. What a
stage does to a document that a rule makes is known beforehand, and the SQL says it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import sql as functions_sql
from vellum.functions import unicode, values
from vellum.operators import evidence, library, outline, repairs
from vellum.plans import registry
from vellum.sources import archives, reader, tables
from vellum.stages import content, resources, style
from vellum.streaming import events as windows
from vellum.streaming import ledger

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _q(name: str, run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


# --- documents and sheets ----------------------------------------------------------------------------------------------

#: Documents of four kinds, with what each stage is for.
WORN = """CASE page_id % 4 WHEN 0 THEN '<html><head><p>stray</p></head><body><center>a</center><p align="right" foo="1">b<p>c<img src="gone.png"></body></html>'
 WHEN 1 THEN '<html lang="pl"><head><meta charset="utf-8"/><title>T</title></head><body><h1>x</h1><table><col/><col/><tr><td>1</td></tr><div>out</div></table></body></html>'
 WHEN 2 THEN '<html><body><font color="red" size="5">f</font><span class="c1">s</span><i id="1a">k</i><i id="1a">k</i><a href="no.html">t</a></body></html>'
 ELSE '<p><img src="cover.jpg"></p><span><div>q</div></span><script>x</script><b onclick="y">z</b>' END"""
_steps = {0: {"place": 1, "modernise": 2, "sweep": 1, "skeleton": 3, "neutralise": 1}, 1: {"place": 2}, 2: {"modernise": 1, "skeleton": 4, "ids": 2, "neutralise": 1, "unwrap": 1}, 3: {"skeleton": 6, "blocks": 1, "pictures": 1, "alt": 1, "scripts": 2}}


def _rewritten(spark, sf):
    pages = _t(spark, sf, "pages").select("page_id", F.expr(WORN).alias("data"))
    return content.rewritten(pages, carry=["page_id"], files=frozenset(["t/cover.jpg"]), path="t/a.html", inert=frozenset(["c1"]), title="Book", strict=True, scripts=False)


_q("documents_rewritten", lambda s, d: _rewritten(s, d).select("page_id", "mode", "reverted", F.explode("changes").alias("step", "n")),
   "SELECT page_id, mode, false AS reverted, step, n FROM pages JOIN (VALUES " + ", ".join(f"({k}, '{'xml' if k in (1, 2) else 'html'}', '{s}', {n})" for k, x in _steps.items() for s, n in x.items()) + ") v(k, mode, step, n) ON page_id % 4 = k")
_q("documents_conserved", lambda s, d: content.rewritten(_t(s, d, "pages").select("page_id", "html"), steps=["modernise", "sweep", "ids", "unwrap", "blocks", "pictures", "alt"], carry=["page_id"], data_col="html").select("page_id", "reverted", F.size(F.regexp_extract_all("data", F.lit("<(article)[ >]"), 1)).alias("articles")),
   "SELECT page_id, false AS reverted, len(regexp_extract_all(html, '<article[ >]'))::INTEGER AS articles FROM pages")
SHEET = """CASE p_partkey % 3 WHEN 0 THEN '.a { color: red; color: blue; margin-left: 1px; margin: 0 } .gone { top: 1px } .a { width: 1px }'
 WHEN 1 THEN '@import "http://x.y/z.css"; p { font-style: regular; direction: ltr; font-family: Georgia; font-size: 12pt; break-before: page }' ELSE '.a { background: url(no.png) } .a:hover { top: 0 } .e { }' END"""
_done = {0: {"repeated": 1, "overridden": 1, "merged": 1, "unreachable": 1}, 1: {"imports": 1, "emphasis": 1, "direction": 1, "stacks": 1, "sizes": 1, "breaks": 1}, 2: {"noise": 1, "dead-urls": 1}}
_sheets = lambda s, d: style.mended(_t(s, d, "part").select("p_partkey", F.expr(SHEET).alias("css")), ["p_partkey"], classes=frozenset(["a", "e"]), path="s/a.css")
_q("sheets_mended", lambda s, d: _sheets(s, d).select("p_partkey", F.explode("changes").alias("step", "n")),
   "SELECT p_partkey, step, n FROM part JOIN (VALUES " + ", ".join(f"({k}, '{s}', {n})" for k, x in _done.items() for s, n in x.items()) + ") v(k, step, n) ON p_partkey % 3 = k")
_q("sheets_text", lambda s, d: _sheets(s, d).select("p_partkey", "css"),
   """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' .a { color: blue; margin: 0; width: 1px }' WHEN 1 THEN ' p { font-style: normal; font-family: Georgia, serif; font-size: 1rem; page-break-before: always; break-before: page }' ELSE '.a { background: none } .a:hover { top: 0 }' END AS css FROM part""")  # fmt: skip

# --- books -------------------------------------------------------------------------------------------------------------


def _packed(spark, sf):
    """A book a hundred pages, with a container and a package that lists the even pages and one file that isn't there."""
    own = _t(spark, sf, "pages").select(F.floor(F.col("page_id") / 100).cast("string").alias("book"), "page_id")
    parts = own.select("book", F.concat(F.lit("ops/t"), "page_id", F.lit(".html")).alias("name"), F.expr("CAST('<p>' || page_id || '</p>' AS BINARY)").alias("data"))
    item = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<item id="i'), "page_id", F.lit('" href="T'), "page_id", F.lit('.HTML" media-type="text/html"/>'))).otherwise("")
    ref = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<itemref idref="i'), "page_id", F.lit('"/>'))).otherwise("")
    rows = F.array_sort(F.collect_list(F.struct("page_id", item.alias("i"), ref.alias("r"))))
    made = own.groupBy("book").agg(rows.alias("x")).select("book", F.concat(F.lit('<package version="2.0"><metadata/><manifest><item id="no" href="no.css" media-type="text/css"/>'), F.array_join("x.i", ""), F.lit('</manifest><spine><itemref idref="lost"/>'), F.array_join("x.r", ""), F.lit("</spine></package>")).alias("t"))
    fixed = {"META-INF/container.xml": '<container><rootfiles><rootfile full-path="ops/p.opf"/></rootfiles></container>', "META-INF/encryption.xml": '<encryption><EncryptedData><EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/><CipherData><CipherReference URI="f.ttf"/></CipherData></EncryptedData></encryption>', "mimetype": "application/epub+zip"}
    for name, text in fixed.items():
        parts = parts.union(own.select("book").distinct().select("book", F.lit(name), F.lit(text).cast("binary")))
    return archives.pack(parts.union(made.select("book", F.lit("ops/p.opf"), F.col("t").cast("binary"))))


_read = lambda s, d: reader.books(_packed(s, d), "book")
BOOKS_SQL = "b AS (SELECT (page_id // 100)::VARCHAR AS book, count(*) AS n, count(*) FILTER (page_id % 2 = 0) AS even, count(*) FILTER (page_id % 4 = 0) AS fourth FROM pages GROUP BY 1)"
_q("books_read", lambda s, d: _read(s, d).groupBy("book", "kind").agg(F.count("*").alias("n")),
   f"""WITH {BOOKS_SQL}, k AS (SELECT book, unnest(['entry', 'rendition', 'package', 'manifest', 'finding', 'spine', 'encrypted', 'meta-inf', 'unlisted']) AS kind, unnest([n + 4, 1, 1, even + 1, 2, fourth + 1, 1, 2, n - even]) AS n FROM b) SELECT * FROM k WHERE n > 0""")
_q("books_manifest", lambda s, d: reader.of_kind(_read(s, d), "manifest", "id", "value", "path", "media_type"),
   f"WITH {BOOKS_SQL} SELECT (page_id // 100)::VARCHAR AS book, 'i' || page_id AS id, 'ops/T' || page_id || '.HTML' AS value, 'ops/t' || page_id || '.html' AS path, 'application/xhtml+xml' AS media_type FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT book, 'no', 'ops/no.css', NULL, 'text/css' FROM b")
_q("books_protected", lambda s, d: reader.is_protected(_read(s, d)), f"WITH {BOOKS_SQL} SELECT book, false AS protected FROM b")
_q("anchors_found", lambda s, d: outline.anchors_of(_t(s, d, "pages").select(F.lit("b").alias("book"), F.col("url").alias("path"), F.expr("CASE WHEN page_id % 2 = 0 THEN 'i' || (page_id % 5) END").alias("element_id")), _t(s, d, "pages").select(F.lit("b").alias("book"), F.col("url").alias("path"), F.expr("CASE page_id % 3 WHEN 0 THEN '' ELSE 'n' || (page_id % 4) END").alias("name"))),
   "SELECT DISTINCT 'b' AS book, url AS path, unnest(list_filter([CASE WHEN page_id % 2 = 0 THEN 'i' || page_id % 5 END, CASE WHEN page_id % 3 > 0 THEN 'n' || page_id % 4 END], lambda x: x IS NOT NULL)) AS fragment FROM pages")
_q("guide_written", lambda s, d: resources.guide(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("ord"), F.expr("CASE l_partkey % 4 WHEN 0 THEN 'bodymatter' WHEN 1 THEN 'titlepage' WHEN 2 THEN 'normal' ELSE 'toc' END").alias("kind"), F.concat(F.lit("f"), F.col("l_suppkey") % 3).alias("path"))),
   "SELECT l_orderkey AS book, min(l_linenumber)::INTEGER AS ord, CASE l_partkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'title-page' ELSE 'toc' END AS kind, 'f' || l_suppkey % 3 AS path FROM lineitem WHERE l_partkey % 4 <> 2 GROUP BY ALL")
_bytes = "CASE p_partkey % 5 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '00010000AA' WHEN 3 THEN '774F4632' ELSE '1234' END"
_q("files_retyped", lambda s, d: resources.retyped(_t(s, d, "part").select(F.col("p_brand").alias("book"), F.expr("'d/x' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.jpeg' WHEN 1 THEN '.PNG' ELSE '.ttf' END").alias("path"), F.lit("a/b").alias("media_type"), F.unhex(F.expr(_bytes)).alias("data"))),
   """WITH f AS (SELECT p_brand AS book, p_partkey AS p, 'd/x' || p_partkey AS stem, CASE p_partkey % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'PNG' ELSE 'ttf' END AS own, ['png', 'jpg', 'ttf', 'woff2', NULL][p_partkey % 5 + 1] AS told FROM part)
SELECT book, stem || '.' || own AS path, stem || '.' || CASE WHEN told IS NULL OR lower(own) = told OR (own = 'jpeg' AND told = 'jpg') THEN own ELSE told END AS new_path, CASE told WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'ttf' THEN 'font/ttf' WHEN 'woff2' THEN 'font/woff2' ELSE 'a/b' END AS media_type FROM f""")  # fmt: skip
_q("fonts_recovered", lambda s, d: resources.recovered_fonts(_t(s, d, "part").select(F.col("p_brand").alias("book"), F.col("p_partkey").cast("string").alias("path"), F.unhex(F.expr("CASE WHEN p_partkey % 3 = 0 THEN '01010101FF' ELSE '11111111' END")).alias("data"), F.unhex(F.lit("01000101")).alias("key"))).select("path", F.hex("data").alias("data"), "recovered"),
   "SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 3 = 0 THEN '00010000FE' ELSE '11111111' END AS data, p_partkey % 3 = 0 AS recovered FROM part")
_q("notes_linked", lambda s, d: resources.footnotes(_t(s, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").cast("string").alias("path"), F.expr("'<p>see [' || (o_orderkey % 4) || '] and [' || (o_orderkey % 3) || ']</p>'").alias("data")), _t(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("book"), F.lit(1).alias("number"), F.lit("n.html#1").alias("href"))).select("book", "path", "links"),
   "SELECT o_custkey::VARCHAR AS book, o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 4 = 1 OR o_orderkey % 3 = 1 THEN 1 ELSE 0 END::INTEGER AS links FROM orders WHERE o_custkey % 2 = 0")
_nodes = "CASE l_linenumber % 3 WHEN 0 THEN 'koń-' WHEN 1 THEN 'ski ' || l_partkey ELSE 'plain' END"
_q("words_cut", lambda s, d: resources.cut_words(_t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).select(F.col("l_orderkey").alias("book"), F.lit("p").alias("path"), F.col("l_linenumber").alias("pre"), (F.col("l_partkey") % 5 == 0).alias("is_block"), (F.col("l_partkey") % 2 == 0).alias("is_bare"), F.expr(_nodes).alias("text"))),
   """WITH l AS (SELECT l_orderkey AS book, l_linenumber AS pre, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), n AS (SELECT *, lead(pre) OVER w AS np, lead(p) OVER w AS pp FROM l WINDOW w AS (PARTITION BY book ORDER BY pre))
SELECT book, 'p' AS path, pre, 'koń' AS lhs, ['koń', 'ski', 'plain'][np % 3 + 1] AS rhs FROM n WHERE pre % 3 = 0 AND np IS NOT NULL AND pp % 5 <> 0 AND (p % 2 = 0 OR pp % 2 = 0)""")  # fmt: skip
_q("paragraph_profile", lambda s, d: resources.profile(_t(s, d, "lineitem").select(F.col("l_suppkey").alias("book"), F.expr("CASE l_linenumber % 4 WHEN 0 THEN '* * *' WHEN 1 THEN 'A heading' WHEN 2 THEN 'A sentence.' ELSE '' END").alias("text"), (F.col("l_discount") * 5).alias("indent"), (F.col("l_tax") * 10).alias("space"), (F.col("l_partkey") % 3 == 0).alias("bold"), (F.col("l_partkey") % 7 == 0).alias("centred")), "book"),
   "SELECT l_suppkey AS book, count(*) AS paragraphs, count(*) FILTER (l_discount * 5 > 0.2::DOUBLE) AS indented, count(*) FILTER (l_tax * 10 > 0.5::DOUBLE) AS spaced, count(*) FILTER (l_linenumber % 4 = 0) AS separators, count(*) FILTER (l_linenumber % 4 < 2 AND (l_partkey % 3 = 0 OR l_partkey % 7 = 0)) AS headings FROM lineitem GROUP BY 1")
_q("class_census", lambda s, d: resources.class_census(_t(s, d, "lineitem").select(F.col("l_suppkey").alias("book"), F.concat(F.lit("c"), F.col("l_partkey") % 9).alias("name"), F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'h1' WHEN 1 THEN 'p' ELSE 'span' END").alias("tag"), F.col("l_orderkey").alias("ord")), _t(s, d, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_suppkey").alias("book"), F.concat(F.lit("c"), F.col("l_partkey") % 5).alias("name"), F.col("l_linestatus").alias("prop"))),
   """WITH u AS (SELECT l_suppkey AS book, 'c' || l_partkey % 9 AS name, string_agg(DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'h1' WHEN 1 THEN 'p' ELSE 'span' END, ',' ORDER BY CASE l_linenumber % 3 WHEN 0 THEN 'h1' WHEN 1 THEN 'p' ELSE 'span' END) AS tags, min(l_orderkey) AS first, count(*) AS uses FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_suppkey AS book, 'c' || l_partkey % 5 AS name, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS properties FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2) SELECT u.*, properties FROM u LEFT JOIN p USING (book, name)""")  # fmt: skip


def _staged(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("data"))
    stages = [
        resources.Stage("measure", lambda d: d.where("doc_id >= 0"), mutates=False), resources.Stage("dots", lambda d: d.withColumn("data", F.replace("data", F.lit("."), F.lit("…")))),
        resources.Stage("ends", lambda d: d.withColumn("data", F.when(F.col("doc_id") % 3 == 0, F.concat("data", F.lit("!"))).otherwise(F.col("data")))),
    ]
    return resources.run_stages(docs, stages, ["doc_id"])[1]


_q("stages_run", _staged, "SELECT 'measure' AS stage, 0::BIGINT AS changed UNION ALL SELECT 'dots', count(*) FILTER (contains(text, '.')) FROM documents UNION ALL SELECT 'ends', count(*) FILTER (doc_id % 3 = 0) FROM documents")
_q("fidelity_checks", lambda s, d: (lambda e: evidence.checks(shapes=evidence.shapes_survive(e, e.where("event_id % 16 > 0")), media=evidence.media_survive(e.select("book", F.col("tag").alias("digest"), F.col("tag").alias("name")), e.where("event_id % 4 = 0").select("book", F.col("tag").alias("digest")))))(_t(s, d, "events").select(F.col("user_id").alias("book"), F.col("event_type").alias("tag"), "event_id")),
   """WITH g AS (SELECT user_id AS book, event_type AS tag, count(*) AS was, count(*) FILTER (event_id % 16 > 0) AS now, count(*) FILTER (event_id % 4 = 0) AS kept FROM events GROUP BY 1, 2)
SELECT book, 'shapes' AS "check", count(*) AS failures FROM g WHERE now < was * 0.95::DOUBLE GROUP BY 1 UNION ALL SELECT book, 'media', count(*) FROM g WHERE kept = 0 GROUP BY 1""")  # fmt: skip

_q("words_folded", lambda s, d: _t(s, d, "documents").select("doc_id", F.sha2(unicode.folded("text"), 256).alias("digest")), "SELECT doc_id, sha256(strip_accents(lower(text))) AS digest FROM documents")
_q("texts_composed", lambda s, d: _t(s, d, "documents").select("doc_id", F.sha2(unicode.composed(F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit("ö"), F.lit("o\u0308"))), 256).alias("digest")), "SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents")
_q("halves_known", lambda s, d: repairs.halves_known(_t(s, d, "part").select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'pl' WHEN 1 THEN 'en' ELSE 'xx' END").alias("language"), F.concat(F.lit("W"), F.col("p_partkey") % 7).alias("lhs"), F.concat(F.lit("z"), F.col("p_partkey") % 5).alias("rhs")), _t(s, d, "part").where("p_partkey < 30").select(F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'pl' ELSE 'en' END").alias("language"), F.expr("CASE WHEN p_partkey < 5 THEN 'w' || p_partkey ELSE 'w' || (p_partkey % 7) || 'z' || (p_partkey % 5) END").alias("word"))).select("p_partkey", "broken"),
   """WITH l AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'pl' ELSE 'en' END AS language, CASE WHEN p_partkey < 5 THEN 'w' || p_partkey ELSE 'w' || (p_partkey % 7) || 'z' || (p_partkey % 5) END AS word FROM part WHERE p_partkey < 30),
c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pl' WHEN 1 THEN 'en' ELSE 'xx' END AS language, 'w' || p_partkey % 7 AS a, 'w' || p_partkey % 7 || 'z' || p_partkey % 5 AS j FROM part)
SELECT p_partkey, CASE WHEN language <> 'xx' THEN NOT EXISTS (SELECT 1 FROM l WHERE l.language = c.language AND word = a) AND EXISTS (SELECT 1 FROM l WHERE l.language = c.language AND word = j) END AS broken FROM c""")  # fmt: skip
_lines = lambda s, d: _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("p")).withColumn("path", F.concat(F.lit("f"), "ord"))
_q("reading_texts", lambda s, d: outline.reading_text(_lines(s, d).select("book", "ord", "path", (F.col("p") % 4 > 0).alias("linear")), _lines(s, d).select("book", "path", F.concat(F.lit("  part\n"), "p", F.lit(" ")).alias("text"))),
   "WITH l AS (SELECT l_orderkey AS book, l_linenumber AS ord, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) SELECT book, string_agg('part ' || p, ' ' ORDER BY ord) AS text, count(*) AS documents FROM l WHERE p % 4 > 0 GROUP BY 1")
_q("pointers_renamed", lambda s, d: outline.renamed(_lines(s, d).select("book", "path", "p"), {"spine": _lines(s, d).select("book", "ord", "path")}, _lines(s, d).where("p % 3 = 0").select("book", "path", F.concat(F.lit("OPS/"), "path").alias("new_path")))[1]["spine"],
   "WITH l AS (SELECT l_orderkey AS book, l_linenumber AS ord, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) SELECT book, ord, CASE WHEN p % 3 = 0 THEN 'OPS/' ELSE '' END || 'f' || ord AS path FROM l")
_q("traces_ordered", lambda s, d: registry._traces(s, d).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "tool"))).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tool"))), lambda t: t["tool"]), ", ").alias("tools")),
   f"WITH t AS ({registry.oracle_sql()['generator_traces']}) SELECT doc_id, string_agg(tool, ', ' ORDER BY confidence DESC, tool) AS tools FROM t GROUP BY 1")

# --- tables, functions, streams ----------------------------------------------------------------------------------------

_q("json_leaves", lambda s, d: tables.leaves(_t(s, d, "orders").select("o_orderkey", F.expr("""'{"a":{"b":' || o_custkey || ',"c":{"d":"x"}},"e":[1,2]}'""").alias("j")), "j"),
   "SELECT o_orderkey, unnest(['a/b', 'a/c/d', 'e']) AS path, unnest([o_custkey::VARCHAR, 'x', '[1,2]']) AS value FROM orders")


def _by_sql(spark, sf):
    functions_sql.register(spark)
    _t(spark, sf, "documents").createOrReplaceTempView("vellum_documents")
    return spark.sql("SELECT doc_id, sha2(vellum_canonical(text), 256) AS canonical, vellum_looks_polish(text) AS polish, vellum_has_notice(text) AS notice, vellum_slug(source) AS slug FROM vellum_documents")


_canon = registry.CANON_SQL.format(x="text")
_q("sql_functions", _by_sql, f"SELECT doc_id, sha256({_canon}) AS canonical, length(text) > 0 AND (length(text) - length(translate(text, '{registry.tx.POLISH}', ''))) * 1000 >= length(text) * 35 AS polish, {registry.NOTICE_SQL} AS notice, trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
_q("rollup_counts", lambda s, d: _t(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_q("cube_counts", lambda s, d: _t(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_q("names_in_both", lambda s, d: _t(s, d, "lineitem").where("l_returnflag = 'A'").select("l_partkey").intersect(_t(s, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey")), "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")


def _sampled(spark, sf):
    by = Window.partitionBy("book")
    p = _t(spark, sf, "pages").select((F.col("page_id") % 5).alias("book"), "page_id").withColumn("i", F.row_number().over(by.orderBy("page_id")) - 1).withColumn("n", F.count("*").over(by))
    return p.where(values.sampled(F.col("i"), F.col("n"), 6)).select("book", "page_id")


_q("pages_sampled", _sampled,
   "SELECT book, page_id FROM (SELECT page_id % 5 AS book, page_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY page_id % 5) AS n FROM pages WINDOW w AS (PARTITION BY page_id % 5 ORDER BY page_id)) WHERE n <= 6 OR i < 3 OR ((i - 3) % greatest(1, (n - 3) // 3) = 0 AND (i - 3) / greatest(1, (n - 3) // 3) < 3)")


def _streamed(made):
    """A stream over the table's files, run to its end; what its windows hold is then a table."""

    def run(spark, sf):
        stream = ledger.drop_folder(spark, sf, _t(spark, sf, "events").schema, "events.parquet")
        return ledger.finished(made(stream.withColumn("ts", F.col("ts").cast("timestamp"))))

    return run


_q("sliding_windows_stream", _streamed(lambda e: windows.windowed(e, "ts", ["event_type"], "2 days", "1 day", late="10000 days").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")),
   "SELECT strftime(s, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1, 2")
_q("sessions_stream", _streamed(lambda e: windows.sessions(e, "ts", ["user_id"], "6 hours", late="10000 days").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")),
   """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
_q("library_findings_json", lambda s, d: library.ranked(registry._findings(s, d)).select("rule", F.to_json(F.struct("stage", "level", "books", "occurrences")).alias("json")),
   f"""SELECT rule, '{{"stage":"' || stage || '","level":"' || level || '","books":' || count(DISTINCT book) || ',"occurrences":' || count(*) || '}}' AS json FROM ({registry.FINDINGS_SQL}) GROUP BY stage, level, rule""")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
