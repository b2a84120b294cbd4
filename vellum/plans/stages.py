"""Queries of the repairs, outlines, gates, reports and evidence over relations that a rule derives from the driver's
tables, each beside the SQL that checks it. Rules are expressions that Spark and the checking SQL read alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import markup, names, values
from vellum.functions import text as tx
from vellum.operators import evidence, gates, library, outline, repairs, reports, sequences
from vellum.plans import registry

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _q(name: str, run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _one(name: str, table: str, key: str, rule: str, column, sql: str, **kinds) -> None:
    """A query of one scalar expression over one value by a rule; `sql` says the same of the value `v`."""
    to = kinds.get("to", "value")
    _q(name, lambda s, d: _t(s, d, table).select(key, F.expr(rule).alias("v")).select(key, column(F.col("v")).alias(to)), f"SELECT {key}, {sql} AS {to} FROM (SELECT *, {rule} AS v FROM {table})")


# --- scalar judgements -------------------------------------------------------------------------------------------------

SALE = "CASE doc_id % 5 WHEN 0 THEN 'Order ##' || CAST(doc_id AS STRING) || ' (x***@y.z) ' || text WHEN 1 THEN replace(text, '. ', '. Licensed to Jan Kowalski. ') WHEN 2 THEN 'Sold to A1. ' || text ELSE text END"
_phrases = "|".join(p.replace(" ", "\\s+") for p in sorted(markup.SHOP, key=len, reverse=True))
_shop = lambda x: "(" + " OR ".join(f"contains(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), {_s(p)})" for p in markup.SHOP) + ")"
_prose = lambda x: f"(len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')) >= 3 AND len(list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-ząćęłńóśźż]{{3,}}'))) > 0)"
_cut = f"(?is)^(.*?)({_phrases})((?:[\\s.,:;–—-]*[^\\s\\d@#]*[\\d@#]\\S*[\\s.,:;]*)*)(.*)$"
_q(
    "notices_removed",
    lambda s, d: repairs.notices_taken_out(_t(s, d, "documents").select("doc_id", F.expr(SALE).alias("text"))).select("doc_id", F.sha2("kept", 256).alias("kept"), "removed"),
    f"""WITH d AS (SELECT doc_id, {SALE} AS text FROM documents), p AS (SELECT doc_id, i, trim(x) AS x FROM (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS parts FROM d WHERE {_shop('text')})) WHERE trim(x) <> ''),
c AS (SELECT *, {_shop('x')} AS hit, trim(regexp_extract(x, {_s(_cut)}, 1)) AS a, trim(regexp_extract(x, {_s(_cut)}, 4)) AS z FROM p),
k AS (SELECT doc_id, i, hit, CASE WHEN hit THEN trim(CASE WHEN {_prose('a')} THEN a ELSE '' END || ' ' || CASE WHEN {_prose('z')} THEN z ELSE '' END) ELSE x END AS kept FROM c),
t AS (SELECT doc_id, string_agg(kept, ' ' ORDER BY i) FILTER (kept <> '') AS kept, count(*) FILTER (hit) AS removed FROM k GROUP BY 1)
SELECT doc_id, sha256(CASE WHEN t.doc_id IS NULL THEN d.text ELSE coalesce(t.kept, '') END) AS kept, coalesce(removed, 0)::INTEGER AS removed FROM d LEFT JOIN t USING (doc_id)""",
)
MARKED = "CASE doc_id % 3 WHEN 0 THEN '\"' || text ELSE replace(text, ' the ', ' \"the\" ') END"
_q(
    "quotes_retyped",
    lambda s, d: _t(s, d, "documents").select("doc_id", markup.retyped(F.expr(MARKED), "„", "”").alias("r")).select("doc_id", F.sha2("r.text", 256).alias("digest"), "r.replaced", "r.inside"),
    f"""SELECT doc_id, sha256(array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x WHEN i % 2 = 0 THEN '„' || x ELSE '”' || x END), '')) AS digest, (len(p) - 1)::INTEGER AS replaced, (len(p) - 1) % 2 = 1 AS inside
FROM (SELECT doc_id, string_split({MARKED}, '"') AS p FROM documents)""",
)
STYLES = "CASE p_partkey % 7 WHEN 0 THEN 'color: red; display : NONE' WHEN 1 THEN 'font-size: ' || CAST(p_size % 4 AS STRING) || 'px' WHEN 2 THEN 'font-size:0.9em' WHEN 3 THEN 'font-size: .0em !important;' WHEN 4 THEN 'visibility:hidden' WHEN 5 THEN 'font-size: 10px' ELSE '' END"
_one("unreadable_styles", "part", "p_partkey", STYLES, markup.is_unreadable, "(regexp_matches(v, '(?i)display ?: ?none|visibility:hidden') OR (regexp_matches(v, '^font-size: [0-2]px')) OR v LIKE '%.0em%')", to="hidden")
_one("placeholder_alts", "part", "p_partkey", "CASE p_partkey % 5 WHEN 0 THEN 'Image' WHEN 1 THEN 'img_' || CAST(p_partkey % 1200 AS STRING) WHEN 2 THEN p_name || '.JPG' WHEN 3 THEN p_name ELSE ' plan ' END", lambda v: markup.is_placeholder(v, F.lit("pics/plan.png")),
     "regexp_full_match(lower(trim(v)), 'image|[a-z]{1,12}[\\s._-]*[0-9]{1,3}|[a-z0-9._-]+\\.jpg|plan')", to="placeholder")
_one("resource_kinds", "part", "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN 'a/b.XHTML' WHEN 1 THEN 'c.jpeg' WHEN 2 THEN 'x.woff2' WHEN 3 THEN 's.css' WHEN 4 THEN 'noext' ELSE 'page.htm' END", lambda v: markup.resource_kind(v, F.when(F.col("p_partkey") % 11 == 0, "image/png")),
     "CASE WHEN p_partkey % 11 = 0 THEN 'images' ELSE CASE p_partkey % 6 WHEN 0 THEN 'documents' WHEN 1 THEN 'images' WHEN 2 THEN 'fonts' WHEN 3 THEN 'stylesheets' WHEN 4 THEN 'other' ELSE 'documents' END END", to="kind")
_q(
    "animated_images",
    lambda s, d: _t(s, d, "part").select("p_partkey", markup.is_animated(F.unhex(F.expr("CASE p_partkey % 4 WHEN 0 THEN '474946383961' || repeat('21F90400', CAST(p_size % 3 AS INT)) WHEN 1 THEN '52494646000000005745425000' || CASE WHEN p_size % 2 = 0 THEN '414E494D' ELSE '0414E494D0' END WHEN 2 THEN '89504E47' ELSE '' END"))).alias("moves")),
    "SELECT p_partkey, (p_partkey % 4 = 0 AND p_size % 3 = 2) OR (p_partkey % 4 = 1 AND p_size % 2 = 0) AS moves FROM part",
)
_one("zero_lengths", "part", "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '0.0em' WHEN 2 THEN '-0px' WHEN 3 THEN '0.1em' WHEN 4 THEN ' .00% ' ELSE 'zero' END", markup.is_zero_length, "p_partkey % 6 IN (0, 1, 2, 4)", to="zero")
_one("colours", "part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN '#0aF' WHEN 1 THEN '#102030' WHEN 2 THEN 'rgb(' || CAST(p_size AS STRING) || ', 300,7)' ELSE 'red' END", lambda v: F.to_json(markup.colour(v)),
     """CASE p_partkey % 4 WHEN 0 THEN '{"red":0,"green":170,"blue":255}' WHEN 1 THEN '{"red":16,"green":32,"blue":48}' WHEN 2 THEN '{"red":' || p_size || ',"green":255,"blue":7}' END""", to="rgb")  # fmt: skip
_one("font_sizes_rem", "part", "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) || 'px' WHEN 1 THEN CAST(p_size AS STRING) || '.5 PT' ELSE '2em' END", markup.size_in_rem, "CASE p_partkey % 3 WHEN 0 THEN round(p_size / 16.0::DOUBLE, 4) WHEN 1 THEN round((p_size + 0.5::DOUBLE) * 4 / 3 / 16, 4) END", to="rem")
_one("inert_declarations", "part", "p_partkey", "CASE p_partkey % 5 WHEN 0 THEN 'Normal' WHEN 1 THEN 'italic' WHEN 2 THEN 'inherit' WHEN 3 THEN 'oblique' ELSE 'normal ' END", lambda v: markup.is_inert(F.lit("font-style"), v, F.when(F.col("p_partkey") % 2 == 1, "italic")),
     "CASE p_partkey % 5 WHEN 0 THEN p_partkey % 2 = 0 WHEN 1 THEN p_partkey % 2 = 1 WHEN 2 THEN true WHEN 3 THEN false ELSE p_partkey % 2 = 0 END", to="inert")
_one("compound_shapes", "part", "p_partkey", "CASE p_partkey % 5 WHEN 0 THEN 'Biało' WHEN 1 THEN 'pseudo' WHEN 2 THEN 'mo' WHEN 3 THEN 'plan' ELSE 'poli' END", markup.reads_as_compound, "p_partkey % 5 IN (0, 1, 4)", to="compound")
_q("illegal_characters", lambda s, d: _t(s, d, "documents").select("doc_id", F.translate("text", "éñ", "\x02\x1f").alias("t")).select("doc_id", markup.illegal_count(F.col("t")).alias("illegal"), F.length(markup.legal(F.col("t"))).alias("left")),
   "SELECT doc_id, (length(text) - length(translate(text, 'éñ', '')))::INTEGER AS illegal, length(translate(text, 'éñ', ''))::INTEGER AS left FROM documents")
ENTITIES = "replace(replace(html, '<p>', '<p>&nbsp;&eacute;&odd;&amp;'), '</p>', '&mdash;&x9;&odder;</p>')"
_q("entities_numeric", lambda s, d: _t(s, d, "pages").select("page_id", F.expr(ENTITIES).alias("h")).select("page_id", F.sha2(markup.numeric_entities(F.col("h")), 256).alias("digest"), F.array_join(markup.unresolvable(F.col("h")), ",").alias("unknown")),
   f"SELECT page_id, sha256(replace(replace(replace(replace(replace(h, '&nbsp;', '&#160;'), '&eacute;', '&#233;'), '&mdash;', '&#8212;'), '&copy;', '&#169;'), '&middot;', '&#183;')) AS digest, concat_ws(',', CASE WHEN contains(h, '&odd;') THEN 'odd' END, CASE WHEN contains(h, '&odder;') THEN 'odder' END, CASE WHEN contains(h, '&x9;') THEN 'x9' END) AS unknown FROM (SELECT page_id, {ENTITIES} AS h FROM pages)")
_one("doctypes_modern", "pages", "page_id", "CASE page_id % 3 WHEN 0 THEN '<!DOCTYPE html PUBLIC \"-//W3C//DTD XHTML 1.1//EN\" \"x.dtd\">' WHEN 1 THEN '<!doctype html [<!ENTITY a \"b\">]>' ELSE '' END || html", lambda v: F.sha2(markup.modern_doctype(v), 256),
     "sha256(CASE WHEN page_id % 3 < 2 THEN '<!DOCTYPE html>' ELSE '' END || regexp_replace(html, '(?i)<!doctype[^>]*>', '<!DOCTYPE html>', 'g'))", to="digest")
_one("titles_filled", "pages", "page_id", "CASE page_id % 3 WHEN 0 THEN '<title> </title>' WHEN 1 THEN '<title lang=\"x\"/>' ELSE '<title>kept</title>' END || url", lambda v: markup.filled_title(v, F.concat(F.lit("a & b "), F.col("page_id"))),
     "CASE WHEN page_id % 3 < 2 THEN '<title>a &amp; b ' || page_id || '</title>' ELSE '<title>kept</title>' END || url", to="html")
_q("document_titles", lambda s, d: _t(s, d, "pages").select("page_id", markup.title_of(F.expr("CASE page_id % 4 WHEN 0 THEN regexp_replace(html, '(?is)<title.*</title>', '') WHEN 1 THEN '<p>none</p>' ELSE html END"), F.concat(F.lit("a/some-page-"), "page_id", F.lit(".html"))).alias("title")),
   """WITH h AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(html, '(?is)<title.*</title>', '', 'g') WHEN 1 THEN '<p>none</p>' ELSE html END AS h FROM pages),
t AS (SELECT page_id, list_transform(['title', 'h1', 'h2'], lambda n: nullif(trim(regexp_replace(regexp_replace(regexp_extract(h, '(?is)<' || n || '[^>]*>(.*?)</' || n || '>', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), '')) AS f FROM h)
SELECT page_id, left(coalesce(f[1], f[2], f[3], 'some page ' || page_id), 200) AS title FROM t""")  # fmt: skip

# --- names -------------------------------------------------------------------------------------------------------------

_q("relative_paths", lambda s, d: _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", names.relative(F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'ops/text/c.xhtml' WHEN 1 THEN 'c.xhtml' ELSE 'ops/text/deep/c.xhtml' END"), F.expr("CASE l_partkey % 3 WHEN 0 THEN 'ops/img/a.png' WHEN 1 THEN 'a.png' ELSE 'ops/text/b.xhtml' END")).alias("href")),
   """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN CASE l_partkey % 3 WHEN 0 THEN '../img/a.png' WHEN 1 THEN '../../a.png' ELSE 'b.xhtml' END WHEN 1 THEN CASE l_partkey % 3 WHEN 0 THEN 'ops/img/a.png' WHEN 1 THEN 'a.png' ELSE 'ops/text/b.xhtml' END
ELSE CASE l_partkey % 3 WHEN 0 THEN '../../img/a.png' WHEN 1 THEN '../../../a.png' ELSE '../b.xhtml' END END AS href FROM lineitem""")  # fmt: skip
_q("file_slugs", lambda s, d: names.unique_names(_t(s, d, "part").select("p_partkey", F.col("p_brand").alias("shelf"), names.file_slug(F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Żółw & Ćma.HTML' WHEN 1 THEN p_name WHEN 2 THEN '中文.jpg' ELSE p_type || '.Tar.GZ' END")).alias("slug")), "shelf", "slug", "p_partkey"),
   """WITH n AS (SELECT p_partkey, p_brand AS shelf, CASE p_partkey % 4 WHEN 0 THEN 'zolw-cma.html' WHEN 1 THEN trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') WHEN 2 THEN 'file.jpg' ELSE trim(regexp_replace(lower(p_type || '.tar'), '[^a-z0-9]+', '-', 'g'), '-') || '.gz' END AS slug FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY shelf, slug ORDER BY p_partkey) AS k FROM n) SELECT p_partkey, shelf, slug, CASE WHEN k = 1 THEN slug ELSE regexp_replace(slug, '^(.*?)(\\.[^.]*)?$', '\\1-' || k || '\\2') END AS unique FROM k""")  # fmt: skip
_url = uuid.NAMESPACE_URL.hex
_q("book_uuids", lambda s, d: names.book_uuid(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.concat(F.lit("f"), "l_linenumber").alias("path"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"))),
   f"""WITH b AS (SELECT l_orderkey AS book, sha256(string_agg('f' || l_linenumber || chr(9) || sha256(l_partkey::VARCHAR), chr(10) ORDER BY 'f' || l_linenumber, sha256(l_partkey::VARCHAR))) AS d FROM lineitem GROUP BY 1),
h AS (SELECT book, sha1(from_hex('{_url}' || hex(d))) AS x FROM b)
SELECT book, 'urn:uuid:' || x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab89ab89ab89ab', ('0x' || x[17])::INTEGER + 1, 1) || x[18:20] || '-' || x[21:32] AS identifier FROM h""")  # fmt: skip
_one("language_tags", "part", "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN 'EN_us' WHEN 1 THEN ' pl ' WHEN 2 THEN 'zh-hant-tw' WHEN 3 THEN 'english language' WHEN 4 THEN '' ELSE 'de-1996' END", names.language_tag, "CASE p_partkey % 6 WHEN 0 THEN 'en-US' WHEN 1 THEN 'pl' WHEN 2 THEN 'zh-hant-TW' WHEN 5 THEN 'de-1996' ELSE 'en' END", to="tag")
_q("languages_settled", lambda s, d: _t(s, d, "documents").select("doc_id", names.settled_language(F.col("lang"), F.expr("CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'ę') ELSE text END")).alias("language")),
   f"""SELECT doc_id, CASE WHEN length(t) >= 500 AND (length(t) - length(translate(t, '{tx.POLISH}', ''))) * 1000 >= length(t) * 35 THEN 'pl' ELSE coalesce(lang, 'en') END AS language FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'ę') ELSE text END AS t FROM documents)""")
_one("names_filed", "supplier", "s_suppkey", "CASE s_suppkey % 3 WHEN 0 THEN '  Jan  Maria   Nowak ' WHEN 1 THEN 'Nowak, Jan' ELSE s_name END", names.file_as, "CASE WHEN s_suppkey % 3 = 0 THEN 'Nowak, Jan Maria' WHEN s_suppkey % 3 = 2 AND contains(trim(s_name), ' ') THEN regexp_extract(trim(s_name), '[^ ]+$') || ', ' || regexp_extract(trim(s_name), '^(.*) [^ ]+$', 1) END", to="file_as")
_one("media_folders", "part", "p_partkey", "CASE p_partkey % 5 WHEN 0 THEN 'application/xhtml+xml' WHEN 1 THEN 'image/png' WHEN 2 THEN 'font/ttf' WHEN 3 THEN 'application/x-thing' ELSE 'text/css' END", names.folder_of, "CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'images' WHEN 2 THEN 'fonts' WHEN 3 THEN 'misc' ELSE 'styles' END", to="folder")

# --- descriptions ------------------------------------------------------------------------------------------------------

_titles = lambda s, d: _t(s, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("ord"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE ' ' || o_orderpriority END").alias("value"))
_q("titles_settled", lambda s, d: repairs.titles(_titles(s, d)),
   """WITH t AS (SELECT o_custkey AS book, list(trim(o_orderpriority) ORDER BY o_orderkey) FILTER (o_orderkey % 4 <> 0) AS t FROM orders GROUP BY 1)
SELECT book, coalesce(t[1], 'Untitled') AS main, t[2] AS subtitle, coalesce(array_to_string(t[3:], '|'), '') AS others FROM t""")  # fmt: skip
_ids = "CASE o_orderkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '10.1/' || o_orderpriority WHEN 2 THEN ' 9780306406157' ELSE o_orderpriority END"
_q("identifiers_settled", lambda s, d: repairs.identifiers(_t(s, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("ord"), F.expr(_ids).alias("value"), (F.col("o_orderkey") % 7 == 0).alias("is_primary")), _t(s, d, "customer").select(F.col("c_custkey").alias("book"), F.concat(F.lit("urn:uuid:"), "c_custkey").alias("identifier"))),
   f"""WITH r AS (SELECT o_custkey AS book, o_orderkey AS ord, trim({_ids}) AS value, o_orderkey % 7 = 0 AS p FROM orders), o AS (SELECT book, value, min(ord) AS ord, arg_min(p, ord) AS p FROM r WHERE value <> '' GROUP BY 1, 2),
f AS (SELECT *, bool_or(p) OVER (PARTITION BY book) AS any_p, min(ord) OVER (PARTITION BY book) AS first FROM o)
SELECT book, value, CASE WHEN value LIKE '10.%' THEN 'DOI' WHEN value = '9780306406157' THEN 'ISBN' END AS scheme, p OR (NOT any_p AND ord = first) AS is_primary, false AS minted FROM f
UNION ALL SELECT c_custkey, 'urn:uuid:' || c_custkey, NULL, true, true FROM customer WHERE c_custkey NOT IN (SELECT book FROM f)""")  # fmt: skip
_people = "CASE o_orderkey % 4 WHEN 0 THEN 'Ann  Lee' WHEN 1 THEN 'ann lee' WHEN 2 THEN 'Lee, Ann' ELSE ' ' END"
_q("creators_settled", lambda s, d: repairs.creators(_t(s, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("ord"), F.expr(_people).alias("name"), F.expr("CASE o_orderstatus WHEN 'O' THEN 'aut' WHEN 'F' THEN 'edt' ELSE 'Writer' END").alias("role"))),
   f"""WITH r AS (SELECT o_custkey AS book, o_orderkey AS ord, trim(regexp_replace({_people}, '\\s+', ' ', 'g')) AS name, CASE o_orderstatus WHEN 'O' THEN 'aut' WHEN 'F' THEN 'edt' ELSE 'Writer' END AS role FROM orders)
SELECT book, min(ord) AS ord, arg_min(name, ord) AS name, CASE WHEN role = 'Writer' THEN 'aut' ELSE role END AS role, CASE WHEN lower(name) = 'ann lee' THEN CASE WHEN arg_min(name, ord) = 'Ann Lee' THEN 'Lee, Ann' ELSE 'lee, ann' END END AS file_as FROM r WHERE name <> '' GROUP BY book, lower(name), role""")  # fmt: skip
_q("modified_pinned", lambda s, d: _t(s, d, "orders").select("o_orderkey", repairs.pinned_modified(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') || 'T01:02:03Z' WHEN o_orderkey % 3 = 1 THEN '2020' END"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN '2001-02-03T04:05:06Z' END")).alias("modified")),
   "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T01:02:03Z' WHEN o_orderkey % 2 = 0 THEN '2001-02-03T04:05:06Z' ELSE '1970-01-01T00:00:00Z' END AS modified FROM orders")

# --- typography, hyphens, questions ------------------------------------------------------------------------------------

WORDED = "replace(replace(CASE length(source) % 2 WHEN 0 THEN '„' || text || '”' ELSE '«' || text || '»' END, ' la ', ' \"la\" '), '. ', '... a ')"
TONGUE = "CASE lang WHEN 'es' THEN 'pl' ELSE lang END"


def _typography(spark, sf):
    docs = _t(spark, sf, "documents").where("source IS NOT NULL").select("doc_id", "source", F.expr(WORDED).alias("text"), F.expr(TONGUE).alias("lang"))
    out = repairs.typography(docs, "source", F.col("lang"), sequences.quote_convention(docs, "source"))
    return out.select("doc_id", F.sha2("repaired", 256).alias("digest"), "ellipses", "conjunctions", "quotes", "reverted")


_marks = {m: f"sum(length(t) - length(replace(t, '{m}', '')))" for m in values.QUOTES.values()}
_total = " + ".join(_marks.values())
_bind = lambda x: f"regexp_replace({x}, '(^|[\\s\u00a0(„«\"])([aiouwzAIOUWZ]) ([\\p{{L}}\\p{{N}}_])', '\\1\\2' || chr(160) || '\\3', 'g')"
_q("typography_repaired", _typography,
   f"""WITH d AS (SELECT doc_id, source, {WORDED} AS t, {TONGUE} AS lang FROM documents WHERE source IS NOT NULL),
c AS (SELECT source, CASE WHEN {_total} >= 20 AND ({_marks['„']} + {_marks['”']}) * 3 >= ({_total}) * 2 THEN 'polish' WHEN {_total} >= 20 AND ({_marks['«']} + {_marks['»']}) * 3 >= ({_total}) * 2 THEN 'french' END AS convention FROM d GROUP BY 1),
a AS (SELECT *, regexp_replace(t, '(^|[^.])\\.\\.\\.([^.]|$)', '\\1…\\2', 'g') AS e FROM d JOIN c USING (source)), b AS (SELECT *, CASE WHEN lang = 'pl' THEN {_bind(_bind('e'))} ELSE e END AS n FROM a),
q AS (SELECT *, string_split(n, '"') AS p FROM b)
SELECT doc_id, sha256(CASE WHEN convention IS NULL THEN n ELSE array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x WHEN i % 2 = 0 THEN CASE convention WHEN 'polish' THEN '„' ELSE '«' END || x ELSE CASE convention WHEN 'polish' THEN '”' ELSE '»' END || x END), '') END) AS digest,
  ((length(t) - length(e)) / 2)::INTEGER AS ellipses, (length(replace(e, chr(160), '')) - length(replace(n, chr(160), '')))::INTEGER AS conjunctions, CASE WHEN convention IS NULL THEN 0 ELSE len(p) - 1 END::INTEGER AS quotes, false AS reverted FROM q""")  # fmt: skip


def _joined(spark, sf):
    docs = registry._broken(_t(spark, sf, "documents")).where("source IS NOT NULL")
    sure = library.hyphen_candidates(docs).where("confidence = 'confirmed'")
    out = repairs.joined_hyphens(docs.select("source", "doc_id", "text"), sure.select("source", "lhs", "rhs"))
    return out.select("doc_id", F.sha2("text", 256).alias("digest"), "joined", repairs.only_hyphens_went(F.col("before"), F.col("text")).alias("conserved"))


_hyphens = registry.HYPHENS_SQL
_q("hyphens_joined", _joined, _hyphens + f""", w AS MATERIALIZED (SELECT source, list(DISTINCT lhs || '-' || rhs) AS broken FROM named WHERE confidence = 'confirmed' GROUP BY 1),
d AS (SELECT doc_id, source, {registry.BROKEN} AS text FROM main.documents WHERE source IS NOT NULL),
a AS (SELECT doc_id, text, CASE WHEN broken IS NULL THEN text ELSE array_to_string(list_transform(regexp_extract_all(text, '(?s)[\\p{{L}}\\p{{N}}]+-[\\p{{L}}\\p{{N}}]+|[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'), lambda p: CASE WHEN list_contains(broken, lower(p)) THEN replace(p, '-', '') ELSE p END), '') END AS after FROM d LEFT JOIN w USING (source))
SELECT doc_id, sha256(after) AS digest, coalesce(length(text) - length(after), 0)::INTEGER AS joined, replace(text, '-', '') = replace(after, '-', '') AS conserved FROM a""")  # fmt: skip
_q("review_questions", lambda s, d: repairs.review_questions(library.hyphen_candidates(registry._broken(_t(s, d, "documents")).where("source IS NOT NULL"))),
   _hyphens + """, w AS (SELECT source, confidence, list(lhs || '-' || rhs ORDER BY lhs || '-' || rhs) AS l FROM named WHERE confidence IN ('likely', 'uncertain') AND source IS NOT NULL GROUP BY 1, 2)
SELECT source, confidence, len(l) AS words, array_to_string(l[1:40], ', ') AS shown, left(sha256('hyphen' || chr(0) || source || chr(0) || confidence || ':' || len(l) || chr(0) || 'join'), 16) AS question FROM w""")  # fmt: skip
_q("answers_settled", lambda s, d: repairs.answered(_t(s, d, "orders").select(F.col("o_orderkey").alias("question"), F.col("o_orderpriority").alias("group")), _t(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("question"), F.concat(F.lit("use "), "l_returnflag").alias("choice")), _t(s, d, "orders").where("o_orderstatus = 'P' AND o_orderpriority LIKE '%U%'").select(F.col("o_orderpriority").alias("group"), F.lit("join").alias("choice"))),
   """WITH a AS (SELECT l_orderkey AS question, min('use ' || l_returnflag) AS c FROM lineitem WHERE l_quantity > 45 GROUP BY 1), g AS (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '%U%')
SELECT o_orderkey AS question, o_orderpriority AS "group", coalesce(c, CASE WHEN p IS NOT NULL THEN 'join' END, 'keep') AS choice, CASE WHEN c IS NOT NULL THEN 'stored' WHEN p IS NOT NULL THEN 'group' ELSE 'unanswered' END AS origin FROM orders LEFT JOIN a ON question = o_orderkey LEFT JOIN g ON p = o_orderpriority""")  # fmt: skip

# --- outlines and layouts ----------------------------------------------------------------------------------------------

#: An outline of every order's lines, of which the nth is as deep as this.
LEVEL = "CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 6 THEN 1 ELSE 2 END"


def _points(spark, sf):
    return _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("pre")).agg(F.min("l_partkey").alias("p")).selectExpr("book", "pre", LEVEL.replace("l_linenumber", "pre") + " AS depth", "'p' || p AS label", "'f' || p AS path", "CASE WHEN p % 2 = 0 THEN 'a' || p END AS fragment")


_files = lambda s, d: _t(s, d, "lineitem").where("l_partkey % 3 > 0").select(F.col("l_orderkey").alias("book"), F.concat(F.lit("f"), "l_partkey").alias("path"))
_anchors = lambda s, d: _t(s, d, "lineitem").where("l_partkey % 5 > 0").select(F.col("l_orderkey").alias("book"), F.concat(F.lit("f"), "l_partkey").alias("path"), F.expr("CASE WHEN l_partkey % 4 = 0 THEN 'a' || l_partkey ELSE 'z' END").alias("fragment"))
POINTS_SQL = f"pts AS (SELECT l_orderkey AS book, l_linenumber AS pre, ({LEVEL})::INTEGER AS depth, min(l_partkey) AS p FROM lineitem GROUP BY ALL)"
_q("toc_pruned", lambda s, d: outline.pruned(_points(s, d), _files(s, d), _anchors(s, d)),
   f"""WITH {POINTS_SQL}, m AS (SELECT *, CASE WHEN p % 3 > 0 THEN 'f' || p END AS path, CASE WHEN p % 3 > 0 AND p % 2 = 0 AND (p % 5 = 0 OR p % 4 = 0) THEN 'a' || p END AS fragment FROM pts)
SELECT book, pre, depth, 'p' || p AS label, path, fragment FROM m WHERE path IS NOT NULL OR EXISTS (SELECT 1 FROM m d WHERE d.book = m.book AND d.pre > m.pre AND d.path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m x WHERE x.book = m.book AND x.pre > m.pre AND x.pre <= d.pre AND x.depth <= m.depth))""")  # fmt: skip
_spine = lambda s, d: _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("ord")).agg(F.concat(F.lit("f"), F.min("l_partkey")).alias("path"), (F.min("l_partkey") % 4 > 0).alias("linear"))
SPINE_SQL = "sp AS (SELECT l_orderkey AS book, l_linenumber AS ord, 'f' || min(l_partkey) AS path, min(l_partkey) % 4 > 0 AS linear FROM lineitem GROUP BY 1, 2)"
_q("toc_synthesised", lambda s, d: outline.synthesised(_spine(s, d), _spine(s, d).select("book", "path", F.concat(F.lit("Part "), "path").alias("label")).distinct()),
   f"WITH {SPINE_SQL} SELECT book, (row_number() OVER (PARTITION BY book ORDER BY ord) - 1)::INTEGER AS pre, 'Part ' || path AS label, path FROM sp WHERE linear")
_given = lambda s, d: _t(s, d, "lineitem").where("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("ord"), F.expr("CASE WHEN l_linenumber = 1 THEN 'cover' WHEN l_partkey % 3 = 0 THEN 'bodymatter' ELSE 'toc' END").alias("kind"), F.expr("CASE WHEN l_linenumber = 1 THEN 'f' || l_partkey ELSE 'nav' END").alias("path"))
_q("landmarks_settled", lambda s, d: outline.landmarks(_given(s, d), _spine(s, d)),
   f"""WITH {SPINE_SQL}, g AS (SELECT l_orderkey AS book, l_linenumber AS ord, CASE WHEN l_linenumber = 1 THEN 'cover' WHEN l_partkey % 3 = 0 THEN 'bodymatter' ELSE 'toc' END AS kind, CASE WHEN l_linenumber = 1 THEN 'f' || l_partkey ELSE 'nav' END AS path FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) WHERE l_linenumber <= 3),
f AS (SELECT book, arg_min(path, ord) AS first, bool_or(kind = 'bodymatter') AS has, max(ord) AS last FROM g GROUP BY 1)
SELECT book, min(ord)::INTEGER AS ord, kind, path FROM g GROUP BY book, kind, path UNION ALL SELECT book, (coalesce(max(last), -1) + 1)::INTEGER, 'bodymatter', arg_min(path, ord) FROM sp LEFT JOIN f USING (book) WHERE linear AND NOT coalesce(has, false) AND (first IS NULL OR path <> first) GROUP BY book""")  # fmt: skip
_q("toc_depths", lambda s, d: outline.depths(_points(s, d)), f"WITH {POINTS_SQL} SELECT book, count(*) AS entries, (max(depth) + 1)::INTEGER AS deepest FROM pts GROUP BY 1")
_q("toc_rendered", lambda s, d: outline.rendered(_points(s, d).withColumn("path", F.when(F.col("pre") % 3 > 0, F.col("path")))),
   f"""WITH {POINTS_SQL}, x AS (SELECT *, depth - coalesce(lag(depth) OVER (PARTITION BY book ORDER BY pre), -1) AS deeper, CASE WHEN pre % 3 = 0 THEN '<span>p' || p || '</span>' ELSE '<a href="f' || p || CASE WHEN p % 2 = 0 THEN '#a' || p ELSE '' END || '">p' || p || '</a>' END AS entry FROM pts)
SELECT book, string_agg(CASE WHEN deeper > 0 THEN '<ol>' ELSE '</li>' || repeat('</ol></li>', -deeper) END || '<li>' || entry, '' ORDER BY pre) || '</li></ol>' || repeat('</li></ol>', arg_max(depth, pre)) AS html FROM x GROUP BY book""")  # fmt: skip
_junk = "CASE p_partkey % 6 WHEN 0 THEN 'a/Thumbs.db' WHEN 1 THEN 'chapter' || CAST(p_partkey AS STRING) || '.bak' WHEN 2 THEN '__MACOSX/x' WHEN 3 THEN 'x/._a.png' WHEN 4 THEN 'thumbs.db.txt' ELSE 'c.html' END"
# A book is a part, whose brand and key read alike for some: `Brand#2` and 34, `Brand#23` and 4. They stay apart.
_junk_of = lambda f: outline.junk(f, f.where("book.p_partkey % 4 = 0"), f.where("book.p_partkey % 9 = 0"))
_q("junk_files", lambda s, d: _junk_of(_t(s, d, "part").select(F.struct("p_brand", "p_partkey").alias("book"), F.expr(_junk).alias("path"))).select(F.concat("book.p_brand", "book.p_partkey").alias("book"), "path", "kept"),
   f"SELECT p_brand || p_partkey AS book, {_junk} AS path, p_partkey % 4 = 0 OR p_partkey % 9 = 0 AS kept FROM part WHERE p_partkey % 6 < 4")
_q("unmovable_files", lambda s, d: outline.unmovable(_t(s, d, "part").selectExpr("p_brand AS book", "'d/n' || p_partkey || '.json' AS path", "p_partkey % 3 = 0 AS understood", "'load(\"../n' || (p_partkey + 25) || '.json\")' AS text")),
   """WITH f AS (SELECT p_brand AS book, 'd/n' || p_partkey || '.json' AS path, 'n' || p_partkey || '.json' AS base, p_partkey % 3 = 0 AS understood, 'n' || (p_partkey + 25) || '.json' AS said FROM part), m AS (SELECT a.book, a.path, b.path AS target FROM f a JOIN f b ON a.book = b.book AND a.said = b.base WHERE NOT a.understood)
SELECT book, path FROM m UNION SELECT book, target FROM m""")  # fmt: skip


def _relaid(spark, sf):
    lines = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    files = lines.selectExpr("l_orderkey AS book", "'Old/' || l_linenumber || '/0007-Chapter ' || (p % 3) || CASE WHEN l_linenumber % 2 = 0 THEN '.HTM' ELSE '.png' END AS path", "CASE WHEN l_linenumber = 7 THEN 'application/x-dtbncx+xml' WHEN l_linenumber % 2 = 0 THEN 'application/xhtml+xml' ELSE 'image/png' END AS media_type", "l_linenumber AS n")
    return outline.relaid(files, files.where("n % 4 = 0").select("book", "path", F.col("n").alias("ord")), files.where("n = 5").select("book", "path"))


_q("files_relaid", _relaid, """WITH l AS (SELECT l_orderkey AS book, l_linenumber AS n, min(l_partkey) % 3 AS c FROM lineitem GROUP BY 1, 2), f AS (SELECT book, n, 'Old/' || n || '/0007-Chapter ' || c || CASE WHEN n % 2 = 0 THEN '.HTM' ELSE '.png' END AS path,
  CASE WHEN n = 7 THEN 'OPS/toc.ncx' WHEN n % 4 = 0 THEN 'OPS/text/' || lpad(n::VARCHAR, 4, '0') || '-chapter-' || c || '.xhtml' WHEN n % 2 = 0 THEN 'OPS/text/chapter-' || c || '.xhtml' ELSE 'OPS/images/0007-chapter-' || c || '.png' END AS wish FROM l WHERE n <> 5),
k AS (SELECT *, row_number() OVER (PARTITION BY book, wish ORDER BY n % 4 <> 0, CASE WHEN n % 4 = 0 THEN n END, path) AS k FROM f) SELECT book, path, CASE WHEN k = 1 THEN wish ELSE regexp_replace(wish, '^(.*?)(\\.[^.]*)?$', '\\1-' || k || '\\2') END AS new_path FROM k""")  # fmt: skip
_q("spine_names", lambda s, d: outline.spine_names(_spine(s, d)).distinct(), f"WITH {SPINE_SQL} SELECT DISTINCT book, path, lpad(ord::VARCHAR, 4, '0') || '-' AS prefix FROM sp")
_q("foreign_files", lambda s, d: outline.foreign(_t(s, d, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_returnflag").alias("rendition"), F.concat(F.lit("f"), F.col("l_partkey") % 50).alias("path")), F.col("rendition") == "A"),
   "SELECT DISTINCT l_suppkey AS book, 'f' || l_partkey % 50 AS path FROM lineitem WHERE l_returnflag <> 'A' EXCEPT SELECT l_suppkey, 'f' || l_partkey % 50 FROM lineitem WHERE l_returnflag = 'A'")
_q("references_redirected", lambda s, d: outline.redirected(_t(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "'f' || (l_partkey % 40) AS path", "CASE WHEN l_suppkey % 2 = 0 THEN 'x' || (l_suppkey % 6) END AS fragment"), _t(s, d, "part").where("p_partkey <= 30").selectExpr("'f' || p_partkey AS path", "'g' || p_partkey AS new_path"), _t(s, d, "part").where("p_partkey <= 10").selectExpr("'f' || p_partkey AS path", "'x2' AS fragment", "'y' || p_partkey AS new_fragment")),
   "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 40 BETWEEN 0 AND 30 THEN 'g' ELSE 'f' END || l_partkey % 40 AS path, CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_suppkey % 6 = 2 AND l_partkey % 40 BETWEEN 0 AND 10 THEN 'y' || l_partkey % 40 ELSE 'x' || l_suppkey % 6 END END AS fragment FROM lineitem")

# --- gates -------------------------------------------------------------------------------------------------------------

_sizes = "'e' || l_linenumber || CASE l_linenumber % 3 WHEN 0 THEN '.XHTML' WHEN 1 THEN '.png' ELSE '.css' END"
_q("memory_gate", lambda s, d: gates.estimated(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.expr(_sizes).alias("name"), (F.col("l_partkey") * 100_000).alias("size"))).withColumn("fits", gates.fits(F.col("peak"), F.when(F.col("book") % 3 > 0, F.lit(500 << 20)), F.when(F.col("book") % 5 == 0, F.lit(100 << 20)))),
   f"""WITH b AS (SELECT l_orderkey AS book, coalesce(sum(l_partkey * 100000) FILTER (l_linenumber % 3 <> 1), 0)::BIGINT AS text_bytes, coalesce(sum(l_partkey * 100000) FILTER (l_linenumber % 3 = 1), 0)::BIGINT AS binary_bytes FROM lineitem GROUP BY 1),
p AS (SELECT *, floor(1.15::DOUBLE * ({40 << 20} + text_bytes * 4.6::DOUBLE + binary_bytes * 2.8::DOUBLE))::BIGINT AS peak FROM b) SELECT *, coalesce(peak <= coalesce(CASE WHEN book % 5 = 0 THEN {100 << 20} END, CASE WHEN book % 3 > 0 THEN floor({500 << 20} * 0.8::DOUBLE) END), true) AS fits FROM p""")  # fmt: skip
_q("over_budget", lambda s, d: gates.over_budget(_t(s, d, "lineitem").select(F.col("l_suppkey").alias("book"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("path"), (F.col("l_partkey") * 100_000).alias("bytes"), (F.col("l_quantity") * 25).cast("int").alias("depth"))),
   f"""SELECT l_suppkey AS book, l_orderkey || '-' || l_linenumber AS path, CASE WHEN l_partkey * 100000 > {64 << 20} THEN 'too large' ELSE 'too deep' END AS reason FROM lineitem WHERE l_partkey * 100000 > {64 << 20} OR (l_quantity * 25)::INTEGER > 1024
UNION ALL SELECT l_suppkey, NULL, 'too many files' FROM lineitem GROUP BY 1 HAVING count(*) > 20000""")  # fmt: skip
_q("book_fingerprints", lambda s, d: gates.fingerprint(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.concat(F.lit("f"), "l_linenumber").alias("path"), F.col("l_partkey").cast("string").alias("digest"))),
   "SELECT l_orderkey AS book, sha256(string_agg('f' || l_linenumber || ' ' || l_partkey, chr(10) ORDER BY 'f' || l_linenumber, l_partkey::VARCHAR)) AS digest FROM lineitem GROUP BY 1")
_q("text_gate", lambda s, d: gates.text_gate(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.when(F.col("l_partkey") % 9 == 0, F.col("l_partkey")).otherwise(-1).alias("lost_at")), _t(s, d, "orders").select(F.col("o_orderkey").alias("book"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'hyphens.joined' WHEN 1 THEN 'xhtml.watermark-consolidated' ELSE 'nav.x' END").alias("rule"))),
   "SELECT l_orderkey AS book, CASE WHEN NOT bool_or(l_partkey % 9 = 0) THEN 'passed' WHEN l_orderkey % 3 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) THEN 'consented' ELSE 'refused' END AS verdict FROM lineitem GROUP BY 1")


def _published(mode):
    def run(spark, sf):
        lines = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_returnflag").alias("shape"), "l_shipdate", F.col("l_linenumber").alias("n"))
        sides = [lines.where(f"n % 2 = {k}").groupBy("book", "shape").agg(F.count("*").alias("n")) for k in (0, 1)]
        return gates.publication_gate(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("book"), (F.col("o_orderkey") % 5 > 0).alias("checked")), *sides, mode)

    return run


_shapes = "x AS (SELECT l_orderkey AS book, l_returnflag AS shape, count(*) FILTER (l_linenumber % 2 = 1) AS a, count(*) FILTER (l_linenumber % 2 = 0) AS b FROM lineitem GROUP BY 1, 2)"
for _mode, _more, _bare in (("clean", "sum(a)", "true"), ("no-new-errors", "sum(CASE WHEN a > b THEN a ELSE 0 END)", "false")):
    _q(f"publication_gate_{_mode.split('-')[0]}", _published(_mode),
       f"WITH {_shapes}, c AS (SELECT book, {_more} AS n FROM x GROUP BY 1) SELECT o_orderkey AS book, CASE WHEN o_orderkey % 5 > 0 THEN coalesce(n, 0) ELSE 0 END::BIGINT AS introduced, CASE WHEN CASE WHEN o_orderkey % 5 > 0 THEN coalesce(n, 0) > 0 ELSE {_bare} END THEN 'refused' ELSE 'published' END AS verdict FROM orders LEFT JOIN c ON book = o_orderkey")
_lost = "'d/x' || l_linenumber || CASE l_linenumber % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.TTF' WHEN 2 THEN '.mp3' ELSE '.what' END"
_q("losses_diagnosed", lambda s, d: gates.diagnosed(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.expr(_lost).alias("name")), _t(s, d, "lineitem").where("l_partkey % 2 = 0").select(F.col("l_orderkey").alias("book"), F.expr(_lost).alias("name")), _t(s, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_partkey").alias("document"), F.expr("substr(" + _lost.replace("l_linenumber", "(l_linenumber + 1)") + ", 3)").alias("word"))),
   f"""WITH l AS (SELECT l_orderkey AS book, {_lost} AS name, l_linenumber AS n, l_partkey FROM lineitem), m AS (SELECT book, n + 1 AS n, count(DISTINCT l_partkey) AS c FROM l GROUP BY 1, 2)
SELECT l.book, l.name, CASE l.n % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'font' WHEN 2 THEN 'audio' ELSE 'unknown' END AS kind, EXISTS (SELECT 1 FROM l b WHERE b.book = l.book AND b.name = l.name AND b.l_partkey % 2 = 0) AS declared, coalesce(c, 0) AS referenced FROM l LEFT JOIN m ON m.book = l.book AND m.n = l.n""")  # fmt: skip
_q("verdicts_reused", lambda s, d: gates.reused(_t(s, d, "orders").select(F.col("o_orderkey").alias("book"), (F.col("o_custkey") % 40).alias("digest"), F.col("o_orderstatus").alias("checker")), _t(s, d, "lineitem").where("l_linenumber = 1 AND l_suppkey % 3 = 0").select((F.col("l_partkey") % 60).alias("digest"), F.col("l_linestatus").alias("checker"), F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("verdict"))),
   "WITH v AS (SELECT l_partkey % 60 AS digest, l_linestatus AS checker, arg_max(l_returnflag, l_orderkey) AS verdict FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 3 = 0 GROUP BY 1, 2) SELECT o_orderkey AS book, o_custkey % 40 AS digest, o_orderstatus AS checker, verdict FROM orders LEFT JOIN v ON v.digest = o_custkey % 40 AND checker = o_orderstatus")
_q("batch_planned", lambda s, d: gates.planned(_t(s, d, "part").selectExpr("'in/' || p_partkey AS source", "CASE WHEN p_partkey % 10 = 0 THEN 'in/' || p_partkey WHEN p_partkey % 10 = 1 THEN 'out/same' || (p_partkey % 30) ELSE 'out/' || p_partkey END AS destination"), _t(s, d, "part").where("p_partkey % 4 = 2").selectExpr("'out/' || p_partkey AS path")),
   "WITH j AS (SELECT p_partkey, 'in/' || p_partkey AS source, CASE WHEN p_partkey % 10 = 0 THEN 'in/' || p_partkey WHEN p_partkey % 10 = 1 THEN 'out/same' || (p_partkey % 30) ELSE 'out/' || p_partkey END AS destination FROM part) SELECT source, destination, CASE WHEN p_partkey % 10 = 0 THEN 'itself' WHEN p_partkey % 10 = 1 AND count(*) OVER (PARTITION BY destination) > 1 THEN 'collision' WHEN p_partkey % 10 > 1 AND p_partkey % 4 = 2 THEN 'occupied' END AS problem FROM j")
_q("layouts_settled", lambda s, d: _t(s, d, "part").select("p_partkey", gates.settled_layout(F.expr("CASE p_partkey % 4 WHEN 0 THEN 'content.opf' WHEN 1 THEN 'a/b/book.opf' WHEN 2 THEN 'a/../b.opf' ELSE 'x y.opf' END"), F.col("p_size") % 3 == 0).alias("l")).select("p_partkey", "l.folder", "l.name"),
   "SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_partkey % 4 > 1 THEN 'OPS' WHEN p_partkey % 4 = 0 THEN '' ELSE 'a/b' END AS folder, CASE WHEN p_size % 3 = 0 OR p_partkey % 4 > 1 THEN 'package.opf' WHEN p_partkey % 4 = 0 THEN 'content.opf' ELSE 'book.opf' END AS name FROM part")

# --- reports -----------------------------------------------------------------------------------------------------------

LEVEL_RULE = "CASE event_id % 11 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' WHEN 2 THEN 'WARN' WHEN 3 THEN 'PRESERVED' WHEN 4 THEN 'FIX' ELSE 'INFO' END"
_findings = lambda s, d: _t(s, d, "events").select(F.col("user_id").alias("book"), F.expr(LEVEL_RULE).alias("level"), F.col("event_type").alias("stage"), F.concat(F.lit("m"), "event_id").alias("message"))
FOUND_SQL = f"f AS (SELECT user_id AS book, {LEVEL_RULE} AS level, event_type AS stage, 'm' || event_id AS message FROM events), r AS (SELECT *, list_position({reports.LEVELS!r}, level) AS rank FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY rank, stage, message) AS place FROM r)"
_per = ", ".join(f"count(*) FILTER (level = '{v}') AS {v.lower()}" for v in reports.LEVELS)
_q("report_counts", lambda s, d: reports.counts(_findings(s, d)), f"WITH {FOUND_SQL} SELECT book, {_per}, count(*) FILTER (level = 'ERROR') = 0 AS ok FROM f GROUP BY 1")
_q("findings_ordered", lambda s, d: reports.ordered(_findings(s, d)), f"WITH {FOUND_SQL} SELECT book, level, stage, message, place::INTEGER AS place FROM o")
_q("books_worst_first", lambda s, d: reports.worst_first(reports.counts(_findings(s, d)).withColumnRenamed("book", "source")).select("source", "ok", "error", "warn").limit(25),
   f"WITH {FOUND_SQL}, c AS (SELECT book AS source, count(*) FILTER (level = 'ERROR') = 0 AS ok, count(*) FILTER (level = 'ERROR') AS error, count(*) FILTER (level = 'WARN') AS warn FROM f GROUP BY 1) SELECT * FROM c ORDER BY ok, error DESC, warn DESC, source LIMIT 25")
_results = "SELECT o_orderpriority AS run, o_custkey AS book, o_orderkey % 4 AS errors, CASE WHEN o_orderpriority LIKE '5%' AND o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 3 END AS before, o_orderkey % 50 = 0 AS fatal, o_orderkey % 40 = 1 AS lost, o_orderkey % 30 > 0 AS written FROM orders"


def _totals(spark, sf):
    o = _t(spark, sf, "orders").selectExpr("o_orderpriority AS run", "o_custkey AS book", "o_orderkey % 4 AS errors", "CASE WHEN o_orderpriority LIKE '5%' AND o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 3 END AS before", "CAST(o_orderkey % 50 = 0 AS INT) AS fatal", "o_orderkey % 40 = 1 AS lost", "o_orderkey % 30 > 0 AS written")
    return reports.run_totals(o)


_q("run_totals", _totals, f"""WITH r AS ({_results}), s AS (SELECT *, row_number() OVER (PARTITION BY run, book ORDER BY errors DESC, before DESC NULLS LAST, fatal DESC, lost DESC, written DESC) AS k FROM r), t AS (SELECT run, count(*) AS books, sum(errors)::BIGINT AS errors,
  CASE WHEN count(*) FILTER (before IS NULL) = 0 THEN sum(greatest(errors - before, 0)) END::BIGINT AS introduced, CASE WHEN count(*) FILTER (before IS NULL) = 0 THEN sum(least(errors, before)) END::BIGINT AS carried, sum(fatal::INTEGER)::BIGINT AS fatal, count(*) FILTER (lost) AS lost, count(*) FILTER (NOT written) AS unwritten FROM s WHERE k = 1 GROUP BY 1)
SELECT *, coalesce(introduced, errors) = 0 AND fatal = 0 AND lost = 0 AND unwritten = 0 AS clean FROM t""")  # fmt: skip
_q("releases", lambda s, d: reports.releases(_t(s, d, "orders").select(F.col("o_orderpriority").alias("version"))), "SELECT o_orderpriority AS version, count(*) AS runs FROM orders GROUP BY 1")
_q("archive_health", lambda s, d: reports.health(registry._scanned(s, d)), "SELECT (page_id // 100)::VARCHAR AS book, count(*) AS entries, 0::BIGINT AS damaged, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1")
_q("ledger_lines", lambda s, d: reports.ledger_lines(_t(s, d, "events").select(F.col("user_id").alias("book"), F.lit("style").alias("stage"), F.col("event_type").alias("action"), F.concat(F.lit("s"), "event_id").alias("subject"), F.when(F.col("value") > 80, "content").otherwise("none").alias("risk"), (F.col("event_id") % 7 > 0).alias("reversible"))),
   "SELECT user_id AS book, 'style: ' || event_type || ' s' || event_id || ' [' || CASE WHEN value > 80 THEN 'content' ELSE 'none' END || ']' || CASE WHEN event_id % 7 > 0 THEN '' ELSE ' (for good)' END AS line FROM events WHERE value > 80 OR event_id % 7 = 0")
_q("reports_json", lambda s, d: reports.as_json(_findings(s, d)),
   f"""WITH {FOUND_SQL} SELECT book, '{{"schema":4,"ok":' || CASE WHEN count(*) FILTER (level = 'ERROR') = 0 THEN 'true' ELSE 'false' END || ',"summary":{{' || {" || ',' || ".join(f"'{chr(34)}{v.lower()}{chr(34)}:' || count(*) FILTER (level = '{v}')" for v in reports.LEVELS)} || '}},"findings":[' || string_agg('{{"level":"' || level || '","stage":"' || stage || '","message":"' || message || '"}}', ',' ORDER BY place) || ']}}' AS json FROM o GROUP BY book""")
_q("reports_text", lambda s, d: reports.as_text(_findings(s, d)),
   f"""WITH {FOUND_SQL}, h AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY book ORDER BY place) THEN '[' || level || ']' || chr(10) ELSE '' END || '  - ' || stage || ': ' || message AS line FROM o) SELECT book, string_agg(line, chr(10) ORDER BY place) AS text FROM h GROUP BY book""")

# --- evidence ----------------------------------------------------------------------------------------------------------

#: Pages dressed with what they lack.
DRESS = """CASE page_id % 4 WHEN 0 THEN '<p class="c12 note"><img src="a/b.png" alt=""/><img src="x/plan.png" alt="plan"/><span>„tak”… a - b</span></p><table><tr><td>1</td></tr></table>'
 WHEN 1 THEN '<h1>x</h1><h3>y</h3><img src="q.png"/><img role="presentation" src="z.png"/><p style="font-size:1px">Ab3dEfGh1jK</p><svg></svg><p align="left"> </p>' WHEN 2 THEN '<p>This copy was licensed to Jan 12</p><span class="calibre3"><span lang="pl">ą... krót- ki</span></span><div style="page-break-before: always; font-size: 12pt">x</div>'
 ELSE '<table><th>a</th></table><nav>n</nav><video src="v"></video><img alt="A tree by a river" src="t.jpg"/>' END"""
_dressed = lambda s, d: _t(s, d, "pages").select((F.col("page_id") % 13).alias("book"), F.concat("html", F.expr(DRESS)).alias("html"))
_n = lambda p, x="h": f"len(regexp_extract_all({x}, {_s(p)}))"
_tags = lambda name: f"regexp_extract_all(h, '(?is)<{name}(?:\\s[^>]*)?>')"
_attr = lambda x, name: f"regexp_extract({x}, '(?is)\\s{name}\\s*=\\s*\"([^\"]*)\"', 1)"
_bare = f"trim({_attr('x', 'alt')}) = ''"
_deco = f"(lower({_attr('x', 'role')}) = 'presentation' OR lower({_attr('x', 'aria-hidden')}) = 'true')"
_named = f"(regexp_full_match(lower(trim({_attr('x', 'alt')})), '{'|'.join(markup.PLACEHOLDERS)}|[a-z0-9._-]+\\.(jpg|jpeg|png|gif|svg|webp)|[a-z]{{1,12}}[\\s._-]*[0-9]{{1,3}}') OR lower(trim({_attr('x', 'alt')})) = lower(nullif(regexp_replace(regexp_extract({_attr('x', 'src')}, '[^/]*$'), '\\.[^.]*$', ''), '')))"
HTML_SQL = f"p AS (SELECT page_id % 13 AS book, html || {DRESS} AS h FROM pages)"
_imgs = lambda test: f"len(list_filter({_tags('img')}, lambda x: {test}))"
SURVEY_SQL = f"""{HTML_SQL}, l AS (SELECT *, list_transform(regexp_extract_all(h, '(?i)<h([1-6])[\\s>]', 1), lambda x: x::INTEGER) AS lv, regexp_extract_all(h, '(?is)<table[\\s>].*?</table>') AS tb FROM p),
survey AS (SELECT book, count(*) AS documents, sum(len({_tags('img')}))::BIGINT AS images, sum({_imgs(f"{_bare} AND NOT {_deco}")})::BIGINT AS undescribed, sum({_imgs(f"{_bare} AND {_deco}")})::BIGINT AS decorative, sum({_imgs(f"NOT {_bare} AND coalesce({_named}, false)")})::BIGINT AS placeholders,
  sum(len(lv))::BIGINT AS headings, sum(len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] > lv[i - 1] + 1)))::BIGINT AS leaps, sum(len(tb))::BIGINT AS tables, sum(len(list_filter(tb, lambda x: NOT regexp_matches(x, '(?i)<th[\\s>]'))))::BIGINT AS headless, sum(len({_tags('svg')}))::BIGINT AS drawings,
  bool_or(regexp_matches(h, '(?i)<math[\\s>]')) AS mathml, bool_or(regexp_matches(h, '(?i)<script[\\s>]')) AS scripted, bool_or(regexp_matches(h, '(?i)<audio[\\s>]')) AS audio, bool_or(regexp_matches(h, '(?i)<video[\\s>]')) AS video, bool_or(regexp_matches(h, '(?i)(animation|transition)(-[a-z-]+)?\\s*:')) AS motion FROM l GROUP BY book)"""
_survey = lambda s, d: evidence.accessibility(_dressed(s, d), "book")
_q("accessibility_survey", _survey, f"WITH {SURVEY_SQL} SELECT * FROM survey")
_q("accessibility_claims", lambda s, d: evidence.declared(_survey(s, d), "book"),
   f"""WITH {SURVEY_SQL}, c AS (SELECT *, images > 0 OR drawings > 0 AS pictures, undescribed + placeholders + drawings AS bare FROM survey)
SELECT book, concat_ws(',', CASE WHEN audio THEN 'auditory' END, 'textual', CASE WHEN pictures THEN 'visual' END) AS modes, CASE WHEN NOT pictures OR bare = 0 THEN 'textual' ELSE 'textual,visual' END AS sufficient,
  concat_ws(',', CASE WHEN mathml THEN 'MathML' END, CASE WHEN pictures AND bare = 0 THEN 'alternativeText' END, 'displayTransformability', 'readingOrder', CASE WHEN headings > 0 THEN 'structuralNavigation' END, 'tableOfContents') AS features, CASE WHEN video OR scripted OR motion THEN 'unknown' ELSE 'none' END AS hazards FROM c""")  # fmt: skip
_q("accessibility_gaps", lambda s, d: evidence.gaps(_survey(s, d), "book"), f"WITH {SURVEY_SQL}, g AS (SELECT book, unnest(['undescribed', 'placeholders', 'leaps', 'headless']) AS gap, unnest([undescribed, placeholders, leaps, headless]) AS n FROM survey) SELECT * FROM g WHERE n > 0")
_visible = " OR ".join(f"contains(lower(t), {_s(p)})" for p in markup.VISIBLE)
_q("watermark_marks", lambda s, d: evidence.marks(_dressed(s, d), "book"),
   f"""WITH {HTML_SQL}, l AS (SELECT book, unnest(regexp_extract_all(h, '(?s)<[a-zA-Z][a-zA-Z0-9]*[^>]*>[^<>]{{1,400}}</')) AS x FROM p), t AS (SELECT book, x, trim(regexp_extract(x, '(?s)>([^<>]*)</$', 1)) AS t FROM l),
m AS (SELECT book, {_visible} AS notice, regexp_full_match(t, '[A-Za-z0-9+/=_-]{{10,120}}') AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]') AND contains(x, 'font-size:1px') AS token FROM t WHERE t <> '')
SELECT book, count(*) FILTER (notice) AS notices, count(*) FILTER (NOT notice AND token) AS tokens FROM m GROUP BY 1""")  # fmt: skip
_media = lambda s, d, w: _t(s, d, "lineitem").where(w).select(F.col("l_suppkey").alias("book"), F.sha2((F.col("l_partkey") % 90).cast("string"), 256).alias("digest"), F.concat(F.lit("i"), "l_partkey").alias("name"))
_q("media_lost", lambda s, d: evidence.media_survive(_media(s, d, "l_linenumber <= 4"), _media(s, d, "l_linenumber > 4")),
   "SELECT l_suppkey AS book, sha256((l_partkey % 90)::VARCHAR) AS digest, min('i' || l_partkey) AS name FROM lineitem l WHERE l_linenumber <= 4 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linenumber > 4 AND b.l_suppkey = l.l_suppkey AND b.l_partkey % 90 = l.l_partkey % 90) GROUP BY l_suppkey, l_partkey % 90")
_q("shapes_lost", lambda s, d: (lambda e: evidence.shapes_survive(e, e.where("event_id % 16 > 0").select("book", "tag")))(_t(s, d, "events").select(F.col("user_id").alias("book"), F.col("event_type").alias("tag"), "event_id")),
   "SELECT user_id AS book, event_type AS tag, count(*) AS was, count(*) FILTER (event_id % 16 > 0) AS now FROM events GROUP BY 1, 2 HAVING count(*) FILTER (event_id % 16 > 0) < count(*) * 0.95::DOUBLE")
_rules = "CASE o_orderkey % 3 WHEN 0 THEN 'color' WHEN 1 THEN 'cursor' ELSE 'float' END"
_styled = lambda s, d, v: _t(s, d, "orders").select(F.col("o_custkey").alias("book"), F.lit("p").alias("tag"), F.concat(F.lit(" Order "), F.col("o_orderkey") % 5, F.lit("\n of "), "o_orderpriority").alias("text"), F.expr(_rules).alias("prop"), F.expr(v).alias("value"), "o_orderkey")
_q("styles_lost", lambda s, d: evidence.styles_survive(_styled(s, d, "o_orderstatus"), _styled(s, d, "CASE WHEN o_custkey % 4 = 0 THEN lower(o_orderstatus) ELSE 'x' END").where("o_orderkey % 7 > 0")),
   f"""WITH e AS (SELECT o_custkey AS book, 'p' AS tag, left('Order ' || o_orderkey % 5 || ' of ' || o_orderpriority, 40) AS opening, {_rules} AS prop, o_orderstatus AS v, CASE WHEN o_custkey % 4 = 0 THEN lower(o_orderstatus) ELSE 'x' END AS w, o_orderkey % 7 > 0 AS kept FROM orders),
b AS (SELECT book, tag, opening, prop, max(v) AS was FROM e WHERE prop <> 'cursor' GROUP BY ALL), a AS (SELECT book, tag, opening, prop, max(w) AS now FROM e WHERE kept AND prop <> 'cursor' GROUP BY ALL), k AS (SELECT DISTINCT book, tag, opening FROM e WHERE kept)
SELECT b.*, a.now FROM b SEMI JOIN k USING (book, tag, opening) LEFT JOIN a USING (book, tag, opening, prop) WHERE lower(was) IS DISTINCT FROM lower(now)""")  # fmt: skip
_words = lambda s, d: _t(s, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("book"), F.posexplode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("at", "word"), "doc_id")
_q("words_missing", lambda s, d: (lambda w: evidence.missing_words(w.withColumn("at", F.struct("doc_id", "at")), w.where("doc_id % 3 > 0")))(_words(s, d)).groupBy("book").agg(F.count("*").alias("missing"), F.min_by("word", F.struct("at", "word")).alias("first")),
   """WITH w AS MATERIALIZED (SELECT source, doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i FROM (SELECT source, doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS x FROM documents WHERE source IS NOT NULL)),
k AS (SELECT DISTINCT source, word FROM w WHERE doc_id % 3 > 0), f AS (SELECT source, word, min((doc_id, i)) AS place FROM w ANTI JOIN k USING (source, word) GROUP BY 1, 2) SELECT source AS book, count(*) AS missing, arg_min(word, (place, word)) AS first FROM f GROUP BY 1""")  # fmt: skip
_order = lambda s, d, o: _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("book"), "l_linenumber").agg(F.concat(F.lit("Part "), F.col("l_linenumber"), F.lit(" begins")).alias("opening")).withColumn("ord", F.expr(o))
_q("reading_orders", lambda s, d: evidence.order_survives(_order(s, d, "l_linenumber"), _order(s, d, "CASE WHEN book % 3 = 0 AND l_linenumber = 1 THEN 99 ELSE l_linenumber END").where("book % 5 > 0 OR l_linenumber <> 2")),
   "SELECT l_orderkey AS book, CASE WHEN l_orderkey % 3 = 0 AND bool_or(l_linenumber = 1) THEN count(DISTINCT l_linenumber) FILTER (l_linenumber > 1) WHEN l_orderkey % 5 = 0 AND bool_or(l_linenumber = 2) THEN 1 ELSE 0 END::INTEGER AS out_of_order FROM lineitem GROUP BY 1")
_q("spines_aligned", lambda s, d: evidence.aligned(_order(s, d, "l_linenumber"), _order(s, d, "l_linenumber + 10").where("l_linenumber <> 3 OR book % 2 = 0")),
   "SELECT DISTINCT l_orderkey::VARCHAR AS book, l_linenumber::BIGINT AS before_ord, (l_linenumber + 10)::BIGINT AS after_ord FROM lineitem WHERE l_linenumber <> 3 OR l_orderkey % 2 = 0")
_plain = "trim(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<(script|style|title)[\\s>].*?</(script|style|title)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_counts = {
    "blocks": _n("(?i)<(p|div|h[1-6]|li|blockquote|td|th)[\\s>]"), "empty_paragraphs": _n("(?i)<p(\\s[^>]*)?>\\s*</p>"), "images": f"len({_tags('img')})", "images_without_alt": _imgs("NOT regexp_matches(x, '(?is)\\salt\\s*=\\s*\"[^\"]*\"')"),
    "images_empty_alt": _imgs("regexp_matches(x, '(?is)\\salt\\s*=\\s*\"\\s*\"')"), "image_pages": f"CASE WHEN len({_tags('img')}) > 0 AND length(t) < 40 THEN 1 ELSE 0 END", "spans": f"len({_tags('span')})",
    "bare_spans": f"len(list_filter({_tags('span')}, lambda x: NOT regexp_matches(x, '(?i)\\s(id|lang|role|aria-hidden|epub:type)\\s*=')))", "nested_spans": _n("(?i)<span[^>]*>\\s*<span[\\s>]"), "inline_styles": _n('(?i)\\sstyle="'), "presentational_attributes": _n('(?i)\\s(align|bgcolor|face|valign|border)="'),
    "absolute_font_sizes": _n("(?i)font-size\\s*:\\s*[\\d.]+(px|pt)"), "forced_page_breaks": _n("(?i)page-break-(before|after)\\s*:\\s*always"), "links": _n("(?i)<a\\s[^>]*href="), "tables": _n("(?i)<table[\\s>]"), "headings": _n("(?i)<h[1-6][\\s>]"), "scripts": _n("(?i)<script[\\s>]"), "breaks": _n("(?i)<(br)[\\s/>]"),
    "characters": "length(t)", "ellipses": _n("…", "t"), "ellipsis_dots": _n("\\.\\.\\.", "t"), "bound_spaces": _n(" ", "t"), "soft_hyphens": _n("­", "t"), "zero_width": _n("​", "t"), "dashes": _n("[–—]", "t"), "straight_quotes": _n('"', "t"), "curly_quotes": _n("[„“”«»]", "t"),
    "polish_letters": f"length(t) - length(translate(t, '{tx.POLISH}', ''))", "misread": f"length(t) - length(translate(t, {registry._chars(tx.C1_FROM)}, ''))", "broken_hyphens": _n("\\p{L}- \\p{Ll}", "t"), "emails": _n(tx.EMAIL, "t"),
}
_q("page_inventory", lambda s, d: evidence.inventory(_dressed(s, d), "book"),
   f"""WITH {HTML_SQL}, x AS (SELECT book, h, {_plain} AS t FROM p), f AS (SELECT book, count(*) AS documents, sum(strlen(h))::BIGINT AS bytes, {", ".join(f"sum({e})::BIGINT AS {c}" for c, e in _counts.items())}, count(*) FILTER ({_visible}) AS with_notice, count(*) FILTER (regexp_matches(h, '(?i)isbn')) AS with_isbn,
  bool_or(regexp_matches(h, '(?i)<nav[\\s>]')) AS has_nav, bool_or(regexp_matches(h, '(?i)dir\\s*=\\s*.rtl')) AS rtl FROM x GROUP BY book),
c AS (SELECT DISTINCT book, unnest(regexp_split_to_array(v, '\\s+')) AS name FROM (SELECT book, unnest(regexp_extract_all(h, '(?i)\\sclass="([^"]*)"', 1)) AS v FROM p)), n AS (SELECT book, count(*) FILTER (name <> '') AS distinct_classes, count(*) FILTER (regexp_full_match(name, '(?i)(c|p|s|t|x|calibre|class|style|para|span|sgc-?)_?-?\\d+')) AS meaningless_classes FROM c GROUP BY 1)
SELECT f.*, coalesce(distinct_classes, 0) AS distinct_classes, coalesce(meaningless_classes, 0) AS meaningless_classes, CASE WHEN blocks > 0 THEN round(spans / blocks, 2) ELSE 0 END AS spans_per_block, CASE WHEN blocks > 0 THEN round(100.0::DOUBLE * coalesce(distinct_classes, 0) / blocks, 1) ELSE 0 END AS classes_per_100_blocks,
  CASE WHEN characters > 0 THEN round(1000.0::DOUBLE * polish_letters / characters, 2) ELSE 0 END AS polish_per_1000, documents > 0 AND image_pages >= 2 AND characters < 40 * documents AS comic FROM f LEFT JOIN n USING (book)""")  # fmt: skip


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
