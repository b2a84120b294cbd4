"""Queries of the library's own operators over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import compare, library, references
from vellum.plans import books
from vellum.sources import archives, elements
from vellum.streaming import ledger


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _str(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _chars(x: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in x)


NOTICE_SQL = "(" + " OR ".join(f"contains(lower(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), {_str(p)})" for p in tx.NOTICES) + ")"
CANON_SQL = f"trim(regexp_replace(regexp_replace(translate(replace({{x}}, '...', '…'), {_chars(tx.FOLD_FROM)}, {_chars(tx.FOLD_TO)}), '[' || {_chars(tx.INVISIBLE[1:-1])} || ']', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
#: Text with typographic damage put in by a rule, since the tables have none.
WORN = "CASE doc_id % 4 WHEN 0 THEN replace(text, ' the ', ' „the” ') WHEN 1 THEN replace(text, '. ', '... ') WHEN 2 THEN replace(text, ' de ', chr(160) || 'de ') ELSE replace(text, ', ', chr(8203) || ' — ') END"


def _worn(docs: DataFrame) -> DataFrame:
    return docs.withColumn("worn", F.expr(WORN.replace("chr(8203)", "'\u200b'").replace("chr(160)", "'\u00a0'")))


#: Text with hyphens as a converter leaves them, and with opaque marks, put in by a rule as well.
BROKEN = "CASE WHEN doc_id % 3 = 0 THEN replace(text, 'tion ', '-tion ') ELSE text END"
MARKED = "CASE WHEN doc_id % 5 = 0 THEN text || ' ' || substr(md5(text), 1, 16) ELSE text END"


def _broken(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.expr(BROKEN))


#: Up to `named`: candidates with their confidence.
HYPHENS_SQL = f"WITH documents AS (SELECT source, {BROKEN} AS text FROM main.documents), " + """pairs AS (SELECT source, p, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+-[\\p{L}\\p{N}]+')) AS p FROM documents) GROUP BY 1, 2),
halves AS (SELECT source, n, string_split(p, '-')[1] AS l, string_split(p, '-')[2] AS r FROM pairs),
kept AS MATERIALIZED (SELECT source, lower(l) AS lhs, lower(r) AS rhs, sum(n)::BIGINT AS n FROM halves WHERE NOT (regexp_matches(l || r, '\\p{N}') OR substr(r, 1, 1) <> lower(substr(r, 1, 1)) OR (l = upper(l) AND l <> lower(l)) OR length(l) = 1 OR length(r) = 1 OR lower(l) = lower(r)) GROUP BY 1, 2, 3),
words AS MATERIALIZED (SELECT source, word, count(*) AS c FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents) GROUP BY 1, 2),
cand AS MATERIALIZED (SELECT k.source, lhs, rhs, n, coalesce(j.c, 0) AS joined, greatest(coalesce(a.c, 0) - n, 0) AS alone FROM kept k LEFT JOIN words j ON j.source = k.source AND j.word = lhs || rhs LEFT JOIN words a ON a.source = k.source AND a.word = lhs),
named AS (SELECT *, CASE WHEN joined >= 1 THEN 'confirmed' WHEN n > 3 THEN 'kept' WHEN alone = 0 THEN 'likely' ELSE 'uncertain' END AS confidence FROM cand) """


MARKS = [("quill", "the", 0.4), ("quill", "and", 0.3), ("quill", " la ", 0.6), ("press", " der ", 0.7), ("press", " und ", 0.5), ("press", " que ", 0.2), ("binder", "###", 0.45), ("binder", " | ", 0.35), ("binder", "$$$", 0.45)]
QUOTAS = [("long", 30), ("short", 400), ("digits", 20), ("polish", 200), ("notice", 50), ("junk", 90), ("never", 5)]


def _findings(spark, sf):
    docs = _t(spark, sf, "documents").where("text IS NOT NULL")
    tests = {"notice": tx.has_notice(F.col("text")), "mail": F.size(tx.emails(F.col("text"))) > 0, "junk": F.contains("text", F.lit("***")), "table": F.contains("text", F.lit(" | ")), "short": F.length("text") < 100, "long": F.length("text") > 8000}
    return library.families(docs.select("source", "text"), "source", tests).select(F.col("source").alias("book"), F.when(F.col("family").isin("notice", "mail"), "rights").otherwise("shape").alias("stage"), F.when(F.col("family") == "mail", "ERROR").otherwise("INFO").alias("level"), F.col("family").alias("rule"))


FINDINGS_SQL = f"""SELECT source AS book, CASE WHEN rule IN ('notice', 'mail') THEN 'rights' ELSE 'shape' END AS stage, CASE WHEN rule = 'mail' THEN 'ERROR' ELSE 'INFO' END AS level, rule FROM (
  SELECT source, unnest(list_filter([CASE WHEN {NOTICE_SQL} THEN 'notice' END, CASE WHEN regexp_matches(text, {_str(tx.EMAIL)}) THEN 'mail' END, CASE WHEN contains(text, '***') THEN 'junk' END,
    CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN length(text) > 8000 THEN 'long' END], lambda x: x IS NOT NULL)) AS rule FROM documents WHERE text IS NOT NULL)"""


def _coverage(spark, sf):
    t = F.col("text")
    tests = {"long": F.length(t) > 8000, "short": F.length(t) < 1000, "digits": F.rlike(t, F.lit("[0-9]{3}")), "polish": tx.looks_polish(t), "notice": tx.has_notice(t), "junk": F.contains(t, F.lit("***"))}
    return library.coverage(library.families(_t(spark, sf, "documents"), "doc_id", tests), spark.createDataFrame(QUOTAS, "family string, want long"))


def _traces(spark, sf):
    docs = _t(spark, sf, "documents")
    held = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(p)), F.struct(F.lit(t).alias("tool"), F.lit(p).alias("pattern"), F.lit(w).alias("weight"))) for t, p, w in MARKS]))
    return library.noisy_or(docs.select("doc_id", F.explode(held).alias("m")).select("doc_id", "m.tool", "m.pattern", "m.weight"), ["doc_id", "tool"])


def _graph(spark, sf):
    lines = _t(spark, sf, "lineitem")
    part, supp = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    return lines.select(part.alias("src"), supp.alias("dst")).union(lines.where("l_linenumber = 7 AND l_partkey % 3 > 0").select(supp, part)).distinct()


GRAPH_SQL = """l AS (SELECT 'p' || l_partkey AS p, 's' || l_suppkey AS s, l_linenumber AS n FROM lineitem),
edges AS MATERIALIZED (SELECT p AS src, s AS dst FROM l UNION SELECT s, p FROM l WHERE n = 7 AND substr(p, 2)::INTEGER % 3 > 0),
reached AS (SELECT DISTINCT src AS node FROM edges WHERE src LIKE 'p1%' AND length(src) <= 3 UNION SELECT dst FROM reached JOIN edges ON src = node)"""


def _reached(spark, sf):
    return _reached_of(references._cut(_graph(spark, sf)))


def _reached_of(edges):
    return references.reachable(edges, edges.where("src LIKE 'p1%' AND length(src) <= 3").select(F.col("src").alias("node")))


def _orphans(spark, sf):
    edges = references._cut(_graph(spark, sf))  # made once for its nodes and for every round
    return references.orphans(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), _reached_of(edges))


def _links(spark, sf):
    links = references.edges(_t(spark, sf, "pages"))
    return links.select("page_id", "href", references.site_path(F.col("url")).alias("from_path"), tx.resolve(references.site_path(F.col("url")), F.col("href")).alias("target"))


def _balance(spark, sf):
    docs = _t(spark, sf, "documents").select("source", "doc_id", F.length("text").alias("n"))
    kept, gone = docs.where("doc_id % 7 <> 3"), docs.where("doc_id % 7 = 3 AND doc_id % 2 = 0")
    return compare.balance(*[d.select(F.col("source").alias("category"), "n") for d in (docs, kept, gone)])


def _runs(spark, sf):
    """A ledger derived from the conversations: a run each, wider as they are longer."""
    c = _t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("run")).agg(F.count("*").alias("books"), F.countDistinct("role").alias("modes"), (F.sum(F.length("text")) % 5 > 0).alias("clean"))
    return compare.run_ledger(c.withColumn("version", F.concat(F.lit("v"), F.floor(F.col("run") / 2).cast("string"))))


def _signatures(spark, sf):
    d = _t(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("value"))
    path = F.concat_ws("/", "source", "lang")
    new = _t(spark, sf, "documents").where("doc_id % 50 <> 1").groupBy("source", "lang").agg(F.count("*").alias("value"))
    return compare.signature_diff(d.select(path.alias("path"), "value"), new.where("lang <> 'es' OR value > 4").select(path.alias("path"), "value"))


def _changes(spark, sf):
    c = _t(spark, sf, "events").select("event_type", (F.col("value") > 50).alias("big"), F.col("user_id"))
    return compare.change_summary(c.select(F.col("event_type").alias("action"), F.when(F.col("big"), "content").otherwise("none").alias("risk"), (F.col("user_id") % 3 != 0).alias("reversible")))


def _merge(spark, sf):
    p = _t(spark, sf, "pages")
    return compare.merge_plan(p.select(references.site_path(F.col("url")).alias("name"), F.col("page_id").alias("copy"), F.sha2("html", 256).alias("digest"), (F.col("page_id") % 5 != 2).alias("ok")))


def _parts(spark, sf):
    """The pages as the files of books: a book by hundreds of ids, names as careless tools write them."""
    p = _t(spark, sf, "pages")
    name = F.concat(F.when(F.col("page_id") % 3 == 0, "./text/").when(F.col("page_id") % 3 == 1, "/text\\\\x\\\\..\\\\").otherwise("C:/text//"), F.col("page_id").cast("string"), F.lit(".html"))
    return p.select(F.floor(F.col("page_id") / 100).cast("string").alias("book"), name.alias("name"), F.encode("html", "UTF-8").alias("data"))


def _scanned(spark, sf):
    found = archives.entries(archives.pack(_parts(spark, sf)), "book", with_data=False)
    return found.select("book", "name", "size", "ok", "digest")


def _windows(spark, sf):
    stream = ledger.drop_folder(spark, sf, _t(spark, sf, "events").schema, "events.parquet")
    return ledger.counted(stream, {"day": F.date_format(ledger.tumbling(F.col("ts"), "1 day"), "yyyy-MM-dd"), "event_type": F.col("event_type")})


def _text(fn):
    return lambda spark, sf: fn(_t(spark, sf, "documents"))


def queries() -> dict:
    lang = "CASE WHEN looks_polish AND lang <> 'pl' AND length >= 500 THEN true ELSE false END"
    return {
        "book_inventory": _text(library.inventory),
        "library_shape": _text(lambda d: library.shape(library.inventory(d), {"with_mail": F.col("emails") > 0, "with_notice": F.col("with_notice") > 0, "hyphenated": F.col("hyphens") > 3, "large": F.col("characters") > 100000, "with_empty": F.col("empty") > 0})),
        "family_coverage": _coverage,
        "findings_ranked": lambda s, d: library.ranked(_findings(s, d)),
        "findings_top": lambda s, d: library.ranked(_findings(s, d), top=4, levels=["ERROR", "INFO"]).select("place", "rule", "books"),
        "message_normalise": _text(lambda d: d.groupBy(F.sha2(tx.message_shape(F.col("text")), 256).alias("shape")).agg(F.count("*").alias("n"))),
        "failure_reasons": lambda s, d: _t(s, d, "pages").groupBy(tx.without_paths(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("could not read "), "url", F.lit(" at 'x'"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("no entry C:\\books\\"), F.col("page_id").cast("string"), F.lit(" in shelf "), F.col("page_id") % 2)).otherwise("damaged")).alias("reason")).agg(F.count("*").alias("n")),
        "generator_traces": _traces,
        "language_contradiction": _text(lambda d: d.select("doc_id", tx.looks_polish(F.col("text")).alias("looks_polish"), F.length("text").alias("length"), "lang").selectExpr("doc_id", f"{lang} AS contradicted")),
        "dominant_language_per_source": _text(lambda d: library.dominant(d, "source", "lang")),
        "canonical_text_hash": _text(lambda d: _worn(d).select("doc_id", F.sha2(tx.canonical(F.col("worn")), 256).alias("digest"))),
        "typography_conserved": _text(lambda d: _worn(d).select("doc_id", (tx.canonical(F.col("worn")) == tx.canonical(F.replace(F.col("worn"), F.lit("..."), F.lit("…")))).alias("unchanged"), (F.length("worn") - F.length(F.replace(F.col("worn"), F.lit("..."), F.lit("…")))).alias("shorter"))),
        "mojibake_census": _text(lambda d: d.select("doc_id", F.translate("text", "éñü", "\x80\x93\x99").alias("t")).select("doc_id", tx.misread(F.col("t")).alias("misread"), F.sha2(tx.reread(F.col("t")), 256).alias("reread"))),
        "hyphen_candidates": _text(lambda d: library.hyphen_candidates(_broken(d))),
        "hyphen_confidence": _text(lambda d: library.hyphen_candidates(_broken(d)).groupBy("confidence").agg(F.count("*").alias("n"))),
        "vocabulary_pruned": _text(lambda d: library.vocabulary(d, library.words(d.where("lang = 'en'"), "source").where(F.length("word") >= 8).distinct())),
        "opaque_tokens": _text(lambda d: d.withColumn("text", F.expr(MARKED)).select("doc_id", F.explode(tx.opaque_tokens(F.split("text", "[ \n]"))).alias("token"))),
        "personal_data": _text(lambda d: d.select("doc_id", F.explode(tx.emails(F.col("text"))).alias("email"))),
        "notice_phrases": _text(lambda d: d.where(tx.has_notice(F.col("text"))).select("doc_id")),
        "slugs_unique": lambda s, d: _t(s, d, "part").groupBy(tx.slug(F.col("p_name")).alias("slug")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")),
        "tag_shape": lambda s, d: _t(s, d, "pages").select(F.explode(F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)[ >]"), 1)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")),
        "archive_entries": _scanned,
        "event_windows_stream": _windows,
        "element_tags": lambda s, d: elements.elements(_t(s, d, "pages")).groupBy("tag").agg(F.count("*").alias("n")),
        "level_jumps": lambda s, d: library.level_jumps(_t(s, d, "conversations").select("conv_id", "turn", F.pmod(F.length("text"), F.lit(5)).alias("level")), "conv_id", "turn", "level"),
        "link_edges": _links,
        "dangling_links": lambda s, d: references.dangling(_links(s, d).where("target IS NOT NULL"), _t(s, d, "pages").select(F.regexp_replace(references.site_path(F.col("url")), "^/", "").alias("target")).distinct()).groupBy("target").agg(F.count("*").alias("n")),
        "relocation_candidates": lambda s, d: references.relocations(_t(s, d, "pages").select(F.concat(F.lit("moved/"), tx.basename(F.col("url"))).alias("target")), _t(s, d, "pages").select(F.col("url").alias("path"))),
        "reachable_nodes": _reached,
        "orphans": _orphans,
        "name_collisions": lambda s, d: references.collisions(_t(s, d, "pages").select(references.site_path(F.col("url")).alias("path"))),
        "balance_reconcile": _balance,
        "words_lost": _text(lambda d: library.words(d, "source").distinct().join(library.words(d.where("doc_id % 4 <> 1"), "source").distinct(), ["source", "word"], "left_anti").groupBy("source").agg(F.count("*").alias("lost"))),
        "exact_duplicates": _text(lambda d: compare.duplicates(d.select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id")),
        "signature_diff": _signatures,
        "multiset_minus": _text(lambda d: compare.multiset_minus(d.where("doc_id % 2 = 0").select("lang", "source"), d.where("doc_id % 2 = 1").select("lang", "source"), ["lang", "source"])),
        "green_streak": _runs,
        "widenings": lambda s, d: compare.widenings(_runs(s, d)),
        "merge_plan": _merge,
        "change_summary": _changes,
        "quota_star": lambda s, d: library.coverage(_t(s, d, "customer").select(F.col("c_mktsegment").alias("family")), s.createDataFrame([("BUILDING", 300), ("MACHINERY", 250), ("NONE", 9)], "family string, want long")),
    } | books.queries()


def oracle_sql() -> dict[str, str]:
    words = "SELECT {k}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents"
    polish = f"(length(text) - length(translate(text, {_str(tx.POLISH)}, '')))"
    looks = f"(length(text) > 0 AND {polish} * 1000 >= length(text) * {tx.POLISH_PER_1000})"
    inventory = f"""SELECT source, count(*) AS documents, sum(length(t))::BIGINT AS characters, sum(len(string_split(t, chr(10))))::BIGINT AS lines, sum(len(regexp_extract_all(t, '[0-9]')))::BIGINT AS digits,
  sum({polish.replace("text", "t")})::BIGINT AS polish_letters, sum(len(regexp_extract_all(t, '[A-Za-z]-[A-Za-z]')))::BIGINT AS hyphens, sum(len(regexp_extract_all(t, {_str(tx.EMAIL)})))::BIGINT AS emails,
  count(*) FILTER ({NOTICE_SQL.replace("text,", "t,")}) AS with_notice, count(*) FILTER (t = '') AS empty FROM (SELECT source, coalesce(text, '') AS t FROM documents) GROUP BY 1"""
    tests = "['long', 'short', 'digits', 'polish', 'notice', 'junk']"
    flags = f"[length(text) > 8000, length(text) < 1000, regexp_matches(text, '[0-9]{{3}}'), {looks}, {NOTICE_SQL}, contains(text, '***')]"
    marks = ", ".join(f"({_str(t)}, {_str(p)}, {w}::DOUBLE)" for t, p, w in MARKS)
    site = "regexp_replace(string_split(url, '#')[1], '^[a-z]+://[^/]*', '')"
    base = "string_split(string_split(string_split({x}, '#')[1], '?')[1], '/')[-1]"
    bare = "string_split(href, '#')[1]"
    # The pages' links are absolute, rooted or plain, without dots: the SQL needs no stack.
    links = f"""SELECT page_id, href, from_path, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:|^//') THEN NULL ELSE array_to_string(list_filter(string_split(CASE WHEN {bare} = '' THEN from_path WHEN {bare} LIKE '/%' THEN {bare} ELSE regexp_replace(from_path, '[^/]*$', '') || {bare} END, '/'), lambda p: p <> '' AND p <> '.'), '/') END AS target
  FROM (SELECT page_id, {site} AS from_path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""
    ranked = f"""SELECT *, row_number() OVER (ORDER BY books DESC, occurrences DESC, stage, level, rule)::INTEGER AS place FROM (
  SELECT stage, level, rule, count(DISTINCT book) AS books, count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT book))[1:3], ',') AS examples FROM ({FINDINGS_SQL}) GROUP BY 1, 2, 3)"""
    return {
        "book_inventory": inventory,
        "library_shape": f"""WITH b AS ({inventory}), t AS (SELECT count(*) AS books, count(*) FILTER (emails > 0) AS a, count(*) FILTER (with_notice > 0) AS b, count(*) FILTER (hyphens > 3) AS c, count(*) FILTER (characters > 100000) AS d, count(*) FILTER (empty > 0) AS e FROM b)
SELECT unnest(['with_mail', 'with_notice', 'hyphenated', 'large', 'with_empty']) AS test, unnest([a, b, c, d, e]) AS n, books FROM t""",
        "family_coverage": f"""WITH m AS (SELECT unnest({tests}) AS family, unnest({flags}) AS is_member FROM documents), h AS (SELECT family, count(*) AS have FROM m WHERE is_member GROUP BY 1)
SELECT family, want::BIGINT AS want, coalesce(have, 0)::BIGINT AS have, greatest(0, want - coalesce(have, 0))::BIGINT AS short FROM (VALUES {", ".join(f"({_str(f)}, {w})" for f, w in QUOTAS)}) q(family, want) LEFT JOIN h USING (family)""",
        "findings_ranked": ranked,
        "findings_top": f"SELECT place, rule, books FROM ({ranked}) WHERE place <= 4 AND level IN ('ERROR', 'INFO')",
        "message_normalise": """SELECT sha256(trim(regexp_replace(regexp_replace(text, '''[^'']*''|"[^"]*"|“[^”]*”|„[^”]*”', '…', 'g'), '[0-9]+(?:[.,][0-9]+)?', 'N', 'g'))) AS shape, count(*) AS n FROM documents GROUP BY 1""",
        "failure_reasons": """SELECT trim(regexp_replace(CASE page_id % 3 WHEN 0 THEN 'could not read ' || url || ' at ''x''' WHEN 1 THEN 'no entry C:\\books\\' || page_id || ' in shelf ' || page_id % 2 ELSE 'damaged' END, '(?:[A-Za-z]:)?[^\\s''"]*[\\\\/][^\\s''"]*', '…', 'g')) AS reason, count(*) AS n FROM pages GROUP BY 1""",
        "generator_traces": f"""WITH m AS (SELECT * FROM (VALUES {marks}) v(tool, pattern, weight)), c AS (SELECT doc_id, tool, least(0.999, round(1 - product(1 - weight), 3)) AS confidence, count(*) AS patterns FROM documents JOIN m ON contains(text, pattern) GROUP BY 1, 2) SELECT * FROM c WHERE confidence >= 0.5""",
        "language_contradiction": f"SELECT doc_id, coalesce({looks} AND lang <> 'pl' AND length(text) >= 500, false) AS contradicted FROM documents",
        "dominant_language_per_source": """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source, sum(n)::BIGINT AS total, max(n) AS n, arg_max(lang, (n, lang)) AS top FROM c GROUP BY 1) SELECT source, CASE WHEN n * 3 >= total * 2 AND total >= 20 THEN top END AS dominant, n, total FROM t""",
        "canonical_text_hash": f"SELECT doc_id, sha256({CANON_SQL.format(x='w')}) AS digest FROM (SELECT doc_id, {WORN} AS w FROM documents)",
        "typography_conserved": f"SELECT doc_id, {CANON_SQL.format(x='w')} = {CANON_SQL.format(x="replace(w, '...', '…')")} AS unchanged, (length(w) - length(replace(w, '...', '…')))::INTEGER AS shorter FROM (SELECT doc_id, {WORN} AS w FROM documents)",
        "mojibake_census": f"WITH x AS (SELECT doc_id, translate(text, 'éñü', chr(128) || chr(147) || chr(153)) AS t FROM documents) SELECT doc_id, (length(t) - length(translate(t, {_chars(tx.C1_FROM)}, '')))::INTEGER AS misread, sha256(translate(t, {_chars(tx.C1_FROM)}, {_chars(tx.C1_TO)})) AS reread FROM x",
        "hyphen_candidates": HYPHENS_SQL + " SELECT * FROM named",
        "hyphen_confidence": HYPHENS_SQL + " SELECT confidence, count(*) AS n FROM named GROUP BY 1",
        "vocabulary_pruned": f"WITH w AS MATERIALIZED ({words.format(k='lang, source')}), k AS (SELECT DISTINCT source, word FROM w WHERE lang = 'en' AND length(word) >= 8) SELECT w.source, w.word, count(*) AS n FROM w SEMI JOIN k ON w.source = k.source AND w.word = k.word GROUP BY 1, 2",
        "opaque_tokens": f"SELECT doc_id, token FROM (SELECT doc_id, unnest(regexp_split_to_array({MARKED}, '[ \\n]')) AS token FROM documents) WHERE regexp_full_match(token, '{tx.TOKEN}') AND regexp_matches(token, '[A-Za-z]') AND regexp_matches(token, '[0-9]')",
        "personal_data": f"SELECT doc_id, unnest(regexp_extract_all(text, {_str(tx.EMAIL)})) AS email FROM documents",
        "notice_phrases": f"SELECT doc_id FROM documents WHERE {NOTICE_SQL}",
        "slugs_unique": "SELECT regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1",
        "tag_shape": "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY 1",
        "archive_entries": "SELECT (page_id // 100)::VARCHAR AS book, 'text/' || page_id || '.html' AS name, strlen(html)::BIGINT AS size, true AS ok, sha256(html) AS digest FROM pages",
        "event_windows_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2",
        "element_tags": "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(regexp_replace(html, '(?is)(<script[^>]*>).*?</script>', '\\1', 'g')), '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM pages) GROUP BY 1",
        "level_jumps": "SELECT conv_id, count(*) FILTER (level > before + 1) AS jumps FROM (SELECT conv_id, length(text) % 5 AS level, lag(length(text) % 5) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1",
        "link_edges": links,
        "dangling_links": f"SELECT target, count(*) AS n FROM ({links}) WHERE target IS NOT NULL AND target NOT IN (SELECT regexp_replace({site}, '^/', '') FROM pages) GROUP BY 1",
        "relocation_candidates": f"WITH f AS (SELECT lower({base.format(x='url')}) AS name, min(url) AS moved_to FROM pages GROUP BY 1 HAVING count(DISTINCT url) = 1) SELECT DISTINCT 'moved/' || {base.format(x='url')} AS target, moved_to FROM pages JOIN f ON lower({base.format(x='url')}) = name",
        "reachable_nodes": f"WITH RECURSIVE {GRAPH_SQL} SELECT node FROM reached",
        "orphans": f"WITH RECURSIVE {GRAPH_SQL} SELECT node FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) WHERE node NOT IN (SELECT node FROM reached)",
        "name_collisions": f"WITH p AS (SELECT {site} AS path FROM pages), v AS (SELECT unnest(['exact', 'case', 'stem', 'basename']) AS view, unnest([path, lower(path), lower(regexp_replace(path, '\\.[^./]*$', '')), lower(string_split(string_split(path, '?')[1], '/')[-1])]) AS name FROM p) SELECT view, name, count(*) AS n FROM v GROUP BY 1, 2 HAVING count(*) > 1",
        "balance_reconcile": """WITH s AS (SELECT source AS category, sum(length(text))::BIGINT AS before_n, coalesce(sum(length(text)) FILTER (doc_id % 7 <> 3), 0)::BIGINT AS after_n, coalesce(sum(length(text)) FILTER (doc_id % 7 = 3 AND doc_id % 2 = 0), 0)::BIGINT AS explained_n FROM documents GROUP BY 1) SELECT *, greatest(0, before_n - after_n - explained_n)::BIGINT AS lost FROM s""",
        "words_lost": f"WITH w AS ({words.format(k='doc_id, source')}), k AS (SELECT DISTINCT source, word FROM w WHERE doc_id % 4 <> 1) SELECT source, count(*) AS lost FROM (SELECT DISTINCT source, word FROM w) a ANTI JOIN k USING (source, word) GROUP BY 1",
        "exact_duplicates": "SELECT doc_id, digest, first, copies FROM (SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY sha256(text)) AS first, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents) WHERE doc_id <> first",
        "signature_diff": """WITH o AS (SELECT source || '/' || lang AS path, count(*) AS value FROM documents GROUP BY source, lang), n AS (SELECT source || '/' || lang AS path, count(*) AS value FROM documents WHERE doc_id % 50 <> 1 GROUP BY source, lang HAVING lang <> 'es' OR count(*) > 4)
SELECT path, o.value AS old, n.value AS new, CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (path) WHERE o.value IS DISTINCT FROM n.value""",
        "multiset_minus": "SELECT lang, source, count(*) AS n FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 1) GROUP BY 1, 2",
        "green_streak": """WITH r AS (SELECT conv_id AS run, 'v' || (conv_id // 2) AS version, count(*) AS books, count(DISTINCT role) AS modes, sum(length(text)) % 5 > 0 AS clean FROM conversations GROUP BY conv_id),
w AS (SELECT *, coalesce(books >= lag(books) OVER o AND modes >= lag(modes) OVER o AND (books > lag(books) OVER o OR modes > lag(modes) OVER o), false) AS widened FROM r WINDOW o AS (ORDER BY run)),
i AS (SELECT *, sum(CASE WHEN NOT widened AND NOT clean THEN 1 ELSE 0 END) OVER (ORDER BY run) AS island FROM w),
s AS (SELECT *, CASE WHEN clean AND NOT widened AND coalesce(lag(version) OVER (PARTITION BY island, clean AND NOT widened ORDER BY run) <> version, true) THEN 1 ELSE 0 END AS fresh FROM i)
SELECT run, version, books, modes, clean, widened, sum(fresh) OVER (PARTITION BY island ORDER BY run)::BIGINT AS streak FROM s""",
        "widenings": """SELECT conv_id AS run, 'v' || (conv_id // 2) AS version, books, modes FROM (SELECT *, lag(books) OVER o AS b, lag(modes) OVER o AS m FROM (SELECT conv_id, count(*) AS books, count(DISTINCT role) AS modes FROM conversations GROUP BY 1) WINDOW o AS (ORDER BY conv_id))
WHERE books >= b AND modes >= m AND (books > b OR modes > m)""",
        "merge_plan": f"SELECT {site} AS name, min(page_id) FILTER (page_id % 5 <> 2) AS take, count(*) AS copies, count(DISTINCT sha256(html)) FILTER (page_id % 5 <> 2) > 1 AS conflict, min(page_id) FILTER (page_id % 5 <> 2) IS NULL AS missing FROM pages GROUP BY 1",
        "change_summary": "SELECT event_type AS action, CASE WHEN value > 50 THEN 'content' ELSE 'none' END AS risk, count(*) AS n, count(*) FILTER (user_id % 3 = 0) AS irreversible FROM events GROUP BY GROUPING SETS ((event_type, CASE WHEN value > 50 THEN 'content' ELSE 'none' END), (event_type), (CASE WHEN value > 50 THEN 'content' ELSE 'none' END), ())",
        "quota_star": "SELECT family, want::BIGINT AS want, count(c_custkey) AS have, greatest(0, want - count(c_custkey))::BIGINT AS short FROM (VALUES ('BUILDING', 300), ('MACHINERY', 250), ('NONE', 9)) q(family, want) LEFT JOIN customer ON c_mktsegment = family GROUP BY family, want",
    } | books.oracle_sql()
