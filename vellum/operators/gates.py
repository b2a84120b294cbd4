"""Gates before a book is published: memory, budgets, text, messages of a validator; what was lost, verdicts kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of files that are read as text; bytes of memory for a byte of text and of anything else, for a
# book at all, and what is added for safety; the share of free memory that may be planned with.
TEXT_SUFFIXES = ["xhtml", "html", "htm", "xml", "opf", "ncx", "css", "svg"]
TEXT_COST, BINARY_COST, BASE_BYTES, SAFETY, HEADROOM = 4.6, 2.8, 40 << 20, 1.15, 0.8
# Rules by which text goes on purpose.
CONSENTED = ["xhtml.shop-notice-removed", "xhtml.watermark-removed", "xhtml.watermark-relocated", "hyphens.joined"]
# What a lost file was, by its suffix.
LOST_KINDS = {
    "document": ["xhtml", "html", "htm", "xml"], "stylesheet": ["css"], "image": ["jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "tif", "tiff"], "font": ["ttf", "otf", "woff", "woff2"],
    "audio": ["mp3", "m4a", "ogg", "wav"], "video": ["mp4", "webm"], "navigation": ["ncx"], "package": ["opf"],
}
# Limits of a book: files, bytes and nesting of a document.
FILES, DOCUMENT_BYTES, NESTING = 20_000, 64 << 20, 1024


def _suffix(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def estimated(entries: DataFrame) -> DataFrame:
    """(book, text_bytes, binary_bytes, peak) from (book, name, size): the memory that a book is expected to take."""
    is_text = _suffix(F.col("name")).isin(TEXT_SUFFIXES)
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long")
    sums = entries.groupBy("book").agg(of(is_text).alias("text_bytes"), of(~is_text).alias("binary_bytes"))
    peak = F.floor(SAFETY * (BASE_BYTES + F.col("text_bytes") * TEXT_COST + F.col("binary_bytes") * BINARY_COST))
    return sums.withColumn("peak", peak.cast("long"))


def fits(peak: Column, free: Column, limit: Column) -> Column:
    """Whether a book fits: within the limit if one is given, else within a share of the free memory; true if neither is known."""
    return F.coalesce(peak <= F.coalesce(limit, F.floor(free * HEADROOM)), F.lit(True))


def over_budget(documents: DataFrame) -> DataFrame:
    """(book, path, reason) of documents (book, path, bytes, depth) beyond a limit, and of books with too many of them."""
    reason = F.when(F.col("bytes") > DOCUMENT_BYTES, "too large").when(F.col("depth") > NESTING, "too deep")
    each = documents.withColumn("reason", reason).where("reason IS NOT NULL").select("book", "path", "reason")
    many = documents.groupBy("book").agg(F.count("*").alias("n")).where(F.col("n") > FILES)
    return each.union(many.select("book", F.lit(None).cast("string"), F.lit("too many files")))


def fingerprint(files: DataFrame) -> DataFrame:
    """(book, digest) over (book, path, digest): two equal ones prove that a stage changed nothing."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda f: F.concat_ws(" ", f["path"], f["digest"]))
    return files.groupBy("book").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def text_gate(losses: DataFrame, findings: DataFrame) -> DataFrame:
    """(book, verdict): `passed` where no character is lost (`lost_at` of -1), `consented` where a finding (book, rule) names a
    change that takes text out on purpose, else `refused`."""
    asked = findings.where(F.col("rule").isin(CONSENTED)).select("book").distinct().withColumn("__asked", F.lit(True))
    worst = losses.groupBy("book").agg(F.max("lost_at").alias("lost_at")).join(asked, "book", "left")
    return worst.select("book", F.when(F.col("lost_at") < 0, "passed").when(F.col("__asked"), "consented").otherwise("refused").alias("verdict"))


def publication_gate(books: DataFrame, before: DataFrame, after: DataFrame, mode: str) -> DataFrame:
    """(book, introduced, verdict) of books (book, checked): `off` lets all pass; `clean` refuses any message after; else,
    under `no-new-errors`, a shape of message that comes more often after than before refuses.

    before, after: (book, shape, n). Books that nothing has checked are refused under `clean` alone.
    """
    if mode == "off":
        return books.select("book", F.lit(0).cast("long").alias("introduced"), F.lit("published").alias("verdict"))
    signed = after.select("book", "shape", F.col("n").alias("a"), F.lit(0).alias("b")).union(before.select("book", "shape", F.lit(0), "n"))
    sums = signed.groupBy("book", "shape").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    more = F.sum("a") if mode == "clean" else F.sum(F.when(F.col("a") > F.col("b"), F.col("a")).otherwise(0))
    counted = sums.groupBy("book").agg(more.alias("introduced"))
    out = books.join(counted, "book", "left").withColumn("introduced", F.when(F.col("checked"), F.coalesce("introduced", F.lit(0))).otherwise(0).cast("long"))
    refused = F.when(F.col("checked"), F.col("introduced") > 0).otherwise(F.lit(mode == "clean"))
    return out.select("book", "introduced", F.when(refused, "refused").otherwise("published").alias("verdict"))


def lost_kind(name: Column) -> Column:
    """What a file was that could not be read, by its name's suffix."""
    out, suffix = F.lit("unknown"), _suffix(name)
    for kind, suffixes in LOST_KINDS.items():
        out = F.when(suffix.isin(suffixes), kind).otherwise(out)
    return out


def diagnosed(lost: DataFrame, declared: DataFrame, mentions: DataFrame) -> DataFrame:
    """(book, name, kind, declared, referenced) of lost files (book, name): whether the package lists them (book, name), and how
    many documents mention their base name (book, document, word). Mentions are met by equality and counted once a document."""
    base = F.element_at(F.split("name", "/"), -1)
    listed = declared.select("book", "name").distinct().withColumn("__d", F.lit(True))
    spoken = mentions.select("book", "document", F.col("word").alias("__base")).distinct().groupBy("book", "__base").agg(F.count("*").alias("referenced"))
    out = lost.withColumn("__base", base).join(listed, ["book", "name"], "left").join(spoken, ["book", "__base"], "left")
    return out.select("book", "name", lost_kind(F.col("name")).alias("kind"), F.col("__d").isNotNull().alias("declared"), F.coalesce("referenced", F.lit(0)).alias("referenced"))


def reused(outputs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(book, digest, checker, verdict): verdicts that an earlier run gave on the same bytes with the same checker; null where
    the book must be checked again."""
    kept = verdicts.groupBy("digest", "checker").agg(F.max_by("verdict", "run").alias("verdict"))
    return outputs.join(kept, ["digest", "checker"], "left").select("book", "digest", "checker", "verdict")


def settled_layout(package: Column, moves: Column, root: str = "OPS") -> Column:
    """(folder, name) of the package document: the source's own where files stay and its path is usable, else the default."""
    usable = F.rlike(package, F.lit(r"^[^\s\\:*?\"<>|]+\.opf$")) & ~F.rlike(package, F.lit(r"(^|/)\.\.?(/|$)|^/"))
    keep = ~moves & F.coalesce(usable, F.lit(False))
    folder = F.when(F.contains(package, F.lit("/")), F.regexp_replace(package, "/[^/]*$", "")).otherwise("")
    name = F.element_at(F.split(package, "/"), -1)
    return F.struct(F.when(keep, folder).otherwise(root).alias("folder"), F.when(keep, name).otherwise("package.opf").alias("name"))


def planned(jobs: DataFrame, existing: DataFrame) -> DataFrame:
    """`jobs` (source, destination) with `problem`: destinations that several sources claim, that are there already, or that
    are a job's own source; null for the others."""
    claimed = jobs.groupBy("destination").agg(F.count("*").alias("__n"))
    there = existing.select(F.col("path").alias("destination"), F.lit(True).alias("__there")).distinct()
    out = jobs.join(claimed, "destination").join(there, "destination", "left")
    problem = F.when(F.col("source") == F.col("destination"), "itself").when(F.col("__n") > 1, "collision").when(F.col("__there"), "occupied")
    return out.select("source", "destination", problem.alias("problem"))
