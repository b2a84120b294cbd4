"""The library's scalar judgements as functions of SQL text, and a table function that opens archives.

Scalars are SQL functions whose bodies Spark puts into the query's own expressions; only the table function runs Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from vellum.functions import text as tx


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bodies() -> dict[str, tuple[str, str]]:
    """Type and body of each function of one text `x`."""
    folded = f"translate(replace(x, '...', '…'), {_quoted(tx.FOLD_FROM)}, {_quoted(tx.FOLD_TO)})"
    polish = f"(length(x) - length(translate(x, {_quoted(tx.POLISH)}, '')))"
    low = r"lower(regexp_replace(x, '[ \\t\\n\\r]+', ' '))"
    return {
        "vellum_canonical": ("STRING", rf"trim(regexp_replace(regexp_replace({folded}, {_quoted(tx.INVISIBLE)}, ''), '[ \\t\\n\\r\\f]+', ' '))"),
        "vellum_polish_share": ("DOUBLE", f"CASE WHEN length(x) > 0 THEN {polish} * 1000 / length(x) ELSE 0 END"),
        "vellum_looks_polish": ("BOOLEAN", f"length(x) > 0 AND {polish} * 1000 >= length(x) * {tx.POLISH_PER_1000}"),
        "vellum_has_notice": ("BOOLEAN", "(" + " OR ".join(f"contains({low}, {_quoted(p)})" for p in tx.NOTICES) + ")"),
        "vellum_is_token": ("BOOLEAN", f"x RLIKE '^{tx.TOKEN}$' AND x RLIKE '[A-Za-z]' AND x RLIKE '[0-9]'"),
        "vellum_slug": ("STRING", "regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-'), '^-+|-+$', '')"),
    }


class _Entries:
    """(name, size, ok) of the entries of an archive."""

    def eval(self, content: bytes):
        from vellum.sources import reader

        for name, data in reader._entries(content or b"")[0].items():
            yield name, None if data is None else len(data), data is not None


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session; gives their names."""
    from pyspark.sql.functions import udtf

    found = bodies()
    for name, (kind, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    spark.udtf.register("vellum_entries", udtf(_Entries, returnType="name string, size long, ok boolean"))
    return sorted([*found, "vellum_entries"])
