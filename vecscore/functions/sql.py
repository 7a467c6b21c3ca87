"""The library's functions under names that SQL can call; their bodies are SQL, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"
_NORMS = f"(sqrt({_DOT.format(a='a', b='a')}) * sqrt({_DOT.format(a='b', b='b')}))"
FUNCTIONS = {
    "cosine_similarity": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"try_divide({_DOT.format(a='a', b='b')}, {_NORMS})"),
    "cosine_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"1 - try_divide({_DOT.format(a='a', b='b')}, {_NORMS})"),
    "relevance_score": ("distance DOUBLE, alpha DOUBLE", "DOUBLE", "exp(-alpha * distance)"),
    "strip_tags": ("html STRING", "STRING", r"trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' '), '[ \\t\\r\\n\\f\\x0B]+', ' '))"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
