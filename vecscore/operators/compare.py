"""Direct against batch embeddings of the same texts: per-row cosine and largest difference, and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecscore.functions.vectors import has_vector_columns, is_finite, norm, similarity_cosine, to_array, vector_columns


def compare_embeddings(direct: DataFrame, batch: DataFrame) -> DataFrame:
    """``id, cosine_similarity, max_abs_diff`` of ids on both sides; cosine is null where a norm is 0 or not finite."""
    if has_vector_columns(direct.columns) and has_vector_columns(batch.columns):
        common = [c for c in vector_columns(direct.columns) if c in batch.columns]
        if not common:
            raise ValueError("the two sides share no vector column")
        direct, batch = direct.select("id", *common), batch.select("id", *common)
    a = to_array(direct).select("id", F.col("embedding").alias("a"))
    b = to_array(batch).select("id", F.col("embedding").alias("b"))
    usable = is_finite(norm(F.col("a"))) & is_finite(norm(F.col("b")))
    return a.join(b, "id").select("id", F.when(usable, similarity_cosine(F.col("a"), F.col("b"))).alias("cosine_similarity"), F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y))).alias("max_abs_diff"))


def compare_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count(F.lit(1)).alias("matched_ids"), F.avg("cosine_similarity").alias("mean_cosine_similarity"), F.min("cosine_similarity").alias("min_cosine_similarity"), F.max("max_abs_diff").alias("max_abs_diff"))


def checked_comparison(direct: DataFrame, batch: DataFrame, label: str = "corpus") -> tuple[DataFrame, dict]:
    """The comparison and its summary, or an error if either side or the overlap is empty."""
    for name, side in (("Direct", direct), ("Batch", batch)):
        if side.limit(1).count() == 0:
            raise ValueError(f"{name.lower()} side of label {label!r}: no vectors")
    rows = compare_embeddings(direct, batch)
    summary = compare_summary(rows).first().asDict()
    if not summary["matched_ids"]:
        raise ValueError("no id is on both sides")
    return rows, summary
