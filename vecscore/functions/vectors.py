"""Vectors as ``array<double>``: products, cosine, and the V1..Vd column codec."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_V = re.compile(r"^V[0-9]+$")


def vector_columns(columns: list[str]) -> list[str]:
    """Names V1, V2, ... in numeric order; none is an error."""
    found = sorted((c for c in columns if _V.match(c)), key=lambda c: int(c[1:]))
    if not found:
        raise ValueError("no column V1, V2, ... holds a vector's numbers")
    return found


def has_vector_columns(columns: list[str]) -> bool:
    return any(_V.match(c) for c in columns)


def to_array(df: DataFrame, name: str = "embedding") -> DataFrame:
    """V1..Vd folded into one array column; a frame that has the array already keeps it, as doubles."""
    if name in df.columns and not has_vector_columns(df.columns):
        return df.withColumn(name, F.col(name).cast("array<double>"))
    cols = vector_columns(df.columns)
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in cols])).drop(*cols)


def to_columns(df: DataFrame, dim: int, name: str = "embedding") -> DataFrame:
    """The array column unfolded into V1..Vd."""
    return df.select(*[c for c in df.columns if c != name], *[F.get(F.col(name), F.lit(k)).alias(f"V{k + 1}") for k in range(dim)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def similarity_cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, not clipped; null where a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def distance_cosine(a: Column, b: Column) -> Column:
    return F.lit(1.0) - similarity_cosine(a, b)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def all_finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, is_finite), F.lit(False))
