"""XXH64 with seed 0 as 16 hex digits, evaluated in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _jvm_xxh64(col: Column, seed: int) -> Column:
    """Catalyst's own XxHash64 expression; its SQL function only has seed 42."""
    from pyspark.sql.classic.column import Column as ClassicColumn

    sc = SparkSession.active().sparkContext
    sql = sc._jvm.org.apache.spark.sql
    utils = sql.classic.ExpressionUtils
    children = sc._jvm.PythonUtils.toSeq([utils.expression(col._jc)])
    return ClassicColumn(utils.column(sql.catalyst.expressions.XxHash64(children, seed)))


def _arrow_xxh64(col: Column) -> Column:
    @F.pandas_udf("string")
    def hashed(text: pd.Series) -> pd.Series:
        import xxhash

        return text.map(lambda t: None if t is None else xxhash.xxh64_hexdigest(t.encode()))

    return hashed(col)


def xxh64_hex(col: Column) -> Column:
    """Seed-0 XXH64 of a string's UTF-8 bytes; null stays null. Sessions without a JVM gateway use Arrow batches."""
    try:
        hashed = F.lower(F.lpad(F.hex(_jvm_xxh64(col, 0)), 16, "0"))
    except (AttributeError, ImportError, TypeError):
        return _arrow_xxh64(col)
    return F.when(col.isNotNull(), hashed)


def custom_id(id_: Column, text_hash: Column) -> Column:
    """Key of a request row: ``cid_`` and the hash of ``id::text_hash``."""
    return F.concat(F.lit("cid_"), xxh64_hex(F.concat(id_, F.lit("::"), text_hash)))
