"""Small relational operators: natural join, newest row per key, superseded rows, duplicates, samples, label lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def distances(prototype: DataFrame, area: DataFrame) -> DataFrame:
    """Inner join on all columns that both have; lazy."""
    common = [c for c in prototype.columns if c in area.columns]
    if not common:
        raise ValueError(f"nothing to join on: {prototype.columns} and {area.columns}")
    return prototype.join(area, common, "inner")


def keep_newest(df: DataFrame, key: str = "id", order: str = "batch") -> DataFrame:
    """The row of each key with the largest ``order``: one aggregation, combined on the map side."""
    rest = [c for c in df.columns if c not in (key, order)]
    newest = df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r"))
    return newest.select(*[F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns])


def superseded(df: DataFrame, key: str = "id", order: str = "batch") -> DataFrame:
    """Rows that have a newer one of their key."""
    newest = df.groupBy(key).agg(F.max(order).alias("_newest"))
    return df.join(newest, key).filter(F.col(order) < F.col("_newest")).drop("_newest")


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """``key, n`` of keys that come up more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def changed_rows(prepared: DataFrame, existing: DataFrame) -> DataFrame:
    """Prepared rows without an existing row of the same id and hash."""
    return prepared.join(existing.select("id", "text_hash"), ["id", "text_hash"], "left_anti")


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly n rows, if there are as many, by a hash of the key and the seed: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def resolve_labels(spark: SparkSession, labels) -> DataFrame | None:
    """``id, label`` from a DataFrame, a CSV path, {id: label} or {label: [ids]}; rows without an id or a label are passed over."""
    if labels is None:
        return None
    if isinstance(labels, DataFrame):
        found = labels
    elif isinstance(labels, str):
        found = spark.read.csv(labels, header=True)
    elif isinstance(labels, dict):
        listed = any(isinstance(v, list | tuple | set) for v in labels.values())
        pairs = [(i, k) for k, v in labels.items() for i in v] if listed else list(labels.items())
        found = spark.createDataFrame([tuple(None if x is None else str(x) for x in p) for p in pairs], "id string, label string")
    else:
        raise ValueError(f"labels of type {type(labels).__name__}; a DataFrame, a CSV path or a dict is needed")
    if not {"id", "label"} <= set(found.columns):
        raise ValueError(f"labels need id and label; these have {found.columns}")
    found = found.select(F.trim(F.col("id").cast("string")).alias("id"), F.trim(F.col("label").cast("string")).alias("label")).filter("id <> '' AND label <> ''")  # nulls go too
    if found.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("an id has several labels")
    return found


def with_group(points: DataFrame, labels: DataFrame | None, default: str = "other") -> DataFrame:
    """``group`` of each point: its label, else the default."""
    if labels is None:
        return points.withColumn("group", F.lit(default))
    return points.join(labels.withColumnRenamed("label", "group"), "id", "left").withColumn("group", F.coalesce("group", F.lit(default)))
