"""Decision threshold by F1 or by precision at a recall, from scores and labels.

Each score falls into the bucket of thresholds strictly below it, so the counts at
all thresholds are suffix sums over buckets: one aggregation over the scores, then
a window over as many rows as there are thresholds. No score is ever sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecscore.functions.vectors import is_finite
from vecscore.project import read_dataset, required_text

METRICS = ("f1", "precision_at_recall")


@dataclass(frozen=True)
class Calibration:
    th: float
    precision: float
    recall: float
    f1: float
    thresholds: list[float]
    precision_curve: list[float]
    recall_curve: list[float]
    f1_curve: list[float]


def below(df: DataFrame, value: str, sorted_values: list[float], name: str = "bucket") -> DataFrame:
    """``df`` with how many of the sorted values lie strictly below ``value``: a binary search of log2(n) projections."""
    table = F.array(*[F.lit(float(x)) for x in sorted_values])
    out, step = df.withColumn(name, F.lit(0)), 1
    while step * 2 <= len(sorted_values):
        step *= 2
    while step and sorted_values:
        probe: Column = F.get(table, F.col(name) + (step - 1))
        out = out.withColumn(name, F.when(probe < F.col(value), F.col(name) + step).otherwise(F.col(name)))
        step //= 2
    return out


def labelled(scores: DataFrame, labels: DataFrame, score_col: str = "relevance_score") -> DataFrame:
    """``score, label`` of scored rows with a finite score and a label; ids that repeat multiply."""
    if not {"id", score_col} <= set(scores.columns):
        raise ValueError(f"scores need id and {score_col}; this table has {scores.columns}")
    if not {"id", "label"} <= set(labels.columns):
        raise ValueError(f"labels need id and label; this table has {labels.columns}")
    own = labels.select(F.col("id").cast("string").alias("id"), F.col("label").cast("int").alias("label")).filter("label IS NOT NULL")
    rows = scores.select(F.col("id").cast("string").alias("id"), F.col(score_col).cast("double").alias("score"))
    return rows.filter(is_finite(F.col("score"))).join(own, "id").select("score", "label")


def threshold_curve(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """``i, threshold, tp, fp, fn, precision, recall, f1`` for each threshold; a row is positive if its score is above."""
    order = sorted(range(len(thresholds)), key=lambda i: thresholds[i])
    ranked = [float(thresholds[i]) for i in order]
    counts = below(rows, "score", ranked).groupBy("bucket").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.count(F.lit(1)).alias("all"))
    grid = rows.sparkSession.range(0, len(ranked) + 1, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    table = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("bucket") - 1)
    # rows here: one per threshold
    down = Window.partitionBy().orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    joined = grid.join(F.broadcast(counts), "bucket", "left").fillna(0, ["pos", "all"])
    out = joined.select("bucket", F.sum("pos").over(down).alias("tp"), F.sum("all").over(down).alias("called"), F.sum("pos").over(every).alias("positives")).filter("bucket > 0")
    out = out.select((table([int(i) for i in order])).alias("i"), table(ranked).alias("threshold"), "tp", (F.col("called") - F.col("tp")).alias("fp"), (F.col("positives") - F.col("tp")).alias("fn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    out = out.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def threshold_grid(rows: DataFrame, n_thresholds: int = 1001) -> list[float]:
    """Evenly spaced from the least to the largest labelled score."""
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    if low is None or high is None:
        raise ValueError("no score has a label")
    grid = np.linspace(low, high, int(n_thresholds))
    grid[-1] = high
    return grid.tolist()


def best_row(curve: list, metric: str, recall_min: float) -> int:
    """Index of the first best threshold; if none reaches the recall, the first."""
    if metric == "f1":
        values = [r["f1"] for r in curve]
    else:
        values = [r["precision"] if r["recall"] >= recall_min else -np.inf for r in curve]
    return int(np.argmax(values))


def calibrate(scores: DataFrame, labels: DataFrame, score_col: str = "relevance_score", metric: str = "f1", recall_min: float = 0.8, thresholds: list[float] | None = None, n_thresholds: int = 1001) -> Calibration:
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is unknown; there are {METRICS}")
    rows = labelled(scores, labels, score_col)
    given = [float(t) for t in thresholds] if thresholds is not None else threshold_grid(rows, n_thresholds)
    curve = sorted(threshold_curve(rows, given).collect(), key=lambda r: r["i"])  # a row per threshold
    k = best_row(curve, metric, recall_min)
    pick = lambda name: [float(r[name]) for r in curve]
    best = curve[k]
    return Calibration(float(given[k]), float(best["precision"]), float(best["recall"]), float(best["f1"]), given, pick("precision"), pick("recall"), pick("f1"))


def calibrate_threshold(spark: SparkSession, scores_parquet: str, labels_parquet: str, score_col: str = "relevance_score", **options) -> Calibration:
    scores_parquet = required_text("scores_parquet", scores_parquet)
    if not labels_parquet:
        raise ValueError("labels_parquet is empty")
    return calibrate(read_dataset(spark, scores_parquet), read_dataset(spark, labels_parquet), score_col, **options)
