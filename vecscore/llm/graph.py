"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import drop_table, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with ``m`` of their ``u``. ``least`` is a written table, so both sides of the join are plain exchanges: a node of many edges can be split."""
    return edges.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for each node of an edge the smallest node of its component; the smallest itself has no row.

    Each round is two aggregations and joins over the edges. The minimum of each node is
    combined before it is shuffled and written before it is joined: the optimizer can split
    a hot node's edges only where neither side of the join is an aggregate. A round's edges
    are written to the shared folder, so no lineage grows.

    Defined results: edges of a node with itself and repeated edges change nothing; no edge, no row.
    """
    e = materialise(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(_with_least(both, least).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small_least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "small_least")
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = _with_least(large, small_least).select(F.explode(ends).alias("x")).select("x.*").filter(F.col("u") != F.col("v")).distinct()
        new = materialise(small, "edges")
        after = _state(new)
        for old in (least, large, small_least, e):
            drop_table(old)
        e = new
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
