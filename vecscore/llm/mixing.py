"""Mixing sources to target weights: cube-method balanced sampling.

Every source gets a target of words; a document of it is to be taken
``target / source size`` times, at most twice. Whole repeats are given to all its
documents; the fraction left is an inclusion probability, and the cube method
turns the probabilities of a source into 0 or 1 while it keeps two totals: words
and documents. Its flight phase takes three documents at a time and moves their
probabilities along the null space of the two constraints, until one of them
reaches 0 or 1; a block of any size ends with two fractional documents at most.

Blocks of bounded size are flown apart; what stays fractional in all blocks of a
source meets again in fewer blocks, round by round, until one block holds the
source's rest. The landing there tries all choices of its last dozen documents and
takes the one whose words come nearest to what was due. The random moves follow hashes of the documents, so
reruns agree.

Defined results: a null text has size 0; sources without words have target 0 and
nothing is taken; a null source is a source, ordered last; a null doc_id is an id; rows alike in
doc_id and text are separate rows whose order can't show; of landings that come equally near,
that with the document count nearest, then the first, is taken; very long texts count
whole; an empty table gives an empty table; other columns, whatever their names, are kept by
:func:`repeated` and not read by :func:`mix`. What is sorted in one task is a row per source.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecscore.llm.common import boxed, count_words, materialise, unboxed

#: The weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """``of`` (the source), ``source_size, n, target`` from ``source, size``: weighted shares, filled up to ``most`` times each size.

    Sharing the excess again until none is above is one level: every source gets
    the smaller of its cap and level times weight. Sources are sorted by the level at
    which they fill; sums before and after each give the level. The windows hold a row per
    source, not per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("fills", F.col("cap") / F.col("w"))
    up = Window.orderBy("fills", F.col("source").asc_nulls_last())
    t = t.withColumn("filled", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open", F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    whole = Window.partitionBy()
    t = t.withColumn("due", share * F.sum("source_size").over(whole)).withColumn("level", (F.col("due") - F.col("filled")) / F.col("open"))
    # these levels rise up to the first source that doesn't fill at its own, and fall from there on
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(whole))
    return t.select(F.col("source").alias("of"), "source_size", "n", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray, keep: int = 2) -> None:
    """Move the probabilities, in place, until ``keep`` (2 at least) or fewer are fractional; words and documents expected stay the same."""
    eps = 1e-12
    todo = np.flatnonzero((p > eps) & (p < 1 - eps)).tolist()
    trio, at = todo[:3], 3
    turn = 0
    while len(trio) == 3 and len(trio) + len(todo) - at > keep:
        a, b, c = trio
        sa, sb, sc = float(size[a]), float(size[b]), float(size[c])
        u = (sc - sb, sa - sc, sb - sa)  # sums to 0, and so does its product with the sizes
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)  # equal sizes: any move that sums to 0
        norm = max(map(abs, u))
        forward = backward = math.inf
        for i, x in zip(trio, u, strict=True):
            x /= norm
            if x > 0:
                forward, backward = min(forward, (1 - p[i]) / x), min(backward, p[i] / x)
            elif x < 0:
                forward, backward = min(forward, p[i] / -x), min(backward, (1 - p[i]) / -x)
        step = forward if draw[turn % len(draw)] * (forward + backward) < backward else -backward
        turn += 1
        rest = []
        for i, x in zip(trio, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * x / norm))
            if p[i] <= eps or p[i] >= 1 - eps:
                p[i] = round(p[i])
            else:
                rest.append(i)
        if len(rest) == 3:  # rounding kept the nearest one off its edge
            near = min(rest, key=lambda i: min(p[i], 1 - p[i]))
            p[near] = round(p[near])
            rest.remove(near)
        trio = rest
        while len(trio) < 3 and at < len(todo):
            trio.append(todo[at])
            at += 1


def land(p: np.ndarray, size: np.ndarray) -> None:
    """Set the last few fractional ones, in place: of the choices with as many documents as expected, give or take one, that with the nearest words."""
    rest = np.flatnonzero((p > 0) & (p < 1))
    if not len(rest):
        return
    choices = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    words = np.abs(choices @ size[rest] - float((p[rest] * size[rest]).sum()))
    rows = np.abs(choices.sum(axis=1) - float(p[rest].sum()))
    p[rest] = choices[int(np.lexsort((rows, words, rows >= 1.5))[0])]


def _round(units: DataFrame, block: int, k: int, last: bool, landing: int) -> DataFrame:
    """One round: each block of each source is flown; in the last round, a source is one block and is landed."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size"], ignore_index=True)
        p, size = pdf["p"].to_numpy(dtype=float, copy=True), pdf["size"].to_numpy(dtype=float)
        seed = int(pdf["h"].to_numpy().view(np.uint64).sum(dtype=np.uint64)) ^ k
        flight(p, size, np.random.Generator(np.random.PCG64(seed)).random(max(1, len(p))), landing if last else 2)
        if last:
            land(p, size)
        pdf["p"] = p
        return pdf

    blocks = F.lit(0) if last else F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.lit(1), F.ceil(F.col("left") / block))).cast("int")
    return units.withColumn("b", blocks).groupBy("source", "b").applyInPandas(fly, units.withColumn("b", F.lit(0)).schema).drop("b")


def cube_sample(units: DataFrame, block: int = 4096, landing: int = 12) -> DataFrame:
    """``units`` (source, doc_id, h, size, p) with ``p`` 0 or 1. ``h`` spreads and orders the rows of a source."""
    kinds = ["source", "doc_id", "h", "size", "p"]
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    done = units.select(*kinds).filter(~fractional)
    rest = units.select(*kinds).filter(fractional)
    k = 0
    while True:
        counts = materialise(rest.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("left")), "left")
        most = counts.agg(F.max("left")).first()[0] or 0
        last = most <= block
        joined = rest.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        flown = materialise(_round(joined.select(*kinds, "left"), block, k, last, landing).select(*kinds), f"flown{k}")
        done = done.unionByName(flown.filter(~fractional))
        if last:
            return done
        rest = flown.filter(fractional)
        k += 1


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, h, size, source_size, target, copies`` for each row of ``docs``; copies is how often the mix takes it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    rows = materialise(rows, "sizes")
    targets = materialise(source_targets(rows, share, most, weights), "targets")
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    times = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    joined = joined.withColumn("times", times).withColumn("whole", F.floor(F.col("times") + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), F.col("times") - F.col("whole")))
    joined = joined.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
    chosen = cube_sample(joined.select("source", "doc_id", "h", "size", "p"))
    chosen = chosen.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = F.when(F.col("source_size") > 0, F.floor(F.least(F.lit(most), F.col("target") / F.col("source_size")) + 1e-9)).otherwise(F.lit(0))
    return chosen.select("doc_id", "source", "h", "size", "source_size", "target", (whole + F.col("p")).cast("long").alias("copies"))


def repeated(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    copies = mixed.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "h", "copies").groupBy("id", "h").agg(F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("rows"))
    copies = materialise(copies, "copies")
    keyed = boxed(docs, id=F.coalesce(F.col(doc_id), F.lit(-1)), h=F.xxhash64(F.col(doc_id), F.col(text)))
    one = keyed.join(copies.filter("rows = 1 AND sum > 0"), ["id", "h"]).withColumn("each", F.col("sum").cast("int"))
    one = one.select("row", "each")
    if not copies.filter("rows > 1 AND sum > 0").limit(1).count():  # nearly always; the texts aren't read once more then
        return unboxed(one.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("each")))), docs)
    # rows alike in id and text share their copies out among them
    several = keyed.join(copies.filter("rows > 1 AND sum > 0"), ["id", "h"])
    k = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.xxhash64("row")))
    several = several.withColumn("k", k).withColumn("each", (F.floor(F.col("sum") / F.col("rows")) + F.when(F.col("k") <= F.col("sum") % F.col("rows"), 1).otherwise(0)).cast("int")).select("row", "each")
    return unboxed(one.unionByName(several).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("each")))), docs)
