"""Corpus by reference cosine distances, with a centroid on either side.

The long form (corpus_id, reference_id, distance) is the canonical one. References that
fit one block of ``BLOCK_BYTES`` are sent to all tasks and multiplied with the
corpus's vectors batch by batch, so the corpus is never shuffled and the matrix streams
out. More references never come to the driver: both sides are dealt into blocks of
``SIDE`` rows, and each pair of blocks meets in one task.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.functions.vectors import all_finite, dot, norm, to_array
from vecscore.project import Project, model_part, path_part, read_embeddings, required_text, scored_dir

CENTROID = "centroid"
#: Bytes of one reference block (as doubles) that is sent to the tasks.
BLOCK_BYTES = 64 << 20
#: Rows of a block where both sides are dealt out: a task holds the products of two.
SIDE = 1024


def label_vectors(embeddings: DataFrame, label: str, *carried: str) -> DataFrame:
    """``id, embedding`` of one label, and other columns asked for; the filter reaches the partition columns."""
    part = embeddings.filter(F.col("label").isin(label, path_part(label)))
    return to_array(part).select(F.col("id").cast("string").alias("id"), "embedding", *carried)


def unit_vectors(df: DataFrame) -> DataFrame:
    n = norm(F.col("embedding"))
    return df.withColumn("embedding", F.transform("embedding", lambda x: x / n))


def check_side(df: DataFrame, side: str, label: str) -> tuple[int, int]:
    """Rows and dimension of a side, after one pass that finds what can't be used."""
    n = norm(F.col("embedding"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"), F.min(F.size("embedding")).alias("low"), F.sum(F.when(~all_finite(F.col("embedding")) | (n == 0), 1).otherwise(0)).alias("bad")).first()
    if not row["n"]:
        raise ValueError(f"{side}_label {label!r} has no vectors")
    if df.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError(f"an id of {side}_label {label!r} has several vectors")
    if row["bad"]:
        raise ValueError(f"{row['bad']} vectors of {side}_label {label!r} have no direction: zero or not finite")
    if row["dim"] != row["low"]:
        raise ValueError(f"vectors of {side}_label {label!r} have {row['low']} to {row['dim']} numbers")
    return row["n"], row["dim"]


def mean_vector(df: DataFrame) -> np.ndarray:
    """Mean of the vectors: a partial sum per task, then one row per task is added up."""

    def sums(batches):
        total, n = None, 0
        for batch in batches:
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)) if batch.num_rows else None
            if x is not None:
                total, n = (x.sum(axis=0) if total is None else total + x.sum(axis=0)), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([n], pa.int64())], names=["total", "n"])

    part = df.select("embedding").mapInArrow(sums, "total array<double>, n long")
    added = part.select("n", F.posexplode("total").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("k").collect()  # a row per dimension
    return np.array([r["x"] for r in added]) / added[0]["n"] if added else np.zeros(0)


def centroid(unit: DataFrame, side: str) -> np.ndarray:
    mean = mean_vector(unit)
    size = float(np.sqrt((mean**2).sum()))
    if not size or not np.isfinite(size):
        raise ValueError(f"the {side} vectors cancel out: their centroid has no direction")
    return mean / size


def distance_to(df: DataFrame, vector: np.ndarray) -> Column:
    """Cosine distance of the unit vectors in ``df`` to a unit vector."""
    return F.lit(1.0) - dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector]))


PAIRS = "corpus_id string, reference_id string, distance double"


def _products(corpus_ids: pa.ChunkedArray, x: np.ndarray, ids: list[str], matrix: np.ndarray):
    """Arrow batches of all distances of some corpus rows, about a million at a time."""
    step = max(1, 1_000_000 // max(1, len(ids)))
    for at in range(0, len(x), step):
        d = 1 - x[at : at + step] @ matrix.T
        own = pa.array(np.repeat(corpus_ids[at : at + step], len(ids)), pa.string())
        yield pa.RecordBatch.from_arrays([own, pa.array(ids * len(d), pa.string()), pa.array(d.ravel())], names=["corpus_id", "reference_id", "distance"])


def cosine_pairs(corpus: DataFrame, reference: DataFrame, dim: int | None = None) -> DataFrame:
    """``corpus_id, reference_id, distance`` of all pairs of unit vectors."""
    dim = dim or corpus.agg(F.max(F.size("embedding"))).first()[0] or 1
    n = reference.count()
    if 8 * dim * n > BLOCK_BYTES:
        return _dealt_pairs(corpus, reference, corpus.count(), n)
    block = reference.orderBy("id").toPandas()  # at most BLOCK_BYTES
    if not len(block):
        return corpus.sparkSession.createDataFrame([], PAIRS)
    ids, matrix = block["id"].tolist(), np.stack(block["embedding"].to_numpy())

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _products(batch.column(0).to_numpy(zero_copy_only=False), np.stack(batch.column(1).to_numpy(zero_copy_only=False)), ids, matrix)

    return corpus.select("id", "embedding").mapInArrow(run, PAIRS)


def _dealt_pairs(corpus: DataFrame, reference: DataFrame, n_corpus: int, n_reference: int) -> DataFrame:
    """The same by pairs of blocks. A row is sent once for each block of the other side, a thousandth of what the pairs take."""
    rows, columns = max(1, -(-n_corpus // SIDE)), max(1, -(-n_reference // SIDE))

    def dealt(df: DataFrame, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        return df.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(theirs)).select("id", "embedding", "i", "j")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"corpus_id": pa.array([], pa.string()), "reference_id": pa.array([], pa.string()), "distance": pa.array([], pa.float64())})
        x, y = (np.stack(t.column("embedding").to_numpy(zero_copy_only=False)) for t in (left, right))
        return pa.Table.from_batches(_products(left.column("id").to_numpy(zero_copy_only=False), x, right.column("id").to_pylist(), y))

    sides = dealt(corpus, rows, columns, "i", "j").groupBy("i", "j"), dealt(reference, columns, rows, "j", "i").groupBy("i", "j")
    return sides[0].cogroup(sides[1]).applyInArrow(run, PAIRS)


def reference_cosine(embeddings: DataFrame, corpus_label: str, reference_label: str, max_cells: float = 5e7) -> DataFrame:
    """All distances in the long form, with the centroid column, row and corner."""
    corpus, reference = label_vectors(embeddings, corpus_label), label_vectors(embeddings, reference_label)
    n_r, dim = check_side(reference, "reference", reference_label)
    n_c, _ = check_side(corpus, "corpus", corpus_label)
    if reference.filter(F.col("id") == CENTROID).limit(1).count():
        raise ValueError(f"{CENTROID!r} is the centroid's own id; a reference has it too")
    if (n_c + 1) * (n_r + 1) > max_cells:
        raise ValueError(f"Cosine matrix would hold {(n_c + 1) * (n_r + 1)} cells, more than `max_cells`.")
    corpus, reference = unit_vectors(corpus), unit_vectors(reference)
    rc, cc = centroid(reference, "reference"), centroid(corpus, "corpus")
    spark = embeddings.sparkSession
    column = corpus.select(F.col("id").alias("corpus_id"), F.lit(CENTROID).alias("reference_id"), distance_to(corpus, rc).alias("distance"))
    row = reference.select(F.lit(CENTROID).alias("corpus_id"), F.col("id").alias("reference_id"), distance_to(reference, cc).alias("distance"))
    corner = spark.range(1).select(F.lit(CENTROID).alias("corpus_id"), F.lit(CENTROID).alias("reference_id"), F.lit(float(1 - cc @ rc)).alias("distance"))
    return cosine_pairs(corpus, reference, dim).unionByName(column).unionByName(row).unionByName(corner)


@contextmanager
def case_sensitive(spark: SparkSession):
    """Ids may differ in case only, and so may the wide form's columns; the session's setting comes back after the block."""
    name, before = "spark.sql.caseSensitive", spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def to_wide(pairs: DataFrame, value: str = "distance") -> DataFrame:
    """``id`` and a column per reference id, the centroid last. Where ids differ in case only, read and write it within :func:`case_sensitive`."""
    names = sorted((r[0] for r in pairs.select("reference_id").distinct().collect()), key=lambda x: (x == CENTROID, x))
    with case_sensitive(pairs.sparkSession):
        return pairs.groupBy(F.col("corpus_id").alias("id")).pivot("reference_id", names).agg(F.first(value))


def to_long(wide: DataFrame) -> DataFrame:
    values = [c for c in wide.columns if c != "id"]
    cells = F.array(*[F.struct(F.lit(c).alias("reference_id"), F.col(f"`{c}`").cast("double").alias("distance")) for c in values])
    return wide.select(F.col("id").alias("corpus_id"), F.inline(cells))


def distance_reference_cosine(spark: SparkSession, project_dir: str, embeddings_dir: str | None = None, corpus_label: str = "corpus", reference_label: str = "reference", max_cells: float = 5e7, wide: bool = True) -> str:
    """Write the matrix of a project's model and return its folder; an older one is replaced."""
    corpus_label, reference_label = required_text("corpus_label", corpus_label), required_text("reference_label", reference_label)
    if not max_cells > 0:
        raise ValueError(f"max_cells = {max_cells!r}: a number above 0 is needed")
    project = Project(spark, project_dir)
    folder, name = (project.path("embeddings", embeddings_dir), embeddings_dir) if embeddings_dir else project.resolve_model_dir()
    pairs = reference_cosine(read_embeddings(spark, folder), corpus_label, reference_label, max_cells)
    out = project.path("distance_reference_cosine", path_part(name) if embeddings_dir else model_part(folder, name), f"corpus_label={path_part(corpus_label)}", f"reference_label={path_part(reference_label)}")
    with case_sensitive(spark):
        (to_wide(pairs).coalesce(1) if wide else pairs).write.mode("overwrite").parquet(f"{out}/pairwise-cosine.parquet")
    return f"{out}/pairwise-cosine.parquet"


def score_columns(df: DataFrame, method: str = "linear", alpha: float = 1.0) -> DataFrame:
    """Every column but ``id`` as a score: ``1 - d`` or ``exp(-alpha d)``."""
    if method not in ("linear", "exponential"):
        raise ValueError(f"method {method!r} is unknown; there are linear and exponential")
    if method == "exponential" and not (isinstance(alpha, int | float) and alpha > 0):
        raise ValueError(f"alpha = {alpha!r}: exponential scores need a number above 0")
    if "id" not in df.columns:
        raise ValueError(f"distances have an id; this table has {df.columns}")
    values = [c for c in df.columns if c != "id"]
    if not values:
        raise ValueError("no distances beside the id")
    score = (lambda d: 1 - d) if method == "linear" else (lambda d: F.exp(-alpha * d))
    return df.select("id", *[score(F.col(f"`{c}`")).alias(c) for c in values])


def score_reference_cosine(spark: SparkSession, distance_parquet: str, output_dir: str | None = None, method: str = "linear", alpha: float = 1.0) -> str:
    distance_parquet = required_text("distance_parquet", distance_parquet)
    out = scored_dir(distance_parquet, output_dir)
    with case_sensitive(spark):
        df = score_columns(spark.read.option("pathGlobFilter", "*.parquet").parquet(distance_parquet), method, alpha)
        df.write.mode("overwrite").parquet(out)
    return out


def similarity_cosine(a, b):
    """Cosine of a vector with a vector, or with each row of a matrix; NaN where a norm is 0."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    scale = np.sqrt((a**2).sum()) * np.sqrt((b**2).sum(axis=-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale == 0, np.nan, (b @ a) / scale)[()]


def distance_cosine(a, b):
    return 1 - similarity_cosine(a, b)


def pairs_to_pandas(pairs: DataFrame) -> pd.DataFrame:
    """A small matrix for inspection."""
    with case_sensitive(pairs.sparkSession):
        return to_wide(pairs).toPandas()
