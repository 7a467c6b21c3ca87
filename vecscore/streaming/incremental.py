"""Structured Streaming over a corpus folder: every micro-batch embeds its new and changed rows into a shard of its own.

A micro-batch that is run again finds its rows' hashes in the table already and
embeds nothing, so the sink is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecscore.operators.embed import existing_hashes, prepare_rows, prune_superseded, utc_now, write_shard
from vecscore.operators.relational import changed_rows
from vecscore.project import Project, required_text
from vecscore.sources.providers import BackendConfig, backend_info, embed_frame

SCHEMA = "id string, title string, abstract string"


def embed_increment(rows: DataFrame, project: Project, backend: BackendConfig, label: str, save_text: bool = True) -> int:
    """Embed what of ``rows`` is new or changed. Returns how many.

    Of rows that share an id those of the newest file count (``_at``, if they have it); if these
    differ still, no order tells which one holds, and the micro-batch fails as a batch run does.
    """
    spark = rows.sparkSession
    if "_at" in rows.columns:
        newest = rows.groupBy(F.col("id").alias("_id")).agg(F.max("_at").alias("_newest"))
        rows = rows.join(newest, F.col("id").eqNullSafe(F.col("_id"))).filter("_at = _newest")
    info = backend_info(backend)
    label_dir = project.label_dir(info["model_id"], label)
    prepared = prepare_rows(rows.select("id", "title", "abstract").distinct())
    existing = existing_hashes(spark, project, label_dir)
    changed = prepared if existing is None else changed_rows(prepared, existing)
    n = changed.count()
    if n:
        found = embed_frame(changed, backend).select("id", "text_hash", F.lit(backend.provider).alias("provider"), F.lit(info["model_id"]).alias("model_id"), F.lit(utc_now()).alias("created_at"), *(["text"] if save_text else []), "embedding")
        staged = f"{label_dir}/.staged.tmp"
        project.files.delete(staged)
        found.write.parquet(staged)
        write_shard(spark.read.parquet(staged), project, label_dir)
        project.files.delete(staged)
        prune_superseded(spark, project, label_dir)
    return n


def stream_embeddings(spark: SparkSession, project_dir: str, backend: BackendConfig, corpus_name: str = "corpus", label: str | None = None, checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Start a stream over ``<project>/<corpus>``; ``once`` works off what is there and stops."""
    project = Project(spark, project_dir)
    label = required_text("label", label or corpus_name)
    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(project.path(corpus_name)).select("*", F.col("_metadata.file_modification_time").alias("_at"))
    writer = stream.writeStream.foreachBatch(lambda df, _: embed_increment(df, project, backend, label) and None)
    writer = writer.option("checkpointLocation", checkpoint or project.path("_stream", corpus_name))
    return (writer.trigger(availableNow=True) if once else writer).start()
