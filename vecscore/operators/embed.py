"""Incremental embedding: only new and changed rows are embedded, into a new shard; older rows of theirs go after that."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.functions.vectors import to_columns
from vecscore.operators.cleaning import clean_abstract_for_embedding, parse_text
from vecscore.operators.relational import changed_rows, keep_newest
from vecscore.project import Project, path_part, read_dataset, required_text
from vecscore.sources.providers import BackendConfig, backend_info, embed_frame
from vecscore.staging import materialise


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def read_corpus(spark: SparkSession, project: Project, corpus_name: str) -> DataFrame:
    df = read_dataset(spark, project.path(corpus_name), strict=True)
    missing = [c for c in ("id", "title", "abstract") if c not in df.columns]
    if missing:
        raise ValueError(f"corpus {corpus_name!r} lacks {missing}")
    return df.select(F.trim(F.col("id").cast("string")).alias("id"), "title", "abstract")


def prepare_rows(corpus: DataFrame, text_preprocessor: Callable | None = None, cleaner_args: dict | None = None) -> DataFrame:
    """Checked ``id, text, text_hash`` and extra columns of the preprocessor; ids are checked over the whole corpus.

    The rows are written once: whoever counts, compares or embeds them doesn't clean the texts again.
    """
    if cleaner_args is not None and not isinstance(cleaner_args, dict):
        raise ValueError(f"cleaner_args is a dict of arguments, not {type(cleaner_args).__name__}")
    run = text_preprocessor or clean_abstract_for_embedding
    if not callable(run):
        raise ValueError(f"text_preprocessor can't be called: {run!r}")
    df = run(corpus, **(cleaner_args or {}))
    if not isinstance(df, DataFrame):
        raise ValueError(f"text_preprocessor gave {type(df).__name__}, not a DataFrame")
    missing = [c for c in ("id", "text", "text_hash") if c not in df.columns]
    if missing:
        raise ValueError(f"text_preprocessor's rows lack {missing}")
    df = df.withColumn("id", F.trim(F.col("id").cast("string"))).filter("id IS NOT NULL AND id <> '' AND text IS NOT NULL AND text <> ''")
    df = materialise(df, "prepared")
    if text_preprocessor is not None and df.join(corpus.select("id"), "id", "left_anti").limit(1).count():
        raise ValueError("text_preprocessor made ids that the corpus doesn't have")
    if df.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("an id has more than one prepared row")
    return df


def pandas_preprocessor(run: Callable, extras: str = "") -> Callable:
    """A preprocessor from a function of pandas frames, which then gets Arrow batches of the corpus; ``extras`` names further columns (``"lang string"``)."""
    schema = "id string, text string, text_hash string" + (f", {extras}" if extras else "")

    def preprocess(df: DataFrame, **arguments) -> DataFrame:
        def frames(batches):
            for batch in batches:
                yield run(batch, **arguments)

        return df.mapInPandas(frames, schema)

    preprocess.__name__ = getattr(run, "__name__", "pandas_preprocessor")
    return preprocess


def existing_hashes(spark: SparkSession, project: Project, label_dir: str) -> DataFrame | None:
    """``id, text_hash``, the newest of each id; None without shards."""
    if not any(x.startswith("batch=") for x in project.files.children(label_dir)):
        return None
    df = read_dataset(spark, label_dir, merge=True)
    name = "text_hash" if "text_hash" in df.columns else "hash"  # older shards
    rows = df.select(F.col("id").cast("string").alias("id"), F.col(name).alias("text_hash"), F.col("batch").cast("int").alias("batch"))
    return keep_newest(rows).select("id", "text_hash")


def write_shard(df: DataFrame, project: Project, label_dir: str) -> int:
    """``df`` as the next ``batch=<n>`` of a label; never over an older one. Vectors become V1..Vd."""
    batch = project.next_batch(label_dir)
    dim = df.agg(F.max(F.size("embedding")).alias("d"), F.min(F.size("embedding")).alias("m")).first()
    if dim["d"] != dim["m"]:
        raise ValueError(f"vectors of {dim['m']} to {dim['d']} numbers can't share a shard")
    to_columns(df, dim["d"]).write.mode("errorifexists").parquet(f"{label_dir}/batch={batch}")
    return batch


def prune_superseded(spark: SparkSession, project: Project, label_dir: str) -> int:
    """Drop rows of older shards whose id a newer shard has; shards left empty go. Returns the rows dropped.

    One pass over ids and shard numbers finds what is superseded; only shards with such rows
    are rewritten. The kept rows join the shard's files before the old files go, so a
    broken run leaves rows twice but never loses a vector; the next run tidies up.
    """
    shards = [x for x in project.files.children(label_dir) if x.startswith("batch=")]
    if not shards:
        return 0
    rows = read_dataset(spark, label_dir, merge=True).select(F.col("id").cast("string").alias("id"), F.col("batch").cast("int").alias("batch"))
    per_id = rows.groupBy("id", "batch").agg(F.count(F.lit(1)).alias("n"))
    newest = rows.groupBy("id").agg(F.max("batch").alias("newest"))
    found = f"{label_dir}/.superseded.tmp"
    project.files.delete(found)
    per_id.join(newest, "id").filter("batch < newest OR n > 1").select("id", "n", (F.col("batch") < F.col("newest")).alias("gone"), "batch").write.partitionBy("batch").parquet(found)
    dropped = 0
    for shard in sorted(x for x in project.files.children(found) if x.startswith("batch=")):
        path, here = f"{label_dir}/{shard}", spark.read.parquet(f"{found}/{shard}")
        gone = here.filter("gone").select(F.col("id").alias("_gone"))
        own = read_dataset(spark, path)
        keep = own.join(gone, own["id"].cast("string") == gone["_gone"], "left_anti").dropDuplicates(["id"])
        dropped += here.agg(F.sum(F.when(F.col("gone"), F.col("n")).otherwise(F.col("n") - 1))).first()[0]
        rewrite_shard(project, keep, path, f"{label_dir}/.{shard}.tmp")
    project.files.delete(found)
    return dropped


def rewrite_shard(project: Project, keep: DataFrame, path: str, beside: str) -> None:
    """Replace a shard's files by those of ``keep``: written beside, moved in, and only then the old ones go; an empty shard goes as a whole."""
    files = project.files
    old = [x for x in files.children(path) if x.endswith(".parquet")]
    files.delete(beside)
    keep.write.parquet(beside)
    if keep.sparkSession.read.parquet(beside).limit(1).count():
        for name in files.children(beside):
            if name.endswith(".parquet"):
                files.rename(f"{beside}/{name}", f"{path}/{name}")
        for name in old:
            files.delete(f"{path}/{name}")
    else:
        files.delete(path)
    files.delete(beside)


def describe_preprocessor(run: Callable | None) -> str:
    return "clean_abstract_for_embedding" if run is None else getattr(run, "__name__", inspect.getmodule(run) and str(run) or "custom")


def embed_corpus(
    spark: SparkSession, project_dir: str, backend: BackendConfig, corpus_name: str = "corpus", batch_size: int = 5000, delete_existing: bool = False, text_preprocessor: Callable | None = None,
    cleaner_args: dict | None = None, save_text: bool = True, label: str | None = None, dry_run: bool = False,
) -> dict:
    """Embed the corpus's new and changed rows; a dry run only writes what would be done.

    ``batch_size`` is the most rows that a provider gets at once.
    """
    corpus_name, label = required_text("corpus_name", corpus_name), required_text("label", label or corpus_name)
    if not batch_size or batch_size <= 0:
        raise ValueError(f"batch_size = {batch_size!r}: rows above 0 are needed")
    project = Project(spark, project_dir)
    corpus = read_corpus(spark, project, corpus_name)
    info = backend_info(backend)
    if not info["model_id"]:
        raise ValueError(f"provider {backend.provider!r} doesn't say which model it runs")
    label_dir = project.label_dir(info["model_id"], label)
    if delete_existing and not dry_run:
        project.files.delete(label_dir)
    prepared = prepare_rows(corpus, text_preprocessor, cleaner_args)
    existing = None if delete_existing else existing_hashes(spark, project, label_dir)
    changed = prepared if existing is None else changed_rows(prepared, existing)
    if dry_run:
        return _dry_run(project, corpus, prepared, changed, corpus_name)
    meta = {"provider": backend.provider, "model": info["model_id"], "base_url": backend.base_url, "max_batch_size": info["max_batch_size"], "timeout": backend.timeout, "retries": backend.retries,
            "tei_url": backend.tei_url, "text_preprocessor": describe_preprocessor(text_preprocessor), "embedding_label": label}
    project.files.make(project.model_dir(info["model_id"]))
    project.files.write_yaml(f"{project.model_dir(info['model_id'])}/{Project.META}", meta)
    n = changed.count()
    batch, dropped = None, 0
    if n:
        tasks = max(1, min(n // batch_size + 1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
        extras = [c for c in changed.columns if c not in ("id", "text", "text_hash")]
        rows = embed_frame(changed.repartition(tasks, "id"), backend, portion=int(batch_size))
        rows = rows.select("id", "text_hash", F.lit(backend.provider).alias("provider"), F.lit(info["model_id"]).alias("model_id"), F.lit(utc_now()).alias("created_at"), *(["text"] if save_text else []), *extras, "embedding")
        # vectors cost: they are written once as they come, and read back for the shard
        staged = f"{label_dir}/.staged.tmp"
        project.files.delete(staged)
        rows.write.parquet(staged)
        batch = write_shard(spark.read.parquet(staged), project, label_dir)
        project.files.delete(staged)
        dropped = prune_superseded(spark, project, label_dir)
    return {"model_dir": project.model_dir(info["model_id"]), "label": label, "embedded_rows": n, "batch": batch, "superseded_rows": dropped}


def dry_run_preview(corpus: DataFrame, prepared: DataFrame, changed: DataFrame) -> DataFrame:
    """Originals, cleaned text and ``would_embed`` of every row that survives the cleaner."""
    originals = corpus.select("id", F.coalesce("title", F.lit("")).alias("title_original"), F.coalesce("abstract", F.lit("")).alias("abstract_original")).dropDuplicates(["id"])
    marked = prepared.select("id", "text", "text_hash").join(changed.select("id", F.lit(True).alias("would_embed")), "id", "left")
    rows = parse_text(marked.withColumn("would_embed", F.coalesce("would_embed", F.lit(False))))
    return rows.join(originals, "id").select("id", "title_original", "abstract_original", "cleaned_title", "cleaned_abstract", "text", "text_hash", "would_embed")


def _dry_run(project: Project, corpus: DataFrame, prepared: DataFrame, changed: DataFrame, corpus_name: str) -> dict:
    preview = dry_run_preview(corpus, prepared, changed)
    path = project.path(f"{path_part(corpus_name)}_dryrun.parquet")
    project.files.delete(path)
    n = preview.count()
    if n:
        preview.write.parquet(path)
    return {"preview": path if n else None, "rows": n, "would_embed": preview.filter("would_embed").count() if n else 0}
