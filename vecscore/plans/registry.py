"""Query registry: name -> callable(spark, sf_dir), with the DuckDB SQL of those that SQL can express.

The tables play these parts: ``embeddings`` of label 0 are the reference, the others
the corpus; ``documents`` are titles (first line) and abstracts (the rest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.demo import documents_as_corpus
from vecscore.functions.text import strip_tags
from vecscore.functions.vectors import all_finite, norm, similarity_cosine
from vecscore.operators import area, batchjobs, calibrate, cleaning, compare, cosine, embed, projection, relational
from vecscore.plans.sql import ORACLE_SQL  # noqa: F401
from vecscore.sources.providers import backend_config, embed_frame
from vecscore.staging import materialise, spread, work_dir

REGULARIZATION = 0.1  # of the areas: with 1e-6 nearly all scores of these vectors are 0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, embedding, label`` with the labels' parts."""
    part = F.when(F.col("label") == 0, "reference").otherwise("corpus")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), part.alias("label"))


def _units(spark, sf_dir, label):
    return cosine.unit_vectors(cosine.label_vectors(vectors(spark, sf_dir), label))


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _to_centroid(spark, sf_dir):
    corpus = _units(spark, sf_dir, "corpus")
    return corpus.select("id", cosine.distance_to(corpus, cosine.centroid(_units(spark, sf_dir, "reference"), "reference")).alias("distance"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cosine.score_columns(_to_centroid(spark, sf_dir))
    return scored.select("id", F.round("distance", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


def cosine_pairs(spark, sf_dir):
    return _rounded(cosine.cosine_pairs(_units(spark, sf_dir, "corpus"), _units(spark, sf_dir, "reference")), "distance")


def cosine_matrix(spark, sf_dir):
    return _rounded(cosine.reference_cosine(vectors(spark, sf_dir), "corpus", "reference", max_cells=1e12), "distance")


def cosine_to_reference_centroid(spark, sf_dir):
    return _rounded(_to_centroid(spark, sf_dir), "distance")


def cosine_from_corpus_centroid(spark, sf_dir):
    reference = _units(spark, sf_dir, "reference")
    return _rounded(reference.select("id", cosine.distance_to(reference, cosine.centroid(_units(spark, sf_dir, "corpus"), "corpus")).alias("distance")), "distance")


def cosine_centroid_corner(spark, sf_dir):
    c, r = (cosine.centroid(_units(spark, sf_dir, x), x) for x in ("corpus", "reference"))
    return spark.range(1).select(F.round(F.lit(float(1 - c @ r)), 6).alias("distance"))


def score_cosine_linear(spark, sf_dir):
    return _rounded(cosine.score_columns(_to_centroid(spark, sf_dir)), "distance")


def score_cosine_exponential(spark, sf_dir):
    return _rounded(cosine.score_columns(_to_centroid(spark, sf_dir), "exponential", 2.0), "distance")


def _cleaned(spark, sf_dir, **options):
    rows = cleaning.clean_abstract_for_embedding(documents_as_corpus(_table(spark, sf_dir, "documents")), **options)
    return rows.select("id", F.md5("text").alias("text_md5"), *cleaning.FLAGS)


def clean_lenient(spark, sf_dir):
    return _cleaned(spark, sf_dir, mode="lenient")


def clean_balanced(spark, sf_dir):
    return _cleaned(spark, sf_dir, mode="balanced")


def clean_strict(spark, sf_dir):
    return _cleaned(spark, sf_dir, mode="strict")


def clean_policy_discard(spark, sf_dir):
    return _cleaned(spark, sf_dir, mode="balanced", no_abstract_policy="discard")


def clean_policy_conditional(spark, sf_dir):
    return _cleaned(spark, sf_dir, mode="balanced", no_abstract_policy="conditional")


def clean_flags(spark, sf_dir):
    rows = _cleaned(spark, sf_dir, mode="strict")
    return rows.groupBy("text_quality", "discard_reason").agg(F.count(F.lit(1)).alias("n"))


def strip_html_pages(spark, sf_dir):
    text = strip_tags(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


def _scores(spark, sf_dir):
    n = F.length(F.coalesce("text", F.lit(""))).cast("double")
    scores = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), (n / (n + F.lit(1500.0))).alias("relevance_score"))
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").alias("label"))
    return calibrate.labelled(scores, labels)


def calibrate_curve(spark, sf_dir):
    rows = _scores(spark, sf_dir)
    curve = calibrate.threshold_curve(rows, calibrate.threshold_grid(rows))
    return _rounded(curve.select(F.col("i").cast("long").alias("i"), "threshold", "tp", "fp", "fn", "precision", "recall", "f1"), "threshold", "precision", "recall", "f1")


def calibrate_f1(spark, sf_dir):
    rows = _scores(spark, sf_dir)
    curve = calibrate.threshold_curve(rows, calibrate.threshold_grid(rows))
    best = curve.orderBy(F.desc("f1"), "i").limit(1)
    return _rounded(best.select("threshold", "precision", "recall", "f1"), "threshold", "precision", "recall", "f1")


def calibrate_precision_at_recall(spark, sf_dir):
    rows = _scores(spark, sf_dir)
    curve = calibrate.threshold_curve(rows, calibrate.threshold_grid(rows))
    value = F.when(F.col("recall") >= 0.8, F.col("precision")).otherwise(float("-inf"))
    best = curve.orderBy(value.desc(), "i").limit(1)
    return _rounded(best.select("threshold", "precision", "recall", "f1"), "threshold", "precision", "recall", "f1")


def area_mean(spark, sf_dir):
    mean = cosine.mean_vector(cosine.label_vectors(vectors(spark, sf_dir), "reference"))
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(float(x)) for x in mean])).alias("k", "mu")).select((F.col("k") + 1).cast("long").alias("dim"), F.round("mu", 6).alias("mu"))


def area_covariance(spark, sf_dir):
    reference = cosine.label_vectors(vectors(spark, sf_dir), "reference")
    sigma = area.covariance(reference, cosine.mean_vector(reference))
    flat = spark.range(1).select(F.posexplode(F.array(*[F.lit(float(x)) for x in sigma.ravel()])).alias("k", "cov"))
    d = len(sigma)
    return flat.select((F.floor(F.col("k") / d) + 1).cast("long").alias("i"), (F.col("k") % d + 1).cast("long").alias("j"), F.round("cov", 6).alias("cov"))


def _plane(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("embedding", F.slice("embedding", 1, 2))


def area_distance_2d(spark, sf_dir):
    df = _plane(spark, sf_dir)
    return _rounded(area.corpus_area_distance(df, area.fit_reference_area(df, "reference", REGULARIZATION)), "area_distance", digits=4)


def area_distance_full(spark, sf_dir):
    df = vectors(spark, sf_dir)
    return _rounded(area.corpus_area_distance(df, area.fit_reference_area(df, "reference", REGULARIZATION)), "area_distance")


def area_score(spark, sf_dir):
    df = vectors(spark, sf_dir)
    found = area.corpus_area_distance(df, area.fit_reference_area(df, "reference", REGULARIZATION))
    return _rounded(area.area_score(found, 0.05), "relevance_score", "area_distance")


def _prepared(spark, sf_dir):
    return cleaning.clean_abstract_for_embedding(documents_as_corpus(_table(spark, sf_dir, "documents")), mode="balanced")


def _prepared_once(spark, sf_dir):
    """The prepared rows, and those of them that are embedded already: the rows of English documents. The texts are cleaned once."""
    prepared = materialise(_prepared(spark, sf_dir).select("id", "text", "text_hash"), "prepared")
    english = _table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select(F.col("doc_id").cast("string").alias("id"))
    return prepared, prepared.select("id", "text_hash").join(english, "id", "left_semi")


def changed_rows(spark, sf_dir):
    return relational.changed_rows(*_prepared_once(spark, sf_dir)).select("id", F.md5("text").alias("text_md5"))


def dry_run_preview(spark, sf_dir):
    corpus = documents_as_corpus(_table(spark, sf_dir, "documents"))
    prepared, existing = _prepared_once(spark, sf_dir)
    rows = embed.dry_run_preview(corpus, prepared, relational.changed_rows(prepared, existing))
    return rows.select("id", F.md5("title_original").alias("title_md5"), F.md5("abstract_original").alias("abstract_md5"), "cleaned_title", F.md5("cleaned_abstract").alias("cleaned_md5"), F.md5("text").alias("text_md5"), "would_embed")


def _generations(spark, sf_dir):
    """Three shards: all vectors, those of labels 1 to 5, and those of label 5, each vector as the sum of its numbers."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("v"))
    shard = lambda df, k: df.select("id", F.lit(k).alias("batch"), F.round(F.col("v") + k, 4).alias("v"))
    return shard(rows, 1).unionByName(shard(rows.filter("label BETWEEN 1 AND 5"), 2)).unionByName(shard(rows.filter("label = 5"), 3))


def keep_newest(spark, sf_dir):
    return relational.keep_newest(_generations(spark, sf_dir))


def superseded_rows(spark, sf_dir):
    return relational.superseded(_generations(spark, sf_dir))


def duplicate_ids(spark, sf_dir):
    return relational.duplicate_ids(_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id")))


def natural_join_distances(spark, sf_dir):
    return relational.distances(cosine_to_reference_centroid(spark, sf_dir), area_distance_full(spark, sf_dir))


def _two_sides(spark, sf_dir):
    direct = vectors(spark, sf_dir).select("id", "embedding")
    return direct, direct.withColumn("embedding", F.transform("embedding", lambda x: x * 0.9 + 0.01))


def compare_embeddings(spark, sf_dir):
    return _rounded(compare.compare_embeddings(*_two_sides(spark, sf_dir)), "cosine_similarity", "max_abs_diff")


def compare_summary(spark, sf_dir):
    return _rounded(compare.compare_summary(compare.compare_embeddings(*_two_sides(spark, sf_dir))), "mean_cosine_similarity", "min_cosine_similarity", "max_abs_diff")


def similarity_neighbours(spark, sf_dir):
    """Cosine of each vector with its reverse, by the column function."""
    return vectors(spark, sf_dir).select("id", F.round(similarity_cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("similarity"))


def batch_request_lines(spark, sf_dir):
    """Size and digest of each request, its id's hash cut out: SQL has no such hash (tests compare it with xxhash's)."""
    lines = batchjobs.request_lines(_prepared(spark, sf_dir), "model-x")
    plain = F.regexp_replace("request_line", '"cid_[0-9a-f]{16}"', '"cid"')
    return lines.select("id", F.length("custom_id").cast("long").alias("custom_id_chars"), F.md5(plain).alias("line_md5"), "request_bytes")


def batch_job_plan(spark, sf_dir):
    lines = batchjobs.request_lines(_prepared(spark, sf_dir).select("id", "text", "text_hash"), "model-x")
    plan = batchjobs.plan_jobs(materialise(lines.select("id", "request_bytes"), "requests"), 100, 1 << 20)
    return plan.groupBy(F.col("job").cast("long").alias("job")).agg(F.count(F.lit(1)).alias("requests"), F.sum("request_bytes").alias("bytes"))


def batch_parse_output(spark, sf_dir):
    body = F.struct(F.struct(F.array(F.struct("embedding")).alias("data")).alias("body"))
    lines = vectors(spark, sf_dir).select(F.to_json(F.struct(F.concat(F.lit("cid_"), "id").alias("custom_id"), body.alias("response"))).alias("value"))
    return batchjobs.parse_output(spark, lines).select("custom_id", F.size("embedding").cast("long").alias("dim"), F.round(F.col("embedding")[0], 6).alias("v1"))


def batch_collected_rows(spark, sf_dir):
    """Results of a job with what its manifest says of them."""
    body = F.struct(F.struct(F.array(F.struct("embedding")).alias("data")).alias("body"))
    rows = vectors(spark, sf_dir)
    lines = rows.select(F.to_json(F.struct(F.concat(F.lit("cid_"), "id").alias("custom_id"), body.alias("response"))).alias("value"))
    manifest = rows.select(F.concat(F.lit("cid_"), "id").alias("custom_id"), "id", F.concat(F.lit("hash of "), "id").alias("text_hash"), F.col("label").alias("part"))
    found = batchjobs.join_manifest(batchjobs.parse_output(spark, lines), manifest, "openai", "model-x")
    return found.select("id", "text_hash", "provider", "model_id", "part", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def queued_requests(spark, sf_dir):
    """What a submission sends while a job with the English rows runs and one with the French rows has failed: all but the former."""
    lines = materialise(batchjobs.request_lines(_prepared(spark, sf_dir), "model-x").select("id", "custom_id", "request_bytes"), "requests")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    jobs = []
    for lang, status in (("en", "in_progress"), ("fr", "failed")):
        path = work_dir(spark)
        lines.join(docs.filter(F.col("lang") == lang), "id").select("custom_id").write.parquet(path)
        jobs.append({"manifest_parquet": path, "status": status, "ingested_at": ""})
    return lines.join(batchjobs.queued_ids(spark, {"jobs": jobs}), "custom_id", "left_anti").select("id", "request_bytes")


def distance_neighbours(spark, sf_dir):
    """Cosine distance of each vector to its reverse."""
    return vectors(spark, sf_dir).select("id", F.round(1 - similarity_cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("distance"))


def usable_vectors(spark, sf_dir):
    """Of each label how many vectors there are, of which length, and how many can't be used for cosines."""
    rows = _table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    bad = ~all_finite(F.col("v")) | (norm(F.col("v")) == 0)
    return rows.groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).cast("long").alias("dim"), F.sum(bad.cast("long")).alias("bad"))


def label_lookup(spark, sf_dir):
    df = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label")
    known = df.filter("label IN (0, 1)").select("id", F.when(F.col("label") == 0, "reference").otherwise("corpus").alias("label"))
    return relational.with_group(df.select("id"), relational.resolve_labels(spark, known))


def sample_rows(spark, sf_dir):
    return relational.sample_rows(vectors(spark, sf_dir).select("id", "label"), 100)


def local_embeddings(spark, sf_dir):
    """The offline embedder over all prepared texts."""
    found = embed_frame(_prepared(spark, sf_dir).select("id", "text"), backend_config("local"))
    return found.select("id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"))


def pca_projection(spark, sf_dir):
    return projection.pca_projection(vectors(spark, sf_dir).drop("label"))


def umap_projection(spark, sf_dir):
    return projection.umap_projection(vectors(spark, sf_dir).drop("label"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship, cosine_pairs, cosine_matrix, cosine_to_reference_centroid, cosine_from_corpus_centroid, cosine_centroid_corner, score_cosine_linear, score_cosine_exponential,
        clean_lenient, clean_balanced, clean_strict, clean_policy_discard, clean_policy_conditional, clean_flags, strip_html_pages, calibrate_f1, calibrate_precision_at_recall, calibrate_curve,
        area_mean, area_covariance, area_distance_2d, area_distance_full, area_score, changed_rows, dry_run_preview, keep_newest, superseded_rows, duplicate_ids, natural_join_distances,
        compare_embeddings, compare_summary, similarity_neighbours, batch_request_lines, batch_job_plan, batch_parse_output, batch_collected_rows, queued_requests, distance_neighbours, usable_vectors, label_lookup, sample_rows, local_embeddings, pca_projection, umap_projection,
    )
}
