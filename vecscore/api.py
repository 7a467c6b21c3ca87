"""The public functions under one roof."""

from vecscore.demo import demo_finalize_openai_batch, demo_tables, run_demo, run_demo_openai
from vecscore.functions.sql import register_functions
from vecscore.operators.area import ReferenceAreaModel, distance_ridge, fit_ridge, score_ridge
from vecscore.operators.batchjobs import batch_collect_openai, batch_status_openai, batch_submit_openai
from vecscore.operators.calibrate import calibrate, calibrate_threshold
from vecscore.operators.cleaning import clean_abstract_for_embedding
from vecscore.operators.compare import compare_embeddings, compare_summary
from vecscore.operators.cosine import distance_cosine, distance_reference_cosine, score_reference_cosine, similarity_cosine
from vecscore.operators.embed import embed_corpus, pandas_preprocessor
from vecscore.operators.projection import pca_projection, plot_embeddings_pca, plot_embeddings_umap, umap_projection
from vecscore.operators.relational import distances
from vecscore.sources.providers import backend_config, backend_embed_texts, backend_info, backend_read, backend_save, backend_specter2_tei, embed_texts
from vecscore.streaming.incremental import stream_embeddings

__all__ = [
    "ReferenceAreaModel", "backend_config", "backend_embed_texts", "backend_info", "backend_read", "backend_save", "backend_specter2_tei", "batch_collect_openai", "batch_status_openai", "batch_submit_openai",
    "calibrate", "calibrate_threshold", "clean_abstract_for_embedding", "compare_embeddings", "compare_summary", "demo_finalize_openai_batch", "demo_tables", "distance_cosine", "distance_reference_cosine", "distance_ridge", "distances",
    "embed_corpus", "embed_texts", "fit_ridge", "pandas_preprocessor", "pca_projection", "plot_embeddings_pca", "plot_embeddings_umap", "register_functions", "run_demo", "run_demo_openai", "score_reference_cosine", "score_ridge", "similarity_cosine", "stream_embeddings", "umap_projection",
]
