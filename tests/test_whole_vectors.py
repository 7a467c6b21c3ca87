"""Area scores and joined distances of whole vectors against NumPy."""

import numpy as np
import pytest

from vecscore.plans import registry


def test_area_queries_use_every_dimension(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6)) + 1
    rows = [(k, [float(x) for x in v[k]], k % 3) for k in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    r, c = v[::3], {str(k): v[k] for k in range(60) if k % 3}
    inverse = np.linalg.inv(np.cov(r.T) + registry.REGULARIZATION * np.eye(6))
    area = {k: float((x - r.mean(axis=0)) @ inverse @ (x - r.mean(axis=0))) for k, x in c.items()}
    scored = {x["id"]: (x["area_distance"], x["relevance_score"]) for x in registry.QUERIES["area_score"](spark, str(tmp_path)).collect()}
    joined = {x["id"]: x["area_distance"] for x in registry.QUERIES["natural_join_distances"](spark, str(tmp_path)).collect()}
    assert set(scored) == set(joined) == set(area)
    for k, d in area.items():
        assert scored[k] == pytest.approx((d, np.exp(-0.05 * d)), abs=1e-6) and joined[k] == pytest.approx(d, abs=1e-6)
