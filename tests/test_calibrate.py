"""Thresholds: strict comparison, both metrics, grids, and brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vecscore import api
from vecscore.operators import calibrate


def scores(spark, values):
    return spark.createDataFrame([(f"S{k}", float(v)) for k, v in enumerate(values)], "id string, relevance_score double")


def labels(spark, values):
    return spark.createDataFrame([(f"S{k}", v) for k, v in enumerate(values)], "id string, label int")


def brute(values, marks, thresholds):
    out = []
    for t in thresholds:
        tp = sum(v > t and y == 1 for v, y in zip(values, marks, strict=True))
        fp = sum(v > t and y != 1 for v, y in zip(values, marks, strict=True))
        fn = sum(v <= t and y == 1 for v, y in zip(values, marks, strict=True))
        out.append((tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0))
    return out


def test_precision_at_recall(spark):
    found = api.calibrate(scores(spark, [0.9, 0.7, 0.2, 0.1]), labels(spark, [1, 1, 0, 0]), metric="precision_at_recall", recall_min=0.5, thresholds=[0.2, 0.5, 0.8])
    assert found.th == 0.2 and found.precision == 1 and found.precision_curve == [1, 1, 1] and found.recall_curve == [1, 1, 0.5]


def test_grid_and_unlabelled_rows(spark, tmp_path):
    values = [*np.linspace(0.95, 0.65, 6), *np.linspace(0.4, 0.1, 6), float("nan")]
    scores(spark, values).write.parquet(str(tmp_path / "s"))
    labels(spark, [1] * 6 + [0] * 6).write.parquet(str(tmp_path / "l"))
    found = api.calibrate_threshold(spark, str(tmp_path / "s"), str(tmp_path / "l"), n_thresholds=11)
    assert found.thresholds[0] == pytest.approx(0.1) and found.thresholds[-1] == 0.95
    assert found.f1 == 1 and 0.4 - 1e-9 < found.th <= 0.65
    with pytest.raises(ValueError, match="no score has a label"):
        api.calibrate(scores(spark, [0.5]), spark.createDataFrame([("other", 1)], "id string, label int"))
    with pytest.raises(ValueError, match="labels need id and label"):
        api.calibrate(scores(spark, [0.5]), spark.createDataFrame([("S0",)], "id string"))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.5000001, 0.9]), st.integers(0, 1)), min_size=1, max_size=12), st.lists(st.sampled_from([-1.0, 0.0, 0.1, 0.3, 0.5, 0.9, 2.0]), min_size=1, max_size=7))
def test_curve_is_that_of_brute_force(spark, rows, thresholds):
    values, marks = [v for v, _ in rows], [y for _, y in rows]
    found = api.calibrate(scores(spark, values), labels(spark, marks), thresholds=thresholds)
    want = brute(values, marks, thresholds)
    assert found.precision_curve == pytest.approx([p for p, _ in want]) and found.recall_curve == pytest.approx([r for _, r in want])
    assert found.thresholds == thresholds


def test_buckets_search_all_sizes(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(-5, 40)], "v double")
    for n in (1, 2, 3, 7, 8, 13):
        grid = [k / 3 for k in range(n)]
        assert all(r["bucket"] == sum(g < r["v"] for g in grid) for r in calibrate.below(df, "v", grid).collect())
