"""Cosine matrices, reference areas, scores: small fixtures with known values."""

import math

import numpy as np
import pytest
import yaml

from vecscore import api
from vecscore.operators import area, cosine
from vecscore.operators.relational import distances
from vecscore.project import Project, read_dataset, read_embeddings, scored_dir

SIX = [("R1", [1.0, 0.1], "reference"), ("R2", [1.2, -0.1], "reference"), ("R3", [0.8, 0.05], "reference"), ("R4", [1.1, 0.0], "reference"), ("C1", [1.0, 0.0], "corpus"), ("C2", [-1.0, 0.2], "corpus")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<double>, label string")


def two_clusters():
    v1, cycle = np.linspace(0.85, 1.15, 40), [-0.08, -0.04, 0.0, 0.04, 0.08]
    rows = [(f"W{k + 1}", [float(v1[k]), cycle[k % 5]], "reference") for k in range(40)]
    return rows + [(f"W{k + 41}", [-float(v1[k]), cycle[::-1][k % 5]], "corpus") for k in range(40)]


@pytest.fixture()
def project(spark, tmp_path):
    rows = [(i, *v, label, 1 + k // 10) for k, (i, v, label) in enumerate(two_clusters())]
    folder = tmp_path / "p/embeddings/model_id=BAAI_bge-small-en-v1.5"
    spark.createDataFrame(rows, "id string, V1 double, V2 double, label string, batch int").write.partitionBy("label", "batch").parquet(str(folder))
    (folder / "embed_model.yaml").write_text(yaml.safe_dump({"provider": "hf", "model": "BAAI/bge-small-en-v1.5"}))
    return str(tmp_path / "p")


def test_vector_pairs():
    assert np.allclose(api.similarity_cosine([1, 0], [[1, 0], [0, 1], [-1, 0]]), [1, 0, -1])
    assert np.allclose(api.distance_cosine([1, 0], [[1, 0], [0, 1], [-1, 0]]), [0, 1, 2])
    assert math.isnan(api.similarity_cosine([0, 0], [1, 0]))


def test_matrix_of_a_project(spark, project):
    path = api.distance_reference_cosine(spark, project)
    wide = read_dataset(spark, path).toPandas().set_index("id")
    assert wide.shape == (41, 41)  # and the id column
    rows = two_clusters()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    r = np.mean([unit[i] for i, _, s in rows if s == "reference"], axis=0)
    c = np.mean([unit[i] for i, _, s in rows if s == "corpus"], axis=0)
    r, c = r / np.linalg.norm(r), c / np.linalg.norm(c)
    assert abs(wide.loc["W41", "W3"] - (1 - unit["W41"] @ unit["W3"])) < 1e-10
    assert abs(wide.loc["W50", "centroid"] - (1 - unit["W50"] @ r)) < 1e-10
    assert abs(wide.loc["centroid", "W7"] - (1 - unit["W7"] @ c)) < 1e-10
    assert abs(wide.loc["centroid", "centroid"] - (1 - c @ r)) < 1e-10
    scores = read_dataset(spark, api.score_reference_cosine(spark, path)).toPandas().set_index("id")
    assert np.allclose(scores[wide.columns].loc[wide.index], 1 - wide)
    long = cosine.to_long(read_dataset(spark, path))
    assert long.count() == 41 * 41


@pytest.mark.parametrize("rows,message", [
    (SIX + [("C1", [0.5, 0.5], "corpus")], "corpus_label 'corpus' has several"),
    (SIX + [("R1", [0.5, 0.5], "reference")], "reference_label 'reference' has several"),
    (SIX + [("Z", [0.0, 0.0], "corpus")], "corpus_label 'corpus' have no direction"),
    (SIX + [("Z", [0.0, 0.0], "reference")], "reference_label 'reference' have no direction"),
    (SIX + [("Z", [float("nan"), 0.0], "corpus")], "not finite"),
    ([x for x in SIX if x[2] == "corpus"], "reference_label"),
    ([x for x in SIX if x[2] == "reference"], "corpus_label"),
    ([("R1", [1.0, 0.0], "reference"), ("R2", [-1.0, 0.0], "reference"), ("C1", [1.0, 0.0], "corpus")], "reference vectors cancel"),
    ([("R1", [1.0, 0.0], "reference"), ("C1", [1.0, 0.0], "corpus"), ("C2", [-1.0, 0.0], "corpus")], "corpus vectors cancel"),
])
def test_cosine_refuses(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        cosine.reference_cosine(frame(spark, rows), "corpus", "reference")


def test_cosine_guard_and_orthogonal(spark):
    df = frame(spark, [("R1", [1.0, 0.0], "reference"), ("C1", [0.0, 1.0], "corpus")])
    with pytest.raises(ValueError, match="max_cells"):
        cosine.reference_cosine(df, "corpus", "reference", max_cells=3)
    found = {(r["corpus_id"], r["reference_id"]): r["distance"] for r in cosine.reference_cosine(df, "corpus", "reference").collect()}
    assert found[("C1", "R1")] == 1 and len(found) == 4


def test_blocks_of_references_give_the_same_pairs(spark, monkeypatch):
    df = frame(spark, two_clusters())
    sides = [cosine.unit_vectors(cosine.label_vectors(df, x)) for x in ("corpus", "reference")]
    whole = {(r[0], r[1]): r[2] for r in cosine.cosine_pairs(*sides).collect()}
    monkeypatch.setattr(cosine, "BLOCK_BYTES", 8 * 2 * 7)
    monkeypatch.setattr(cosine, "SIDE", 9)
    assert {(r[0], r[1]): r[2] for r in cosine.cosine_pairs(*sides).collect()} == pytest.approx(whole)


def test_case_of_ids_and_of_the_session(spark):
    df = frame(spark, [("r", [1.0, 0.1], "reference"), ("R", [0.5, 0.5], "reference"), ("C1", [0.0, 1.0], "corpus")])
    before = spark.conf.get("spark.sql.caseSensitive")
    assert list(cosine.pairs_to_pandas(cosine.reference_cosine(df, "corpus", "reference")).columns) == ["id", "R", "r", "centroid"]
    assert spark.conf.get("spark.sql.caseSensitive") == before


def test_distances_to_two_references_lie_side_by_side(spark, project):
    first = api.distance_ridge(spark, project, regularization=0.01)
    was = {r["id"]: r["area_distance"] for r in read_dataset(spark, first).collect()}
    folder = Project(spark, project).resolve_model_dir()[0]
    again = read_embeddings(spark, folder).filter("label = 'reference'")
    again.filter("id <> 'W1'").drop("label", "batch").write.parquet(f"{folder}/label=fewer/batch=1")
    second = api.distance_ridge(spark, project, reference_label="fewer", regularization=0.01)
    assert first != second and first.endswith("/corpus_label=corpus/reference_label=reference") and second.endswith("/corpus_label=corpus/reference_label=fewer") and "/distance_ridge/model_id=" in first
    assert {r["id"]: r["area_distance"] for r in read_dataset(spark, first).collect()} == was
    other = {r["id"]: r["area_distance"] for r in read_dataset(spark, second).collect()}
    assert set(other) == set(was) and other != was


def test_area_distances_and_scores(spark, project):
    out = api.distance_ridge(spark, project, regularization=0.01)
    rows = read_dataset(spark, out).collect()
    assert len(rows) == 40 and all(math.isfinite(r["area_distance"]) and r["area_distance"] >= 0 for r in rows)
    meta = yaml.safe_load(open(f"{out}/embed_model.yaml"))
    assert meta["ridge_reference_label"] == "reference" and meta["model"] == "BAAI/bge-small-en-v1.5"
    again = api.distance_ridge(spark, project, fit_path=f"{project}/ridge_fit.json")
    assert sorted(r["area_distance"] for r in read_dataset(spark, again).collect()) == pytest.approx(sorted(r["area_distance"] for r in rows))
    scores = read_dataset(spark, api.score_ridge(spark, out)).collect()
    assert all(0 <= r["relevance_score"] <= 1 for r in scores)
    assert scored_dir("/a/distance_x/m", None) == "/a/score_x/m" and scored_dir("/a/b", None) == "/a/score_b"


def test_area_fit_against_numpy(spark):
    df = frame(spark, SIX)
    model = area.fit_reference_area(df, regularization=1e-6)
    x = np.array([v for _, v, s in SIX if s == "reference"])
    assert np.allclose(model.mu, x.mean(axis=0)) and np.allclose(model.sigma_inv, np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(2)))
    d = {r["id"]: r["area_distance"] for r in area.corpus_area_distance(df, model).collect()}
    assert d["C2"] > d["C1"]
    assert np.allclose([d["C1"], d["C2"]], area.squared_mahalanobis([[1.0, 0.0], [-1.0, 0.2]], model))


def test_area_of_one_row_and_of_a_line(spark):
    with pytest.warns(UserWarning, match="no covariance"):
        model = area.fit_reference_area(frame(spark, SIX[:1]))
    assert model.mu == [1.0, 0.1] and np.allclose(model.sigma_inv, np.eye(2) / (1 + 1e-6))
    with pytest.raises(ValueError, match="singular"):
        area.fit_reference_area(frame(spark, [(f"R{k}", [float(k), 2.0 * k], "reference") for k in range(4)]), regularization=1e-30)
    with pytest.raises(ValueError, match="aren't finite"):
        area.fit_reference_area(frame(spark, [*SIX, ("R9", [float("inf"), 0.0], "reference")]))


def test_scores_of_tables(spark):
    wide = spark.createDataFrame([("A", 0.25), ("centroid", 0.5)], "id string, R1 double")
    assert [r["R1"] for r in cosine.score_columns(wide).orderBy("id").collect()] == [0.75, 0.5]
    assert cosine.score_columns(wide, "exponential", 2.0).orderBy("id").first()["R1"] == pytest.approx(math.exp(-0.5))
    with pytest.raises(ValueError, match="alpha"):
        cosine.score_columns(wide, "exponential", 0)
    rows = spark.createDataFrame([("A", 0.0), ("B", 2.0)], "id string, area_distance double")
    assert [r["relevance_score"] for r in area.area_score(rows, 1.0).orderBy("id").collect()] == pytest.approx([1.0, math.exp(-2)])


def test_bad_area_tables(spark, tmp_path):
    for name, rows, message in (("nan", [("A", float("nan"))], "aren't finite"), ("none", [], "no distances")):
        spark.createDataFrame(rows, "id string, area_distance double").write.parquet(str(tmp_path / name))
        with pytest.raises(ValueError, match=message):
            api.score_ridge(spark, str(tmp_path / name))


def test_natural_join(spark):
    a = spark.createDataFrame([("W1", 0.9), ("W2", 0.4), ("W3", -0.2)], "id string, distance double")
    b = spark.createDataFrame([("W2", 0.8), ("W3", 0.1), ("W4", 0.7)], "id string, relevance_score double")
    assert sorted(r["id"] for r in distances(a, b).collect()) == ["W2", "W3"]


def test_projections_of_next_to_nothing(spark):
    df = frame(spark, two_clusters()).drop("label")
    for n in (0, 1):
        some = df.limit(n)
        for points in (api.pca_projection(some, {"x": ["W1"]}), api.umap_projection(some, {"x": ["W1"]})):
            rows = points.collect()
            assert len(rows) == n and all((r[1], r[2]) == (0.0, 0.0) for r in rows)
    assert api.umap_projection(df.limit(2), n_epochs=3).count() == 2


def test_layout_keeps_clusters_apart(spark):
    from vecscore.operators import projection

    a, b = projection.curve_of(0.1)
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.01)  # the published fit
    i, j, w = projection.fuzzy_graph(np.array([[1, 2], [0, 2], [0, 1]]), np.array([[0.1, 0.2], [0.1, 0.3], [0.2, 0.3]]))
    assert list(zip(i, j, strict=True)) == [(0, 1), (0, 2), (1, 2)] and w[0] == pytest.approx(1) and (w <= 1).all()
    points = api.umap_projection(frame(spark, two_clusters()).drop("label"), n_neighbors=8, n_epochs=100).toPandas()
    side = points["id"].isin([f"W{k}" for k in range(1, 41)]).to_numpy()
    y = points[["U1", "U2"]].to_numpy()
    apart = np.linalg.norm(y[:, None] - y[None], axis=2) + np.diag(np.full(len(y), np.inf))
    assert (side[apart.argmin(axis=1)] == side).mean() >= 0.9  # nearly every point's nearest is of its own cluster


def test_projections(spark):
    df = frame(spark, two_clusters()).drop("label")
    points = api.pca_projection(df, {"reference": ["W1", "W2"], "corpus": ["W41"]}).toPandas()
    assert len(points) == 80 and abs(points["PC1"].mean()) < 1e-9 and sorted(set(points["group"])) == ["corpus", "other", "reference"]
    x = np.array([v for _, v, _ in two_clusters()])
    assert points["PC1"].var(ddof=1) == pytest.approx(np.linalg.eigvalsh(np.cov(x.T))[-1])
    assert list(api.umap_projection(df, n_epochs=5, sample_n=30).columns) == ["id", "U1", "U2", "group"]
    assert api.umap_projection(df, n_epochs=5, sample_n=30).count() == 30


def test_neighbours_are_those_of_all_pairs(spark, monkeypatch):
    from vecscore.operators import projection

    x = np.random.default_rng(5).normal(size=(300, 6))
    df = spark.createDataFrame([(f"{k:03d}", v.tolist()) for k, v in enumerate(x)], "id string, embedding array<double>")
    monkeypatch.setattr(projection, "BLOCK", 32)
    for metric, sent in (("cosine", 1 << 20), ("euclidean", 70 * 6 * 8)):  # the latter in five portions
        monkeypatch.setattr(projection, "SENT", sent)
        rows = projection.numbered(projection.unit_vectors(df) if metric == "cosine" else df)
        got = {r["place"]: r for r in projection.nearest_neighbours(rows, 300, 7, metric).collect()}
        y = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = (1 - y @ y.T if metric == "cosine" else np.linalg.norm(x[:, None] - x[None], axis=2)) + np.diag(np.full(300, np.inf))
        assert [(r["place"], r["id"]) for r in rows.orderBy("place").collect()] == [(k, f"{k:03d}") for k in range(300)]
        for k in range(300):
            want = np.argsort(d[k])[:7]
            assert got[k]["near"] == want.tolist() and got[k]["d"] == pytest.approx(d[k][want])


def test_copies_have_neighbours_close_by(monkeypatch):
    from vecscore.operators import projection

    monkeypatch.setattr(projection, "BLOCK", 32)
    x = np.tile([[0.6, 0.8]], (320, 1))
    near = np.concatenate([projection.closest(x[k : k + 16], np.arange(k, k + 16), x, 0, 5, "cosine")[0] for k in range(0, 320, 16)])
    assert (near >= 0).all() and (near != np.arange(320)[:, None]).all()
    assert np.bincount(near.ravel(), minlength=320).max() <= 64  # no point is everybody's neighbour


def test_layout_of_more_points_than_the_driver_lays_out(spark, monkeypatch):
    from vecscore.operators import projection

    monkeypatch.setattr(projection, "HELD", 50)  # of 80 points
    monkeypatch.setattr(projection, "BLOCK", 16)
    df = frame(spark, two_clusters()).drop("label")
    found = projection.nearest_neighbours(projection.numbered(projection.unit_vectors(df)), 80, 8)
    local = found.orderBy("place").toPandas()
    want = {(i, j): w for i, j, w in zip(*projection.fuzzy_graph(np.stack(local["near"]), np.stack(local["d"])), strict=True)}
    edges = {}
    for r in projection.edge_blocks(found).collect():
        head = np.frombuffer(r["head"], np.int64)
        assert set(head // 16) == {r["b"]}
        edges |= {(i, j): w for i, j, w in zip(head.tolist(), np.frombuffer(r["tail"], np.int64).tolist(), np.frombuffer(r["w"]).tolist(), strict=True)}
    assert edges == pytest.approx(want | {(j, i): w for (i, j), w in want.items()})
    points = api.umap_projection(df, n_neighbors=8, n_epochs=100).orderBy("id").toPandas()
    assert len(points) == 80 and points["id"].nunique() == 80
    side = points["id"].isin([f"W{k}" for k in range(1, 41)]).to_numpy()
    y = points[["U1", "U2"]].to_numpy()
    apart = np.linalg.norm(y[:, None] - y[None], axis=2) + np.diag(np.full(80, np.inf))
    assert np.isfinite(y).all() and (side[apart.argmin(axis=1)] == side).mean() >= 0.9
    again = api.umap_projection(df, n_neighbors=8, n_epochs=100).orderBy("id").toPandas()
    assert (again[["U1", "U2"]].to_numpy() == y).all()
