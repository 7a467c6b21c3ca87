"""Asynchronous jobs: packing, state, submit, status, collect; and the comparison with direct vectors."""

import json
from pathlib import Path

import pytest

from vecscore import api
from vecscore.operators import batchjobs, compare
from vecscore.project import Project, read_dataset
from vecscore.sources import http, providers

BACKEND = providers.backend_config("openai", model="m")


class FakeService:
    """Takes jobs and answers with the length of each text."""

    def __init__(self, status="in_progress"):
        self.files, self.jobs, self.status, self.asked = {}, {}, status, 0

    def upload(self, name, data):
        self.files[f"file-{len(self.files) + 1}"] = data
        return f"file-{len(self.files)}"

    def create(self, file_id, window):
        job = f"job-{len(self.jobs) + 1}"
        self.jobs[job] = file_id
        return {"id": job, "status": "validating"}

    def get(self, job_id):
        self.asked += 1
        return {"id": job_id, "status": self.status, "output_file_id": f"out-{self.jobs[job_id]}" if self.status == "completed" else None}

    def download(self, file_id):
        lines = [json.loads(x) for x in self.files[file_id.removeprefix("out-")].decode().splitlines()]
        return "\n".join(json.dumps({"custom_id": x["custom_id"], "response": {"body": {"data": [{"embedding": [float(len(x["body"]["input"])), 1.0]}]}}}) for x in reversed(lines)).encode()


def write_corpus(spark, root, n, text="Abstract", name="corpus"):
    spark.createDataFrame([(f"W{k}", f"Title {k}", f"{text} {k}") for k in range(1, n + 1)], "id string, title string, abstract string").write.mode("overwrite").parquet(f"{root}/{name}")


@pytest.fixture()
def root(tmp_path):
    (tmp_path / "p").mkdir()
    return str(tmp_path / "p")


def test_packing():
    assert batchjobs.pack_jobs([1] * 5, 2, 100) == ([0, 0, 1, 1, 2], False)
    assert batchjobs.pack_jobs([4, 4, 4], 10, 8) == ([0, 0, 1], True)
    with pytest.raises(ValueError, match="request"):
        batchjobs.pack_jobs([9], 10, 8)
    for bad in ((0, 1), (50_001, 1), (1, 0), (1, (200 << 20) + 1), ("a", 1)):
        with pytest.raises(ValueError):
            batchjobs.check_limits(*bad)
    with pytest.raises(ValueError, match="24h"):
        batchjobs.check_limits(1, 1, "48h")


def test_plan_is_the_greedy_one_and_ranges_follow(spark):
    lines = spark.createDataFrame([(f"{k:03}", f"c{k}", 10 + k % 5) for k in range(50)], "id string, custom_id string, request_bytes long")
    got = {r["id"]: r["job"] for r in batchjobs.plan_jobs(lines, 7, 60).collect()}
    want = batchjobs.pack_jobs([10 + k % 5 for k in range(50)], 7, 60)[0]
    assert [got[f"{k:03}"] for k in range(50)] == want
    for rows in (1, 7, 20):
        assert {r["id"]: r["job"] for r in batchjobs.plan_jobs(lines.repartition(3), 7, 60, range_rows=rows).collect()} == got
    assert batchjobs.plan_jobs(lines.limit(0), 7, 60).count() == 0
    with pytest.warns(UserWarning, match="max_job_bytes = 60"):
        batchjobs.plan_jobs(lines, 7, 60)
    with pytest.raises(ValueError, match="id '004' has 14 bytes"):
        batchjobs.plan_jobs(lines.filter("id < '006'"), 7, 13)


def test_submit_status_collect(spark, root, monkeypatch):
    client = FakeService()
    write_corpus(spark, root, 5)
    out = api.batch_submit_openai(spark, root, BACKEND, max_requests_per_job=2, client=client)
    assert (out["submitted_jobs"], out["submitted_rows"], out["skipped_rows"]) == (3, 5, 0)
    line = json.loads(client.files["file-1"].decode().splitlines()[0])
    assert line["url"] == "/v1/embeddings" and line["body"] == {"model": "m", "input": "Title: Title 1"} and line["custom_id"].startswith("cid_")
    again = api.batch_submit_openai(spark, root, BACKEND, client=client)
    assert (again["submitted_jobs"], again["skipped_rows"]) == (0, 5)
    status = api.batch_status_openai(spark, root, client=client).collect()
    assert [r["status"] for r in status] == ["in_progress"] * 3 and sum(r["row_count_submitted"] for r in status) == 5
    assert api.batch_collect_openai(spark, root, BACKEND, client=client)["pending"] == 3
    client.status = "completed"
    done = api.batch_collect_openai(spark, root, BACKEND, client=client)
    assert (done["downloaded"], done["written_rows"]) == (3, 5)
    folder = Project(spark, root).label_dir("m", "corpus")
    df = read_dataset(spark, folder).toPandas().set_index("id")
    assert df.loc["W3", "V1"] == len("Title: Title 3") and df.loc["W3", "provider"] == "openai"
    assert api.batch_collect_openai(spark, root, BACKEND, client=client)["checked"] == 0
    asked = client.asked
    api.batch_status_openai(spark, root, client=client)
    assert client.asked == asked
    # a changed row goes out again, and its older vector goes once the new one is in
    write_corpus(spark, root, 5, "A quite different abstract that is long enough to be kept as it is, number")
    assert api.batch_submit_openai(spark, root, BACKEND, client=client)["submitted_rows"] == 5
    assert api.batch_collect_openai(spark, root, BACKEND, client=client)["written_rows"] == 5
    assert Project(spark, root).files.children(folder) == ["batch=4"]


def test_lock_failed_jobs_and_state(spark, root, monkeypatch):
    client = FakeService("failed")
    write_corpus(spark, root, 2)
    state = batchjobs.JobState(Project(spark, root), "corpus")
    with state, pytest.raises(RuntimeError, match="is held"):
        api.batch_submit_openai(spark, root, BACKEND, client=client)
    assert api.batch_status_openai(spark, root, client=client).count() == 0
    with pytest.raises(ValueError, match="no jobs were ever sent"):
        api.batch_collect_openai(spark, root, BACKEND, client=client)
    api.batch_submit_openai(spark, root, BACKEND, client=client)
    assert api.batch_collect_openai(spark, root, BACKEND, client=client)["failed"] == 1
    assert api.batch_submit_openai(spark, root, BACKEND, client=client)["submitted_rows"] == 2  # what failed may go again
    Path(state.file).write_text("")
    for crc in Path(state.folder).glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="job list is lost"):
        state.read()
    monkeypatch.delenv(http.TOKEN_VARIABLE, raising=False)
    with pytest.raises(ValueError, match="no token"):
        batchjobs.BatchClient(BACKEND)
    with pytest.raises(ValueError, match="openai provider alone"):
        batchjobs.BatchClient(providers.backend_config("local"))


def test_output_lines(spark):
    frame = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    both = frame('{"custom_id":"a","response":{"body":{"data":[{"embedding":[1,2]}]}}}', "", '{"custom_id":"b","embedding":[3.5,4]}', '{"custom_id":"","embedding":[1]}', '{"custom_id":"c","error":1}')
    assert {r["custom_id"]: r["embedding"] for r in batchjobs.parse_output(spark, both).collect()} == {"a": [1, 2], "b": [3.5, 4]}
    for lines, message in (([" "], "no lines"), (['{"custom_id":"a"}'], "both an id and a vector"), (['{"custom_id":"a","embedding":[1]}'] * 2, "more than once")):
        with pytest.raises(ValueError, match=message):
            batchjobs.parse_output(spark, frame(*lines))
    parsed = batchjobs.parse_output(spark, both)
    manifest = spark.createDataFrame([("b", "2", "h2", "y"), ("a", "1", "h1", "x"), ("z", "9", "h9", "w")], "custom_id string, id string, text_hash string, extra string")
    assert {r["id"]: (r["text_hash"], r["extra"]) for r in batchjobs.join_manifest(parsed, manifest, "openai", "m").collect()} == {"1": ("h1", "x"), "2": ("h2", "y")}
    with pytest.raises(ValueError, match="manifest doesn't list"):
        batchjobs.join_manifest(parsed, manifest.filter("id = '1'"), "openai", "m")
    with pytest.raises(ValueError, match="a manifest needs"):
        batchjobs.join_manifest(parsed, manifest.drop("id"), "openai", "m")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, V1 double, V2 double")


def test_comparison(spark):
    direct = vectors(spark, [("A", 0.1, 0.2), ("B", 0.3, 0.4), ("Z", 0.0, 0.0)])
    batch = vectors(spark, [("A", 0.1, 0.2), ("B", 0.31, 0.39), ("Z", 1.0, 0.0), ("X", 1.0, 1.0)])
    rows, summary = compare.checked_comparison(direct, batch)
    got = {r["id"]: r for r in rows.collect()}
    assert got["A"]["max_abs_diff"] == 0 and got["B"]["max_abs_diff"] == pytest.approx(0.01) and got["Z"]["cosine_similarity"] is None and got["Z"]["max_abs_diff"] == 1
    assert summary["matched_ids"] == 3 and summary["min_cosine_similarity"] < 1
    with pytest.raises(ValueError, match="direct side"):
        compare.checked_comparison(direct.limit(0), batch)
    with pytest.raises(ValueError, match="no id is on both sides"):
        compare.checked_comparison(direct, vectors(spark, [("Q", 1.0, 1.0)]))
    with pytest.raises(ValueError, match="share no vector column"):
        compare.compare_embeddings(direct, spark.createDataFrame([("A", 1.0)], "id string, V9 double"))


def test_demo_compares_direct_with_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"D{k}", f"Title {k}", None) for k in range(3)], "id string, title string, abstract string")
    api.run_demo(spark, str(tmp_path / "d"), rows, rows, BACKEND)
    root, client = str(tmp_path / "d"), FakeService("in_progress")
    api.batch_submit_openai(spark, root, BACKEND, label="corpus_batch", client=client)
    assert api.demo_finalize_openai_batch(spark, root, client=client)["status"] == "pending"
    direct = spark.createDataFrame([(f"D{k}", float(len(f"Title: Title {k}")), 1.5) for k in range(3)], "id string, V1 double, V2 double")
    direct.write.parquet(f"{root}/embeddings/model_id=m/label=corpus/batch=1")
    client.status = "completed"
    out = api.demo_finalize_openai_batch(spark, root, client=client)
    assert out["status"] == "done" and out["matched_ids"] == 3 and out["max_abs_diff"] == pytest.approx(0.5)
