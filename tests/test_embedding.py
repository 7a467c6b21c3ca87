"""Incremental embedding, dry runs, shards, compaction, providers, streaming and the demo."""

import json
import threading
import xml.etree.ElementTree
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
import yaml

from vecscore import api
from vecscore.operators import embed
from vecscore.operators.relational import resolve_labels, sample_rows, with_group
from vecscore.project import Project, read_dataset, read_embeddings
from vecscore.sources import http, providers

LOCAL = providers.backend_config("local", model="hashed-words-8")


def write_corpus(spark, root, rows, name="corpus", mode="overwrite"):
    spark.createDataFrame(rows, "id string, title string, abstract string").coalesce(1).write.mode(mode).parquet(f"{root}/{name}")


def shards(spark, root, label="corpus"):
    project = Project(spark, root)
    folder = project.label_dir(LOCAL.model, label)
    return {int(b.removeprefix("batch=")): sorted(r["id"] for r in read_dataset(spark, f"{folder}/{b}").collect()) for b in project.files.children(folder) if b.startswith("batch=")}


@pytest.fixture()
def root(tmp_path):
    (tmp_path / "p").mkdir()
    return str(tmp_path / "p")


def test_shards_follow_changes(spark, root):
    write_corpus(spark, root, [("W1", "Alpha", "A abstract"), ("W2", "Beta", "B abstract")])
    assert api.embed_corpus(spark, root, LOCAL)["embedded_rows"] == 2 and shards(spark, root) == {1: ["W1", "W2"]}
    for text, want in (("B again", {1: ["W1"], 2: ["W2"]}), ("B once more", {1: ["W1"], 3: ["W2"]})):
        write_corpus(spark, root, [("W1", "Alpha", "A abstract"), ("W2", text, None)])
        api.embed_corpus(spark, root, LOCAL)
        assert shards(spark, root) == want
    assert api.embed_corpus(spark, root, LOCAL)["embedded_rows"] == 0 and shards(spark, root) == {1: ["W1"], 3: ["W2"]}
    api.embed_corpus(spark, root, LOCAL, label="other/one")
    assert shards(spark, root, "other/one") == {1: ["W1", "W2"]}
    api.embed_corpus(spark, root, LOCAL, delete_existing=True, save_text=False)
    assert shards(spark, root) == {1: ["W1", "W2"]} and shards(spark, root, "other/one") == {1: ["W1", "W2"]}
    df = read_embeddings(spark, Project(spark, root).model_dir(LOCAL.model))
    assert {"id", "text_hash", "provider", "model_id", "created_at", "V1", "V8", "label", "batch"} <= set(df.columns)
    meta = yaml.safe_load(Path(root, "embeddings", f"model_id={LOCAL.model}", "embed_model.yaml").read_text())
    assert meta["provider"] == "local" and meta["text_preprocessor"] == "clean_abstract_for_embedding"


def test_dry_run_embeds_nothing(spark, root):
    write_corpus(spark, root, [("W1", "Alpha", "A abstract"), ("W2", "Beta", None)])
    out = api.embed_corpus(spark, root, LOCAL, dry_run=True)
    assert out["rows"] == out["would_embed"] == 2 and not Path(root, "embeddings").exists()
    assert read_dataset(spark, out["preview"]).columns == ["id", "title_original", "abstract_original", "cleaned_title", "cleaned_abstract", "text", "text_hash", "would_embed"]
    write_corpus(spark, root, [("W1", "Alpha", None)], "few")
    out = api.embed_corpus(spark, root, LOCAL, corpus_name="few", dry_run=True, cleaner_args={"no_abstract_policy": "discard"})
    assert out["rows"] == 0 and out["preview"] is None


def test_preprocessors_are_checked(spark, root):
    write_corpus(spark, root, [("W1", "Alpha", "A"), ("W2", "Beta", "B")])
    from pyspark.sql import functions as F

    own = lambda df: df.select("id", F.col("title").alias("text"), F.md5("title").alias("text_hash"), F.lit("x").alias("extra"))
    api.embed_corpus(spark, root, LOCAL, text_preprocessor=own)
    assert "extra" in read_embeddings(spark, Project(spark, root).model_dir(LOCAL.model)).columns
    for bad, message in (
        (lambda df: df, "rows lack"), (lambda df: own(df).unionByName(own(df)), "more than one prepared row"), (lambda df: own(df).withColumn("id", F.lit("new")), "doesn't have"), (lambda df: 3, "not a DataFrame"),
    ):
        with pytest.raises(ValueError, match=message):
            api.embed_corpus(spark, root, LOCAL, text_preprocessor=bad)
    with pytest.raises(ValueError, match="batch_size"):
        api.embed_corpus(spark, root, LOCAL, batch_size=0)
    with pytest.raises(ValueError, match="project_dir"):
        api.embed_corpus(spark, root + "/none", LOCAL)
    write_corpus(spark, root, [("W1", "Alpha", "A")], "bad")
    read_dataset(spark, f"{root}/bad").drop("title").write.parquet(f"{root}/worse")
    with pytest.raises(ValueError, match="lacks .*title"):
        api.embed_corpus(spark, root, LOCAL, corpus_name="worse")


def test_stream_embeds_what_arrives(spark, root):
    write_corpus(spark, root, [("W1", "Alpha", "A"), ("W2", "Beta", "B")])
    api.stream_embeddings(spark, root, LOCAL).awaitTermination(120)
    write_corpus(spark, root, [("W2", "Beta", "B"), ("W3", "Gamma", "C")], mode="append")
    api.stream_embeddings(spark, root, LOCAL).awaitTermination(120)
    assert shards(spark, root) == {1: ["W1", "W2"], 2: ["W3"]}


def test_stream_takes_the_newest_file_or_refuses(spark, root):
    import os
    import time

    write_corpus(spark, root, [("W1", "Alpha", "old"), ("W2", "Beta", "B"), ("W2", "Beta", "B")])
    before = time.time() - 100
    for f in Path(root, "corpus").glob("*.parquet"):
        os.utime(f, (before, before))
    write_corpus(spark, root, [("W1", "Alpha", "new")], mode="append")
    api.stream_embeddings(spark, root, LOCAL).awaitTermination(120)
    folder = Project(spark, root).label_dir(LOCAL.model, "corpus")
    got = {r["id"]: r["text"] for r in read_dataset(spark, folder).collect()}
    assert set(got) == {"W1", "W2"} and got["W1"].startswith("Title: Alpha") and "old" not in got["W1"]
    project = Project(spark, root)
    tied = spark.createDataFrame([("W9", "a", "b"), ("W9", "a", "c")], "id string, title string, abstract string")
    from vecscore.streaming.incremental import embed_increment

    with pytest.raises(ValueError, match="more than one prepared row"):
        embed_increment(tied, project, LOCAL, "corpus")


def test_providers_get_portions(spark):
    seen = []

    class Counting(providers.LocalProvider):
        @classmethod
        def embed(cls, texts, c):
            if len(texts) > 7:
                raise ValueError(f"{len(texts)} at once")
            return super().embed(texts, c)

    providers.register("counting", Counting)
    try:
        backend = providers.BackendConfig("counting", "local://", "hashed-words-8")
        rows = spark.range(100).selectExpr("cast(id AS string) AS id", "concat('text ', id) AS text").coalesce(1)
        assert providers.embed_frame(rows, backend, portion=7).count() == 100 and not seen
    finally:
        del providers.PROVIDERS["counting"]


def test_state_survives_a_broken_write(spark, root):
    """Wherever a write stops, a reader finds the old text or the new one."""
    files = Project(spark, root).files
    path = f"{root}/state.json"
    files.write_text(path, "one")
    files.write_text(path, "two")
    assert files.read_text(path) == "two" and files.children(root) == [x for x in files.children(root) if x in ("state.json", ".state.json.crc")]

    class Stopped(Exception):
        pass

    def stop(*_):
        raise Stopped

    for step in ("rename", "_replace"):
        old = getattr(files, step)
        setattr(files, step, stop)
        with pytest.raises(Stopped):
            files.write_text(path, "three")
        setattr(files, step, old)
        assert files.read_text(path) == "two" and files.exists(path)
    # a store that deletes before it renames, stopped between the two
    files.write_text(path + ".ready", "four")
    files.delete(path)
    assert files.exists(path) and files.read_text(path) == "four"
    files.write_text(path, "five")
    assert files.read_text(path) == "five"


def test_a_broken_prune_loses_no_vector(spark, root, monkeypatch):
    write_corpus(spark, root, [(f"W{k}", "Alpha", f"A abstract {k}") for k in range(6)])
    api.embed_corpus(spark, root, LOCAL)
    project = Project(spark, root)
    folder = project.label_dir(LOCAL.model, "corpus")
    first = {r["id"]: r["V1"] for r in read_dataset(spark, folder).collect()}
    with monkeypatch.context() as m:
        m.setattr(embed, "prune_superseded", lambda *_: 0)
        write_corpus(spark, root, [("W0", "Changed", None), ("W1", "Changed too", None)] + [(f"W{k}", "Alpha", f"A abstract {k}") for k in range(2, 6)])
        api.embed_corpus(spark, root, LOCAL)

    class Stopped(Exception):
        pass

    for step, after in (("rename", 0), ("delete", 1), ("delete", 2)):
        calls = []

        def stop(*args, old=getattr(type(project.files), step), after=after, calls=calls):
            calls.append(args)
            if len(calls) > after + (1 if step == "delete" else 0):  # the first deletion is of an older run's leavings
                raise Stopped
            return old(project.files, *args)

        with monkeypatch.context() as m:
            m.setattr(project.files, step, stop)
            with pytest.raises(Stopped):
                embed.prune_superseded(spark, project, folder)
        rows = read_dataset(spark, folder, merge=True).collect()
        assert {r["id"] for r in rows} == set(first)
        assert all(any(r["id"] == i and r["V1"] == v for r in rows) for i, v in first.items() if i not in ("W0", "W1"))
    embed.prune_superseded(spark, project, folder)
    assert shards(spark, root) == {1: ["W2", "W3", "W4", "W5"], 2: ["W0", "W1"]}
    assert embed.prune_superseded(spark, project, folder) == 0


def test_demo_runs_end_to_end(spark, tmp_path):
    rows = spark.createDataFrame([(f"D{k:02}", f"Title {k}", ("plants and soil " if k % 2 else "atoms and fields ") * 6) for k in range(12)], "id string, title string, abstract string")
    out = api.run_demo(spark, str(tmp_path / "d"), rows, rows.filter("id > 'D08'"), LOCAL, max_corpus=8, render=True)
    assert read_dataset(spark, f"{tmp_path}/d/corpus").count() == 8 and read_dataset(spark, out["scores"]).count() == 9
    with pytest.raises(ValueError, match="overwrite"):
        api.run_demo(spark, str(tmp_path / "d"), rows, rows, LOCAL)
    assert api.backend_read(spark, out["backend"]) == LOCAL
    assert read_dataset(spark, out["area_scores"]).count() == 8


def test_demo_of_its_own_tables(spark, tmp_path):
    """The script and the notebook hold the same steps; the notebook's cells run."""
    out = api.run_demo(spark, str(tmp_path / "d"), backend=LOCAL)
    compile(Path(out["script"]).read_text(), "demo", "exec")
    cells = [c for c in json.loads(Path(out["notebook"]).read_text())["cells"] if c["cell_type"] == "code"]
    names = {}
    for c in cells:
        exec("".join(c["source"]), names)  # noqa: S102
    picture = Path(tmp_path, "d", "pca.svg").read_text()
    root = xml.etree.ElementTree.fromstring(picture)
    titles = [x.text for x in root.iter("{http://www.w3.org/2000/svg}title")]
    assert len(titles) == 60 + 8 and any(t.startswith("reference:") for t in titles)


def test_pictures_of_many_groups_and_none():
    from vecscore.functions import svg

    points = [(f"p<{k}", k % 7, k // 7, f"g&{k % 5}") for k in range(60)]
    for n, panels in ((0, 1), (1, 1), (60, 5)):
        root = xml.etree.ElementTree.fromstring(svg.scatter(points[:n], ("U1", "U2"), 'a "title"'))
        assert len(root.findall(".//{http://www.w3.org/2000/svg}rect[@class='frame']")) == panels
        assert len(root.findall(".//{http://www.w3.org/2000/svg}circle[@class='dot']")) == n * panels


class Service(BaseHTTPRequestHandler):
    seen: list = []
    fail = 0

    def log_message(self, *_):
        pass

    def answer(self, value, code=200):
        body = json.dumps(value).encode()
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        self.answer({"model_id": "m", "served_model_name": "served", "embedding_size": 2, "max_client_batch_size": 2} if self.path == "/info" else {}, 200 if self.path == "/info" else 404)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append((self.path, body, self.headers.get("Authorization")))
        if Service.fail:
            Service.fail -= 1
            return self.answer({"error": "busy"}, 503)
        texts = body.get("inputs", body.get("input"))
        vectors = [[float(len(t)), 1.0] for t in texts]
        return self.answer({"data": [{"embedding": v} for v in vectors]} if "input" in body else vectors)


@pytest.fixture()
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    Service.seen, Service.fail = [], 0
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_providers_over_http(service, monkeypatch):
    monkeypatch.setenv(http.TOKEN_VARIABLE, "key")
    tei = api.backend_config("tei", tei_url=f"{service}/embed")
    assert api.backend_info(tei) | {"raw": 0} == {"provider": "tei", "model_id": "served", "dim": 2, "max_batch_size": 2, "raw": 0}
    assert api.embed_texts(["a", "bb", "ccc"], tei).values.tolist() == [[1, 1], [2, 1], [3, 1]]
    assert [len(b["inputs"]) for _, b, _ in Service.seen] == [2, 1] and Service.seen[0][2] == "Bearer key"
    oa = api.backend_config("openai", base_url=service, model="x", max_batch_size=1)
    assert list(api.embed_texts(["a", "bb"], oa).columns) == ["V1", "V2"] and Service.seen[-1][0] == "/embeddings"
    hf = api.backend_config("hf", base_url=service, model="o/m")
    assert len(api.embed_texts(["a"], hf)) == 1 and Service.seen[-1][0] == "/pipeline/feature-extraction/o/m"
    assert providers.HfProvider.url(api.backend_config("hf", model="o/m")).endswith("/models/o/m")
    assert api.embed_texts([], hf).shape == (0, 0)
    dead = api.backend_config("tei", tei_url="http://127.0.0.1:9/embed", retries=0)
    assert api.backend_info(dead)["max_batch_size"] == 128


def test_retries(service, monkeypatch):
    waits = []
    Service.fail = 2
    assert http.with_retry(lambda: http.post_json(f"{service}/x", {"inputs": ["a"]}), 3, waits.append) == [[1.0, 1.0]] and waits == [1, 2]
    with pytest.raises(RuntimeError, match="given up after 2 attempts: no"):
        http.with_retry(lambda: (_ for _ in ()).throw(OSError("no")), 1, waits.append)


def test_provider_arguments(spark, tmp_path):
    for bad in ({"provider": "none"}, {"timeout": 0}, {"retries": -1}, {"max_batch_size": 0.5}):
        with pytest.raises(ValueError):
            api.backend_config(**bad)
    assert api.backend_specter2_tei(9000, "host").base_url == "http://host:9000/embed"
    with pytest.raises(ValueError, match="port"):
        api.backend_specter2_tei(-1)
    with pytest.raises(ValueError, match="differ in length"):
        providers.as_matrix([[1.0], [1.0, 2.0]])
    with pytest.raises(ValueError, match="not with a list of vectors"):
        providers.as_matrix({"a": 1})
    for answer, message in (({}, "no data"), ({"data": 3}, "not a list"), ({"data": [{"x": 1}]}, "no embedding")):
        with pytest.raises(ValueError, match=message):
            providers.OpenAiProvider.vectors(answer)
    path = str(tmp_path / "b.yaml")
    backend = api.backend_config("openai", model="m", max_batch_size=7)
    api.backend_save(spark, backend, path)
    assert api.backend_read(spark, path) == backend
    assert providers.parse_backend({"backend": {"provider": "hf", "model": "m"}}).model == "m" and providers.parse_backend({"tei_url": "http://x/embed"}).provider == "tei"
    with pytest.raises(ValueError, match="neither a provider"):
        providers.parse_backend({"a": 1})


def test_label_forms(spark, tmp_path):
    points = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    (tmp_path / "l.csv").write_text("id,label\na,x\nb,y\n")
    for given in (str(tmp_path / "l.csv"), {"a": "x", "b": "y"}, {"x": ["a"], "y": ["b"]}, spark.createDataFrame([("a", "x"), ("b", "y")], "id string, label string")):
        assert {r["id"]: r["group"] for r in with_group(points, resolve_labels(spark, given)).collect()} == {"a": "x", "b": "y", "c": "other"}
    blank = resolve_labels(spark, spark.createDataFrame([("a", "x"), (None, "y"), ("", "y"), ("b", None), ("c", " ")], "id string, label string"))
    assert [tuple(r) for r in blank.collect()] == [("a", "x")] and resolve_labels(spark, {"a": None, "": "x"}).count() == 0
    with pytest.raises(ValueError, match="several labels"):
        resolve_labels(spark, {"x": ["a"], "y": ["a"]})
    assert sorted(r["id"] for r in sample_rows(points, 2).collect()) == sorted(r["id"] for r in sample_rows(points.repartition(3), 2).collect())


def test_prune_is_idempotent(spark, root):
    write_corpus(spark, root, [("W1", "Alpha", "A")])
    api.embed_corpus(spark, root, LOCAL)
    project = Project(spark, root)
    assert embed.prune_superseded(spark, project, project.label_dir(LOCAL.model, "corpus")) == 0
