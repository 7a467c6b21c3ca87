"""A project is a tree of files: tables in Parquet, settings in YAML, job state in JSON.

All file work goes through Hadoop's file system, so a project can lie on any store
that Spark reads.
"""

from __future__ import annotations

import re
import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_part(value: str) -> str:
    """A value as one part of a path."""
    return str(value).replace("/", "_")


def required_text(name: str, value) -> str:
    value = "" if value is None else str(value).strip()
    if not value:
        raise ValueError(f"{name} is empty")
    return value


#: Ending of a whole new file that is about to take its place.
READY = ".ready"


class Storage:
    """Whole files and folders on a Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        self._settle(path)
        p, fs = self._path(path)
        return fs.exists(p)

    def _settle(self, path: str) -> None:
        """Finish a write that stopped between its two renames: the whole new file is beside the place of the old one."""
        (p, fs), (ready, _) = self._path(path), self._path(path + READY)
        if not fs.exists(p) and fs.exists(ready):
            fs.rename(ready, p)

    def children(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        p, fs = self._path(old)
        if not fs.rename(p, self._path(new)[0]):
            raise OSError(f"{old} couldn't be moved to {new}")

    def make(self, path: str) -> None:
        p, fs = self._path(path)
        fs.mkdirs(p)

    def read_text(self, path: str) -> str:
        self._settle(path)
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str, new_only: bool = False) -> bool:
        """Write beside the target and rename over it, so no moment is without a whole file; ``new_only`` creates or returns False.

        The new file gets its ``READY`` name when it is whole. Stores whose rename can't
        replace at once may be without the target for a moment: a reader then takes the ready one.
        """
        p, fs = self._path(path)
        if new_only:
            try:
                stream = fs.create(p, False)
            except Exception as error:
                if "already exists" in str(error).lower() or "FileAlreadyExists" in str(error):
                    return False
                raise
            stream.write(bytearray(text.encode()))
            stream.close()
            return True
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        q, _ = self._path(beside)
        stream = fs.create(q, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        ready, _ = self._path(path + READY)
        self._settle(path)
        fs.delete(ready, False)
        self.rename(beside, path + READY)
        self._replace(path + READY, path)
        return True

    def _replace(self, old: str, new: str) -> None:
        """Rename over an existing file."""
        jvm, (p, _), (q, _) = self.spark._jvm, self._path(old), self._path(new)
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext
        context.getFileContext(p.toUri(), self._conf).rename(p, q, options)

    def read_yaml(self, path: str):
        return yaml.safe_load(self.read_text(path))

    def write_yaml(self, path: str, value) -> None:
        self.write_text(path, yaml.safe_dump(value, sort_keys=False))


class Project:
    """Paths of a project and the reads and writes that follow its layout."""

    META = "embed_model.yaml"
    OLD_META = "_tei_info.yaml"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, required_text("project_dir", root).rstrip("/"), Storage(spark)
        if not self.files.exists(self.root):
            raise ValueError(f"no project_dir at {root}")

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def model_dir(self, model_id: str) -> str:
        return self.path("embeddings", f"model_id={path_part(model_id)}")

    def label_dir(self, model_id: str, label: str) -> str:
        return f"{self.model_dir(model_id)}/label={path_part(label)}"

    def next_batch(self, label_dir: str) -> int:
        found = [int(m[1]) for x in self.files.children(label_dir) if (m := re.fullmatch(r"batch=(\d+)", x))]
        return max(found, default=0) + 1

    def resolve_model_dir(self) -> tuple[str, str]:
        """(folder, model name): ``embeddings`` itself if it has settings, its only model, or the whole of it."""
        base = self.path("embeddings")
        names = self.files.children(base)
        for meta in (self.META, self.OLD_META):
            if meta in names:
                return base, path_part((self.files.read_yaml(f"{base}/{meta}") or {}).get("model") or "embeddings")
        models = [x for x in names if x.startswith("model_id=")]
        if len(models) == 1:
            return f"{base}/{models[0]}", models[0].removeprefix("model_id=")
        return base, "embeddings"


def model_part(folder: str, name: str) -> str:
    """The part of an output path that names the model: ``model_id=<model>``, or the folder's name if no model is known."""
    own = folder.rstrip("/").rsplit("/", 1)[-1]
    return own if own.startswith("model_id=") or name == "embeddings" else f"model_id={path_part(name)}"


def read_dataset(spark: SparkSession, path: str, strict: bool = False, merge: bool = False) -> DataFrame:
    """Parquet below a path, a file or a folder; unless strict, side files are passed over."""
    reader = spark.read.option("mergeSchema", str(merge).lower())
    if not strict:
        reader = reader.option("pathGlobFilter", "*.parquet")
    return reader.parquet(path)


def read_embeddings(spark: SparkSession, model_dir: str) -> DataFrame:
    """All shards of a model, with ``label`` as text and ``batch`` as a number; shards may differ in columns."""
    df = read_dataset(spark, model_dir, merge=True)
    if "label" not in df.columns:
        raise ValueError(f"vectors below {model_dir} have no label; embed_corpus(label=...) writes one")
    df = df.withColumn("label", F.col("label").cast("string"))
    return df.withColumn("batch", F.col("batch").cast("int")) if "batch" in df.columns else df


def scored_dir(distance_path: str, given: str | None) -> str:
    """Where scores go: the path with ``distance_`` of a part made ``score_``, else a folder beside it."""
    if given:
        return given
    parts = distance_path.rstrip("/").split("/")
    for k, part in enumerate(parts):
        if part.startswith("distance_"):
            return "/".join([*parts[:k], "score_" + part.removeprefix("distance_"), *parts[k + 1 :]])
    return "/".join([*parts[:-1], f"score_{parts[-1].removesuffix('.parquet')}"])
