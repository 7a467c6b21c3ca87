"""Working tables in the cluster's shared folder: written once, read as often as needed, gone when the driver's Python ends."""

from __future__ import annotations

import atexit
import os
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_cleaned: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared folder, ``spark.checkpoint.dir``.

    Only a session whose tasks all run in the driver's own process may name none; it gets
    one in /tmp, where a cluster's executors would each write to a disk of their own.
    An application's folders lie in one, which is deleted when the driver's Python ends.
    """
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        shared = "/tmp/checkpoints"
    root = os.path.join(shared, f"vecscore-{app}")
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_delete, spark, root)
    return os.path.join(root, uuid.uuid4().hex)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except (Py4JError, OSError):  # the JVM is gone by then
        pass


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives the planner the
    true size of the table, so that it can choose a broadcast only where it fits.
    """
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in one partition for each of the cluster's cores, if its files give fewer.

    A file of one row group is read by one task, and all that follows the scan would stay in
    it. Larger tables have more row groups than there are cores and are left as they are.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= want else df.repartition(want)
