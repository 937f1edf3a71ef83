"""Intermediate tables of iterated operators, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own below ``spark.checkpoint.dir``.

    Without that setting a local master gets a temporary folder, one per
    application; on a cluster it is an error.
    """
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {key} to a folder that the driver and all executors share")
        root = _temporary[app] = _temporary.get(app) or tempfile.mkdtemp(prefix="corpusloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
