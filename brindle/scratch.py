"""Folders for written tables and checkpoints: in the shared folder of the cluster, or a temporary one in local tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        shared = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def free_prefix(*frames: DataFrame) -> str:
    """A prefix that no column of the frames has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for df in frames for c in df.columns):
        prefix += "_"
    return prefix
