"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from causeway.sources.checkpoints import is_local


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder, which all executors share; on this machine alone, under its temporary folder."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not is_local(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="causeway-scratch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
