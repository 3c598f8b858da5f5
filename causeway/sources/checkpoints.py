"""Cutting lineage on storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df``, written once to the checkpoint folder of the session.

    The folder is the cluster's ``spark.checkpoint.dir``. Where none is set, a master on this machine alone gets
    one of its own, as in tests; on a cluster executors could not read it, so that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not is_local(context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="causeway-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")
