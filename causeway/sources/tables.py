"""Parquet tables of one data directory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``: one file or a folder of part files."""
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    For work that is heavy per row on tables of few files. Tables of many files stay as they are, so nothing is
    shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
