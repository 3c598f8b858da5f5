"""Row numbers and row-offset frames over ordered groups of any size.

A window partitioned by a group puts the whole group into one task. Here a group is numbered with a
two-level prefix sum (counts per bucket of the order key, then numbers within buckets), and frames of
bounded width run on blocks of consecutive rows, with the rows within reach of a border copied into the neighbouring
block. A group that holds a third of all rows thus spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the order-key buckets, and rows of a block.
BUCKET, BLOCK = 1 << 16, 4096


def number_rows(df: DataFrame, group: str, order: str, tie: str, out: str = "rn", bucket: int = BUCKET) -> DataFrame:
    """``out``: number from 1 of each row in its group by (order, tie); ``order`` is an integer column."""
    marked = df.withColumn("__bucket", F.floor(F.col(order) / bucket))
    counts = marked.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("__group"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    within = Window.partitionBy(group, "__bucket").orderBy(order, tie)
    numbered = marked.withColumn("__k", F.row_number().over(within))
    joined = numbered.join(starts, F.col(group).eqNullSafe(F.col("__group")) & F.col("__bucket").eqNullSafe(F.col("__b")))
    return joined.withColumn(out, (F.col("__start") + F.col("__k")).cast("long")).drop("__bucket", "__group", "__b", "__start", "__k")


def in_blocks(df: DataFrame, number: str, behind: int, ahead: int, block: int = BLOCK) -> DataFrame:
    """Rows with ``__block`` and ``__own``; rows within reach of another block's rows are copied to it (not own there)."""
    own = F.floor(F.col(number) / block)
    first = F.floor((F.col(number) - ahead) / block)
    last = F.floor((F.col(number) + behind) / block)
    return (
        df.withColumn("__home", own)
        .withColumn("__block", F.explode(F.sequence(first, last)))
        .withColumn("__own", F.col("__block") == F.col("__home"))
        .drop("__home")
    )
