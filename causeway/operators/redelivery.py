"""Exactly one copy of every message that was delivered at least once.

The identifier is hashed on the executors that hold the rows: ``min_by`` over the struct of
delivery time and row key is an aggregate with map-side partial aggregation, so
an identifier that holds a third of all rows shrinks to one partial row per task before the
shuffle. The struct is packed into one decimal of fixed width, in the same order: on a struct
proper Spark would fall back from hash to sort aggregation. The surplus rows are then the rows whose key was not kept, an anti join on the unique
row key, which spreads evenly whatever the identifiers look like.

Defined results: rows whose ``required`` identifier column is null (or blank) are never copies of
anything; a null in another identifier column is a value of its own; rows without a delivery
time come after all others; ties go to the lowest row key; rows repeated with the same row key
are the same delivery. Empty input gives empty output; further columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space at either end.
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def identifier(column: str) -> Column:
    """An identifier without the letter case and surrounding white space it was typed with."""
    return F.lower(F.regexp_replace(F.col(column), _EDGE_SPACE, ""))


def packed_order(at: Column, row: Column) -> Column:
    """(time, integer key) as one number that orders alike; a null time comes after all others.

    Timestamps of the years 1 to 9999 stay within 3e17 microseconds of the epoch, keys within 64 bits.
    """
    late, offset, width = 8 * 10**17, 3 * 10**17, 2**64
    micros = (F.coalesce(F.unix_micros(at), F.lit(late)) + F.lit(offset)).cast("decimal(19,0)")
    return micros * F.lit(Decimal(width)) + (row.cast("decimal(19,0)") + F.lit(Decimal(width // 2)))


def kept_keys(df: DataFrame, keys: Sequence[str], required: str, delivered: str, row_key: str) -> DataFrame:
    """The ``row_key`` of the earliest delivery of each identifier (rows with ``required`` only)."""
    order = packed_order(F.col(delivered), F.col(row_key))
    named = [identifier(k).alias(f"__id{i}") for i, k in enumerate(keys)]
    rows = df.select(*named, F.col(row_key).alias("__row"), order.alias("__order"))
    rows = rows.where(F.col(f"__id{list(keys).index(required)}") != "")
    return rows.groupBy(*[f"__id{i}" for i in range(len(keys))]).agg(
        F.min_by("__row", "__order").alias("__kept"), F.count(F.lit(1)).alias("__copies")
    )


def surplus(
    df: DataFrame,
    keys: Sequence[str] = ("excerpt_id", "model"),
    required: str = "excerpt_id",
    delivered: str = "delivered_at",
    row_key: str = "row_id",
) -> DataFrame:
    """``row_key`` of each delivery that is not the one kept."""
    kept = kept_keys(df, keys, required, delivered, row_key).select(F.col("__kept").alias(row_key))
    rows = df.where(identifier(required) != "").select(row_key)
    return rows.join(kept, row_key, "left_anti").distinct()


def deduplicate(
    df: DataFrame,
    keys: Sequence[str] = ("excerpt_id", "model"),
    required: str = "excerpt_id",
    delivered: str = "delivered_at",
    row_key: str = "row_id",
) -> DataFrame:
    """All rows of ``df`` without the surplus deliveries, with every column."""
    name = "__surplus"
    while name in df.columns:
        name += "_"
    extra = surplus(df, keys, required, delivered, row_key).select(F.col(row_key).alias(name))
    return df.join(extra, F.col(row_key) == F.col(name), "left_anti")


def copies_per_identifier(
    df: DataFrame,
    keys: Sequence[str] = ("excerpt_id", "model"),
    required: str = "excerpt_id",
    delivered: str = "delivered_at",
    row_key: str = "row_id",
) -> DataFrame:
    """How many identifiers came how many times."""
    kept = kept_keys(df, keys, required, delivered, row_key)
    return kept.groupBy(F.col("__copies").alias("deliveries")).agg(F.count(F.lit(1)).alias("identifiers"))
