"""Grading, run control, merging of runs, and status tables.

Null models are a model of their own; counts are of rows; shares of nothing are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.patterns import share, strip

STATUSES = ("ok", "malformed", "none", "not_in_ontology")


def model_key(model: str = "model") -> Column:
    return F.coalesce(F.lower(strip(F.col(model))), F.lit(""))


def pair_correct(cause: Column, effect: Column, true_cause: Column, true_effect: Column, status: Column) -> Column:
    """GRD-1: status ok and both sides right."""
    return F.coalesce((status == "ok") & (cause == true_cause) & (effect == true_effect), F.lit(False))


def merged_name(name: Column, members: list[str], label: str) -> Column:
    """The compound name of its members, other names as they are."""
    return F.when(F.lower(name).isin([m.lower() for m in members]), F.lit(label)).otherwise(name)


def edge_set(edges: Column, members: list[str], label: str) -> Column:
    """Distinct edges as sorted ``cause -> effect`` texts after merging; ``edges`` has structs (cause, effect)."""
    named = F.transform(
        F.coalesce(edges, F.array()),
        lambda e: F.concat(
            F.coalesce(merged_name(e["cause"], members, label), F.lit("\u0000")), F.lit("\u0001"),
            F.coalesce(merged_name(e["effect"], members, label), F.lit("\u0000")),
        ),
    )
    return F.array_sort(F.array_distinct(named))


def pairs_to_edges(pairs: Column) -> Column:
    """Two-element arrays as (cause, effect) structs."""
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("cause"), F.get(p, F.lit(1)).alias("effect")))


def edges_match(predicted: Column, truth: Column, members: list[str], label: str) -> Column:
    """GRD-2: the same set of edges after merging; edges off the list count."""
    return edge_set(predicted, members, label) == edge_set(truth, members, label)


def first_excerpts(excerpts: DataFrame, n: int, order: str = "excerpt_id") -> DataFrame:
    """RUN-1: the first ``n`` in order."""
    return excerpts.orderBy(order).limit(n)


def only_listed(excerpts: DataFrame, ids: DataFrame, key: str = "excerpt_id") -> DataFrame:
    """RUN-2: the excerpts of an id list."""
    return excerpts.join(ids.select(key).distinct(), key, "left_semi")


def unmatched_ids(excerpts: DataFrame, ids: DataFrame, key: str = "excerpt_id") -> DataFrame:
    """RUN-2: listed ids without an excerpt."""
    return ids.select(key).distinct().join(excerpts, key, "left_anti")


def not_completed(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """RUN-3: what has no record yet; error records count as done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def error_records(results: DataFrame) -> DataFrame:
    """RUN-4: records of failed calls."""
    return results.where("error IS NOT NULL AND status IS NULL")


def latest_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SRC-5: the last row of each key in order; a hash aggregate, not a sort."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(order))).alias("__row")).select("__row.*")


def supersede(original: DataFrame, rerun: DataFrame, keys: list[str]) -> DataFrame:
    """MRG-1: rows of the rerun replace rows of the same key; keys of the rerun alone are dropped.

    Of several rerun rows of a key the greatest counts, by the columns in their order; so no row is multiplied.
    """
    columns = [c for c in original.columns if c not in keys]
    new = rerun.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("__new"))
    joined = original.join(new, keys, "left")
    pick = lambda c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*keys, *[pick(c) for c in columns])


def count_check(rows: DataFrame, by: str, expected: int) -> DataFrame:
    """MRG-2: groups that do not have the expected number of rows."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)


def full_status(status: Column, error: Column) -> Column:
    """AGG-1: status, else error, else unknown."""
    return F.coalesce(status, F.when(error.isNotNull(), "error").otherwise("unknown"))


def status_counts_on_grid(results: DataFrame, models: DataFrame, excerpts: DataFrame) -> DataFrame:
    """AGG-1: per model the statuses over all excerpts; excerpts without a record are missing.

    Missing ones are counted by subtraction, so no grid is built.
    """
    own = results.withColumn("model", model_key()).join(excerpts.select("excerpt_id"), "excerpt_id", "left_semi")
    own = own.withColumn("s", full_status(F.col("status"), F.col("error")))
    counts = own.groupBy("model").agg(
        *[F.count_if(F.col("s") == s).alias(f"n_{s}") for s in (*STATUSES, "error", "unknown")],
        F.count_distinct("excerpt_id").alias("n_excerpts"),
    )
    total = excerpts.agg(F.count_distinct("excerpt_id").alias("n_all")).scalar()
    joined = models.join(counts, "model", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c.startswith("n_") and c != "n_excerpts"]
    return joined.select("model", *zero, (total - F.coalesce("n_excerpts", F.lit(0))).alias("n_missing"))


def status_counts(results: DataFrame, error_needs_no_status: bool) -> DataFrame:
    """AGG-2, AGG-3: per model the statuses; an error is any record with an error, or only one without a status."""
    error = F.col("error").isNotNull()
    if error_needs_no_status:
        error = error & F.col("status").isNull()
    return results.groupBy(model_key().alias("model")).agg(
        F.count(F.lit(1)).alias("n_records"),
        *[F.count_if(F.coalesce(F.col("status") == s, F.lit(False))).alias(f"n_{s}") for s in STATUSES],
        F.count_if(error).alias("n_error"),
    )


def instance_accuracy(results: DataFrame) -> DataFrame:
    """AGG-4: per model the share of records stored as correct."""
    correct = F.count_if(F.coalesce(F.col("correct"), F.lit(False)))
    return results.groupBy(model_key().alias("model")).agg(
        correct.alias("n_correct"), F.count(F.lit(1)).alias("n_total"), share(correct, F.count(F.lit(1))).alias("accuracy")
    )


def contributing(results: DataFrame, labels: list[str]) -> DataFrame:
    """AGG-5 (pairs): ok records with both sides on the list."""
    ok = (F.col("status") == "ok") & F.col("predicted_cause").isin(labels) & F.col("predicted_effect").isin(labels)
    return results.groupBy(model_key().alias("model")).agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("n_contributing"))


def edge_frequency(edges: DataFrame, by: list[str], key: str) -> DataFrame:
    """AGG-6, AGG-7: per edge the number of graphs that have it."""
    return edges.groupBy(*by).agg(F.count_distinct(key).alias("n_graphs"))
