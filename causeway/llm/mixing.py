"""A mix of sources with target weights, by Pfair scheduling.

Every source is a task whose weight is its target share. Its documents, in a fixed pseudo-random
order and repeated in whole rounds, are cut into blocks of ``block_tokens`` tokens; block k of a
source of weight w is released at slot floor(k / w) and due at slot ceil((k + 1) / w). Each slot
takes the released block with the earliest deadline. At every slot each source has had its
weight's share of the blocks to within less than one block.

Weights are rounded to multiples of 1 / period (largest remainders), so the schedule repeats
after one period, which alone is computed on the driver; the slot of any block follows by arithmetic. The period has
``PERIOD`` slots, or as many more as the smallest share needs for a block of its own, up to ``MOST_SLOTS``.

A block is no shorter than the longest document, so that the tokens of any slot stay within two blocks of the
schedule: one for the schedule itself, one for the document at its end. Long documents
come last in each round, so that they are used only where the others do not suffice; a document is used if that brings its source nearer to what is needed, so each source ends within half a document of it.

Scale: tokens are counted in one Arrow pass and cut off by a checkpoint, since two consumers read them.
A source may hold a third of all rows, so its running total is a two-level prefix sum: totals per
(source, hash bucket), a window over these few, then a window within each bucket.

Defined results: the total is the largest at which every present source can keep its share with
at most ``max_repeats`` uses of a document, or ``total_tokens`` if given (sources that cannot
reach their share of it then give all they may; the shares reached say so). Shares of listed
sources without tokens are spread over the others in proportion. Unlisted and null sources,
null, empty and zero-token texts, and sources with a null or non-positive share or repeat cap
take no part. Equal documents under several ids are several documents. A source listed twice counts with the
sum of its shares and its smallest cap. Empty tables give an empty mix.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.bpe import token_counts
from causeway.sources.checkpoints import cut_lineage

#: Slots of one period of the schedule, usually and at most; weights are multiples of its inverse.
PERIOD, MOST_SLOTS = 10_000, 1_000_000
#: Tokens of a block at least; longer documents come last.
BLOCK_TOKENS = 2_048
#: Hash buckets per source for the running totals.
BUCKETS = 1_024


def period_of(shares: dict[str, float]) -> int:
    """Slots of a period in which the smallest share has a block."""
    period = max(PERIOD, len(shares), math.ceil(sum(shares.values()) / min(shares.values())))
    if len(shares) > MOST_SLOTS:
        raise ValueError(f"more than {MOST_SLOTS} sources")
    return min(period, MOST_SLOTS)


def period_weights(shares: dict[str, float], period: int | None = None) -> dict[str, int]:
    """Blocks of each source in one period; they add up to ``period`` and none is zero."""
    period = period or period_of(shares)
    total = sum(shares.values())
    exact = {s: x / total * period for s, x in shares.items()}
    blocks = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    for at in range(period - sum(blocks.values())):
        blocks[order[at % len(order)]] += 1
    excess = sum(blocks.values()) - period
    for s in sorted(blocks, key=lambda s: (-blocks[s], s)):
        less = min(blocks[s] - 1, max(0, excess))
        blocks[s] -= less
        excess -= less
    return blocks


def pfair_period(blocks: dict[str, int]) -> dict[str, list[int]]:
    """For each source the slots of its blocks within one period, earliest deadline first."""
    period = sum(blocks.values())
    release = lambda s, k: k * period // blocks[s]
    deadline = lambda s, k: -(-(k + 1) * period // blocks[s])
    waiting = [(0, s, 0) for s in sorted(blocks)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in blocks}
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            # among equal deadlines, the block whose successor is tighter goes first
            heapq.heappush(ready, (deadline(s, k), deadline(s, k + 1), s, k))
        _, _, s, k = heapq.heappop(ready)
        slots[s].append(slot)
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (max(slot + 1, release(s, k + 1)), s, k + 1))
    return slots


def _targets(targets: DataFrame) -> DataFrame:
    return (
        targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )


def sizes(documents: DataFrame, targets: DataFrame, directory: str | None = None) -> DataFrame:
    """``doc_id, source, order, bucket, n_tokens`` of the documents that may take part."""
    listed = _targets(targets).select("source")
    rows = documents.where("text IS NOT NULL AND text <> ''").select("doc_id", "source", "text")
    # the targets are a fixed list of a few sources
    rows = token_counts(rows.join(F.broadcast(listed), "source", "left_semi"), directory=directory)
    order = F.xxhash64("doc_id", F.lit("mix"))
    bucket = F.pmod(order, F.lit(BUCKETS)).cast("int") + F.when(F.col("n_tokens") > BLOCK_TOKENS, BUCKETS).otherwise(0)
    return rows.where("n_tokens > 0").select("doc_id", "source", order.alias("order"), bucket.alias("bucket"), "n_tokens")


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, list[tuple], int]:
    """Totals per bucket, (source, share, repeats, available, needed) of each present source, and the tokens of the longest document.

    The second is as long as the target list and is made on the driver.
    """
    buckets = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    present = (
        buckets.groupBy("source").agg(F.sum("tokens").alias("available"), F.max("longest").alias("longest")).join(F.broadcast(_targets(targets)), "source").collect()
    )
    if not present:
        return buckets, [], 0
    whole = sum(r["target_share"] for r in present)
    most = min(r["available"] * r["max_repeats"] * whole / r["target_share"] for r in present)
    total = most if total_tokens is None else total_tokens
    rows = [
        (r["source"], r["target_share"] / whole, r["max_repeats"], r["available"],
         int(min(total * r["target_share"] / whole, r["available"] * r["max_repeats"])))
        for r in sorted(present, key=lambda r: r["source"])
    ]
    return buckets, rows, max(r["longest"] for r in present)


def mix_index(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS,
    directory: str | None = None,
) -> DataFrame:
    """``slot, slot_pos, source, doc_id, copy_no, n_tokens``: the mix without its texts.

    The mix is read in the order of (slot, slot_pos); slot_pos is the token offset in the source.
    """
    spark = documents.sparkSession
    sized = cut_lineage(sizes(documents, targets, directory))
    buckets, rows, longest = plan(sized, targets, total_tokens)
    block_tokens = max(block_tokens, longest)
    blocks = period_weights({r[0]: r[1] for r in rows}) if rows else {}
    slots = pfair_period(blocks) if rows else {}
    schedule = spark.createDataFrame(
        [(*r, blocks[r[0]], slots[r[0]]) for r in rows],
        "source STRING, share DOUBLE, repeats INT, available BIGINT, needed BIGINT, per_period INT, slots ARRAY<INT>",
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).drop("tokens", "longest")
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(starts, ["source", "bucket"])
        .join(F.broadcast(schedule.select("source", "repeats", "available", "needed")), "source")
    )
    start = F.col("bucket_start") + F.col("ahead")
    # a use counts if it brings the source nearer to what is needed of it
    spare = F.col("needed") - start - F.col("n_tokens") / 2
    rounds = F.least(F.col("repeats"), (F.floor(spare / F.col("available")) + 1).cast("int"))
    copies = (
        placed.withColumn("start", start)
        .where(rounds > 0)
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), rounds)))
        .withColumn("slot_pos", F.col("start") + (F.col("copy_no") - 1) * F.col("available"))
    )
    block = F.floor(F.col("slot_pos") / block_tokens)
    at = copies.join(F.broadcast(schedule.select("source", "per_period", "slots")), "source")
    slot = F.floor(block / F.col("per_period")) * sum(blocks.values()) + F.get("slots", (block % F.col("per_period")).cast("int"))
    return at.select(slot.alias("slot"), "slot_pos", "source", "doc_id", "copy_no", "n_tokens")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, directory: str | None = None) -> DataFrame:
    """The mix with its texts."""
    index = mix_index(documents, targets, total_tokens, directory=directory)
    return index.join(documents.select("doc_id", "text"), "doc_id")


def reached_shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, directory: str | None = None) -> DataFrame:
    """Per listed source: target and reached share of the tokens, tokens, uses and most uses of a document."""
    index = mix_index(documents, targets, total_tokens, directory=directory)
    got = index.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("copy_no").alias("most_uses")
    )
    whole = got.agg(F.sum("tokens")).scalar()
    return (
        _targets(targets).join(got, "source", "left")
        .select(
            "source", "target_share", "max_repeats",
            F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        )
        .withColumn("reached_share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)))
    )
