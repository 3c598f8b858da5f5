"""Queries on training-data texts: name -> callable(spark, directory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import bpe, canonical, cutoff, mixing, offence, pairs, scans
from causeway.llm.twins import SQL as SQL
from causeway.sources import read_table, spread


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.resolve_unlisted(spread(read_table(spark, sf, "pair_results")), read_table(spark, sf, "concepts"))


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.value_report(read_table(spark, sf, "pair_results"), read_table(spark, sf, "concepts"))


def _names(spark: SparkSession, sf: str) -> list[str]:
    return [n for _, label, _, others in canonical.read_entries(read_table(spark, sf, "concepts")) for n in (label, *others)]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defects(read_table(spark, sf, "pair_results"), read_table(spark, sf, "excerpts"), _names(spark, sf))


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defect_rates(read_table(spark, sf, "pair_results"), read_table(spark, sf, "excerpts"), _names(spark, sf))


def _labels(spark: SparkSession, sf: str) -> list[str]:
    return [label for _, label, _, _ in canonical.read_entries(read_table(spark, sf, "concepts"))]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    cut = cutoff.cut_values(spread(read_table(spark, sf, "pair_results")), _labels(spark, sf))
    return cut.where("evidence IS NOT NULL").select("row_id").distinct()


def p6_sources(spark: SparkSession, sf: str) -> DataFrame:
    report = cutoff.cut_report(read_table(spark, sf, "pair_results"), _labels(spark, sf))
    return report.withColumn("limits", F.array_join("limits", "|"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.locate_noise(spread(read_table(spark, sf, "page_text")), spread(read_table(spark, sf, "paragraph_text")))


def p7_texts(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repaired_texts(read_table(spark, sf, "page_text"), read_table(spark, sf, "paragraph_text"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(spread(read_table(spark, sf, "documents")))


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.decode(bpe.encode(spread(read_table(spark, sf, "documents"))))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.reached_shares(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return offence.found(spread(read_table(spark, sf, "documents")), read_table(spark, sf, "abuse_reviews"))


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return offence.scores(spread(read_table(spark, sf, "documents")), read_table(spark, sf, "abuse_reviews"))


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return offence.source_rates(spread(read_table(spark, sf, "documents")), read_table(spark, sf, "abuse_reviews"))


QUERIES = {
    "p4_found": p4_found,
    "p4_values": p4_values,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_found": p6_found,
    "p6_sources": p6_sources,
    "p7_found": p7_found,
    "p7_texts": p7_texts,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}
