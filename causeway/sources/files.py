"""Text sources: JSON lines with line numbers, tolerant and strict, JSON arrays, id lists and CSV matrices.

Lines are rows ``file, lineno, line``; line numbers count from 1 and include blank and undecodable lines. Large files are read
in splits: lines are numbered within their split, and the lines of the splits before are added.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.patterns import strip


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, lineno, line`` of text files; a line feed at the end of a file begins no line.

    The rows of a split come in order, so the order within it is that of ``monotonically_increasing_id``.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"),
    )
    counts = lines.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = lines.withColumn("k", F.row_number().over(Window.partitionBy("path", "start").orderBy("id")))
    return numbered.join(offsets, ["path", "start"]).select("file", (F.col("offset") + F.col("k")).cast("int").alias("lineno"), "line")


def read_tiers(spark: SparkSession, tiers: Mapping[str, str]) -> DataFrame:
    """SRC-4: lines of several folders with the ``tier`` they come from."""
    out = None
    for tier, path in tiers.items():
        rows = read_lines(spark, path).withColumn("tier", F.lit(tier))
        out = rows if out is None else out.unionByName(rows)
    return out


def route_ocr(text: Column, least: int = 80) -> Column:
    """SRC-2: ``ocr`` for pages with little text, else ``text``."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) < least, "ocr").otherwise("text")


def page_rows(pages: DataFrame) -> DataFrame:
    """SRC-1: pages with text, empty instead of null, and the way they are to be read."""
    return pages.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("route", route_ocr(F.col("text")))


def _is_object(line: Column) -> Column:
    """Whether a line is a complete JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(strip(line))).startswith("OBJECT"), F.lit(False))


def scan_tolerant(lines: DataFrame, schema: T.StructType, text: str = "text", least: int = 40) -> DataFrame:
    """SRC-3: decodable lines whose ``text`` has at least ``least`` characters; blank and undecodable lines are skipped."""
    rows = lines.where(strip(F.col("line")) != "").where(_is_object(F.col("line")))
    decoded = rows.withColumn("r", F.from_json("line", schema))
    return decoded.where(F.length(F.col(f"r.{text}")) >= least).select("file", "lineno", "r.*")


def scan_strict(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """SRC-6: every line decoded, in order; a bad line is an error."""
    bad = F.raise_error(F.concat(F.lit("undecodable line "), F.col("lineno").cast("string"), F.lit(" of "), F.col("file")))
    checked = lines.withColumn("line", F.when(_is_object(F.col("line")), F.col("line")).otherwise(bad.cast("string")))
    return checked.select("file", "lineno", F.from_json("line", schema).alias("r")).select("file", "lineno", "r.*")


def scan_keyed(lines: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """SRC-5: as ``scan_strict``, the last line of each key only."""
    rows = scan_strict(lines, schema)
    best = F.max_by(F.struct(*rows.columns), F.struct("file", "lineno"))
    return rows.groupBy(*keys).agg(best.alias("__r")).select("__r.*")


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-7: the objects of JSON array files."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def ordered_names(lines: DataFrame, expected: int | None = None) -> DataFrame:
    """SRC-8: ``idx, label`` of the non-blank lines, in order from 0; an error if their number is not as expected.

    A name list is a dimension of one small file.
    """
    kept = lines.where(strip(F.col("line")) != "").select(F.struct("lineno", strip(F.col("line")).alias("label")).alias("n"))
    listed = kept.agg(F.array_sort(F.collect_list("n")).alias("a"))
    if expected is not None:
        wrong = F.raise_error(F.concat(F.lit("names: "), F.size("a").cast("string"))).cast(listed.schema["a"].dataType)
        listed = listed.withColumn("a", F.when(F.size("a") == expected, F.col("a")).otherwise(wrong))
    return listed.select(F.posexplode("a").alias("idx", "n")).select("idx", F.col("n.label").alias("label"))


def id_list(lines: DataFrame) -> DataFrame:
    """SRC-9: the distinct stripped non-blank lines."""
    return lines.select(strip(F.col("line")).alias("id")).where("id <> ''").distinct()


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: ``cause, effect`` of the ones of an adjacency matrix CSV."""
    wide = spark.read.option("header", True).csv(path)
    return matrix_edges(wide.withColumnRenamed(wide.columns[0], "cause"), "cause")


def matrix_edges(wide: DataFrame, row: str) -> DataFrame:
    """The cells of a wide matrix that are not 0, as ``row, effect, n``."""
    columns = [c for c in wide.columns if c != row]
    ints = wide.select(row, *[F.col(f"`{c}`").cast("bigint").alias(c) for c in columns])
    return ints.unpivot([row], [F.col(f"`{c}`") for c in columns], "effect", "n").where("n <> 0")


def read_edge_summary(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: an edge summary CSV, all columns as text."""
    return spark.read.option("header", True).csv(path)


def completed_ids(lines: DataFrame, key: str = "excerpt_id") -> DataFrame:
    """SRC-12: ids already recorded; undecodable lines and lines without the key are ignored."""
    return lines.where(_is_object(F.col("line"))).select(F.get_json_object("line", f"$.{key}").alias(key)).where(f"{key} IS NOT NULL").distinct()
