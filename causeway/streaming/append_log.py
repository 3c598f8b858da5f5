"""A streaming twin of resume and append: result lines parsed as they arrive, each record once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from causeway.functions.patterns import strip
from causeway.operators.answers import answer_text, parse_single, strip_thinking

SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("excerpt_id", "model", "raw_response", "raw_thinking")]
    + [T.StructField("delivered_at", T.TimestampType())]
)


def parsed_stream(spark: SparkSession, folder: str, lateness: str = "30 days", variant: str = "soft") -> DataFrame:
    """New result files of ``folder`` as parsed answers; repeats of an answer within ``lateness`` are dropped.

    Answers are the same apart from letter case and surrounding white space of their identifiers, as for the batch operator; one without
    excerpt id has no copies, so its key is made unique. The state holds one key per answer of the lateness window and is cleared by
    the watermark; rows that come later than that are left out, and ``late_rows`` reads them.
    """
    rows = spark.readStream.schema(SCHEMA).json(folder).withWatermark("delivered_at", lateness)
    identifier = F.lower(strip(F.col("excerpt_id")))
    key = F.when(F.coalesce(identifier, F.lit("")) == "", F.concat(F.lit("row "), F.expr("uuid()"))).otherwise(F.concat(F.lit("id "), identifier))
    keyed = rows.withColumn("__excerpt", key).withColumn("__model", F.lower(strip(F.col("model"))))
    once = keyed.dropDuplicatesWithinWatermark(["__excerpt", "__model"])
    text = strip_thinking(answer_text(F.col("raw_response"), F.col("raw_thinking")))
    return once.select("excerpt_id", "model", "delivered_at", parse_single(text, variant).alias("p")).select(
        "excerpt_id", "model", "delivered_at", "p.cause", "p.effect", "p.status"
    )


def late_rows(spark: SparkSession, folder: str, lateness: str = "30 days") -> DataFrame:
    """What a batch run finds among all files of ``folder`` to be more than ``lateness`` behind the newest delivery: the stream may have left it out."""
    rows = spark.read.schema(SCHEMA).json(folder)
    newest = rows.agg(F.max("delivered_at")).scalar()
    return rows.where(F.col("delivered_at") < newest - F.expr(f"INTERVAL {lateness}"))


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The stream appended to a JSON log, everything available now and no more; resumes from ``checkpoint``."""
    return stream.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
