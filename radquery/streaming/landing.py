"""Files that land in a folder, triaged as they come and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from radquery.functions.numeric import pyround
from radquery.operators.scoring import Scorer
from radquery.operators.triage import alternatives, top, urgency

from radquery.sources.images import SIZE, UNREADABLE, features, landed


def triaged(scored: DataFrame) -> DataFrame:
    """Adds condition (as text), confidence, urgency and alternatives to rows with ``probs``; without them all are null."""
    probs = F.transform("probs", lambda x: F.struct(x["cls"].cast("string").alias("cls"), x["p"].cast("double").alias("p")))
    out = scored.withColumn("probs", probs)
    best = top(F.col("probs"))
    out = out.withColumns({"condition": best["cls"], "confidence": pyround(best["p"] * 100, 2)})
    return out.withColumns({"urgency": F.when(F.col("condition").isNotNull(), urgency(F.col("condition"), F.col("confidence"))), "alternatives": alternatives(F.col("probs"), F.col("condition"))})


def triage_images(spark: SparkSession, landing: str, scorer: Scorer, target: str, checkpoint: str, size: int = SIZE) -> StreamingQuery:
    """Takes the image files of a folder, as ``triage_stream`` takes tables: decoded, made into features, scored and triaged.
    Files that are no image are rows with ``error``, and without a decision. ``scorer`` reads the column ``features``."""
    images = landed(spark, landing)
    scored = scorer.transform(features(images.withColumn("variant", F.lit("original")), size=size))
    error = F.when(F.col("features").isNull(), UNREADABLE)
    rows = triaged(scored).select("origin", error.alias("error"), *(F.when(error.isNull(), F.col(c)).alias(c) for c in ("condition", "confidence", "urgency", "alternatives")))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def triage_stream(spark: SparkSession, landing: str, schema: StructType | str, target: str, checkpoint: str) -> StreamingQuery:
    """Takes all Parquet files that are there, and on a later call those that came since; each is taken once."""
    rows = spark.readStream.schema(schema).parquet(landing)
    return triaged(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
