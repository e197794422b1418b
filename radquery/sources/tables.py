"""Stored tables, the document of training results, and saved scorers."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery import schemas
from radquery.operators.keys import numbered
from radquery.operators.scoring import CentroidScorer, LogisticScorer, Scorer
from radquery.sources.scratch import stored

TABLES = {"patients": schemas.PATIENTS, "lung_scans": schemas.LUNG_SCANS, "predictions": schemas.PREDICTIONS, "model_metrics": schemas.MODEL_METRICS, "reports": schemas.REPORTS, "rejections": schemas.REJECTIONS}


def create_tables(spark: SparkSession, folder: str) -> None:
    """Makes the tables that aren't there yet, without rows."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All rows, those of batches among them."""
    return spark.read.schema(TABLES[name]).option("recursiveFileLookup", True).parquet(f"{folder}/{name}")


def record_id(upper: bool = False) -> Column:
    return F.upper(F.uuid()) if upper else F.uuid()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row: the results of both models, as one JSON document."""
    return spark.read.schema(schemas.METRICS_DOCUMENT).option("multiLine", True).json(path)


def write_results(results: DataFrame, path: str) -> None:
    """One document; so there is one row to write."""
    results.limit(1).coalesce(1).write.mode("overwrite").json(path)


def class_names(results: DataFrame) -> DataFrame:
    """One row: the classes as the document has them, at the top or else in a model."""
    return results.select(F.coalesce("class_names", "cnn.class_names", "resnet.class_names").alias("class_names"))


def save_scorer(scorer: Scorer, path: str) -> None:
    """Overwrites what is there, as a checkpoint does."""
    if isinstance(scorer, CentroidScorer):
        scorer.model.write.mode("overwrite").parquet(path)
    elif isinstance(scorer, LogisticScorer):
        scorer.model.write().overwrite().save(path)
    else:
        scorer.save(path)


def load_scorer(spark: SparkSession, scorer: Scorer, path: str) -> Scorer | None:
    """The scorer with a saved model, or None if there is none: decisions then fall back to another model or to the stand-in."""
    try:
        if isinstance(scorer, CentroidScorer):
            scorer.model = spark.read.parquet(path)
        elif isinstance(scorer, LogisticScorer):
            scorer.model = LogisticRegressionModel.load(path)
        else:
            scorer.load(spark, path)
    except Exception as e:  # noqa: BLE001  Spark and the ML reader raise different kinds
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise
    return scorer


def shuffled(df: DataFrame, key: str, seed: int, buffer: int | None = None) -> DataFrame:
    """Adds ``place``, dense from 0: the rows' order after a shuffle.

    With a buffer of b = min(buffer, n) rows it is as if each were drawn at random from the next b of the order by ``key``: a row
    at place p of that order gets the rank of p + u b, with u from its hash, so it comes at most b - 1 places early. Without
    one all rows are mixed.
    """
    mixed = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    if buffer is None:
        return numbered(df.withColumn("_mixed", mixed), [F.col("_mixed"), F.col(key)], "place").drop("_mixed")
    rows = stored(numbered(df, [F.col(key)], "_place"), "ordered")
    u = F.conv(F.substring(mixed, 1, 8), 16, 10).cast("double") / float(1 << 32)
    moved = rows.withColumn("_moved", F.col("_place") + u * min(buffer, rows.count()))
    return numbered(moved, [F.col("_moved"), F.col("_place")], "place").drop("_moved", "_place")


def batches(df: DataFrame, key: str, size: int, seed: int | None = None, buffer: int | None = None) -> DataFrame:
    """Adds ``batch``, dense from 0: rows of the same number are a minibatch of ``size`` rows, of which only the last one may
    have fewer. With a seed the rows are shuffled first."""
    placed = numbered(df, [F.col(key)], "place") if seed is None else shuffled(df, key, seed, buffer)
    return placed.withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def find_model(spark: SparkSession, folders: list[str], name: str) -> str | None:
    """The path of a saved model in the first of the folders that has it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for folder in folders:
        path = hadoop(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return f"{folder}/{name}"
    return None
