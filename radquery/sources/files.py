"""Columns of bytes as files, and images that come as bytes."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radquery.sources.images import UNREADABLE
from radquery.sources.scratch import shared_dir, stored, write_file

IMAGE_COLUMNS = "key string, height int, width int, channels int, data binary, error string"


def sha(content: Column) -> Column:
    return F.sha2(content, 256)


def save_files(files: DataFrame) -> DataFrame:
    """Writes ``content`` under ``path`` for each row; returns the paths and lengths, stored. Rows with one path have one content."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):  # one content in memory beside the batch
                write_file(path.as_py(), content.as_buffer())
            yield pa.record_batch([batch.column(0), pa.array([len(c.as_buffer()) for c in batch.column(1)], pa.int64())], names=["path", "length"])

    return stored(files.select("path", "content").where("path is not null and content is not null").mapInArrow(run, "path string, length long"), "saved")


def decoded_contents(contents: DataFrame) -> DataFrame:
    """A row for each distinct ``key`` of (key, content): height, width, channels and data as in ``images.decoded``, or ``error``.

    Spark's image source reads files alone, so each distinct content is a file in the shared folder for as long as that is
    there, and the same reader decodes both files and columns of bytes. A key names its content (``sha``).
    """
    spark = contents.sparkSession
    folder = f"{shared_dir(spark)}/bytes-{uuid.uuid4().hex}"
    path = F.concat(F.lit(f"{folder}/"), F.substring("key", 1, 2), F.lit("/"), F.col("key"))
    if save_files(contents.dropDuplicates(["key"]).select(path.alias("path"), "content")).isEmpty():
        return spark.createDataFrame([], IMAGE_COLUMNS)
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder).select("image.*")
    fine = F.col("height") > 0
    key = F.element_at(F.split("origin", "/"), -1)
    return images.select(key.alias("key"), *(F.when(fine, F.col(a)).alias(b) for a, b in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))), F.when(~fine, UNREADABLE).alias("error"))


def decoded_bytes(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds height, width, channels, data and error to rows with a column of bytes; a null has an error too. All rows stay."""
    keyed = stored(rows.withColumn("_key", sha(F.col(content))), "bytes")
    images = decoded_contents(keyed.where(F.col("_key").isNotNull()).select(F.col("_key").alias("key"), F.col(content).alias("content")))
    clear = [c for c in ("height", "width", "channels", "data", "error") if c in rows.columns]
    joined = keyed.drop(*clear).join(images.withColumnRenamed("key", "_of"), F.col("_key") == F.col("_of"), "left").drop("_key", "_of")
    return joined.withColumn("error", F.when(F.col("data").isNull(), UNREADABLE))  # no bytes have no file that is read
