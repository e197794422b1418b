"""Uploads that land as rows, with the file's bytes, to records: a micro-batch writes all tables or is run again as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from radquery.operators import records, store
from radquery.operators.keys import read_marks
from radquery.operators.scoring import Scorer
from radquery.sources.files import decoded_contents, save_files, sha
from radquery.sources.images import SIZE, features
from radquery.sources.scratch import stored
from radquery.sources.tables import create_tables

UPLOADS = "filename string, content binary, mime string, patient_id string, scan_type string, notes string, at timestamp"
_PROBS = "array<struct<cls: string, p: double>>"


def take(uploads: DataFrame, folder: str, batch: str, cnn: Scorer | None = None, resnet: Scorer | None = None, size: int = SIZE) -> int:
    """Writes the records of a batch of ``UPLOADS``; how many were accepted. Equal files are decoded and scored once. Checks
    come in this order: type, bytes, whether it is an image, patient."""
    rows = stored(uploads.withColumns({"size_bytes": F.length("content").cast("long"), "key": sha(F.col("content")), "code": store.upload_code(F.col("mime"), F.coalesce(F.length("content"), F.lit(0)))}), "uploads")
    contents = rows.where("code = 200 and content is not null").select("key", "content")
    images = decoded_contents(contents)
    readable = images.where("error is null")
    vectors = features(readable.withColumnRenamed("key", "origin"), size=size)
    scored = stored(_scored(vectors, cnn, resnet), "scored").withColumnRenamed("key", "_key")
    found = rows.join(scored, F.col("key") == F.col("_key"), "left")
    found = found.withColumn("code", F.when((F.col("code") == 200) & F.col("_key").isNull(), 400).otherwise(F.col("code"))).drop("_key")
    fine = records.with_patients(found.where("code = 200"), folder, batch)
    fine = stored(fine.withColumn("code", F.when(F.col("patient").isNull(), 404).otherwise(200)), "resolved")
    refused = found.where("code != 200").select("filename", "patient_id", "mime", "code").unionByName(fine.where("code = 404").select("filename", "patient_id", "mime", "code"))
    records.write_rejections(refused.withColumn("reason", records.reason(F.col("code"), F.col("patient_id"), F.col("mime"))), folder, batch)
    accepted = fine.where("code = 200").drop("content").withColumn("at", F.coalesce("at", F.current_timestamp()))
    written = records.write_records(accepted, folder, batch, [F.col(c) for c in ("at", "filename", "key", "patient_id", "notes")])
    files = written.select("key", "image_path").join(stored(contents.dropDuplicates(["key"]), "contents"), "key")
    save_files(files.select(F.col("image_path").alias("path"), "content"))
    return written.count()


def _scored(vectors: DataFrame, cnn: Scorer | None, resnet: Scorer | None) -> DataFrame:
    out = vectors.select(F.col("origin").alias("key"), "features")
    for name, scorer in (("cnn_probs", cnn), ("resnet_probs", resnet)):
        if scorer is None:
            out = out.withColumn(name, F.lit(None).cast(_PROBS))
        else:
            out = scorer.transform(out)
            out = out.withColumn(name, F.transform("probs", lambda x: F.struct(x["cls"].cast("string").alias("cls"), x["p"].cast("double").alias("p")))).drop("probs")
    return out.select("key", "cnn_probs", "resnet_probs")


def take_uploads(spark: SparkSession, landing: str, folder: str, checkpoint: str, cnn: Scorer | None = None, resnet: Scorer | None = None, size: int = SIZE) -> StreamingQuery:
    """Takes the Parquet files of ``UPLOADS`` that are there, and on a later call those that came since."""
    create_tables(spark, folder)
    read_marks(spark, folder)
    rows = spark.readStream.schema(UPLOADS).parquet(landing)
    stream = rows.writeStream.foreachBatch(lambda batch, number: take(batch, folder, f"uploads-{number}", cnn, resnet, size) and None)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
