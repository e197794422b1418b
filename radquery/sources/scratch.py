"""Tables on the way, in the folder that driver and executors share.

Everything goes below ``spark.checkpoint.dir``, which the cluster names as a folder that all nodes see. Only where it is
unset, and Spark runs in local mode, a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlsplit

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    base = tempfile.mkdtemp(prefix="radquery-shared-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)  # results read it until the process ends
    spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as written to Parquet and read again: made once, of known size, and safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_file(uri: str, content: bytes) -> None:
    """A file that appears under its name only when complete, so a task that is run again does no harm."""
    parts = urlsplit(uri)
    fs, path = (pafs.LocalFileSystem(), parts.path if parts.scheme else uri) if parts.scheme in ("", "file") else pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, path)
