"""Files and tables that driver and executors share.

Everything goes below the folder of ``radquery.sources.scratch``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.sources.scratch import shared_dir


def new_dir(spark: SparkSession, name: str) -> str:
    """The URI of a folder that no other call gets; it is made when something is written there."""
    made = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(made)
    return made


#: What calls within ``temporary`` have made, innermost last: folders, and broadcasts.
_scopes: list[list[str | Broadcast]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Folders and broadcasts that are made within go at the end; what is to stay is written to a folder named before."""
    _scopes.append([])
    try:
        yield
    finally:
        for made in _scopes.pop():
            if isinstance(made, str):
                delete(made)
            else:
                made.destroy()


def share(spark: SparkSession, value) -> Broadcast:
    made = spark.sparkContext.broadcast(value)
    if _scopes:
        _scopes[-1].append(made)
    return made


def delete(uri: str) -> None:
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def write_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows of ``df`` as written to Parquet and read again: it cuts the lineage and survives lost executors."""
    path = path or new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that a join may broadcast: some 16 MB.
BROADCAST_ROWS = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """A stored table of keys, to be broadcast if a count shows that it is small; else Spark chooses how to join it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def files_for(size: int, least: int = 16 << 20, most: int = 1 << 30, many: int = 4096) -> int:
    """The number of files for so many bytes. A file has ``least`` bytes, about; beyond ``many`` files it has more, up to ``most``."""
    return max(1, -(-size // min(most, max(least, size // many))))


#: Rows of some ten numbers that a task of an exchange gets, about, and tasks that an exchange has at most.
TASK_ROWS, MOST_TASKS = 4_000_000, 20_000


def tasks_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """Tasks of an exchange of so many rows: as many as the session names, or more where they would get more than ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-rows // each)))


def is_local(uri: str) -> bool:
    return urlsplit(uri).scheme in ("", "file")


def local_path(uri: str) -> str:
    return urlsplit(uri).path if uri.startswith("file:") else uri


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), local_path(uri)) if is_local(uri) else pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """An output file that appears under its name only when complete, so a task that is run again does no harm."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self) -> pa.NativeFile:
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.stream = self.fs.open_output_stream(self.temporary)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.fs.move(self.temporary, self.path)
        else:
            self.fs.delete_file(self.temporary)


def open_mapped(uri: str) -> pa.NativeFile:
    """Memory-mapped where the shared folder is mounted; else a stream that can seek."""
    fs, path = filesystem(uri)
    return pa.memory_map(path, "r") if is_local(uri) else fs.open_input_file(path)
