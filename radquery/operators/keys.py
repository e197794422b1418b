"""Dense numbers of rows without one task that sees them all, and ids that go on over appends."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radquery.sources.scratch import stored

#: Bits of the places within a partition that Spark numbers.
_BITS = 33
MARKS = "batch string, name string, first long, rows long"
#: Files of marks that a batch reads at most, about; more are put into one.
MARK_FILES = 64


def numbered(df: DataFrame, order: list[Column] | None = None, name: str = "id") -> DataFrame:
    """Adds numbers from 0, without gaps: in the order given, else as partitions follow one another.

    Rows are sorted by ranges and stored with their place in a partition; what comes before a partition is known from the
    partitions' counts, a row each. Equal rows should be told apart by the order, or they meet in one range.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", _BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))  # a row for each partition
    joined = placed.join(F.broadcast(starts), part == F.col("_part"))
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << _BITS) - 1)).drop("_at", "_part", "_before")


def read_marks(spark: SparkSession, folder: str) -> DataFrame:
    spark.createDataFrame([], MARKS).write.mode("ignore").parquet(f"{folder}/marks")
    return spark.read.schema(MARKS).option("recursiveFileLookup", True).parquet(f"{folder}/marks")


def _compact(marks: DataFrame, folder: str) -> None:
    """Puts marks into one file, then deletes the folders of those read. One that is there twice, as after a failure in
    between, does no harm, as marks are read by their greatest numbers."""
    spark, old = marks.sparkSession, marks.inputFiles()  # MARK_FILES names and a few
    marks.coalesce(1).write.parquet(f"{folder}/marks/all/{uuid.uuid4().hex}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    top = hadoop(f"{folder}/marks").getName()
    for file in old:
        parent = hadoop(spark._jvm.java.net.URI.create(file)).getParent()
        if parent.getName() != top:
            parent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(parent, True)


def reserve(spark: SparkSession, folder: str, batch: str, names: list[str], rows: int) -> list[int]:
    """The first ids for the rows that a batch adds to each of the tables, from 1 on. They are kept as the tables' high-water
    marks, so a batch that runs again gets the same ids, and the next one those that follow. One writer at a time."""
    every = read_marks(spark, folder)
    marks = every.where(F.col("name").isin(names)).groupBy("name")
    own = F.max(F.when(F.col("batch") == batch, F.col("first"))).alias("own")
    known = {r["name"]: r for r in marks.agg(own, F.max(F.col("first") + F.col("rows")).alias("next")).collect()}  # a row a name
    first = {n: (known[n]["own"] or known[n]["next"]) if n in known else 1 for n in names}
    new = [(batch, n, first[n], rows) for n in names if n not in known or known[n]["own"] is None]
    if new:
        spark.createDataFrame(new, MARKS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/{'-'.join(n for _, n, _, _ in new)}/batch={batch}")
        if len(every.inputFiles()) > MARK_FILES:
            _compact(every, folder)
    return [first[n] for n in names]


def write_batch(df: DataFrame, folder: str, name: str, batch: str, schema: str) -> None:
    """Writes the rows of a batch as a part of a stored table, in place of those of an earlier run of the batch. Columns that
    the rows lack are null."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    df.select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}/batch={batch}")


def read_batch(spark: SparkSession, folder: str, name: str, batch: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}/batch={batch}")


def append_numbered(df: DataFrame, folder: str, name: str, batch: str, schema: str, order: list[Column] | None = None, one_file: bool = False) -> int:
    """Appends rows with ids that follow those there; how many. Running a batch again replaces its rows, with the same ids. Rows
    that are few can go to one file, so that readers see all of them or none."""
    rows = stored(numbered(df, order, "_id"), name)
    n = rows.count()
    if n:
        (first,) = reserve(df.sparkSession, folder, batch, [name], n)
        rows = rows.withColumn("id", F.col("_id") + first)
        write_batch(rows.coalesce(1) if one_file else rows, folder, name, batch, schema)
    return n
