"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; a row's fraction is (rank + 1/2) / rows of its source. Sorted by
fraction, any stretch of rows holds each source in its share of all rows. The sorted rows are cut into shards whose counts are
at most one apart, so each shard has the mixture of the whole, to one or two rows of a source.

Both ranks are running totals over buckets of the order (``functions.ranks``), so neither a source that holds most rows nor
the whole table is sorted by one task. Rows with equal hash (those alike in id and text) come in no set order among themselves.
Rows without a source are a source of their own; a null text is empty; no row: no shard. All columns are kept, and those named
``shard`` or ``slot`` are replaced. Equal texts needn't stay together under this law.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.functions.ranks import running_total
from radquery.llm.shared import small, write_table

SHARDS, SEED = 8, 42
#: Rows that a bucket has, about, and bits of the number of buckets.
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 50_000, 10, 14


def seeded(docs: DataFrame, seed: int = SEED) -> Column:
    """The place of a row among those of its source."""
    return F.xxhash64(F.lit(seed), docs["doc_id"].cast("string"), docs["text"])


def interleave(rows: DataFrame, source: Column, place: Column, shards: int = SHARDS) -> DataFrame:
    """Adds shard (from 0) and slot (the row's place in it, from 0). ``rows`` should be a stored table, as it is read four
    times; the columns that it has are dealt out twice, so it is best narrow. ``write_shards`` takes the texts along."""
    n = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(n / BUCKET_ROWS + 1))))
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    row = F.struct(*(rows[f"`{c}`"].alias(c) for c in kept)) if kept else F.lit(None)
    keyed = rows.select(row.alias("row"), source.cast("string").alias("source"), place.cast("long").alias("place"))
    sizes = small(write_table(keyed.groupBy("source").agg(F.count("*").alias("of")), "source-sizes")).withColumnRenamed("source", "_source")
    ranked = running_total(keyed, ["source"], F.shiftright("place", 64 - bits), [F.col("place")], F.lit(1).cast("long"), "rank")
    fraction = (F.col("rank") + 0.5) / F.col("of")
    ranked = ranked.join(sizes, F.col("source").eqNullSafe(F.col("_source"))).select("row", "source", "place", fraction.alias("fraction"))
    ranked = write_table(ranked, "fractions")
    order = [F.col("fraction"), F.col("source"), F.col("place")]
    at = running_total(ranked, [], F.floor(F.col("fraction") * (1 << bits)), order, F.lit(1).cast("long"), "position")
    shard = F.expr(f"position * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")  # rounded up
    placed = at.select("row", "position", shard.cast("int").alias("shard"))
    return placed.select(*(F.col("row").getField(c).alias(c) for c in kept), "shard", (F.col("position") - first).alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, files: int = 1) -> DataFrame:
    """Writes all columns of ``docs`` as ``shard=N`` folders of Parquet files, each in order of slots, a shard in as many
    files as asked for; returns them as a table."""
    places = interleave(docs, docs["source"], seeded(docs, seed), shards)
    of = docs.count()
    part = F.expr(f"slot * {files} div {max(1, -(-of // shards))}")
    dealt = places.withColumn("_part", part).repartitionByRange(shards * files, "shard", "_part").sortWithinPartitions("shard", "slot").drop("_part")
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(dealt.schema).parquet(folder)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), "source", seeded(docs).alias("place"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = write_table(rows, "rows")
    placed = interleave(rows, rows["source"], rows["place"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
