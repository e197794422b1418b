"""Running totals and ranks within groups that may hold most of the rows.

A window over such a group is one task's work. Here a group is cut into buckets that follow the order; the totals of the
buckets before are added to a window within a bucket, so no task gets more than a bucket.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radquery.sources.scratch import stored


def running_total(df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group that come before by (bucket, order)."""
    cut = df.withColumns({"_bucket": bucket, "_value": value})
    keys = [*group, "_bucket"]
    sizes = cut.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    sizes = sizes.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_before")
    joined = cut.join(sizes, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))).drop(*(f"_of_{k}" for k in keys))
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_value", "_within", "_before")


BUCKETS = 4096


def hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``_order``, by which rows come in an order that is the same on every run, and a bucket of it. Rows with equal keys
    have the same place."""
    text = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return df.withColumn("_order", F.struct(text.alias("hash"), F.col(key).alias("key"))).withColumn("_bucket", F.conv(F.substring(F.col("_order.hash"), 1, 3), 16, 10).cast("int"))


def nth_by_hash(df: DataFrame, group: str, key: str, seed: int, places: DataFrame) -> DataFrame:
    """(group, name, bound): the order of the row at each of the ``places`` (group, name, nth) of its group, counted from 1.

    Buckets are counted first, and only the rows of the buckets that hold such a place are ranked. What is at most the bound is
    then known from a row alone, without another shuffle. Groups may be null.
    """
    rows = hashed(df.select(group, key), key, seed)
    sizes = stored(rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n")), "bucket-sizes")  # BUCKETS for each group at most
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.select(F.col(group).alias("_group"), "_bucket", "_n", upto.alias("_upto"))
    inside = places.join(sizes, F.col(group).eqNullSafe(F.col("_group")) & (F.col("nth") <= F.col("_upto")) & (F.col("nth") > F.col("_upto") - F.col("_n")))
    inside = stored(inside.select("_group", F.col("_bucket").alias("_at"), "name", (F.col("nth") - F.col("_upto") + F.col("_n")).alias("_k")), "bucket-places")
    where = stored(inside.select("_group", "_at").distinct(), "buckets")
    near = rows.join(where, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_at"))).drop("_group", "_at")
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_order")))
    found = ranked.join(inside, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_at")) & (F.col("_r") == F.col("_k")))
    return found.select(group, "name", F.col("_order").alias("bound"))
