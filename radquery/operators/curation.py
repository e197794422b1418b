"""Dataset curation: index, cleaning, label ids, exact stratified splits and samples, augmentation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radquery.functions.ranks import hashed, nth_by_hash
from radquery.operators.keys import numbered
from radquery.sources.scratch import stored

#: What an image file's name ends in.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff")
MIN_BYTES = 1024
#: Rows that augmentation makes of one, in memory and streamed.
VARIANTS = {"memory": ["original", "flip"], "stream": ["original", "flip", "rotate_left", "rotate_right", "brighten"]}


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(SUFFIXES)})$")


def class_distribution(index: DataFrame, *labels: str) -> DataFrame:
    """Rows and their share in percent for each class, rows without one among them."""
    counts = index.groupBy(*labels).agg(F.count("*").alias("n"))
    total = index.agg(F.count("*").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select(*labels, "n", (100.0 * F.col("n") / F.col("total")).alias("share"))


def first_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with equal key (null is a key too) one with the smallest ``order``, null last. By partial aggregation, so a
    frequent key costs no task more; of rows that are alike in both, one stays."""
    row = F.min_by(F.struct(*df.columns), F.struct(F.col(order).isNull(), F.col(order))).alias("_row")
    return df.groupBy(key.alias("_key")).agg(row).select("_row.*")


def cleaning_stats(index: DataFrame, key: Column, size: str) -> DataFrame:
    """Rows, rows after removal of repeats, and those of them above the minimal size (of repeats, the greatest counts)."""
    groups = index.groupBy(key.alias("_key")).agg(F.count("*").alias("n"), F.max(size).alias("size"))
    return groups.agg(F.sum("n").alias("before"), F.count("*").alias("after_dedup"), F.count_if(F.col("size") > MIN_BYTES).alias("after_size"))


def label_ids(labels: DataFrame, label: str) -> DataFrame:
    """(label, label_idx): places of the distinct labels in alphabetical order, however many there are. Null is no label."""
    every = labels.select(label).where(F.col(label).isNotNull()).distinct()
    return numbered(every, [F.col(label)], "label_idx").select(label, "label_idx")


#: Labels that a join may broadcast.
FEW_LABELS = 1_000_000


def encoded(df: DataFrame, label: str, dictionary: DataFrame) -> DataFrame:
    """Adds ``label_idx`` by a dictionary of ``label_ids``, which may be stored. A label that it lacks, or none, is an error."""
    known = dictionary.select(F.col(label).alias("_label"), F.col("label_idx").alias("_idx"))
    known = F.broadcast(known) if known.count() <= FEW_LABELS else known
    unseen = F.raise_error(F.concat(F.lit("y contains previously unseen labels: "), F.coalesce(F.col(label).cast("string"), F.lit("None"))))
    return df.join(known, F.col(label) == F.col("_label"), "left").withColumn("label_idx", F.coalesce("_idx", unseen)).drop("_label", "_idx")


def decoded_labels(df: DataFrame, label: str, dictionary: DataFrame) -> DataFrame:
    """Adds ``label`` to rows with ``label_idx``; an index that the dictionary lacks is an error."""
    known = dictionary.select(F.col("label_idx").alias("_idx"), F.col(label).alias("_label"))
    known = F.broadcast(known) if known.count() <= FEW_LABELS else known
    unseen = F.raise_error(F.concat(F.lit("y contains previously unseen labels: "), F.coalesce(F.col("label_idx").cast("string"), F.lit("None"))))
    return df.join(known, F.col("label_idx") == F.col("_idx"), "left").withColumn(label, F.coalesce("_label", unseen)).drop("_label", "_idx")


def quotas(counts: DataFrame, label: str, size: Column) -> DataFrame:
    """(label, n, quota): ``size`` rows shared out by largest remainder; ties go by label. A row per class comes in."""
    arrays = counts.agg(F.array_sort(F.collect_list(F.struct(label, "n"))).alias("c"), F.sum("n").alias("total"))
    exact = arrays.withColumn("size", size).withColumn("x", F.transform("c", lambda c: c["n"] / F.col("total") * F.col("size")))
    short = exact.withColumn("short", F.col("size") - F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + F.floor(x)))
    rests = short.withColumn("rests", F.array_sort(F.transform("x", lambda x, i: F.struct((F.floor(x) - x).alias("rest"), i.alias("i")))))
    each = rests.select(F.posexplode("c").alias("_i", "c"), "x", "short", F.transform("rests", lambda r: r["i"]).alias("ranked"))
    more = (F.array_position("ranked", F.col("_i")) <= F.col("short")).cast("long")
    return each.select(f"c.{label}", "c.n", (F.floor(F.element_at("x", F.col("_i") + 1)) + more).cast("long").alias("quota"))


def _bounds(df: DataFrame, key: str, label: str, seed: int, places: DataFrame, names: list[str]) -> DataFrame:
    """(_label, a bound for each name): a row for each class, stored."""
    found = nth_by_hash(df, label, key, seed, places)
    each = found.groupBy(F.col(label).alias("_label")).agg(*(F.max(F.when(F.col("name") == n, F.col("bound"))).alias(f"_{n}") for n in names))
    return stored(each, "bounds")


def stratified_split(df: DataFrame, key: str, label: str, test: float = 0.15, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``split``. Test rows are a share of all, validation rows a share of the rest, exact in each class where keys differ;
    rows with the same key are in the same part. Rows without label are a class.

    The bounds of the parts are found first; then each row's part is known from its own hash.
    """
    counts = stored(df.groupBy(label).agg(F.count("*").alias("n")), "class-sizes")
    first = quotas(counts, label, F.ceil(F.lit(test) * F.col("total")))
    rest = first.select(label, (F.col("n") - F.col("quota")).alias("n"))
    second = quotas(rest, label, F.ceil(F.lit(val / (1 - test)) * F.col("total"))).select(F.col(label).alias("_l"), F.col("quota").alias("_v"))
    both = first.join(second, F.col(label).eqNullSafe(F.col("_l")))
    nth = F.explode(F.array(F.struct(F.lit("test").alias("name"), F.col("quota").alias("nth")), F.struct(F.lit("val").alias("name"), (F.col("quota") + F.col("_v")).alias("nth"))))
    places = stored(both.select(label, nth.alias("x")).select(label, "x.*"), "places")
    bounds = _bounds(df, key, label, seed, places, ["test", "val"])
    joined = hashed(df, key, seed).join(bounds, F.col(label).eqNullSafe(F.col("_label")), "left")
    split = F.when(F.col("_order") <= F.col("_test"), "test").when(F.col("_order") <= F.col("_val"), "val").otherwise("train")
    return joined.withColumn("split", split).drop("_order", "_bucket", "_label", "_test", "_val")


def stratified_subsample(df: DataFrame, key: str, label: str, most: int, seed: int = 42) -> DataFrame:
    """``most`` rows with the classes' shares kept, or all if there are no more; exact where keys differ."""
    counts = stored(df.groupBy(label).agg(F.count("*").alias("n")), "class-sizes")
    places = quotas(counts, label, F.least(F.lit(most), F.col("total"))).select(label, F.lit("last").alias("name"), F.col("quota").alias("nth"))
    bounds = _bounds(df, key, label, seed, places, ["last"])
    joined = hashed(df, key, seed).join(bounds, F.col(label).eqNullSafe(F.col("_label")))
    return joined.where(F.col("_order") <= F.col("_last")).drop("_order", "_bucket", "_label", "_last")


def augmented(df: DataFrame, mode: str) -> DataFrame:
    """A row for each variant of each row."""
    return df.withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS[mode]))))
