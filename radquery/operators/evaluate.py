"""Evaluation of scored rows: confusion, precision and recall, AUC, composite score and winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radquery.functions.dims import COMPOSITE
from radquery.functions.numeric import pyround, ratio
from radquery.functions.ranks import running_total
from radquery.sources.scratch import stored


def pairs(rows: DataFrame, actual: str, predicted: str, *sums: str) -> DataFrame:
    """(actual, predicted, n, sums of further columns): a row for each pair of classes that occurs."""
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))


def dense(found: DataFrame) -> DataFrame:
    """``pairs``, also for classes that don't occur together, with 0 there: the classes crossed with themselves, which is as
    many rows as the table has, and the pairs joined to that."""
    found = stored(found, "pairs")
    classes = stored(found.select(F.explode(F.array("actual", "predicted")).alias("actual")).distinct(), "classes")
    grid = classes.crossJoin(classes.select(F.col("actual").alias("predicted")))
    cells = found.select(*(F.col(c).alias(f"_{c}") for c in found.columns))
    joined = grid.join(cells, F.col("actual").eqNullSafe(F.col("_actual")) & F.col("predicted").eqNullSafe(F.col("_predicted")), "left")
    return joined.select("actual", "predicted", *(F.coalesce(F.col(f"_{c}"), F.lit(0)).alias(c) for c in found.columns[2:]))


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n), also for pairs of classes that don't occur together."""
    return dense(pairs(rows, actual, predicted))


def per_class(matrix: DataFrame) -> DataFrame:
    """(cls, precision, recall, f1, support) from a dense confusion table."""
    cell = F.explode(F.array(F.struct(F.col("actual").alias("cls"), F.lit(True).alias("row")), F.struct(F.col("predicted").alias("cls"), F.lit(False).alias("row"))))
    each = matrix.select("actual", "predicted", "n", cell.alias("x"))
    sums = each.groupBy(F.col("x.cls").alias("cls")).agg(
        F.sum(F.when(F.col("x.row") & (F.col("actual") == F.col("predicted")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.row"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("x.row"), F.col("n")).otherwise(0)).alias("chosen"),
    )
    rates = sums.withColumns({"precision": ratio(F.col("tp"), F.col("chosen")), "recall": ratio(F.col("tp"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rates.select("cls", "precision", "recall", f1.alias("f1"), "support", "tp")


def weighted(report: DataFrame) -> DataFrame:
    """One row: accuracy and the means weighted by support, unrounded."""
    total = F.sum("support")
    mean = lambda c: ratio(F.sum(F.col(c) * F.col("support")), total)
    return report.agg(ratio(F.sum("tp"), total).alias("accuracy"), mean("precision").alias("precision"), mean("recall").alias("recall"), mean("f1").alias("f1_score"))


def auc(rows: DataFrame, group: list[str], score: Column, positive: Column) -> DataFrame:
    """(group, auc): the share of pairs of a positive and a negative row in right order, ties as half; null without pairs.

    Rows with equal scores are summed first, and the scores are cut into ranges of about as many, so no task sees a whole class.
    """
    values = rows.groupBy(*group, score.alias("_score")).agg(F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(values.repartitionByRange(tasks, *group, "_score").withColumn("_range", F.spark_partition_id()), "scores")
    below = running_total(ranged, group, F.col("_range"), [F.col("_score")], F.col("_neg"), "_below")
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    return below.groupBy(*group).agg(F.try_divide(wins.cast("double"), F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc"))


def macro_auc(scored: DataFrame, label: str, probs: str = "probs") -> DataFrame:
    """One row: the mean over classes of one class against the rest; 0 if a class has no positive or no negative row."""
    each = scored.select(F.col(label).alias("_label"), F.explode(probs).alias("x")).select("_label", "x.cls", "x.p")
    one = auc(each, ["cls"], F.col("p"), F.col("_label") == F.col("cls"))
    return one.agg(F.when(F.count_if(F.col("auc").isNull()) > 0, 0.0).otherwise(F.avg("auc")).alias("auc_roc"))


def rounded(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({c: pyround(F.col(c), 4) for c in ("accuracy", "precision", "recall", "f1_score", "auc_roc")})


def composite(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("composite", pyround(sum((F.col(c) * w for c, w in COMPOSITE.items()), F.lit(0.0)), 4))
