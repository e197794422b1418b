"""Learning curves stored as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zipped(curves: DataFrame, first: list[str], others: list[str]) -> DataFrame:
    """A row per epoch, from 1, up to the longer of the ``first`` arrays; where an array is shorter the value is null."""
    pairs = F.arrays_zip(*first, *others)
    longest = F.greatest(*map(F.size, first))
    return curves.select(F.posexplode(F.slice(pairs, 1, longest)).alias("_at", "_p")).select((F.col("_at") + 1).alias("epoch"), *(F.col(f"_p.{c}").alias(c) for c in first + others))


def concatenated(first: DataFrame, second: DataFrame, key: str, curves: list[str]) -> DataFrame:
    """The curves of two phases of training, one after the other, for each key of the first."""
    later = second.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in curves))
    joined = first.join(later, F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(key, *(F.concat(c, f"_{c}").alias(c) for c in curves))


def phases(epochs: Column) -> list[Column]:
    """Epochs with frozen layers (a third, from 1 to 4), and the others, 1 at least."""
    first = F.greatest(F.lit(1), F.least(F.lit(4), F.floor(epochs / 3))).cast("int")
    return [first.alias("frozen"), F.greatest(F.lit(1), epochs - first).cast("int").alias("tuned")]


def early_stop(losses: Column, patience: int = 3) -> Column:
    """struct(stopped, best): the epoch, from 1, at which training stops, and that of the least loss until then."""
    start = F.struct(F.lit(0).alias("at"), F.lit(float("inf")).alias("least"), F.lit(0).alias("best"), F.lit(0).alias("stopped"))

    def step(s: Column, x: Column) -> Column:
        at, better = s["at"] + 1, x.cast("double") < s["least"]
        best = F.when(better, at).otherwise(s["best"])
        moved = F.struct(at.alias("at"), F.when(better, x.cast("double")).otherwise(s["least"]).alias("least"), best.alias("best"), F.when(at - best >= patience, at).otherwise(0).alias("stopped"))
        return F.when(s["stopped"] > 0, s).otherwise(moved)

    return F.aggregate(losses, start, step, lambda s: F.struct(F.when(s["stopped"] > 0, s["stopped"]).otherwise(s["at"]).alias("stopped"), s["best"].alias("best")))


def learning_rates(losses: Column, start: float = 1e-4, factor: float = 0.5, patience: int = 2, floor: float = 1e-7, least_change: float = 1e-4) -> Column:
    """The rate of each epoch: after ``patience`` epochs without a loss lower by ``least_change`` it is cut by ``factor``, not
    below ``floor``."""
    nothing = F.expr("cast(array() as array<double>)")
    first = F.struct(F.lit(float("inf")).alias("least"), F.lit(0).alias("waited"), F.lit(start).alias("rate"), nothing.alias("rates"))

    def step(s: Column, x: Column) -> Column:
        loss = x.cast("double")
        better = loss < s["least"] - F.lit(least_change)
        waited = F.when(better, 0).otherwise(s["waited"] + 1)
        cut = (waited >= patience) & (s["rate"] > floor)
        rate = F.when(cut, F.greatest(s["rate"] * F.lit(factor), F.lit(floor))).otherwise(s["rate"])
        return F.struct(F.when(better, loss).otherwise(s["least"]).alias("least"), F.when(cut, 0).otherwise(waited).alias("waited"), rate.alias("rate"), F.array_append(s["rates"], s["rate"]).alias("rates"))

    return F.aggregate(losses, first, step, lambda s: s["rates"])


def checkpoint_epoch(accuracies: Column) -> Column:
    """The epoch, from 1, of the model that is kept: the first one with the greatest validation accuracy."""
    return F.array_position(accuracies, F.array_max(accuracies)).cast("int")
