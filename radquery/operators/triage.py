"""From probabilities to decisions, within a row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from radquery.functions.dims import URGENCY
from radquery.functions.numeric import pyfmt, pyround


def top(probs: Column) -> Column:
    """The struct with the greatest p; the first of equal ones."""
    return F.element_at(probs, F.array_position(F.transform(probs, lambda x: x["p"]), F.array_max(F.transform(probs, lambda x: x["p"]))).cast("int"))


def percents(probs: Column) -> Column:
    return F.transform(probs, lambda x: F.struct(x["cls"].alias("cls"), pyround(x["p"] * 100, 2).alias("pct")))


def ranked(percents: Column, primary: Column, how_many: int = 2) -> Column:
    """Names and percentages of the next classes of (cls, pct), by percentage, then in class order."""
    others = F.filter(F.transform(percents, lambda x, i: F.struct((-x["pct"]).alias("by"), i.alias("at"), x["cls"].alias("cls"))), lambda x: x["cls"] != primary)
    return F.transform(F.slice(F.array_sort(others), 1, how_many), lambda x: F.concat(x["cls"].cast("string"), F.lit(" ("), pyfmt(-x["by"], 1), F.lit("%)")))


def alternatives(probs: Column, primary: Column, how_many: int = 2) -> Column:
    """``ranked`` of probabilities (cls, p), by the rounded percentage."""
    return ranked(percents(probs), primary, how_many)


def urgency(condition: Column, confidence: Column) -> Column:
    """From the confidence in percent as it was rounded; a limit itself is not above the limit."""
    out = None
    for level, (conditions, limit) in URGENCY.items():
        test = condition.isin(*conditions) & (confidence > limit)
        out = F.when(test, level) if out is None else out.when(test, level)
    return out.otherwise("routine")
