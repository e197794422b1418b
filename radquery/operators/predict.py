"""From the probabilities of two models to one stored prediction, within a row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radquery.functions.dims import DEFAULT_FINDINGS, DEFAULT_PRECAUTIONS, DEMO, DISCLAIMER, FINDINGS, PRECAUTIONS, told
from radquery.functions.numeric import pyround
from radquery.operators.triage import percents, ranked, top, urgency

#: Fixed value: the model that decides where nothing else is said.
DEFAULT_MODEL = "ResNet"


def slot(probs: Column, accuracy: Column) -> Column:
    """A model's result, or null where it has no probabilities."""
    found = F.struct(
        top(probs)["cls"].alias("condition"),
        pyround(top(probs)["p"] * 100, 2).alias("confidence"),
        accuracy.cast("double").alias("accuracy"),
        F.transform(percents(probs), lambda x: F.struct(x["cls"].alias("cls"), x["pct"].alias("pct"))).alias("percents"),
    )
    return F.when(probs.isNotNull(), found)


def demo() -> Column:
    condition = max(DEMO, key=DEMO.get)
    each = F.array(*(F.struct(F.lit(k).alias("cls"), F.lit(v).alias("pct")) for k, v in DEMO.items()))
    return F.struct(F.lit(condition).alias("condition"), F.lit(DEMO[condition]).alias("confidence"), F.lit(None).cast("double").alias("accuracy"), each.alias("percents"))


def predictions(rows: DataFrame, selected: Column | None = None, cnn_accuracy: Column | None = None, resnet_accuracy: Column | None = None) -> DataFrame:
    """Adds a prediction's columns to rows with ``cnn_probs`` and ``resnet_probs``, arrays of (cls, p) or null.

    The selected model's result is final where there is one, else ResNet's, else the CNN's. Where no model has a result, a fixed
    one stands in, for both models.
    """
    none, selected = F.lit(None), F.lit(DEFAULT_MODEL) if selected is None else selected
    slots = rows.select(
        *(c for c in rows.columns if c != "selected_model"),
        selected.alias("selected_model"),
        slot(F.col("cnn_probs"), none if cnn_accuracy is None else cnn_accuracy).alias("_cnn"),
        slot(F.col("resnet_probs"), none if resnet_accuracy is None else resnet_accuracy).alias("_resnet"),
    )
    chosen = F.when(F.lower("selected_model") == "cnn", F.coalesce("_cnn", "_resnet")).otherwise(F.coalesce("_resnet", "_cnn"))
    missing = F.col("_cnn").isNull() & F.col("_resnet").isNull()
    filled = slots.select("*", F.coalesce(chosen, demo()).alias("_final"), F.lit("Both").alias("model_used"))
    filled = filled.withColumns({f"_{m}": F.when(missing, demo()).otherwise(F.col(f"_{m}")) for m in ("cnn", "resnet")})
    columns = {}
    for m in ("cnn", "resnet"):
        x = F.col(f"_{m}")
        columns |= {f"{m}_primary_condition": x["condition"], f"{m}_confidence": x["confidence"], f"{m}_accuracy": x["accuracy"], f"{m}_all_probabilities": F.map_from_entries(x["percents"])}
    best = F.col("_final")
    columns |= {
        "final_condition": best["condition"],
        "final_confidence": best["confidence"],
        "urgency_level": urgency(best["condition"], best["confidence"]),
        "alternative_conditions": ranked(best["percents"], best["condition"]),
        "key_findings": told(best["condition"], FINDINGS, DEFAULT_FINDINGS),
        "precautions": told(best["condition"], PRECAUTIONS, DEFAULT_PRECAUTIONS),
        "disclaimer": F.lit(DISCLAIMER),
    }
    return filled.withColumns(columns).drop("_cnn", "_resnet", "_final", "cnn_probs", "resnet_probs")
