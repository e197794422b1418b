"""A multilayer network, trained by distributed sums of gradients in two phases, and the store of training results.

An epoch is one pass over the stored training rows: each task sums the gradients of its rows, Spark adds the tasks' sums, and
the driver moves the weights, whose number follows from the layers and never from the rows. A second pass takes loss and
accuracy of the validation rows.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery import schemas
from radquery.operators.keys import append_numbered
from radquery.sources.scratch import stored
from radquery.sources.tables import read_table

#: Epochs without a lower loss after which training stops; after which the step is cut, by what, and down to what.
STOP_PATIENCE, CUT_PATIENCE, CUT, LEAST_STEP, LEAST_CHANGE = 3, 2, 0.5, 1e-7, 1e-4
#: Decay of both means of gradients, and what keeps a division from zero (Adam).
DECAY, SMALL = (0.9, 0.999), 1e-7
#: Classes that a network may have.
MOST_CLASSES = 10_000
NETWORK = "layer int, inputs int, outputs int, weights array<double>, classes string"


class Network(NamedTuple):
    classes: list
    layers: list[np.ndarray]  # (inputs + 1) x outputs, the last row for the constant


def initial(classes: list, inputs: int, hidden: tuple[int, ...], seed: int = 42) -> Network:
    rng, sizes = np.random.default_rng(seed), [inputs, *hidden, len(classes)]
    return Network(classes, [np.vstack([rng.standard_normal((a, b)) * np.sqrt(2 / a), np.zeros((1, b))]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)])


def forward(layers: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """The rows before each layer, and the probabilities of the classes."""
    out = [x]
    for k, w in enumerate(layers):
        z = out[-1] @ w[:-1] + w[-1]
        if k < len(layers) - 1:
            out.append(np.maximum(z, 0))
        else:
            e = np.exp(z - z.max(1, keepdims=True))
            out.append(e / e.sum(1, keepdims=True))
    return out


def sums(layers: list[np.ndarray], x: np.ndarray, y: np.ndarray, gradients: bool) -> np.ndarray:
    """Rows, loss, right answers and, layer after layer, the gradients of all rows, summed."""
    values = forward(layers, x)
    p = values[-1][np.arange(len(y)), y]
    head = [len(y), -np.log(np.maximum(p, 1e-300)).sum(), (values[-1].argmax(1) == y).sum()]
    if not gradients:
        return np.array(head, dtype=np.float64)
    error, found = values[-1].copy(), []
    error[np.arange(len(y)), y] -= 1
    for k in reversed(range(len(layers))):
        found.append(np.vstack([values[k].T @ error, error.sum(0)]))
        error = (error @ layers[k][:-1].T) * (values[k] > 0)
    return np.concatenate([head, *(g.ravel() for g in reversed(found))])


def total(rows: DataFrame, layers: list[np.ndarray], gradients: bool) -> np.ndarray:
    """``sums`` over a table of (x, y), by one pass."""
    width = len(layers[0]) - 1

    def run(batches):
        found = None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(np.float64)
            here = sums(layers, x, batch.column(1).to_numpy(), gradients)
            found = here if found is None else found + here
        if found is not None:
            yield pa.record_batch([pa.array(np.arange(len(found))), pa.array(found)], names=["place", "value"])

    added = rows.select("x", "y").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(3 + (sum(w.size for w in layers) if gradients else 0))
    for r in added:
        out[r["place"]] = r["value"]
    return out


def _parts(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([w.size for w in like])
    return [part.reshape(w.shape) for part, w in zip(np.split(flat, ends[:-1]), like, strict=True)]


class Phase(NamedTuple):
    layers: list[np.ndarray]  # of the epoch with the least validation loss
    best: list[np.ndarray]  # of the first epoch with the greatest validation accuracy
    curves: dict[str, list[float]]


def train_phase(train: DataFrame, val: DataFrame, layers: list[np.ndarray], epochs: int, step: float, trained: set[int]) -> Phase:
    """Moves the layers whose numbers are in ``trained``; the others are frozen. Stops early, and cuts the step, by the
    validation loss."""
    layers = [w.copy() for w in layers]
    means, squares = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    curves: dict[str, list[float]] = {c: [] for c in ("training_loss", "training_accuracy", "validation_loss", "validation_accuracy", "rate")}
    least, least_at, kept, top, best = np.inf, 0, layers, -1.0, layers
    plateau, waited = np.inf, 0
    for epoch in range(1, epochs + 1):
        found = total(train, layers, True)
        n = max(found[0], 1)
        for k, g in enumerate(_parts(found[3:] / n, layers)):
            if k in trained:
                means[k] = DECAY[0] * means[k] + (1 - DECAY[0]) * g
                squares[k] = DECAY[1] * squares[k] + (1 - DECAY[1]) * g * g
                move = (means[k] / (1 - DECAY[0] ** epoch)) / (np.sqrt(squares[k] / (1 - DECAY[1] ** epoch)) + SMALL)
                layers[k] = layers[k] - step * move
        checked = total(val, layers, False)
        m = max(checked[0], 1)
        loss, accuracy = checked[1] / m, checked[2] / m
        for c, v in zip(curves, (found[1] / n, found[2] / n, loss, accuracy, step), strict=True):
            curves[c].append(float(v))
        if accuracy > top:
            top, best = accuracy, list(layers)
        if loss < plateau - LEAST_CHANGE:
            plateau, waited = loss, 0
        else:
            waited += 1
            if waited >= CUT_PATIENCE and step > LEAST_STEP:
                step, waited = max(step * CUT, LEAST_STEP), 0
        if loss < least:
            least, least_at, kept = loss, epoch, list(layers)
        elif epoch - least_at >= STOP_PATIENCE:
            break
    return Phase(kept, best, curves)


def save_network(spark: SparkSession, network: Network, path: str) -> None:
    """A row for each layer, in place of what is there."""
    rows = [(k, len(w) - 1, w.shape[1], w.ravel().tolist(), json.dumps(network.classes)) for k, w in enumerate(network.layers)]
    spark.createDataFrame(rows, NETWORK).coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> Network:
    rows = spark.read.schema(NETWORK).parquet(path).orderBy("layer").collect()  # as many as layers
    return Network(json.loads(rows[0]["classes"]), [np.array(r["weights"]).reshape(r["inputs"] + 1, r["outputs"]) for r in rows])


def phases(epochs: int) -> tuple[int, int]:
    """Epochs with frozen layers, and the others, as ``curves.phases`` has them."""
    first = max(1, min(4, epochs // 3))
    return first, max(1, epochs - first)


def examples(rows: DataFrame, features: str, label: str, classes: list) -> DataFrame:
    """(x, y), stored: rows with features whose label is one of the classes."""
    number = F.create_map(*(F.lit(v) for k, c in enumerate(classes) for v in (c, k)))
    y = F.try_element_at(number, F.col(label)) if classes else F.lit(None).cast("int")
    return stored(rows.where(F.col(features).isNotNull()).select(F.col(features).cast("array<float>").alias("x"), y.alias("y")).where("y is not null"), "examples")


def two_phases(train: DataFrame, val: DataFrame, network: Network, folder: str, name: str, epochs: int = 50, steps: tuple[float, float] = (1e-3, 1e-4)) -> tuple[Network, dict[str, list[float]]]:
    """Trains the last layer alone, then all layers at another step from what phase one has stored; ``train`` and ``val`` are
    ``examples``. Each phase keeps its best model by validation accuracy as ``name_phaseN_best``; the last one is ``name``.
    Returns the network and the curves of both phases, one after the other."""
    spark, curves = train.sparkSession, {}
    for k, (n, step) in enumerate(zip(phases(epochs), steps, strict=True), 1):
        start = network if k == 1 else load_network(spark, f"{folder}/{name}_phase1")
        trained = {len(start.layers) - 1} if k == 1 else set(range(len(start.layers)))
        done = train_phase(train, val, start.layers, n, step, trained)
        network = Network(network.classes, done.layers)
        save_network(spark, Network(network.classes, done.best), f"{folder}/{name}_phase{k}_best")
        save_network(spark, network, f"{folder}/{name}_phase{k}" if k == 1 else f"{folder}/{name}")
        for c, values in {"phase": [k] * len(done.curves["rate"]), **done.curves}.items():
            curves[c] = [*curves.get(c, []), *values]
    return network, curves


class NetworkScorer:
    """A network with hidden layers behind the same protocol as the other scorers."""

    def __init__(self, features: str = "embedding", label: str = "label", hidden: tuple[int, ...] = (32,), epochs: int = 60, step: float = 0.02, seed: int = 42):
        self.features, self.label, self.hidden, self.epochs, self.step, self.seed = features, label, hidden, epochs, step, seed

    def fit(self, train: DataFrame) -> NetworkScorer:
        """Trains all layers; one row in seven, by a hash of its features, is for validation."""
        found = [r[0] for r in train.select(self.label).where(F.col(self.label).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect()]
        if len(found) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} classes")
        classes, rows = sorted(found), train.where(F.col(self.features).isNotNull())
        late = F.pmod(F.xxhash64(F.col(self.features)), F.lit(7)) == 0
        width = rows.select(F.size(self.features)).first()[0]
        parts = [examples(rows.where(p), self.features, self.label, classes) for p in (~late, late)]
        start = initial(classes, width, self.hidden, self.seed)
        self.model = Network(classes, train_phase(*parts, start.layers, self.epochs, self.step, set(range(len(start.layers)))).layers)
        return self

    def save(self, path: str) -> None:
        save_network(SparkSession.active(), self.model, path)

    def load(self, spark: SparkSession, path: str) -> None:
        self.model = load_network(spark, path)

    def transform(self, df: DataFrame) -> DataFrame:
        classes, layers = self.model

        @F.pandas_udf("array<double>")
        def probabilities(x):
            import pandas as pd

            there = x.notna()
            out = pd.Series([None] * len(x), dtype=object)
            if there.any():
                out[there.to_numpy()] = pd.Series(list(forward(layers, np.stack(x[there].to_numpy()).astype(np.float64))[-1]), index=out.index[there.to_numpy()])
            return out

        names = F.array(*map(F.lit, classes))
        scored = df.withColumn("_p", probabilities(F.col(self.features).cast("array<double>")))
        probs = F.transform("_p", lambda p, i: F.struct(F.element_at(names, i + 1).alias("cls"), p.alias("p")))
        return scored.withColumn("probs", probs).drop("_p")


# ---- results --------------------------------------------------------------------------------------------------------


def record_training(results: DataFrame, folder: str, batch: str, best: Column) -> DataFrame:
    """Appends a training's rows of metrics (model_name, the figures, curves), as one file, which makes them visible at once.

    ``best`` orders the models, null first and ties by their names, which differ; the greatest alone is active, and the rows of
    trainings before no longer are (``active_metrics``).
    Versions are numbered by trainings. A batch that runs again replaces its rows."""
    spark = results.sparkSession
    others = read_table(spark, folder, "model_metrics").withColumn("_file", F.input_file_name()).where(~F.contains("_file", F.lit(f"/batch={batch}/")))
    before = others.agg(F.countDistinct("version").alias("n")).first()["n"]
    rows = stored(results.withColumn("_best", F.struct(best.alias("best"), "model_name")), "results")
    top = rows.agg(F.max("_best").alias("_top"))  # one row
    chosen = rows.join(F.broadcast(top)).withColumns({"is_active": F.col("_best").eqNullSafe(F.col("_top")), "version": F.lit(f"1.0.{before}"), "trained_at": F.current_timestamp()})
    append_numbered(chosen.drop("_best", "_top"), folder, "model_metrics", batch, schemas.MODEL_METRICS, [F.col("model_name")], one_file=True)
    return active_metrics(spark, folder)


def active_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All stored metrics; active is the best model of the last training alone."""
    rows = read_table(spark, folder, "model_metrics")
    last = rows.agg(F.max_by("version", "id").alias("_last"))  # one row
    return rows.join(F.broadcast(last)).withColumn("is_active", F.col("is_active") & F.col("version").eqNullSafe(F.col("_last"))).drop("_last")
