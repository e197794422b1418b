"""Training in two phases, the network scorer, and the store of results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from radquery.operators import curves, training
from radquery.operators.scoring import CentroidScorer
from radquery.sources import tables
from radquery.sources.scratch import new_folder, stored


def rings(n, seed):
    """Points of two rings about one center, which no centroids tell apart."""
    rng = np.random.default_rng(seed)
    angle, label = rng.uniform(0, 2 * np.pi, n), np.arange(n) % 2
    radius = np.where(label, 2.0, 0.7) + rng.normal(0, 0.1, n)
    return [(i, [float(r * np.cos(a)), float(r * np.sin(a))], "outer" if y else "inner") for i, (a, r, y) in enumerate(zip(angle, radius, label, strict=True))]


@pytest.fixture(scope="module")
def points(spark):
    return [stored(spark.createDataFrame(rings(n, n), "id long, embedding array<double>, label string").repartition(3), "rings") for n in (700, 200)]


def share(rows):
    best = F.element_at("probs", F.expr("cast(array_position(transform(probs, x -> x.p), array_max(transform(probs, x -> x.p))) as int)"))["cls"]
    return rows.agg(F.avg((best == F.col("label")).cast("double"))).first()[0]


def test_network_tells_rings_apart_and_is_saved(spark, points, tmp_path):
    train, test = points
    scorer = training.NetworkScorer(hidden=(16,), epochs=60, step=0.05).fit(train)
    assert share(scorer.transform(test)) > 0.95 > 0.8 > share(CentroidScorer(dims=2).fit(train).transform(test))
    tables.save_scorer(scorer, str(tmp_path / "net"))
    again = tables.load_scorer(spark, training.NetworkScorer(), str(tmp_path / "net"))
    assert again.transform(test).select("id", "probs").orderBy("id").collect() == scorer.transform(test).select("id", "probs").orderBy("id").collect()
    assert tables.load_scorer(spark, training.NetworkScorer(), str(tmp_path / "none")) is None
    odd = spark.createDataFrame([(1, None), (2, [0.0, 2.0])], "id long, embedding array<double>")
    got = {r["id"]: r["probs"] for r in scorer.transform(odd).collect()}
    assert got[1] is None and sum(p["p"] for p in got[2]) == pytest.approx(1)


def plain(x, y, vx, vy, layers, epochs, step, trained):
    """The same phase in one process."""
    layers, m, v = [w.copy() for w in layers], [0.0] * len(layers), [0.0] * len(layers)
    losses = []
    for t in range(1, epochs + 1):
        hidden = np.maximum(x @ layers[0][:-1] + layers[0][-1], 0)
        z = hidden @ layers[1][:-1] + layers[1][-1]
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        d = (p - np.eye(2)[y]) / len(y)
        back = (d @ layers[1][:-1].T) * (hidden > 0)
        gradients = [np.vstack([x.T @ back, back.sum(0)]), np.vstack([hidden.T @ d, d.sum(0)])]
        for k in trained:
            m[k] = 0.9 * m[k] + 0.1 * gradients[k]
            v[k] = 0.999 * v[k] + 0.001 * gradients[k] ** 2
            layers[k] = layers[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)
        z = np.maximum(vx @ layers[0][:-1] + layers[0][-1], 0) @ layers[1][:-1] + layers[1][-1]
        losses.append(float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(vy)), vy])))
    return layers, losses


def test_two_phases_go_on_from_what_is_stored(spark, points):
    folder, classes = new_folder(spark, "models"), ["inner", "outer"]
    train, val = (training.examples(p, "embedding", "label", classes) for p in points)
    start = training.initial(classes, 2, (8,))
    net, found = training.two_phases(train, val, start, folder, "net", epochs=9, steps=(0.05, 0.02))
    assert found["phase"] == [1] * 3 + [2] * 6 and found["validation_loss"][-1] < found["validation_loss"][0] and found["rate"] == [0.05] * 3 + [0.02] * 6
    first = training.load_network(spark, f"{folder}/net_phase1")
    assert np.array_equal(first.layers[0], start.layers[0]) and not np.array_equal(first.layers[1], start.layers[1])  # frozen, and not
    arrays = [np.array([r[i] for r in t.collect()]) for t in (train, val) for i in (0, 1)]
    layers, losses = plain(*arrays, start.layers, 3, 0.05, [1])
    assert found["validation_loss"][:3] == pytest.approx(losses, rel=1e-6)
    layers, losses = plain(*arrays, layers, 6, 0.02, [0, 1])
    assert found["validation_loss"][3:] == pytest.approx(losses, rel=1e-6)
    assert all(np.allclose(a, b, rtol=1e-5, atol=1e-7) for a, b in zip(net.layers, layers, strict=True))
    assert training.load_network(spark, f"{folder}/net").classes == classes and training.load_network(spark, f"{folder}/net_phase2_best").layers[0].shape == (3, 8)


def test_training_stops_and_cuts_its_step(spark, points):
    classes = ["inner", "outer"]
    train = training.examples(points[0], "embedding", "label", classes)
    wrong = training.examples(points[1].withColumn("label", F.when(F.col("label") == "inner", "outer").otherwise("inner")), "embedding", "label", classes)
    done = training.train_phase(train, wrong, training.initial(classes, 2, (8,)).layers, 30, 0.1, {0, 1})
    rates, losses = done.curves["rate"], done.curves["validation_loss"]
    got = spark.createDataFrame([(losses,)], "a array<double>").select(curves.learning_rates(F.col("a"), 0.1).alias("r"), curves.early_stop(F.col("a")).alias("s")).first()
    assert len(rates) < 30 and rates == pytest.approx(got["r"]) and got["s"]["stopped"] == len(rates) and rates[-1] < 0.1


def test_learning_rates(spark):
    df = spark.createDataFrame([([3.0, 2.0, 2.0, 2.00005, 1.99995, 2.5, 1.0, 1.0, 1.0, 1.0],), ([],)], "a array<double>")
    rows = [r[0] for r in df.select(curves.learning_rates(F.col("a"), 1.0, floor=0.2)).collect()]
    assert rows == [[1.0, 1.0, 1.0, 1.0, 0.5, 0.5, 0.25, 0.25, 0.25, 0.2], []]
    assert df.select(curves.checkpoint_epoch(F.col("a"))).first()[0] == 1


def test_one_model_is_active_where_scores_are_equal_or_missing(spark, tmp_path):
    tables.create_tables(spark, str(tmp_path))
    for batch, scores, want in (("a", (0.9, 0.9), "RESNET"), ("b", (0.9, None), "CNN"), ("c", (None, None), "RESNET")):
        rows = spark.createDataFrame([("CNN", scores[0]), ("RESNET", scores[1])], "model_name string, accuracy double")
        got = training.record_training(rows, str(tmp_path), batch, F.col("accuracy"))
        assert [r["model_name"] for r in got.where("is_active").collect()] == [want]
        assert got.where("is_active is null").isEmpty()


def test_one_model_is_active_after_each_training(spark, tmp_path):
    tables.create_tables(spark, str(tmp_path))
    figures = "model_name string, accuracy double, f1_score double, training_loss array<double>"
    for k, scores in enumerate(((0.8, 0.9), (0.95, 0.9), (0.95, 0.9))):
        rows = spark.createDataFrame([("CNN", scores[0], 0.5, [1.0, 0.5]), ("RESNET", scores[1], 0.5, [1.0])], figures)
        got = training.record_training(rows, str(tmp_path), f"t{min(k, 1)}", F.struct("accuracy", "model_name")).collect()  # the second one runs twice
    assert sorted((r["id"], r["model_name"], r["version"], r["is_active"]) for r in got) == [(1, "CNN", "1.0.0", False), (2, "RESNET", "1.0.0", False), (3, "CNN", "1.0.1", True), (4, "RESNET", "1.0.1", False)]
