import json

from pyspark.sql import functions as F

from radquery.operators.scoring import CentroidScorer, LogisticScorer
from radquery.operators.store import append
from radquery.sources import tables


def test_tables_are_made_once_and_appended_to(spark, tmp_path):
    tables.create_tables(spark, str(tmp_path))
    row = spark.createDataFrame([(1, "P1", "Alice", 30, "Female", None, None, None, None, None)], tables.TABLES["patients"])
    append(row, f"{tmp_path}/patients")
    tables.create_tables(spark, str(tmp_path))
    assert tables.read_table(spark, str(tmp_path), "patients").first()["name"] == "Alice"
    assert all(tables.read_table(spark, str(tmp_path), t).count() == (t == "patients") for t in tables.TABLES)


def test_results_document(spark, tmp_path):
    model = {"model_name": "CNN", "accuracy": 0.7822, "confusion_matrix": [[1, 0], [0, 1]], "class_names": ["a", "b"], "training_loss": [1.0, 0.5]}
    (tmp_path / "r.json").write_text(json.dumps({"cnn": model, "resnet": model | {"model_name": "ResNet50"}, "selected_model": "ResNet"}, indent=2))
    results = tables.read_results(spark, str(tmp_path / "r.json"))
    assert tables.class_names(results).first()[0] == ["a", "b"] and results.first()["cnn"]["confusion_matrix"] == [[1, 0], [0, 1]]
    tables.write_results(results, str(tmp_path / "out"))
    assert tables.read_results(spark, str(tmp_path / "out")).first() == results.first()


def test_scorers_are_saved_and_missing_ones_tolerated(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 2), 0.5, 0.1 * i], i % 2) for i in range(20)], "id long, embedding array<double>, label int")
    for scorer, empty in ((CentroidScorer(dims=3), CentroidScorer(dims=3)), (LogisticScorer(), LogisticScorer())):
        path = str(tmp_path / type(scorer).__name__)
        want = scorer.fit(rows).transform(rows).select("id", "probs").orderBy("id").collect()
        tables.save_scorer(scorer, path)
        assert tables.load_scorer(spark, empty, path).transform(rows).select("id", "probs").orderBy("id").collect() == want
        assert tables.load_scorer(spark, empty, str(tmp_path / "none")) is None


def test_batches(spark):
    got = tables.batches(spark.range(100).withColumn("x", F.lit(1)), "id", 8, seed=42)
    sizes = [r["n"] for r in got.groupBy("batch").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 100 and max(sizes) <= 8


def test_record_ids_differ(spark):
    ids = {r[0] for r in spark.range(5).select(tables.record_id(upper=True)).collect()}
    assert len(ids) == 5 and all(i == i.upper() for i in ids)
