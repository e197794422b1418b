"""Known results: published confusion matrices and counts, rounding, thresholds, ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from radquery.functions.dims import DEMO, FINDINGS, PRECAUTIONS
from radquery.functions.numeric import pyfmt, pyround
from radquery.functions.ranks import running_total
from radquery.operators import curation, curves, evaluate, predict, report, store, triage, views
from radquery.streaming.landing import triaged

CLASSES = ["COVID-19", "Lung Cancer", "Normal", "Pneumonia", "Tuberculosis"]
A = [[543, 0, 0, 0, 0], [98, 2, 0, 1, 3], [0, 0, 49, 188, 0], [6, 0, 1, 634, 0], [56, 0, 0, 2, 47]]
B = [[530, 0, 2, 5, 6], [0, 104, 0, 0, 0], [2, 0, 213, 22, 0], [2, 0, 18, 620, 1], [18, 0, 0, 2, 85]]


@pytest.mark.parametrize("matrix, want", [(A, (0.7822, 0.8264, 0.7822, 0.7216)), (B, (0.9521, 0.9518, 0.9521, 0.9517))])
def test_published_matrices(spark, matrix, want):
    rows = [(a, p, n) for a, line in zip(CLASSES, matrix) for p, n in zip(CLASSES, line)]
    got = evaluate.weighted(evaluate.per_class(spark.createDataFrame(rows, "actual string, predicted string, n long")))
    row = got.select(*(pyround(F.col(c), 4) for c in ("accuracy", "precision", "recall", "f1_score"))).first()
    assert tuple(row) == want


def test_composite_of_published_metrics(spark):
    rows = [("ResNet", 0.9517, 0.9521, 0.9939, 0.9521), ("CNN", 0.7216, 0.7822, 0.9519, 0.7822)]
    got = evaluate.composite(spark.createDataFrame(rows, "model string, f1_score double, accuracy double, auc_roc double, recall double"))
    assert {r["model"]: r["composite"] for r in got.collect()} == {"ResNet": 0.9603, "CNN": 0.7919}


def test_published_split_counts(spark):
    counts = spark.createDataFrame(list(zip(CLASSES, (3616, 692, 1583, 4273, 700))), "label string, n long")
    test = curation.quotas(counts, "label", F.ceil(F.lit(0.15) * F.col("total")))
    assert {r["label"]: r["quota"] for r in test.collect()} == dict(zip(CLASSES, (543, 104, 237, 641, 105)))
    rest = test.select("label", (F.col("n") - F.col("quota")).alias("n"))
    val = curation.quotas(rest, "label", F.ceil(F.lit(0.15 / 0.85) * F.col("total")))
    assert sum(r["quota"] for r in val.collect()) == 1630


def test_rounding_is_that_of_python(spark):
    values = [i / 1000 for i in range(0, 3000, 5)] + [2.675, 0.125, 82.45]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", pyround(F.col("x"), 2), pyfmt(F.col("x"), 1)).collect()
    assert all((round(x, 2), f"{x:.1f}") == (a, b) for x, a, b in got)


def test_decisions(spark):
    probs = F.array(*(F.struct(F.lit(k).alias("cls"), F.lit(v / 100).alias("p")) for k, v in DEMO.items()))
    row = spark.range(1).select(triage.top(probs)["cls"], triage.alternatives(probs, F.lit("Pneumonia")), triage.urgency(F.lit("Pneumonia"), F.lit(82.4))).first()
    assert tuple(row) == ("Pneumonia", ["Tuberculosis (7.1%)", "Normal (4.2%)"], "urgent")
    tie = F.array(*(F.struct(F.lit(k).alias("cls"), F.lit(p).alias("p")) for k, p in (("a", 0.4), ("b", 0.4), ("c", 0.2))))
    assert spark.range(1).select(triage.top(tie)["cls"]).first()[0] == "a"


def test_urgency_limits_are_strict(spark):
    rows = [("Lung Cancer", 70.0, "routine"), ("Lung Cancer", 70.01, "emergency"), ("Pneumonia", 60.0, "routine"), ("Pneumonia", 60.01, "urgent"), ("Normal", 99.0, "routine"), ("Tuberculosis", 99.0, "urgent"), ("COPD", 99.0, "routine")]
    df = spark.createDataFrame(rows, "c string, p double, want string")
    assert df.where(triage.urgency(F.col("c"), F.col("p")) != F.col("want")).count() == 0


@pytest.mark.parametrize("places", [1, 2, 4, 6])
def test_rounding_is_that_of_python(spark, places):
    rng = np.random.default_rng(places)
    ties = [k / 2 * 10.0**-places for k in range(-41, 42)] + [2.675, 0.125, 1.005, 82.45, 0.25, 1e15 + 0.3, 123456789012.345, -0.0]
    values = [*map(float, rng.uniform(-1000, 1000, 3000)), *map(float, rng.uniform(0, 1, 3000)), *ties, *(float(np.nextafter(t, s)) for t in ties for s in (-1e9, 1e9))]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", pyround(F.col("x"), places).alias("r")).collect()
    assert {abs(r["x"]) for r in rows if r["r"] != round(r["x"], places)} <= {5e-05}  # where the JVM's text is another


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, p double").withColumn("g", F.lit(1))
    assert evaluate.auc(df, ["g"], F.col("p"), F.col("y") == 1).first()["auc"] == 0.875
    assert evaluate.auc(df.where("y = 1"), ["g"], F.col("p"), F.col("y") == 1).first()["auc"] is None


def test_macro_auc_of_a_class_that_is_always_wrong(spark):
    rows = [(y, [(0, p), (1, 1 - p if same else p)]) for y, p, same in ((0, 0.1, False), (0, 0.2, False), (1, 0.8, False), (1, 0.9, False))]
    df = spark.createDataFrame(rows, "y int, probs array<struct<cls: int, p: double>>")
    assert evaluate.macro_auc(df, "y").first()["auc_roc"] == 0.5  # class 0 has 0.0, class 1 has 1.0
    assert evaluate.macro_auc(df.where("y = 1"), "y").first()["auc_roc"] == 0.0  # undefined


def test_near_certain_scores_are_no_ties(spark):
    df = spark.createDataFrame([(1, 1 - 1e-14), (0, 1 - 2e-14), (1, 1e-14), (0, 1e-15)], "y int, p double").withColumn("g", F.lit(1))
    assert evaluate.auc(df, ["g"], F.col("p"), F.col("y") == 1).first()["auc"] == 0.75


def test_first_by_keeps_one_row_a_key(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("b", 1), ("b", 0), (None, 3), (None, None)], "k string, o int")
    assert sorted(map(tuple, curation.first_by(df, F.col("k"), "o").collect()), key=str) == sorted([("a", 1), ("b", 0), (None, 3)], key=str)


def test_rows_without_label_or_key_stay(spark):
    df = spark.range(100).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("id"), F.when(F.col("id") % 4 != 0, "x").alias("label"))
    parts = curation.stratified_split(df, "id", "label")
    assert parts.count() == 100 and parts.where("label is null").count() == 25
    assert curation.stratified_subsample(df, "id", "label", 1000).count() == 100
    assert running_total(df, ["label"], F.lit(0), [F.col("id")], F.lit(1), "s").count() == 100
    assert curation.quotas(spark.createDataFrame([("a", 3), (None, 3)], "label string, n long"), "label", F.lit(3)).agg(F.sum("quota")).first()[0] == 3


def test_split_reads_its_source_few_times(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 3 as label").write.parquet(str(tmp_path / "t"))
    plan = curation.stratified_split(spark.read.parquet(str(tmp_path / "t")), "id", "label")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2  # the source once, and the bounds of its classes


def test_running_total_is_a_window_sum(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"), (F.col("id") * 7 % 11).alias("v"))
    got = running_total(df, ["g"], F.floor(F.col("x") / 50), [F.col("x")], F.col("v"), "s").collect()
    want, sums = {}, {0: 0, 1: 0, 2: 0}
    for x in range(500):
        want[x] = sums[x % 3]
        sums[x % 3] += x * 7 % 11
    assert {r["x"]: r["s"] for r in got} == want


def test_validation(spark):
    rows = [("Test Patient", 45, "Male", "test@example.com", []), ("Bad Age", -5, "Male", None, ["age"]), ("Bad Email", 30, "Female", "not-an-email", ["email"]), ("Bad Gender", 30, "InvalidGender", None, ["gender"]), (None, None, None, None, ["name", "age", "gender"])]
    df = spark.createDataFrame(rows, "n string, a int, g string, e string, want array<string>")
    got = df.select(store.patient_violations(*map(F.col, "nage")).alias("v"), "want").collect()
    assert all(r["v"] == r["want"] for r in got)
    assert [r[0] for r in spark.createDataFrame([(" \t\n",), ("x ",), (None,)], "s string").select(store.blank_to_null(F.col("s"))).collect()] == [None, "x ", None]


def test_upload_codes(spark):
    df = spark.createDataFrame([("text/plain", 5), ("image/png", 10 << 20), ("image/png", (10 << 20) + 1), (None, 1)], "m string, n long")
    assert [r[0] for r in df.select(store.upload_code(F.col("m"), F.col("n"))).collect()] == [400, 200, 413, 400]


def test_partial_updates_keep_what_was_not_supplied(spark):
    rows = [("p", 1, "a", 5.0, ["name", "age"]), ("p", 2, None, None, ["name"]), ("q", 1, "b", None, ["name"])]
    got = store.latest(spark.createDataFrame(rows, "k string, at int, name string, age double, supplied array<string>"), "k", ["at"], ["name", "age"])
    assert {r["k"]: (r["name"], r["age"]) for r in got.collect()} == {"p": (None, 5.0), "q": ("b", None)}


def test_default_patient(spark):
    records = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "id int, patient int")
    got = store.with_default(records, "patient", spark.createDataFrame([(10,)], "k int"), "k")
    assert {r["id"]: r["resolved"] for r in got.collect()} == {1: "10", 2: "DEFAULT", 3: None}


def test_search_takes_wildcards_as_they_are(spark):
    df = spark.createDataFrame([("100%", None), ("100", "x_y"), (None, None)], "a string, b string")
    count = lambda needle: df.where(views.contains_any(needle, F.col("a"), F.col("b"))).count()
    assert (count("%"), count("_"), count("X_"), count("")) == (1, 1, 1, 3)


def test_curves(spark):
    df = spark.createDataFrame([([3.0, 2.0, 2.5, 2.6, 2.7, 1.0], [1.0, 2.0], [7.0] * 9)], "a array<double>, b array<double>, v array<double>")
    rows = curves.zipped(df, ["a", "b"], ["v"]).collect()
    assert len(rows) == 6 and rows[2]["b"] is None and rows[5]["epoch"] == 6
    assert tuple(df.select(curves.early_stop(F.col("a"))).first()[0]) == (5, 2)


def probabilities(values):
    return F.array(*(F.struct(F.lit(k).alias("cls"), F.lit(v).cast("double").alias("p")) for k, v in values.items())) if values else F.lit(None).cast("array<struct<cls: string, p: double>>")


@pytest.mark.parametrize(
    "selected, cnn, resnet, want",
    [
        ("CNN", {"Normal": 0.2, "COVID-19": 0.8}, {"COPD": 1.0}, ("COVID-19", 80.0, "emergency", ["Normal (20.0%)"])),
        ("ResNet", {"COPD": 1.0}, {"Normal": 0.4, "Pneumonia": 0.6}, ("Pneumonia", 60.0, "routine", ["Normal (40.0%)"])),
        ("ResNet", {"COPD": 1.0}, None, ("COPD", 100.0, "routine", [])),
        ("CNN", None, {"COPD": 1.0}, ("COPD", 100.0, "routine", [])),
        ("ResNet", None, None, ("Pneumonia", 82.4, "urgent", ["Tuberculosis (7.1%)", "Normal (4.2%)"])),
    ],
)
def test_prediction_of_the_selected_model_else_another_else_the_stand_in(spark, selected, cnn, resnet, want):
    rows = spark.range(1).select(probabilities(cnn).alias("cnn_probs"), probabilities(resnet).alias("resnet_probs"))
    r = predict.predictions(rows, F.lit(selected)).first()
    assert (r["final_condition"], r["final_confidence"], r["urgency_level"], r["alternative_conditions"]) == want
    assert r["precautions"] == PRECAUTIONS[want[0]] and [tuple(x) for x in r["key_findings"]] == FINDINGS[want[0]]
    both = cnn is None and resnet is None
    assert (r["cnn_primary_condition"] is not None) == (cnn is not None or both) and (r["resnet_confidence"] is not None) == (resnet is not None or both)


def test_report(spark):
    rows = spark.range(1).select(probabilities({"Other": 0.0}).alias("cnn_probs"), probabilities(None).alias("resnet_probs"))
    made = predict.predictions(rows)
    text = made.select(report.report(F.lit("ab-1"), F.lit("2024-01-02 03:04:05").cast("timestamp"), "Some System")).first()[0]
    assert text.startswith("\nLUNG DISEASE DETECTION REPORT\n") and text.endswith("before any clinical decisions are made.\n") and "{" not in text
    assert "Report ID     : AB-1\nGenerated     : 2024-01-02 03:04 UTC\nAI System     : Some System\n" in text
    assert "CNN    — Condition: Other, Confidence: N/A%\nResNet — Condition: N/A, Confidence: N/A%\nSelected: ResNet (" in text  # zero counts as missing
    assert "• Consult a pulmonologist for detailed evaluation.\n• Undergo further" in text and "Confidence        : 0.0%" in text


def test_one_row_by_key(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    assert store.one_or_none(df, "k", "a")["v"] == store.exactly_one(df, "k", "a")["v"] == 1
    assert store.one_or_none(df, "k", "none") is None
    with pytest.raises(LookupError):
        store.exactly_one(df, "k", "none")
    with pytest.raises(ValueError):
        store.one_or_none(df, "k", "b")


def test_landing_takes_classes_of_any_type(spark):
    df = spark.createDataFrame([(1, [(3, 0.7), (4, 0.3)]), (2, None)], "id int, probs array<struct<cls: int, p: float>>")
    got = {r["id"]: (r["condition"], r["confidence"], r["urgency"], r["alternatives"]) for r in triaged(df).collect()}
    assert got == {1: ("3", 70.0, "routine", ["4 (30.0%)"]), 2: (None, None, None, None)}


def test_phases_of_training(spark):
    df = spark.createDataFrame([(1,), (6,), (9,), (50,)], "e int")
    assert [tuple(r) for r in df.select(*curves.phases(F.col("e"))).collect()] == [(1, 1), (2, 4), (3, 6), (4, 46)]


def test_exact_subsample(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
    assert curation.stratified_subsample(df, "id", "label", 100).count() == 100
    assert curation.stratified_subsample(df, "id", "label", 5000).count() == 1000


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, label string")
    assert curation.stratified_split(df, "id", "label").count() == 0
    assert evaluate.confusion(spark.createDataFrame([], "a int, p int"), "a", "p").count() == 0


def test_array_max_takes_nan_as_the_first_greatest(spark):
    probs = F.array(*(F.struct(F.lit(k).alias("cls"), F.lit(p).alias("p")) for k, p in (("a", 0.4), ("b", float(np.nan)))))
    assert spark.range(1).select(triage.top(probs)["cls"]).first()[0] == "b"
