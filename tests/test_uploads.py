"""Uploads to records, ids over appends, images from bytes, dense minibatches, label dictionaries."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from radquery import schemas
from radquery.operators import curation, evaluate, keys, records
from radquery.operators.scoring import CentroidScorer
from radquery.plans import catalogue
from radquery.sources import files, images, tables
from radquery.streaming import uploads
from tests.conftest import DATA
from tests.test_images import write


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("g"))
    rows = keys.numbered(df, [F.desc("g"), F.col("x")]).collect()
    assert [(r["g"], r["x"]) for r in sorted(rows, key=lambda r: r["id"])] == sorted(((r["g"], r["x"]) for r in rows), key=lambda t: (-t[0], t[1]))
    assert sorted(r["id"] for r in rows) == list(range(1000))
    assert sorted(r["id"] for r in keys.numbered(df.repartition(5)).collect()) == list(range(1000))
    assert keys.numbered(df.where("false"), [F.col("x")]).collect() == []


def test_marks_of_many_batches_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keys, "MARK_FILES", 3)
    folder, files = str(tmp_path), []
    firsts = []
    for k in range(8):
        firsts.append(keys.reserve(spark, folder, f"b{k}", ["x", "y"], 10))
        files.append(len(keys.read_marks(spark, folder).inputFiles()))
    assert firsts == [[10 * k + 1] * 2 for k in range(8)] and max(files) <= 5
    assert keys.reserve(spark, folder, "b2", ["x", "y"], 10) == [21, 21]  # from the marks put together
    assert keys.reserve(spark, folder, "new", ["y", "z"], 5) == [81, 1]
    assert keys.read_marks(spark, folder).distinct().count() == 18


def test_ids_go_on_over_appends(spark, tmp_path):
    folder, schema = str(tmp_path), "id long, name string"
    read = lambda: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/people").collect()
    parts = [spark.range(n).select(F.concat(F.lit(f"{k}-"), F.col("id").cast("string")).alias("name")) for k, n in enumerate((10, 1, 25))]
    for k, part in enumerate(parts):
        assert keys.append_numbered(part, folder, "people", f"b{k}", schema, [F.col("name")]) == (10, 1, 25)[k]
    before = sorted(map(tuple, read()))
    assert [i for i, _ in before] == list(range(1, 37)) and {n.split("-")[0] for i, n in before if i > 11} == {"2"}
    keys.append_numbered(parts[1], folder, "people", "b1", schema, [F.col("name")])  # the batch runs again
    assert sorted(map(tuple, read())) == before
    assert keys.append_numbered(parts[0].where("false"), folder, "people", "b9", schema) == 0


@pytest.fixture(scope="module")
def pictures(spark, tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("pictures"), np.random.default_rng(4)
    for name, kind in (("a", "png"), ("b", "bmp"), ("c", "jpg")):
        write(spark, root / f"{name}.{kind}", rng.integers(0, 256, (20, 24, 3)), kind)
    write(spark, root / "black.jpg", np.zeros((64, 64, 3)), "jpg")
    return root


def test_bytes_are_decoded_as_files_are(spark, pictures):
    rows = [(p.name, p.read_bytes()) for p in sorted(pictures.iterdir())] + [("bad", b"not-an-image"), ("empty", b""), ("none", None), ("again", (pictures / "a.png").read_bytes())]
    df = spark.createDataFrame(rows, "name string, content binary").selectExpr("*", "1 as key", "2 as width", "'x' as error")
    got = {r["name"]: r for r in files.decoded_bytes(df).collect()}
    want = {r["origin"].rsplit("/", 1)[1]: r for r in images.decoded(spark, str(pictures)).collect()}
    assert len(got) == len(rows) and {n for n, r in got.items() if r["error"]} == {"bad", "empty", "none"}
    for name, r in got.items():
        w = want.get("a.png" if name == "again" else name)
        assert (r["height"], r["width"], r["channels"], r["data"]) == ((w["height"], w["width"], w["channels"], w["data"]) if w else (None,) * 4)
        assert r["error"] == (None if w else images.UNREADABLE) and r["key"] == 1
    assert files.decoded_bytes(df.where("false")).collect() == []


def test_uploads_to_records(spark, pictures, tmp_path):
    folder, landing = str(tmp_path / "db"), str(tmp_path / "landing")
    tables.create_tables(spark, folder)
    patient = spark.createDataFrame([("P1", "Alice", 30, "Female")], "patient_id string, name string, age int, gender string")
    keys.append_numbered(patient, folder, "patients", "first", schemas.PATIENTS)
    png, black = (pictures / "a.png").read_bytes(), (pictures / "black.jpg").read_bytes()
    rows = [
        ("a.png", png, "image/png", "P1", None, "note"), ("b.png", png, "image/png", None, "CT", None), ("c.jpg", black, "image/jpeg", "", "", None), ("", black, "image/jpeg", "P1", None, None),
        ("bad.png", b"not-an-image", "image/png", "P1", None, None), ("t.txt", b"hello", "text/plain", None, None, None), ("n.png", None, "image/png", None, None, None),
        ("who.png", png, "image/png", "NONEXISTENT", None, None), ("big.png", b"x" * (10 * 1024 * 1024 + 1), "image/png", None, None, None),
    ]
    df = spark.createDataFrame(rows, "filename string, content binary, mime string, patient_id string, scan_type string, notes string").withColumn("at", F.lit("2024-05-01 10:00:00").cast("timestamp"))
    df.write.parquet(landing)
    known = images.features(images.decoded(spark, str(pictures)), size=16).selectExpr("features", "if(origin like '%black%', 'Normal', 'Pneumonia') as label")
    scorer = CentroidScorer("features", "label", 16 * 16 * 3).fit(known)
    uploads.take_uploads(spark, landing, folder, str(tmp_path / "state"), resnet=scorer, size=16).awaitTermination()
    read = lambda name: tables.read_table(spark, folder, name)

    def check():
        scans, made, reports, people = ({r["id"]: r for r in read(t).collect()} for t in ("lung_scans", "predictions", "reports", "patients"))
        assert sorted(scans) == sorted(made) == sorted(reports) == [1, 2, 3, 4] and sorted(people) == [1, 2]
        assert {r["scan_id"] for r in made.values()} == set(scans) and {r["prediction_id"] for r in reports.values()} == set(made)
        by = {(r["image_filename"], people[r["patient_id"]]["patient_id"], r["scan_type"]): r for r in scans.values()}
        assert set(by) == {("a.png", "P1", "X-Ray"), ("b.png", "DEFAULT", "CT"), ("c.jpg", "DEFAULT", "X-Ray"), ("upload.jpg", "P1", "X-Ray")}
        for r in scans.values():
            content = png if r["image_filename"].endswith("png") else black
            assert open(r["image_path"], "rb").read() == content and r["image_size_bytes"] == len(content) and r["preprocessed"]
        for r in made.values():
            name = scans[r["scan_id"]]["image_filename"]
            assert r["final_condition"] == ("Pneumonia" if name.endswith("png") else "Normal") and r["final_confidence"] > 0 and r["cnn_confidence"] is None
        for r in reports.values():
            assert f"Report ID     : {r['report_id'].upper()}" in r["report_content"] and (r["generated_by"], r["is_reviewed"]) == ("AI System", False)
        refused = {r["filename"]: (r["code"], r["reason"]) for r in read("rejections").collect()}
        assert {k: v[0] for k, v in refused.items()} == {"bad.png": 400, "t.txt": 400, "n.png": 400, "who.png": 404, "big.png": 413}
        assert refused["who.png"][1].startswith("Patient 'NONEXISTENT' not found") and "Could not decode" in refused["bad.png"][1]
        return [sorted(map(str, read(t).drop("created_at", "updated_at").collect())) for t in ("patients", "lung_scans", "predictions", "reports", "rejections")]

    before = check()
    assert uploads.take(df, folder, "uploads-0", resnet=scorer, size=16) == 4  # the batch runs again: nothing is added
    assert check() == before
    df.limit(0).write.mode("append").parquet(landing)
    df.where("filename = 'a.png'").write.mode("append").parquet(landing)
    uploads.take_uploads(spark, landing, folder, str(tmp_path / "state"), size=16).awaitTermination()  # without a model the stand-in decides
    last = read("predictions").where("id = 5").first()
    assert read("lung_scans").count() == read("reports").count() == 5 and (last["final_condition"], last["final_confidence"]) == ("Pneumonia", 82.4)


def test_records_of_no_uploads(spark, tmp_path):
    tables.create_tables(spark, str(tmp_path))
    assert uploads.take(spark.createDataFrame([], uploads.UPLOADS), str(tmp_path), "b") == 0
    assert all(tables.read_table(spark, str(tmp_path), t).isEmpty() for t in tables.TABLES)


def test_uuids_are_shaped_and_differ(spark):
    ids = [r[0] for r in spark.range(50).select(records.uuid_of("scan", F.col("id"))).collect()]
    assert len(set(ids)) == 50 and all([len(p) for p in i.split("-")] == [8, 4, 4, 4, 12] for i in ids)


@pytest.mark.parametrize("seed,buffer", [(None, None), (42, None), (42, 2000), (42, 7)])
def test_batches_are_full_and_shuffled_within_the_buffer(spark, seed, buffer):
    df = spark.range(101).selectExpr("id", "id * 2 as place")
    got = tables.batches(df, "id", 8, seed, buffer).collect()
    assert sorted(collections.Counter(r["batch"] for r in got).items()) == [(k, 8) for k in range(12)] + [(12, 5)]
    assert sorted(r["id"] for r in got) == list(range(101))
    if seed:
        order = {r["id"]: r["place"] for r in tables.shuffled(df, "id", seed, buffer).collect()}
        assert sorted(order.values()) == list(range(101)) and order != {i: i for i in range(101)}
        assert all(i < p + min(buffer or 101, 101) for i, p in order.items())


def test_labels(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["b", "a", "c", "a", "Z"])], "id int, label string")
    dictionary = curation.label_ids(df.union(spark.createDataFrame([(9, None)], df.schema)), "label")
    assert sorted(map(tuple, dictionary.collect())) == [("Z", 0), ("a", 1), ("b", 2), ("c", 3)]
    coded = curation.encoded(df, "label", dictionary)
    assert {r["id"]: r["label_idx"] for r in coded.collect()} == {0: 2, 1: 1, 2: 3, 3: 1, 4: 0}
    back = curation.decoded_labels(coded.drop("label"), "label", dictionary)
    assert sorted((r["id"], r["label"]) for r in back.collect()) == sorted(map(tuple, df.collect()))
    for odd in ("new", None):
        with pytest.raises(Exception, match="previously unseen labels"):
            curation.encoded(spark.createDataFrame([(1, odd)], df.schema), "label", dictionary).collect()
    with pytest.raises(Exception, match="previously unseen labels"):
        curation.decoded_labels(spark.range(9, 10).select(F.col("id").alias("label_idx")), "label", dictionary).collect()


def test_a_million_labels(spark):
    many = spark.range(1_000_000).select(F.concat(F.lit("label"), F.format_string("%07d", F.col("id"))).alias("label"))
    ids = curation.label_ids(many, "label")
    assert ids.where(F.expr("label_idx != cast(substring(label, 6) as long)")).isEmpty() and ids.count() == 1_000_000


def test_confusion_of_many_classes(spark):
    rows = spark.range(20_000).select((F.col("id") % 2000).alias("y"), (F.col("id") * 7 % 1999).alias("p"))
    got = evaluate.confusion(rows, "y", "p").agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("full")).first()
    assert (got["cells"], got["n"], got["full"]) == (2000 * 2000, 20_000, rows.distinct().count())


def test_confusion_with_nulls(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", None), (None, None), ("a", "b")], "y string, p string")
    got = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion(rows, "y", "p").collect()}
    assert len(got) == 9 and got["a", "b"] == 2 and got["a", None] == got[None, None] == 1 and sum(got.values()) == 4


def test_models_are_found_in_the_first_folder_that_has_them(spark, tmp_path):
    (tmp_path / "two" / "resnet").mkdir(parents=True)
    assert tables.find_model(spark, [str(tmp_path / "one"), str(tmp_path / "two")], "resnet") == str(tmp_path / "two" / "resnet")
    assert tables.find_model(spark, [str(tmp_path / "one")], "resnet") is None


def test_upload_records_number_narrow_rows(spark, monkeypatch):
    """Predictions are wide, and are written to their table alone."""
    seen, before = [], keys.stored
    monkeypatch.setattr(keys, "stored", lambda df, name: seen.append((name, set(df.columns))) or before(df, name))
    monkeypatch.setattr(catalogue, "stored", lambda df, name: seen.append((name, set(df.columns))) or before(df, name))
    assert catalogue.QUERIES["upload_records"](spark, DATA).count() == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert len(seen) >= 6 and not any(c & {"key_findings", "precautions", "final_condition", "cnn_probs"} for _, c in seen)
