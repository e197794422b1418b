"""Class directories and image features; images are written by the JVM."""

import numpy as np
import pytest

from radquery.sources import images
from radquery.operators.scoring import CentroidScorer
from radquery.streaming.landing import triage_images, triage_stream


def write(spark, path, pixels: np.ndarray, kind: str) -> None:
    """``pixels``: height x width x 3, red first."""
    jvm = spark.sparkContext._jvm
    h, w = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, pixels[y, x])
            image.setRGB(x, y, (r << 16) | (g << 8) | b)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("scans")
    rng = np.random.default_rng(0)
    for label in ("Normal", "Lung Cancer"):
        (root / label).mkdir()
        write(spark, root / label / "a.png", rng.integers(0, 256, (24, 30, 3)), "png")
    write(spark, root / "Normal" / "B.JPG", np.zeros((16, 16, 3)), "jpg")
    (root / "Normal" / "broken.png").write_bytes(b"not-an-image")
    (root / "Normal" / "notes.txt").write_text("x" * 5000)
    return root


def test_class_directories(spark, folder):
    rows = {(r["label"], r["filename"]) for r in images.class_directories(spark, str(folder), least=0).collect()}
    assert rows == {("Normal", "a.png"), ("Normal", "B.JPG"), ("Normal", "broken.png"), ("Lung Cancer", "a.png")}
    assert images.class_directories(spark, str(folder)).where("length <= 1024").count() == 0


def test_features(spark, folder):
    decoded = images.decoded(spark, str(folder / "Normal"))
    assert decoded.count() == 2  # the broken one is left out
    rows = images.features(decoded, size=32).collect()
    assert all(len(r["features"]) == 32 * 32 * 3 for r in rows)


def test_tensor_shape_type_and_range():
    data = np.random.default_rng(1).integers(0, 256, (100, 80, 1), dtype=np.uint8)
    x = images.tensor(data.tobytes(), 100, 80, 1)
    assert x.shape == (224, 224, 3) and x.dtype == np.float32
    y = x * images.STD + images.MEAN
    assert y.min() >= -1e-5 and y.max() <= 1 + 1e-5


def test_constant_images_stay_constant():
    flat = np.full((20, 20, 3), 90.0)
    assert np.allclose(images.blur(flat), 90)
    assert all(np.allclose(images.resize(flat, 32, m), 90) for m in ("lanczos", "linear"))
    assert np.ptp(images.enhance(flat)) < 1e-6


def test_lab_of_known_colours():
    known = {(255, 255, 255): (100, 0, 0), (255, 0, 0): (53.24, 80.09, 67.20), (0, 255, 0): (87.73, -86.18, 83.18), (0, 0, 255): (32.30, 79.19, -107.86), (0, 0, 0): (0, 0, 0)}
    rgb = np.array([[*known]], dtype=float)
    assert np.allclose(images.to_lab(rgb)[0], [*known.values()], atol=0.05)
    x = np.random.default_rng(3).integers(0, 256, (9, 9, 3)).astype(float)
    assert np.allclose(images.from_lab(images.to_lab(x)), x, atol=1e-6)


def test_enhancing_keeps_the_hue():
    x = np.zeros((32, 32, 3))
    x[..., 0] = np.linspace(60, 120, 32)
    x[..., 1] = x[..., 2] = 40
    before, after = images.to_lab(images.blur(x)), images.to_lab(images.enhance(x))
    inside = (images.enhance(x) > 1).all(-1) & (images.enhance(x) < 254).all(-1)
    assert inside.any() and np.allclose(before[inside][:, 1:], after[inside][:, 1:], atol=0.1)


def test_flip_rotation_and_contrast():
    x = np.random.default_rng(2).integers(0, 256, (30, 30, 3)).astype(float)
    flip = images.VARIANT_OF["flip"]
    assert np.array_equal(flip(flip(x)), x)
    assert np.array_equal(images.rotate(x, 0), x)
    assert images.rotate(np.full((30, 30, 3), 255.0), 15)[0, 0].sum() == 0
    dot = np.zeros((21, 21, 1))
    dot[10, 18] = 100.0  # to the right of the center
    turned = images.rotate(dot, 90)[..., 0]
    assert np.unravel_index(turned.argmax(), turned.shape) == (2, 10) and turned.sum() == pytest.approx(100)  # it is above now
    assert images.rotate(dot, 15)[..., 0].sum() == pytest.approx(100, rel=0.2) and (images.rotate(dot, 15) > 0).sum() > 1
    dull = np.tile(np.linspace(100, 110, 64), (64, 1))
    assert np.ptp(images.equalize(dull)) > np.ptp(dull)


def test_landing_stream_takes_each_file_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, [("Pneumonia", 0.9), ("Normal", 0.1)])], "id long, probs array<struct<cls: string, p: double>>")
    landing, target = str(tmp_path / "landing"), str(tmp_path / "target")
    for n in (1, 2):
        rows.write.mode("append").parquet(landing)
        triage_stream(spark, landing, rows.schema, target, str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(target).count() == n
    assert spark.read.parquet(target).first()["urgency"] == "urgent"


def test_landing_stream_of_images(spark, folder, tmp_path):
    known = images.features(images.decoded(spark, str(folder / "Normal")), size=16).selectExpr("features", "if(origin like '%B.JPG', 'Normal', 'Pneumonia') as label")
    scorer = CentroidScorer("features", "label", 16 * 16 * 3).fit(known)
    query = triage_images(spark, str(folder / "Normal"), scorer, str(tmp_path / "out"), str(tmp_path / "state"), size=16)
    query.awaitTermination()
    rows = {r["origin"].rsplit("/", 1)[1]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (rows["B.JPG"]["condition"], rows["a.png"]["condition"]) == ("Normal", "Pneumonia")
    assert rows["broken.png"]["error"] == images.UNREADABLE and rows["broken.png"]["condition"] is None and rows["a.png"]["error"] is None
