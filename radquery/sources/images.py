"""Images: class directories, decoding by Spark's image source, and numeric features in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.operators.curation import MIN_BYTES, is_image

SIZE = 224
#: Mean and standard deviation of each channel, red first.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
CLIP_LIMIT, TILES = 2.0, 8


def class_directories(spark: SparkSession, folder: str, least: int = MIN_BYTES) -> DataFrame:
    """image_path, label (the directory), filename and length, of image files above a size. Contents aren't read."""
    files = spark.read.format("binaryFile").load(f"{folder}/*/*").select("path", "length").where(F.col("length") > least)
    parts = F.split("path", "/")
    return files.where(is_image(F.col("path"))).select(
        F.col("path").alias("image_path"), F.element_at(parts, -2).alias("label"), F.element_at(parts, -1).alias("filename"), "length"
    )


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """origin, height, width, channels and data of the images that can be decoded."""
    images = spark.read.format("image").load(folder).select("image.*").where("height > 0")
    return images.select("origin", "height", "width", F.col("nChannels").alias("channels"), "data")


#: Fixed value.
UNREADABLE = "Could not decode image"
#: What Spark's image source reads.
IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Image files that land in a folder, as a stream: the columns of ``decoded``, and ``error`` for bytes that are no image."""
    images = spark.readStream.schema(IMAGE).format("image").option("dropInvalid", False).load(folder).select("image.*")
    error = F.when(F.col("height") < 1, UNREADABLE)
    return images.select("origin", "height", "width", F.col("nChannels").alias("channels"), "data", error.alias("error"))


def to_rgb(data: np.ndarray) -> np.ndarray:
    """From gray, BGR or BGRA."""
    return np.repeat(data, 3, axis=2) if data.shape[2] == 1 else data[:, :, 2::-1]


def blur(image: np.ndarray) -> np.ndarray:
    """3 x 3 Gaussian with weights 1 2 1, borders mirrored without the edge."""
    x = np.pad(image.astype(np.float64), ((1, 1), (1, 1), (0, 0)), mode="reflect" if min(image.shape[:2]) > 1 else "edge")
    x = (x[:-2] + 2 * x[1:-1] + x[2:]) / 4
    return (x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]) / 4


def equalize(light: np.ndarray, limit: float = CLIP_LIMIT, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited adaptive histogram equalization of values from 0 to 255, tiles blended bilinearly."""
    h, w = light.shape
    step = max(1, -(-h // tiles)), max(1, -(-w // tiles))
    x = np.pad(light, ((0, step[0] * tiles - h), (0, step[1] * tiles - w)), mode="edge").astype(np.uint8)
    blocks = x.reshape(tiles, step[0], tiles, step[1]).swapaxes(1, 2).reshape(tiles * tiles, -1)
    counts = np.stack([np.bincount(b, minlength=256) for b in blocks]).astype(np.float64)
    most = max(1.0, limit * blocks.shape[1] / 256)
    counts = np.minimum(counts, most) + np.maximum(0, counts - most).sum(1, keepdims=True) / 256
    maps = (np.cumsum(counts, 1) * 255 / blocks.shape[1]).reshape(tiles, tiles, 256)
    y, z = ((np.arange(n) + 0.5) / s - 0.5 for n, s in zip((h, w), step, strict=True))
    lo = [np.clip(np.floor(v).astype(int), 0, tiles - 1) for v in (y, z)]
    hi = [np.minimum(v + 1, tiles - 1) for v in lo]
    fy, fz = np.clip(y - lo[0], 0, 1)[:, None], np.clip(z - lo[1], 0, 1)[None]
    at = lambda a, b: maps[a[:, None], b[None], light.astype(np.uint8)]
    return (1 - fy) * ((1 - fz) * at(lo[0], lo[1]) + fz * at(lo[0], hi[1])) + fy * ((1 - fz) * at(hi[0], lo[1]) + fz * at(hi[0], hi[1]))


#: Linear sRGB to XYZ, by the standard's primaries and white.
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """CIE L*a*b* of sRGB values from 0 to 255; L from 0 to 100."""
    x = rgb / 255
    linear = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    t = linear @ XYZ.T / XYZ.sum(1)  # relative to white
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t * (29 / 6) ** 2 / 3 + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    """sRGB from 0 to 255; what lies outside is cut off."""
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    t = np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29))
    linear = np.clip((t * XYZ.sum(1)) @ np.linalg.inv(XYZ).T, 0, 1)
    return 255 * np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)


def enhance(rgb: np.ndarray) -> np.ndarray:
    """Blurred, then L of L*a*b* equalized as 8 bits; a and b stay."""
    lab = to_lab(blur(rgb))
    lab[..., 0] = equalize(np.rint(lab[..., 0] * 2.55)) / 2.55
    return from_lab(lab)


def _weights(n: int, size: int, taps: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the source pixels of each target pixel: linear (2 taps) or Lanczos (8)."""
    at = (np.arange(size) + 0.5) * n / size - 0.5
    base = np.floor(at).astype(int)[:, None] + np.arange(taps) - taps // 2 + 1
    d = at[:, None] - base
    w = np.maximum(0, 1 - np.abs(d)) if taps == 2 else np.sinc(d) * np.sinc(d / 4) * (np.abs(d) < 4)
    return np.clip(base, 0, n - 1), w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, size: int = SIZE, method: str = "lanczos") -> np.ndarray:
    taps = 2 if method == "linear" else 8
    (rows, wr), (cols, wc) = _weights(image.shape[0], size, taps), _weights(image.shape[1], size, taps)
    x = np.einsum("ikwc,ik->iwc", image[rows].astype(np.float64), wr)
    return np.clip(np.einsum("hjkc,jk->hjc", x[:, cols], wc), 0, 255)


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise about (width // 2, height // 2), between pixels linearly, black outside."""
    h, w = image.shape[:2]
    a, (y, x) = np.deg2rad(degrees), np.indices((h, w))
    y, x = y - h // 2, x - w // 2
    v, u = x * np.sin(a) + y * np.cos(a) + h // 2, x * np.cos(a) - y * np.sin(a) + w // 2
    top, left = np.floor(v).astype(int), np.floor(u).astype(int)
    out = np.zeros(image.shape, dtype=np.float64)
    for dy in (0, 1):
        for dx in (0, 1):
            yy, xx = top + dy, left + dx
            weight = (1 - np.abs(v - yy)) * (1 - np.abs(u - xx)) * ((yy >= 0) & (yy < h) & (xx >= 0) & (xx < w))
            out += weight[:, :, None] * image[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)]
    return out


VARIANT_OF = {
    "original": lambda x: x,
    "flip": lambda x: x[:, ::-1],
    "rotate_left": lambda x: rotate(x, 15),
    "rotate_right": lambda x: rotate(x, -15),
    "brighten": lambda x: np.clip(x * 1.2, 0, 255),
}


def tensor(data: bytes, height: int, width: int, channels: int, variant: str = "original", method: str = "lanczos", size: int = SIZE) -> np.ndarray:
    """float32, size x size x 3: enhanced, resized, varied, scaled to 0..1 and standardised."""
    rgb = to_rgb(np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels))
    x = VARIANT_OF[variant](resize(enhance(rgb), size, method)) / 255
    return ((x - MEAN) / STD).astype(np.float32)


def features(images: DataFrame, method: str = "lanczos", size: int = SIZE) -> DataFrame:
    """origin, variant and features (a flat tensor) of decoded images, with a column ``variant`` or without. Rows that
    couldn't be decoded (of ``landed``) have no features."""
    images = images if "variant" in images.columns else images.withColumn("variant", F.lit("original"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                each = [tensor(r["data"], r["height"], r["width"], r["channels"], r["variant"], method, size).ravel() if r["height"] > 0 else None for r in part.to_pylist()]
                lists = pa.array(each, pa.list_(pa.float32()))
                yield pa.record_batch([part.column(0), part.column(part.schema.get_field_index("variant")), lists], names=["origin", "variant", "features"])

    return images.mapInArrow(run, "origin string, variant string, features array<float>")
