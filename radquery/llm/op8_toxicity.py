"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary and one on windows of toxic text, and each window of a
text is compressed with both. The less the toxic dictionary leaves of a window, and the more the ordinary one, the more of it
is known from toxic text only. Thresholds are calibrated: a pair of lengths counts by how much oftener toxic documents of the
calibration half have a window with it than ordinary ones do, and a logistic function of a document's windows gives its score.

A window is one word, without marks around it, three times: the first copy shows what a dictionary has, and the others, which
either compressor takes from the first, lift the block over zstandard's fixed costs. The windows that a dictionary is trained
on are those that several documents of its class have; the toxic one leaves out those that are about as frequent in ordinary
documents, as toxic documents consist of ordinary words mostly.

Only the fit sees labels. It takes about ``most`` documents of either class, by a hash of id and text, with their whole texts;
rows alike in both are one for it, so the bound holds for any repeats. What is counted in them is counted by Spark, and the driver gets windows for the dictionaries (as many as fit into them), counts by pair
of lengths, and counts by rounded features. Null and empty texts get the score of a text without windows. Rows with equal ids
are scored one by one; a document whose labels differ counts for both. Other labels than 0 and 1, null ones and rows without
id are not learned from. Without labels of both classes every score is the share of toxic ones, or 0. Of further columns
nothing is read. No document: no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.llm.shared import share, write_table
from radquery.llm.words import slices, split_words, texts_of

#: Labelled documents of each class that the fit takes, about (each with the same chance, so a few hundred more or less).
MOST, PLACES = 20_000, 1 << 60
DICTIONARY_BYTES = 1 << 15
#: Of zstandard's trainer: the length of the segments that it picks, and of the strings in them that it counts.
SEGMENT, COUNTED = 64, 6
#: Windows for a dictionary: in so many documents at least, and for the toxic one with such log-odds at least.
LEAST_DOCUMENTS, LEAST_ODDS = 2, 2.5
#: Of a dictionary's fit: windows that the trainer gets, the most frequent ones, and how often it gets each at most (as often as
#: documents have it up to there).
MOST_WINDOWS, MOST_COPIES = DICTIONARY_BYTES // 8, 50
#: Lengths above these count as these.
MOST_BYTES, MOST_LENGTH = 24, 48
CELLS = MOST_BYTES * MOST_LENGTH**2
#: Features are rounded to this for the logistic fit.
STEP = 1 / 16
KEPT_WORDS = 100_000
SCORE_BYTES = 2 << 20


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    odds: np.ndarray  # float32, by bytes of the word and both compressed lengths
    weights: np.ndarray  # of the features, and the constant


def window(word: str) -> bytes:
    return (" " + word).encode() * 3 + b" "


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)  # with the trainer's entropy tables, if it has them
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    parameters = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=16, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, **plain)
    data.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)


def bare(words: pa.Array) -> pa.Array:
    """In lower case, without what isn't a letter or digit at either end."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"^[^\pL\pN]+|[^\pL\pN]+$", "")


class Compressors:
    """The cell of each word: its bytes and the lengths that both dictionaries leave, as one number."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair, self.kept = (compressor(ordinary), compressor(toxic)), {}

    def cells(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), dtype=np.int64)
        for i, w in enumerate(words):
            cell = self.kept.get(w)
            if cell is None:
                text = window(w)
                a, b = (min(MOST_LENGTH - 1, len(c.compress(text))) for c in self.pair)
                cell = (min(MOST_BYTES - 1, len(text) // 3) * MOST_LENGTH + a) * MOST_LENGTH + b
                if len(self.kept) < KEPT_WORDS:
                    self.kept[w] = cell
            out[i] = cell
        return out


def bare_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    codes, offsets, distinct = split_words(texts)
    encoded = bare(distinct).dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False)[codes], offsets, encoded.dictionary.to_pylist()


def document_counts(codes: np.ndarray, offsets: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """For both classes, the documents that have each code."""
    text = np.repeat(np.arange(len(of)), np.diff(offsets))
    pairs = np.unique(text.astype(np.int64) * size + codes)
    return np.stack([np.bincount((pairs % size)[of[pairs // size] == k], minlength=size) for k in (0, 1)])


def log_odds(counts: np.ndarray, n: list[int]) -> np.ndarray:
    return np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))


FEATURES = 4


def features(odds: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: the highest odds of a window, how much its windows speak for toxicity in sum and for each window, and
    how many windows it has (the last three as logarithms)."""
    n = np.diff(offsets)
    out, full = np.zeros((len(n), FEATURES)), n > 0
    if not len(codes):
        return out
    each = odds[codes].astype(np.float64)
    above = lambda limit: np.diff(np.concatenate(([0], np.cumsum(np.maximum(0, each - limit))))[offsets])
    out[full, 0] = np.maximum.reduceat(each, offsets[:-1][full])
    out[:, 1] = np.log1p(np.maximum(0, above(1.5)))
    out[:, 2] = np.log1p(np.maximum(0, 100 * above(2.0) / np.maximum(1, n)))
    out[:, 3] = np.log1p(n)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """``n``: how many rows have these features."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
    return w


def train_dictionary(windows: list[tuple[str, int]], most_copies: int = MOST_COPIES) -> bytes:
    """By zstandard's trainer, from words and how many documents have each; the words as they are where they are too few for it."""
    samples = [window(w) for w, n in sorted(windows) for _ in range(min(n, most_copies))]
    order = np.random.default_rng(42).permutation(len(samples))
    try:
        data = zstandard.train_dictionary(DICTIONARY_BYTES, [samples[i] for i in order], k=SEGMENT, d=COUNTED).as_bytes()
    except zstandard.ZstdError:
        data = b"".join(window(w) for w, _ in sorted(windows, key=lambda x: x[1]))[-DICTIONARY_BYTES:]
    return data or b" "


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST, most_windows: int = MOST_WINDOWS, most_copies: int = MOST_COPIES) -> Model:
    """From labelled documents (doc_id, text) and (doc_id, toxic). One half makes the dictionaries, the other calibrates. The
    bounds are on documents of a class, and on what the trainer of a dictionary gets."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    # Documents alike in id and text are one place here, so neither a frequent id nor a repeated row makes the fit larger.
    placed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(PLACES)).alias("place"))
    half = F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    named = placed.select("doc_id", "place").join(write_table(known, "known-labels"), F.col("doc_id") == F.col("_id"))
    places = write_table(named.select("place", "toxic", half).distinct(), "labelled-places")
    n = {r["toxic"]: r["n"] for r in places.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    limit = {k: int(PLACES * min(1.0, most / max(1, n.get(k, 0)))) for k in (0, 1)}
    chosen = write_table(places.where(F.col("place") < F.when(F.col("toxic") == 1, limit[1]).otherwise(limit[0])), "chosen-places")
    rows = placed.join(F.broadcast(chosen), "place").select("text", "toxic", "half", "place").dropDuplicates(["place", "toxic"]).drop("place")
    rows = write_table(rows, "labelled")  # about ``most`` of either class; it is read three times

    def counted(batches):
        for part in (p for b in batches for p in slices(b, most=SCORE_BYTES)):
            codes, offsets, words = bare_words(texts_of(part.column(0)))
            of = part.column(1).to_numpy().astype(np.int64)
            counts = document_counts(codes, offsets, of, max(1, len(words)))
            some = np.flatnonzero(counts.sum(0))
            yield pa.record_batch([pa.array([words[i] for i in some], pa.string()), counts[0][some], counts[1][some]], names=["word", "n0", "n1"])

    sizes = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    size = [[sizes.get((h, k), 0) for k in (0, 1)] for h in (0, 1)]
    if min(map(min, size)) == 0:
        total = sum(map(sum, size))
        share = sum(s[1] for s in size) / total if total else 0.0
        return Model(b" ", b" ", np.zeros(CELLS, np.float32), np.append(np.zeros(FEATURES), np.log((share + 1e-9) / (1 - share + 1e-9))))
    words = rows.where("half = 0").select("text", "toxic").mapInArrow(counted, "word string, n0 long, n1 long").where("word != ''")
    words = write_table(words.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "window-counts")
    odds = F.log((F.col("n1") + 0.5) / (size[0][1] + 1)) - F.log((F.col("n0") + 0.5) / (size[0][0] + 1))
    # A dictionary has room for so many words only: the most frequent ones, by a bounded top.
    top = lambda c, where: [(r["word"], r[c]) for r in words.where(where).orderBy(F.desc(c), "word").limit(most_windows).collect()]
    dictionaries = [train_dictionary(top("n0", F.col("n0") >= LEAST_DOCUMENTS), most_copies), train_dictionary(top("n1", (F.col("n1") >= LEAST_DOCUMENTS) & (odds > LEAST_ODDS)), most_copies)]

    def in_cells(batches):
        compressors = Compressors(*dictionaries)
        for part in (p for b in batches for p in slices(b, most=SCORE_BYTES)):
            codes, offsets, words = bare_words(texts_of(part.column(0)))
            yield compressors.cells(words)[codes] if len(codes) else np.empty(0, np.int64), offsets, part.column(1).to_numpy().astype(np.int64)

    def cells(batches):
        sums = np.zeros((2, CELLS), dtype=np.int64)
        for codes, offsets, of in in_cells(batches):
            sums += document_counts(codes, offsets, of, CELLS)
        some = np.flatnonzero(sums.sum(0))
        yield pa.record_batch([some, sums[0][some], sums[1][some]], names=["cell", "n0", "n1"])

    half_b = rows.where("half = 1").select("text", "toxic")
    found = half_b.mapInArrow(cells, "cell long, n0 long, n1 long").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()  # CELLS rows at most
    counts = np.zeros((2, CELLS), dtype=np.int64)
    for r in found:
        counts[:, r["cell"]] = r["n0"], r["n1"]
    odds = np.where(counts.sum(0) > 0, log_odds(counts, size[1]), 0).astype(np.float32)

    def measured(batches):
        for codes, offsets, of in in_cells(batches):
            x = np.rint(features(odds, codes, offsets) / STEP).astype(np.int64)
            yield pa.record_batch([*x.T.copy(), of], names=names)

    names = [*(f"x{i}" for i in range(FEATURES)), "toxic"]
    points = half_b.mapInArrow(measured, ", ".join(f"{c} long" for c in names)).groupBy(*names).agg(F.count("*").alias("n")).toPandas().to_numpy(dtype=np.float64)
    return Model(*dictionaries, odds, _logistic(points[:, :FEATURES] * STEP, points[:, FEATURES], points[:, -1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, from doc_id and text."""
    shared = share(docs.sparkSession, model)

    def run(batches):
        model = shared.value
        compressors = Compressors(model.ordinary, model.toxic)
        for part in (p for b in batches for p in slices(b, most=SCORE_BYTES)):
            codes, offsets, words = bare_words(texts_of(part.column(1)))
            odds = model.odds[compressors.cells(words)]
            x = features(odds, codes, offsets) @ model.weights[:-1] + model.weights[-1]
            yield pa.record_batch([part.column(0), 1 / (1 + np.exp(-np.clip(x, -30, 30)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(remainder: int = 0, of: int = 5):
    """True for rows that nothing is learned from; a row without id is one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(True))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, learn(docs.where(~held_out()), labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
