"""Language identification of mixed text by Viterbi over words.

Model: for each language, smoothed log-probabilities of byte n-grams (2 to 4, of the word in lower case between blanks) in a
fixed number of hash buckets, and the scripts that its words are written in. Its size depends on the number of buckets and
languages alone.

A word's score for a language is the mean over its n-grams times a weight; a language that doesn't use the word's script is
no candidate for it. Words without letters favour none. Viterbi then finds for each text the best sequence of languages, in
which each switch costs ``penalty``. Runs of one language are the spans; the language with most letters is the text's.

Null texts, and texts without a letter, are ``und`` with score 0. Ties go to the first language in order. Rows with equal ids
are labelled one by one; null languages aren't learned from. Without training rows every text is ``und``.

Memory: a worker maps 512 KB of weights for each language, of which there may be MOST_LANGUAGES; what it holds for a slice of
texts is bounded, as slices are smaller the more languages there are, and a very long text is labelled in blocks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.llm.shared import AtomicFile, new_dir, open_mapped, share, write_table
from radquery.llm.words import slices, split_words, texts_of

BUCKET_BITS = 17
#: Scripts by ranges of code points: fixed values of the Unicode standard's blocks.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2B8), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "kana": ((0x3040, 0x30FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
OTHER, NONE = len(SCRIPTS), len(SCRIPTS) + 1  # another script's letter; no letter at all
#: Distinct words whose n-grams are in memory at once.
WORDS_AT_ONCE = 1 << 13
SLICE_BYTES = 4 << 20
#: Languages that a model may have, those that a task counts at once, and those up to which slices have their full size.
MOST_LANGUAGES, HELD_LANGUAGES, FEW_LANGUAGES = 1000, 64, 16
#: Words times languages of a text beyond which it is labelled in blocks of as many.
LONG = 1 << 25


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # float32, buckets x languages
    allowed: np.ndarray  # bool, scripts x languages


def _script_table() -> np.ndarray:
    table = np.full(0x10000, -1, dtype=np.int8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            table[a : b + 1] = k
    return table


_SCRIPT_OF = _script_table()


def word_scripts(distinct: list[str]) -> np.ndarray:
    """The script of each word's first letter, or NONE."""
    out = np.full(len(distinct), NONE, dtype=np.int8)
    for i, w in enumerate(distinct):
        for c in w:
            if c.isalpha():
                s = _SCRIPT_OF[ord(c)] if ord(c) < 0x10000 else -1
                out[i] = s if s >= 0 else OTHER
                break
    return out


def word_buckets(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of each word, and the word each belongs to."""
    padded = pc.binary_join_element_wise("", pc.utf8_lower(distinct), "", " ").cast(pa.large_binary())
    data = np.frombuffer(padded.buffers()[2] or b"", dtype=np.uint8)
    ends = np.frombuffer(padded.buffers()[1], dtype=np.int64)[padded.offset : padded.offset + len(padded) + 1]
    data, ends = data[ends[0] : ends[-1]].astype(np.uint64), ends - ends[0]
    word = np.repeat(np.arange(len(padded)), np.diff(ends))
    buckets, owners, key = [], [], data.copy()
    for n in range(2, 5):
        if len(data) < n:
            break
        key = key[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :]
        same = word[: len(key)] == word[n - 1 :]
        mixed = (key[same] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
        buckets.append(mixed.astype(np.int64))
        owners.append(word[: len(key)][same])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.empty(0, np.int64),) * 2


def train(docs: DataFrame, smoothing: float = 0.5) -> Model:
    """From columns text and lang, all rows. A task counts HELD_LANGUAGES languages at once; the driver takes one language's
    counts after another. More than MOST_LANGUAGES are an error, as each needs a column of weights in every worker."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    index = {x: k for k, x in enumerate(languages)}
    size, scripts = 1 << BUCKET_BITS, len(SCRIPTS) + 2

    def rows_of(held):
        for k, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([np.full(len(at), k, np.int32), at.astype(np.int32), counts[at]], names=["lang", "bucket", "n"])

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                codes, offsets, distinct = split_words(texts_of(part.column(1)))
                which = np.array([index[x] for x in part.column(0).to_pylist()], dtype=np.int64)
                script, of_token = word_scripts(distinct.to_pylist()), np.repeat(which, np.diff(offsets))
                order = np.argsort(of_token, kind="stable")
                own, starts = np.unique(of_token[order], return_index=True)
                for first in range(0, len(own), HELD_LANGUAGES):
                    some = own[first : first + HELD_LANGUAGES].tolist()
                    if len({*held, *some}) > HELD_LANGUAGES:
                        yield from rows_of(held)
                        held = {}
                    times = {}
                    for k, tokens in zip(some, np.split(order, starts[1:])[first : first + HELD_LANGUAGES], strict=True):
                        counts = held.setdefault(k, np.zeros(size + scripts, np.int64))
                        times[k] = np.bincount(codes[tokens], minlength=len(distinct))
                        counts[size:] += np.bincount(script, weights=times[k], minlength=scripts).astype(np.int64)
                        times[k][script == NONE] = 0
                    for at in range(0, len(distinct), WORDS_AT_ONCE):
                        bucket, owner = word_buckets(distinct.slice(at, WORDS_AT_ONCE))
                        for k, t in times.items():
                            held[k][:size] += np.bincount(bucket, weights=t[at + owner], minlength=size).astype(np.int64)
        yield from rows_of(held)

    counts = known.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    each = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))  # as many as buckets, for each language
    logs, letters = np.zeros((size, len(languages)), dtype=np.float32), np.zeros((len(languages), scripts))
    for r in write_table(each, "language-counts").toLocalIterator():
        own = np.zeros(size + scripts)
        own[r["bucket"]] = r["n"]
        grams = own[:size] + smoothing
        logs[:, r["lang"]], letters[r["lang"]] = np.log(grams / grams.sum()), own[size:]
    silent = letters.sum(1) == 0  # texts without words
    logs[:, silent] = np.log(1 / size)
    allowed = (letters >= 0.001 * letters[:, :NONE].sum(1, keepdims=True)).T & (letters.T > 0)
    allowed[NONE] = True
    allowed[~allowed.any(1)] = True  # a script that no language uses narrows nothing
    return Model(languages, logs, allowed)


def viterbi(emissions: np.ndarray, codes: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on its text's best path; all texts advance by one word at a time."""
    n, langs = len(codes), emissions.shape[1]
    order = np.argsort(-np.diff(offsets), kind="stable")
    counts, starts = np.diff(offsets)[order], offsets[:-1][order]
    longest = int(counts[0]) if len(counts) else 0
    active = len(counts) - np.searchsorted(counts[::-1], np.arange(longest), "right")  # texts with more than t words
    stay, source = np.ones((n, langs), dtype=bool), np.zeros(n, dtype=np.int32)
    score = np.zeros((len(counts), langs), dtype=np.float32)
    for t in range(longest):
        at, s = starts[: active[t]] + t, score[: active[t]]
        if t:
            best = s.argmax(1)
            switched = np.take_along_axis(s, best[:, None], 1) - penalty
            stay[at], source[at] = s >= switched, best
            np.maximum(s, switched, out=s)
        s += emissions[codes[at]]
    path, now = np.zeros(n, dtype=np.int32), score.argmax(1)
    for t in range(longest - 1, -1, -1):
        at = starts[: active[t]] + t
        path[at] = now[: active[t]]
        held = stay[at, now[: active[t]]]
        now[: active[t]] = np.where(held, now[: active[t]], source[at])
    return path


def _emissions(model: Model, distinct: pa.Array, script: np.ndarray, weight: float) -> np.ndarray:
    """Scores of distinct words, relative to the best language."""
    out = np.empty((len(distinct), len(model.languages)), dtype=np.float32)
    words = max(32, WORDS_AT_ONCE * FEW_LANGUAGES // max(FEW_LANGUAGES, len(model.languages)))
    for at in range(0, len(distinct), words):
        part, own = distinct.slice(at, words), script[at : at + words]
        bucket, owner = word_buckets(part)
        bucket = bucket[np.argsort(owner, kind="stable")]
        counts = np.bincount(owner, minlength=len(part))
        sums = np.concatenate((np.zeros((1, len(model.languages))), np.cumsum(model.weights[bucket], axis=0, dtype=np.float64)))
        ends = np.cumsum(counts)
        scores = weight * (sums[ends] - sums[ends - counts]) / np.maximum(1, counts)[:, None]
        scores[own == NONE] = 0
        scores[~model.allowed[own]] = -1e4
        out[at : at + words] = scores - scores.max(1, keepdims=True)
    return out


def long_path(model: Model, codes: np.ndarray, distinct: pa.Array, script: np.ndarray, weight: float, penalty: float, block: int) -> np.ndarray:
    """``viterbi`` of one long text, in blocks of words. The first pass keeps the scores before each block; then from the last
    block on each is passed once more, with its choices, and traced back."""

    def passed(at: int, score: np.ndarray, choices: bool):
        own, place = np.unique(codes[at : at + block], return_inverse=True)
        each = _emissions(model, distinct.take(pa.array(own)), script[own], weight)
        stay, source = np.ones((len(place) if choices else 0, len(score)), dtype=bool), np.zeros(len(place), dtype=np.int32)
        for t, k in enumerate(place):
            if at + t:
                best = int(score.argmax())
                switched = score[best] - penalty
                if choices:
                    stay[t], source[t] = score >= switched, best
                score = np.maximum(score, switched)
            score = score + each[k]
            score -= score.max()
        return score, stay, source

    before, score = [], np.zeros(len(model.languages))
    for at in range(0, len(codes), block):
        before.append(score)
        score = passed(at, score, False)[0]
    path, now = np.zeros(len(codes), dtype=np.int32), int(score.argmax())
    for k in range(len(before) - 1, -1, -1):
        _, stay, source = passed(k * block, before[k], True)
        for t in range(len(source) - 1, -1, -1):
            path[k * block + t] = now
            now = now if stay[t, now] else int(source[t])
    return path


def identify(docs: DataFrame, model: Model, weight: float = 4.0, penalty: float = 6.0, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (that language's share of the letters), n_letters, and spans of (first_word, words, lang)."""
    path = f"{new_dir(docs.sparkSession, 'language-weights')}/weights"
    with AtomicFile(path) as f:  # workers map it: one copy a machine
        f.write(memoryview(model.weights).cast("B") if model.weights.size else b"\0" * 4)
    shared = share(docs.sparkSession, (model.languages, model.allowed))
    most = max(1 << 14, SLICE_BYTES * FEW_LANGUAGES // max(FEW_LANGUAGES, len(model.languages)))
    schema = "doc_id long, lang_pred string, score double, n_letters long" + ", spans array<struct<first_word: long, words: long, lang: string>>" * with_spans
    span_type = pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])

    def run(batches):
        languages, allowed = shared.value
        langs = len(languages)
        with open_mapped(path) as f:
            weights = np.frombuffer(f.read_buffer(4 * langs << BUCKET_BITS), dtype=np.float32).reshape(1 << BUCKET_BITS, langs)
        model = Model(languages, weights, allowed)
        for part in (p for b in batches for p in slices(b, most=most)):
            codes, offsets, distinct = split_words(texts_of(part.column(1)))
            text = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            words = distinct.to_pylist()
            script = word_scripts(words)
            letters = np.where(script == NONE, 0, np.fromiter(map(len, words), np.int64, len(words)))[codes]
            if langs:
                if part.num_rows == 1 and len(codes) * langs > LONG:
                    best_path = long_path(model, codes, distinct, script, weight, penalty, max(1, LONG // langs))
                else:
                    best_path = viterbi(_emissions(model, distinct, script, weight), codes, offsets, penalty)
                mass = np.bincount(text * langs + best_path, weights=letters, minlength=part.num_rows * langs).reshape(-1, langs)
            else:
                best_path, mass = np.zeros(len(codes), np.int32), np.zeros((part.num_rows, 1))
            total, best = mass.sum(1), mass.argmax(1)
            names = np.array([*model.languages, "und"], dtype=object)
            columns = [part.column(0), names[np.where(total > 0, best, langs)], mass.max(1) / np.maximum(1, total), total.astype(np.int64)]
            if with_spans:
                begin = np.flatnonzero(np.append(True, (best_path[1:] != best_path[:-1]) | (text[1:] != text[:-1]))) if len(best_path) else np.empty(0, np.int64)
                run_words = np.diff(np.append(begin, len(best_path)))
                spans = pa.StructArray.from_arrays([begin - offsets[text[begin]], run_words, pa.array(names[best_path[begin]], pa.string())], fields=list(span_type))
                ends = np.concatenate(([0], np.cumsum(np.bincount(text[begin], minlength=part.num_rows))))
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spans))
            yield pa.record_batch([columns[0], pa.array(columns[1], pa.string()), *columns[2:]], names=["doc_id", "lang_pred", "score", "n_letters", "spans"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def held_out(remainder: int = 1, of: int = 3):
    """True for rows that nothing is learned from; a row without id is one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == remainder, F.lit(True))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs.where(~held_out())), with_spans=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
