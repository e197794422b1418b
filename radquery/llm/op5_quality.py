"""Quality rules with verdicts on hosts.

Each text is measured, and rules on these measures fail or hold. Failures are summed by host (``source``). Small hosts say
little, so a host's failure rate is shrunk toward the rates of all hosts: a beta prior is fitted to them by moments, and the
rate is the posterior mean. A host above ``host_limit`` is rejected with all of its documents. A document that fails a
rule itself is rejected too.

Null texts have no words and fail; documents without source form one host; rows with equal ids are judged one by one. Of
further columns nothing is read. No document: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.llm.shared import write_table
from radquery.llm.words import mix, slices, split_words, texts_of

#: Words of the windows whose repetition within a text counts.
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: A rule's name and when it fails. The first two are the base.
RULES = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "4 * n_symbols > word_chars",
    "dup_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
}


def repeated_words(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, its words that lie in a window of WINDOW words which the text has twice or more."""
    counts, texts = np.diff(offsets), len(offsets) - 1
    if len(codes) < WINDOW:
        return np.zeros(texts, dtype=np.int64)
    text = np.repeat(np.arange(texts), counts)
    word, key = mix(codes.astype(np.uint64) + np.uint64(1)), np.zeros(len(codes) - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(key)]
    starts = np.flatnonzero(text[: len(key)] == text[WINDOW - 1 :])
    key = key[starts] ^ mix(text[starts].astype(np.uint64) + np.uint64(1 << 40))
    order = np.argsort(key)
    pair = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = starts[order[pair]], starts[order[pair + 1]]
    real = text[a] == text[b]
    for k in range(WINDOW):
        real &= codes[a + k] == codes[b + k]
    begins = np.zeros(len(codes) + WINDOW, dtype=np.int32)
    begins[a[real] + WINDOW] = begins[b[real] + WINDOW] = 1
    sums = np.cumsum(begins)
    covered = sums[WINDOW:] > sums[:-WINDOW]  # a window begins at most WINDOW - 1 words before
    return np.bincount(text[covered], minlength=texts)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of each text."""

    def dup_lines(text: str) -> tuple[int, int]:
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        return len(lines), len(lines) - len(set(lines))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part.column(2))
                codes, offsets, distinct = split_words(texts)
                total = lambda each: np.diff(np.concatenate(([0], np.cumsum(each.to_numpy(zero_copy_only=False).astype(np.int64)[codes])))[offsets])
                lines = np.array([dup_lines(x) for x in texts.to_pylist()], dtype=np.int64).reshape(-1, 2)
                yield pa.record_batch(
                    [part.column(0), part.column(1), np.diff(offsets), total(pc.utf8_length(distinct)), total(pc.count_substring_regex(distinct, "[#*$%&|<>]")), lines[:, 1], repeated_words(codes, offsets), lines[:, 0]],
                    names=["doc_id", "source", *MEASURES],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id long, source string, " + ", ".join(f"{m} long" for m in MEASURES))


def host_rates(judged: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """source, host_docs, host_failed, host_rate (shrunk) and host_rejected, from rows of source and ``failed``."""
    hosts = judged.groupBy("source").agg(F.count("*").alias("host_docs"), F.count_if("failed").alias("host_failed"), *(F.count_if(r).alias(f"host_{r}") for r in RULES))
    rate = F.col("host_failed") / F.col("host_docs")
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("host_docs")).alias("inverse")).first()
    mean, spread = m["mean"] or 0.0, m["mean"] and m["mean"] * (1 - m["mean"])
    between = (m["var"] or 0.0) - (spread or 0.0) * (m["inverse"] or 0.0)  # what sampling alone doesn't explain
    strength = min(1e6, max(1.0, spread / between - 1)) if spread and between > 0 else 1e6
    shrunk = (F.col("host_failed") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.withColumns({"host_rate": shrunk, "host_rejected": shrunk > host_limit})


def judge(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """doc_id, source, measures, a column for each rule (true: it fails), those of the host, base_failed and kept."""
    measured = measure(docs).withColumns({k: F.expr(v) for k, v in RULES.items()})
    failed = F.greatest(*(F.col(r) for r in RULES))
    judged = write_table(measured.withColumns({"base_failed": F.col("few_words") | F.col("repeats"), "failed": failed}), "measures")
    hosts = write_table(host_rates(judged, host_limit), "hosts").withColumnRenamed("source", "_host")
    joined = judged.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~(F.col("failed") | F.col("host_rejected")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 8) t(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM d JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 4 * n_symbols > word_chars OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) AS other FROM m),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed OR other) AS failed FROM b GROUP BY source),
s AS (SELECT avg(failed / docs) AS mean, var_pop(failed / docs) - avg(failed / docs) * (1 - avg(failed / docs)) * avg(1 / docs) AS between_hosts FROM h),
k AS (SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND between_hosts > 0 THEN least(1e6, greatest(1, mean * (1 - mean) / between_hosts - 1)) ELSE 1e6 END AS strength FROM s),
v AS (SELECT source, (failed + mean * strength) / (docs + strength) > 0.5 AS host_rejected FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR other OR host_rejected) AS kept, host_rejected
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
