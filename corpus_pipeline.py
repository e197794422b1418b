"""Corpus cleaning: four filters over documents, then packed sequences.

Each stage takes the documents that its predecessor kept. Rejected: documents whose toxicity score is 0.5 or more; those
without a letter, or without a main language; all but the first of each group of near duplicates, by fingerprints that differ in
two bits at most and by a similarity of 0.8 or more; those that hold a passage of a benchmark item. What is left is cut and
packed into training sequences.

Verdicts go by doc_id and text together, so rows alike in both share them, and rows without doc_id, or with the same one, are
judged apart. In a group of near duplicates the row with the smallest doc_id stays, of different texts under it the one with the
smallest hash; rows without doc_id come after all others, by a hash of their text. Of rows with equal doc_id and text one stays,
which is that with the smallest JSON of its other columns. Columns besides doc_id and text are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radquery.llm import op2_decontaminate, op3_simhash, op4_packing, op8_toxicity, op10_language
from radquery.llm.shared import delete, new_dir, small, temporary, write_table

TOXIC_FROM, MAIN_LANGUAGE_FROM, CAPACITY = 0.5, 0.4, 4096
#: Stages beyond toxicity can't be stated in SQL: near duplicates, and language models of bytes.
ORACLE_SQL = None


def _key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key(docs).alias("doc_id"), "text")


def _without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of docs whose key isn't among the doc_id of ``keys``."""
    keys = small(write_table(keys.select(F.col("doc_id").alias("key")).distinct(), name))
    return docs.join(keys, _key(docs) == keys["key"], "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = op8_toxicity.learn(docs.where(~op8_toxicity.held_out()), labels.where(~op8_toxicity.held_out()))
    scored = op8_toxicity.score(_keyed(docs), model)
    return _without(docs, scored.where(F.col("score") >= TOXIC_FROM), "toxic")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = op10_language.identify(_keyed(docs), op10_language.train(docs), with_spans=False)
    return _without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < MAIN_LANGUAGE_FROM)), "no-language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    late = F.lit(1 << 62) + F.pmod(F.xxhash64(docs["text"]), F.lit(1 << 61))  # the place of a row without doc_id
    place = F.coalesce(docs["doc_id"].cast("long"), late)
    groups = op3_simhash.near_groups(docs.select(place.alias("doc_id"), "text"))
    later = groups.where("doc_id != component_id or text_hash != component_hash")
    copies = small(write_table(later.select(F.col("doc_id").alias("place"), "text_hash").distinct(), "copies"))
    kept = docs.join(copies, (place == copies["place"]) & (F.xxhash64(docs["text"]) == copies["text_hash"]), "left_anti")
    several = kept.groupBy(_key(kept).alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1")
    several = write_table(several.select(F.col("doc_id").alias("key")), "several")
    if several.isEmpty():
        return kept
    several = small(several)
    again = kept.join(several, _key(kept) == several["key"], "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in again.columns))  # by its JSON, as not all types have an order
    others = F.struct(F.lit(0).alias("0"), *(F.col(f"`{c}`") for c in again.columns if c not in ("doc_id", "text")))
    first = again.groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(others)).alias("row")).select("row.*")
    return kept.join(several, _key(kept) == several["key"], "left_anti").unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op4_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=CAPACITY)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage makes on its way, and the documents of the stage before it, go when its own rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_dir(spark, name)
        with temporary():
            docs = write_table(stage(spark, docs, sf_dir), name, path)
        if before:
            delete(before)
        before = path
    return docs
