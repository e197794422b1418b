import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
from radquery.llm import op3_simhash
from radquery.llm.shared import write_table
from tests.conftest import DATA

CLEAN = "words number {0} of a clean document that says {0} things about {0} matters and then goes on to {0} others which differ, " * 2


def test_stages_on_planted_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    rows = [(9001, CLEAN.format("one")), (9002, CLEAN.format("one")), (9003, f"{CLEAN.format('two')} {passage} {CLEAN.format('three')}"), (9004, CLEAN.format("four")), (9004, CLEAN.format("four")), (9004, CLEAN.format("five")), (None, CLEAN.format("six")), (None, CLEAN.format("six")), (9005, None), (9006, "12345")]
    planted = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = write_table(stage(spark, docs.unionByName(planted) if name == "language" else docs, DATA), name)
        assert docs.columns == before
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in docs.where("doc_id is null or doc_id > 9000").collect())
    assert kept == sorted([(9001, CLEAN.format("one")), (9004, CLEAN.format("four")), (9004, CLEAN.format("five")), (0, CLEAN.format("six"))])


def test_near_duplicates_under_one_id(spark):
    clean, base, other = (" ".join(f"{w}{i}" for i in range(100)) for w in ("clean", "base", "other"))
    rows = [(1, base), (7, f"{base} more"), (7, clean), (8, other), (8, f"{other} more"), (9, f"{clean} more")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 7, 8]
    assert {r["text"] for r in kept} - {other, f"{other} more"} == {base, clean}


def test_near_duplicates_by_fingerprints_and_by_similarity(spark):
    """1 and 2 have the same fingerprint, as a line that is repeated decides it, but differ in most of their five-word shingles; 0
    is similar to 2 alone."""
    line = " ".join(f"line{i}" for i in range(21)) + " "
    tail = [" ".join(f"tail{k}x{i}" for i in range(60)) for k in range(3)]
    more = " ".join(f"more{i}" for i in range(8))
    rows = [(1, line * 100 + tail[0]), (2, line * 100 + tail[1]), (0, f"{line * 2}{tail[1]} {more}"), (4, tail[2])]
    texts = {r[0]: r[1] for r in rows}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in texts.items()}
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert likeness(1, 2) < 0.8 and likeness(0, 1) < 0.8 and likeness(0, 2) >= 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: int(r["fp"]) for r in op3_simhash.fingerprints(df).collect()}
    assert bin((found[1] ^ found[2]) & (1 << 64) - 1).count("1") <= 2 < bin((found[0] ^ found[2]) & (1 << 64) - 1).count("1")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df.where("doc_id in (1, 2, 4)"), DATA).collect()) == [1, 4]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, DATA).collect()) == [0, 4]


def test_run(spark):
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.count() > 100 and {"doc_id", "sequence_id", "offset"} <= {*packed.columns}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
