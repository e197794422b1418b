"""Very long texts, many turns, and odd tables, through every operator and stage."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline
import public_tokenizers

from radquery.llm import op1_lm_score as lm
from radquery.llm import op2_decontaminate as leak
from radquery.llm import op3_simhash as sim
from radquery.llm import op4_packing as packing
from radquery.llm import op5_quality as quality
from radquery.llm import op6_chat as chat
from radquery.llm import op7_arrow_files as files
from radquery.llm import op8_toxicity as toxicity
from radquery.llm import op9_warc as warc
from radquery.llm import op10_language as language
from radquery.llm import op11_alignment as alignment
from radquery.llm import op13_sharding as sharding
from radquery.llm.shared import new_dir, write_table
from tests.conftest import DATA

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PASSAGE = "the quick benchmark passage that nobody should ever train on because it leaks the answers to everyone"


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of three million characters with and without much white space, one of them a near copy, and a short one."""
    rng = random.Random(1)
    many = " ".join(f"{rng.choice(['word', 'text', 'Some', 'other', 'thing'])}{rng.randrange(3000)}" for _ in range(340_000))
    whole = "".join(rng.choices("abcdefghij", k=200_000))
    rows = [(1, many), (2, f"{many} {PASSAGE}"), (3, whole), (4, "a short text of a few words"), (5, " " * 100_000)]
    assert len(many) > 3_000_000
    return write_table(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'aa' as lang", "'s' as source"), "long-docs")


def test_long_texts(spark, long_docs):
    words = {r["doc_id"]: r["n"] for r in long_docs.selectExpr("doc_id", "size(filter(split(text, ' '), x -> x != '')) as n").collect()}
    scored = {r["doc_id"]: r for r in lm.score(long_docs, lm.train(long_docs, 2)).collect()}
    assert {i: r["n_tokens"] for i, r in scored.items()} == {i: n + 1 for i, n in words.items()}
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    (found,) = leak.find_leaks(long_docs, bench).collect()
    assert (found["doc_id"], found["start_word"]) == (2, words[1])
    assert {r["doc_id"] for r in leak.decontaminate(long_docs, bench).collect()} == {1, 3, 4, 5}
    assert {r["doc_id"]: r["component_id"] for r in sim.near_duplicates(long_docs).collect()}[2] == 1
    assert {r["doc_id"]: r["component_id"] for r in sim.near_copies(long_docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    tokens = {r["doc_id"]: r["n_tokens"] for r in files.read_shards(write_table(files.write_shards(long_docs, new_dir(spark, "long"), TOKENIZER), "manifest")).collect()}
    packed = packing.pack_documents(long_docs, TOKENIZER, capacity=4096).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == tokens and max(r["most"] for r in packed) <= 4096
    assert {r["doc_id"]: r["n_words"] for r in quality.judge(long_docs).collect()} == words
    model = toxicity.learn(long_docs, spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(long_docs, model).collect())
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(long_docs, language.train(long_docs)).collect()} == {1: "aa", 2: "aa", 3: "aa", 4: "aa", 5: "und"}
    aligned = {r["doc_id"]: r for r in alignment.link_counts(long_docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and r["n_groups"] > 0 for r in aligned.values())
    placed = sharding.interleave(long_docs, long_docs["source"], sharding.seeded(long_docs), 2).collect()
    assert sorted(r["shard"] for r in placed) == [0, 0, 0, 1, 1]


def test_long_pages(spark, long_docs):
    pages = long_docs.selectExpr("doc_id as page_id", "'http://a.b/' as url", "text as html")
    chunks = write_table(warc.chunk_records(pages), "chunks")
    archives = write_table(warc.write_archives(chunks, warc.find_revisits(chunks), new_dir(spark, "archives")), "archives")
    got = {}
    for r in sorted(warc.read_archives(archives).collect(), key=lambda r: (r["page_id"], r["chunk"])):
        assert len(r["data"]) <= warc.CHUNK_BYTES
        got[r["page_id"]] = got.get(r["page_id"], b"") + r["data"]
    assert {k: v.decode() for k, v in got.items()} == {r["doc_id"]: r["text"] for r in long_docs.collect()}


def test_many_turns_and_long_turns(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(1000)] + [(2, t, "user", "same role ") for t in range(1000)] + [(3, 1, "user", "x" * 3_000_000), (3, 2, "assistant", "[INST] " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = {r["conv_id"]: r for r in chat.parse_conversations(chat.format_conversations(df)).collect()}
    assert len(made[1]["turns"]) == 1000 and made[1]["loss_text"] == "".join(f"turn {t}" for t in range(0, 1000, 2))
    want = hashlib.sha256(("[INST] " * 200_000).encode()).hexdigest()
    assert hashlib.sha256(made[3]["loss_text"].encode()).hexdigest() == want and made[3]["turns"][0]["text"] == "x" * 3_000_000


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 129, 20_000])
def test_blocks_of_turns(spark, n):
    """Conversations of more than a block of turns: runs of a role that cross blocks, empty texts, letters of several bytes."""
    rng = random.Random(n)
    roles = ["user"] * n
    for t in range(1, n):
        roles[t] = roles[t - 1] if rng.random() < 0.9 else rng.choice(["user", "assistant", "system"])
    texts = [rng.choice(["", "é", "日本 <|end|>", "[INST]", f"text {t}"]) for t in range(n)]
    rows = [(1, t, roles[t], texts[t]) for t in range(n)] + [(2, t, "assistant", texts[t]) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    made = {r["conv_id"]: r for r in chat.parse_conversations(chat.format_conversations(df)).collect()}
    assert [tuple(t) for t in made[1]["turns"]] == list(zip(roles, texts, strict=True))
    assert made[1]["loss_text"] == "".join(x for r, x in zip(roles, texts, strict=True) if r == "assistant") and made[2]["loss_text"] == "".join(texts)
    merged = 1 + sum(a != b for a, b in zip(roles, roles[1:], strict=False))
    assert made[1]["formatted"].count("<|turn|>") == merged == made[1]["formatted"].count("<|end|>") and made[1]["formatted"].count("<|part|>") == n - merged
    spans = [made[1]["formatted"][s["start"] : s["start"] + s["length"]].replace("[\\INST]", "[INST]").replace("<\\|end|>", "<|end|>") for s in made[1]["loss_spans"]]
    assert spans == [x for r, x in zip(roles, texts, strict=True) if r == "assistant"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, name, stage):
    """Without rows; with a column of maps, clashing names, nulls in all columns, repeated rows, and a long text."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert stage(spark, docs.where("false"), DATA).count() == 0
    clean = " ".join(f"sentence{i} about matter{i % 7} and thing{i % 11}" for i in range(60))
    rows = [(1, clean), (1, clean), (None, clean + " more"), (2, None), (3, ""), (None, None), (4, " ".join(f"w{i % 4999}" for i in range(200_000)))]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as long) as n_chars", "map('a', doc_id) as m",
        "1 as key", "2 as score", "3 as place", "4 as `copies.x`", "5 as words", "6 as row", "7 as text_hash", "8 as n", "9 as _key", "10 as toxic",
    )
    out = stage(spark, odd, DATA)
    if name != "packing":
        assert out.columns == odd.columns
    assert out.where("doc_id = 4").isEmpty() == (name == "language")  # without a row to learn from, no language is known
    if name == "near_duplicates":
        assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(1, clean), (2, None), rows[-1]} and out.count() == 3
